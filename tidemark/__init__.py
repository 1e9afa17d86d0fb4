"""Tidemark: analytics over replicated file state, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so a session that was not
# submitted with --py-files can run them too.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

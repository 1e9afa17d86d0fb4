"""Operators of a training-data pipeline over `documents`, `pages` and `benchmark`.

Nothing else in the library imports this subpackage. `queries` registers one query per operator.
"""

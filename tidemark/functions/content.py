"""Content columns: hashes, text probes, canonical JSON, human sizes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBE_BYTES = 4096


def content_hash(content: str | Column) -> Column:
    """SHA-256 content address, lower-case hex."""
    col = F.col(content) if isinstance(content, str) else content
    return F.sha2(col, 256)


def looks_like_text(content: str | Column) -> Column:
    """No NUL among the first 4096 bytes."""
    col = F.col(content) if isinstance(content, str) else content
    probe = F.substring(col.cast("binary"), 1, PROBE_BYTES)
    return ~F.contains(probe, F.lit(bytearray(b"\x00")))


def human_size(size: Column) -> Column:
    kb, mb = F.lit(1024), F.lit(1024 * 1024)
    return (F.when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < mb, F.format_string("%.1f KB", size / kb))
            .otherwise(F.format_string("%.1f MB", size / mb)))


def canonical(text: str | None) -> str | None:
    """Key-sorted compact JSON of one document, list order kept; null when not JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"),
                          ensure_ascii=False)
    except ValueError:
        return None


def canonical_json(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """Add the canonical form of a JSON column, one Arrow batch at a time."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [canonical(v) for v in pdf[column]]})

    return df.mapInPandas(render, schema)

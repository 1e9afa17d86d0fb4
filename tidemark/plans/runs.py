"""Rows packed into blocks of columns before they are dealt out.

A row for one character of a text takes some fifty bytes and more in a shuffle. ``packed`` joins rows that stand next
to each other and have equal keys to one block: steps of whole numbers and codes of texts, each in as few bytes
as they need, compressed. Rows in any order are packed right; rows of a key that lie together are packed small. What reads
blocks works on whole columns (``decoded``, ``gathered``); ``unpacked`` makes rows of them again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType, StructField, StructType

#: Rows looked at together; a block has no more.
AT_ONCE = 1 << 16
#: Rows of blocks that a fold holds before it makes one block of them.
MOST_HELD = 1 << 20
#: Rows that leave a task in one batch.
OUT_ROWS = 1 << 14
#: Spark sums up the bytes of a batch after each row it sends to Python, unless this is the largest int.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_WHOLE = (ByteType, ShortType, IntegerType, LongType)


class Column(NamedTuple):
    """Whole numbers, or codes into ``words`` (-1 for null). ``valid`` marks whole numbers that are not null, if some are."""

    values: np.ndarray
    words: list[Any] | None = None
    valid: np.ndarray | None = None

    def take(self, at) -> Column:
        return Column(self.values[at], self.words, None if self.valid is None else self.valid[at])


@contextmanager
def small_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send batches to Python by their number of rows alone, as for rows of a few bytes the sum takes
    longer than the rows."""
    before = spark.conf.get(BATCH_BYTES, None)
    if before is None:  # a Spark without that sum
        yield
        return
    spark.conf.set(BATCH_BYTES, str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def leaves(column: SparkColumn, kind: DataType, out: str) -> list[SparkColumn]:
    """A column as columns without structs, equal where it is equal: of a struct whether it is there, and its fields."""
    if not isinstance(kind, StructType):
        return [column.alias(out)]
    there = [column.isNotNull().alias(f"{out}_")]
    return there + [x for i, f in enumerate(kind.fields) for x in leaves(column[f.name], f.dataType, f"{out}_{i}")]


def page(column: SparkColumn, kind: DataType) -> SparkColumn:
    """A number that parts the places of a long file, such as the dots of a text: near places have the same."""
    shifted = [F.shiftright(x, 16) if isinstance(k, _WHOLE) else x for x, k in _scalars(column, kind)]
    return F.xxhash64(*shifted)


def _scalars(column: SparkColumn, kind: DataType) -> list[tuple[SparkColumn, DataType]]:
    if not isinstance(kind, StructType):
        return [(column, kind)]
    return [x for f in kind.fields for x in _scalars(column[f.name], f.dataType)]


def _column(array: pa.Array) -> Column:
    t = array.type
    if pa.types.is_boolean(t):
        array = array.cast(pa.int8())
    elif pa.types.is_date32(t):
        array = array.cast(pa.int32())
    elif pa.types.is_timestamp(t):
        array = array.cast(pa.int64())
    if array.null_count == len(array):
        whole = pa.types.is_signed_integer(array.type)
        return Column(np.full(len(array), 0 if whole else -1), None if whole else [], np.zeros(len(array), bool) if whole else None)
    if not pa.types.is_signed_integer(array.type):
        coded = array.dictionary_encode()
        return Column(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist())
    valid = None
    if array.null_count:
        valid = array.is_valid().to_numpy(zero_copy_only=False)
        array = array.fill_null(0)
    return Column(array.to_numpy(zero_copy_only=False).astype(np.int64), None, valid)


def _array(column: Column, kind: pa.DataType) -> pa.Array:
    if column.words is not None:
        codes = pa.array(column.values.astype(np.int32), mask=column.values < 0)
        return pa.DictionaryArray.from_arrays(codes, pa.array(column.words, kind)).dictionary_decode()
    mask = None if column.valid is None else ~column.valid
    if pa.types.is_boolean(kind):
        return pa.array(column.values != 0, mask=mask)
    if pa.types.is_date32(kind):
        return pa.array(column.values.astype(np.int32), mask=mask).cast(kind)
    return pa.array(column.values, mask=mask).cast(kind)


def _narrow(x: np.ndarray, low: int, high: int) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        bounds = np.iinfo(kind)
        if bounds.min <= low and high <= bounds.max:
            return x.astype(kind)
    return x


def encoded(columns: Sequence[Column]) -> bytes:
    """Columns of the same length, at least one row, as bytes."""
    out = []
    for values, words, valid in columns:
        valid = None if valid is None or valid.all() else np.packbits(valid).tobytes()
        first, steps = int(values[0]), values if words is not None else np.diff(values)
        low, high = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
        if words is not None:
            if low == high:
                words, low = ([] if low < 0 else [words[low]]), min(low, 0)
                out.append((low, 0, None, words, valid))
                continue
            if len(words) > len(values):
                used, steps = np.unique(values, return_inverse=True)
                words = [words[i] for i in used.tolist() if i >= 0]
                steps, high = steps - int(used[0] < 0), len(words)
            words = "".join(words) if all(isinstance(w, str) and len(w) == 1 for w in words) else words
        if words is None and low == high:
            out.append((first, low, None, None, valid))
            continue
        small = _narrow(steps, low, high)
        out.append((first, small.dtype.str, small.tobytes(), words, valid))
    raw = pickle.dumps((len(columns[0].values), out), 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def decoded(block: bytes) -> list[Column]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    n, stored = pickle.loads(raw)
    out = []
    for first, step, data, words, valid in stored:
        if data is None:
            values = np.full(n, first, np.int64) if step == 0 else first + step * np.arange(n, dtype=np.int64)
        else:
            values = np.frombuffer(data, step).astype(np.int64)
            if words is None:
                values = first + np.concatenate(([0], np.cumsum(values)))
        out.append(Column(values, None if words is None else list(words),
                          None if valid is None else np.unpackbits(np.frombuffer(valid, np.uint8), count=n).astype(bool)))
    return out


def gathered(blocks: Sequence[Sequence[Column]]) -> list[Column]:
    """The rows of all blocks, one after the other. Codes of texts are in the order of the texts, nulls first."""
    out = []
    for parts in zip(*blocks):
        if parts[0].words is None:
            valid = None
            if any(p.valid is not None for p in parts):
                valid = np.concatenate([np.ones(len(p.values), bool) if p.valid is None else p.valid for p in parts])
            out.append(Column(np.concatenate([p.values for p in parts]), None, valid))
            continue
        words = sorted({w for p in parts for w in p.words})
        rank = {w: i for i, w in enumerate(words)}
        codes = [np.array([*(rank[w] for w in p.words), -1], np.int64)[p.values] for p in parts]
        out.append(Column(np.concatenate(codes), words))
    return out


def ranked(column: Column) -> np.ndarray:
    """Whole numbers in the order of the values: at least 0, and -1 for null."""
    if column.words is not None:
        return column.values
    if column.valid is None:
        low = int(column.values.min())
        return column.values if low >= 0 else np.unique(column.values, return_inverse=True)[1]
    out = np.unique(column.values, return_inverse=True)[1]
    return np.where(column.valid, out, -1)


def sorted_groups(keys: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by ``keys``, the first one first, and where in that order each different row begins."""
    differ = [k for k in keys if (k != k[0]).any()]
    n = len(keys[0])
    if not differ:
        return np.arange(n), np.zeros(1, np.int64)
    if len(differ) == 1 and (np.diff(differ[0]) > 0).all():
        return np.arange(n), np.arange(n)
    order = np.argsort(differ[0], kind="stable") if len(differ) == 1 else np.lexsort(differ[::-1])
    new = np.zeros(n, bool)
    new[0] = True
    for k in differ:
        new[1:] |= np.diff(k[order]) != 0
    return order, np.flatnonzero(new)


def _changes(array: pa.Array) -> np.ndarray:
    """For each row but the first, whether it differs from the one before."""
    if not pa.types.is_struct(array.type):
        c = _column(array)
        out = np.diff(c.values) != 0
        return out if c.valid is None else out | (np.diff(c.valid.astype(np.int8)) != 0)
    there = array.is_valid().to_numpy(zero_copy_only=False)
    out = np.diff(there.astype(np.int8)) != 0
    for field in array.flatten():
        out |= _changes(field)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(AT_ONCE)
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(AT_ONCE)


def packed(rows: DataFrame, keys: Sequence[str], marks: str | None = None) -> DataFrame:
    """``rows`` as ``(*keys, _n, _marked, _block)``: the other columns, none of them a struct, of ``_n`` rows in a block.

    ``marks`` names a column of true and false, of which ``_marked`` counts the true ones.
    """
    keys = list(keys)
    rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    marked = None if marks is None else rows.columns.index(marks) - len(keys)
    schema = block_schema([rows.schema[k] for k in keys])
    out_schema, k = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            n, new = batch.num_rows, np.zeros(batch.num_rows, bool)
            new[0] = True
            for i in range(k):
                new[1:] |= _changes(batch.column(i))
            columns = [_column(batch.column(i)) for i in range(k, batch.num_columns)]
            starts = np.flatnonzero(new)
            ends = [*starts[1:].tolist(), n]
            blocks = [encoded([c.take(slice(s, e)) for c in columns]) for s, e in zip(starts.tolist(), ends)]
            counts = (np.zeros(len(starts), np.int64) if marked is None
                      else np.add.reduceat(columns[marked].values, starts))
            heads = [batch.column(i).take(pa.array(starts)).cast(out_schema.field(i).type) for i in range(k)]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(np.array(ends) - starts), pa.array(counts),
                                              pa.array(blocks, pa.binary())], schema=out_schema)

    return rows.mapInArrow(run, schema)


def block_schema(keys: Sequence[StructField]) -> StructType:
    return StructType([*keys, *StructType.fromDDL("_n bigint, _marked bigint, _block binary").fields])


def unpacked(blocks: DataFrame, keys: Sequence[str], schema: StructType, read=decoded) -> DataFrame:
    """Rows of ``schema``: ``keys`` of the block, then the columns ``read`` makes of its bytes."""
    keys, out_schema = list(keys), to_arrow_schema(schema)
    kinds = [f.type for f in out_schema][len(keys):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, at, n = [], [], 0

            def flush() -> pa.RecordBatch:
                heads = [batch.column(i).take(pa.array(np.concatenate(at))).cast(out_schema.field(i).type)
                         for i in range(len(keys))]
                return pa.RecordBatch.from_arrays([*heads, *map(pa.concat_arrays, zip(*held))], schema=out_schema)

            for i, block in enumerate(batch.column(len(keys))):
                columns = read(block.as_py())
                held.append([_array(c, kind) for c, kind in zip(columns, kinds)])
                at.append(np.full(len(columns[0].values), i))
                n += len(at[-1])
                if n >= OUT_ROWS:
                    yield flush()
                    held, at, n = [], [], 0
            if held:
                yield flush()

    return blocks.select(*keys, "_block").mapInArrow(run, schema)

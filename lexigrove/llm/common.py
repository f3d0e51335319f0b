"""What the operators that run Python share: bounded Arrow batches in and out, and bounded caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are worked on at once. Texts differ widely in length, so a batch of Spark's (64 MB at most) is sliced.
BATCH_ROWS = 512
#: A batch of results is sent back once it holds so many rows, or about so many bytes.
OUT_ROWS, OUT_BYTES = 8192, 8_000_000


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], Iterable[tuple]], schema: pa.Schema, spark_schema: str | T.StructType) -> DataFrame:
    """``each`` turns an Arrow batch into result rows; they leave in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in sliced(batches):
            for row in each(batch):
                rows.append(row)
                held += 16 * len(row) + sum(len(x) for x in row if isinstance(x, (str, bytes)))
                if held >= OUT_BYTES or len(rows) >= OUT_ROWS:
                    yield packed(rows, schema)
                    rows, held = [], 0
        if rows:
            yield packed(rows, schema)

    return df.mapInArrow(run, spark_schema)


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], spark_schema: str | T.StructType) -> DataFrame:
    """``each`` turns an Arrow batch into another one, without a Python object for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield each(batch)

    return df.mapInArrow(run, spark_schema)


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of between one and BATCH_ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def bit_filter(positions: DataFrame, bits: int) -> Broadcast:
    """A broadcast filter of ``bits`` bits, set at ``positions`` (b, from 0 to bits - 1), for ``in_filter``.

    At most bits / 32 rows come to the driver, whatever the number of positions.
    """
    words = positions.groupBy(F.floor(F.col("b") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("bits"))
    filled = np.zeros(bits // 32, "<u4")
    for word, x in words.collect():
        filled[word] = x
    return positions.sparkSession.sparkContext.broadcast(filled.view(np.uint8))


def in_filter(filled: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (filled[positions >> 3] >> (positions & 7).astype(np.uint8) & 1).astype(bool)


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, type=field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Memo(dict):
    """Remembers ``f`` of short keys, in two generations of at most ``limit`` keys each.

    A full generation becomes the old one; what is asked for again moves on to the new one. So its size is bounded,
    and frequent keys stay.
    """

    def __init__(self, f: Callable, limit: int = 400_000, longest: int = 64) -> None:
        super().__init__()
        self.f, self.limit, self.longest, self.old = f, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

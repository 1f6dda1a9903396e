"""Helpers shared by the operators: tables, hold-out remainders, hashes, text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..storage import spooled, stored

__all__ = ["in_bytes", "lower_ascii", "map_arrow", "met_by_key", "remainder", "slices", "spooled", "stored", "table", "unit_hash", "utf8"]

#: Documents handled together inside a Python worker, whatever Arrow batch Spark sends.
ROWS_AT_ONCE = 256

#: A-Z to a-z on bytes; other letters keep their case.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``:``; nulls count as ''.

    52 bits of the digest, so the value is exact in a double and the same in any
    engine with MD5.
    """
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


#: Keys that hold one row in so many or more meet their rows by a broadcast.
HOT = 1000


def met_by_key(rows: DataFrame, known: DataFrame, key: str | list[str], count: str = "n") -> DataFrame:
    """``rows`` joined to ``known``, which has one row for each value of ``key`` (one column or
    several) and in ``count`` how many of ``rows`` have it.

    Values with one row in ``HOT`` or more, at most ``HOT`` of them, are broadcast, so that
    the rows of a hot one stay where they are; all others are shuffled, and none is hot.
    Both inputs are read twice.
    """
    total = known.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = F.col(count) * HOT >= max(total, HOT)
    keys = [key] if isinstance(key, str) else key
    columns = [c for c in known.columns if c not in (*keys, count)]
    few = known.filter(hot).select(*keys, *columns)
    near = rows.join(F.broadcast(few), keys)
    far = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(known.filter(~hot).select(*keys, *columns), keys)
    return near.unionByName(far)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: long documents never pile up in one worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_bytes(batches: Iterator[pa.RecordBatch], most: int, column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with ``most`` bytes in a column of texts, or with one row; small
    batches are put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, before + most - size, "right"))
            if upto == at and not held:
                upto = at + 1
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1]) - before
                at = upto
            if at < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""

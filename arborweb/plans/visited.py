"""The keys that a run has seen, kept so that a round reads what its own keys can hit.

Keys lie in segments, sorted by ranges of their hash. A Bloom
filter of fixed size, kept as a table of bitmaps, is asked first: keys it has never seen are
new for sure. Only for those that it lets through the ranges they fall in are read, and the
answer is exact. A set that outgrows its filter gives it up: all keys go to the exact test; no
answer changes. All bits of a key lie in one bitmap, so keys meet the filter by one
shuffled join, and nothing of it passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: Ranges of the keys' hashes.
BUCKETS = 32
#: Bits of the filter (8 MB as bitmaps), and how many a key sets; bits of one bitmap, as Spark makes them.
BITS, HASHES, BITMAP = 1 << 26, 4, 1 << 15
#: With a key for so many bits or fewer, the filter would let more than half of all new keys through.
LEAST = 2
FILTER = "word BIGINT, bits BINARY"
SEGMENT = "dedup_key STRING, bucket INT"


def bucket(key: Column) -> Column:
    """The range of hashes that a key lies in."""
    return _range(F.xxhash64(key))


def _range(hash: Column) -> Column:
    return F.shiftrightunsigned(hash, 64 - (BUCKETS - 1).bit_length()).cast("int")


def _word(key: Column, bits: int) -> Column:
    """The bitmap that a key's bits lie in: ranges of the same hash as ``bucket``, so that a segment's
    tasks meet few of them each."""
    return F.floor(F.shiftrightunsigned(F.xxhash64(key), 33) * max(1, bits // BITMAP) / (1 << 31)).cast("bigint")


def _places(key: Column, bits: int) -> list[Column]:
    """The bits that a key sets in its bitmap, from 0."""
    a, b = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    return [F.pmod(F.try_add(F.shiftright(a, 1), F.shiftright(b, 3) * k), F.lit(min(bits, BITMAP))).cast("int") for k in range(HASHES)]


def bitmaps(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """``word, bits``: the filter of the keys, at most ``bits`` whatever there are."""
    places = keys.select(_word(key, bits).alias("word"), F.explode(F.array(*_places(key, bits))).alias("p"))
    return places.groupBy("word").agg(F.bitmap_construct_agg("p").alias("bits"))


def let_through(rows: DataFrame, table: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """``rows`` with ``maybe``: False for keys that are not in the filter ``table`` for sure. The caller
    says by a hint how rows and bitmaps meet."""
    met = rows.withColumn("_word", _word(key, bits)).join(table.withColumnsRenamed({"word": "_word", "bits": "_bits"}), "_word", "left")

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))

    return met.withColumn("maybe", reduce(Column.__and__, [is_set(p) for p in _places(key, bits)])).select(*rows.columns, "maybe")


@dataclass(frozen=True)
class VisitedSet:
    """``segments`` are paths of tables, ``filter`` is the path of the filter's table, None while
    there is none, and once the keys are too many for it."""

    spark: SparkSession
    segments: tuple[str, ...] = ()
    filter: str | None = None
    bits: int = BITS

    def keys(self, buckets: list[int] | None = None) -> DataFrame:
        """``dedup_key, bucket`` of all keys, or of some buckets: segments are sorted by bucket, so
        row groups without these are not read."""
        if not self.segments:
            return self.spark.createDataFrame([], SEGMENT)
        rows = self.spark.read.schema(SEGMENT).parquet(*self.segments)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets) if buckets else F.lit(False))

    def add(self, keys: DataFrame, segment: str, filter: str) -> VisitedSet:
        """The set with ``keys`` (dedup_key; nulls name none) written to ``segment``, and a new
        filter to ``filter``, unless the keys are too many for it."""
        own = keys.filter("dedup_key is not null").select("dedup_key", bucket(F.col("dedup_key")).alias("bucket"))
        self.laid(own, segment)
        whole = VisitedSet(self.spark, (*self.segments, segment), None, self.bits)
        # from the files' footers
        if whole.keys().count() * LEAST > self.bits:
            return whole
        # a filter is missing where an earlier version of this package made the set
        added = self.spark.read.schema(SEGMENT).parquet(*([] if self.filter else self.segments), segment)
        made = bitmaps(added, F.col("dedup_key"), self.bits)
        if self.filter:
            before = self.spark.read.schema(FILTER).parquet(self.filter)
            made = before.unionByName(made).groupBy("word").agg(F.bitmap_or_agg("bits").alias("bits"))
        made.write.mode("overwrite").parquet(filter)
        return VisitedSet(self.spark, (*self.segments, segment), filter, self.bits)

    def laid(self, rows: DataFrame, segment: str) -> None:
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(segment)

    def merged(self, since: int, segment: str) -> VisitedSet:
        """The same set with the segments from ``since`` on written as one."""
        self.laid(VisitedSet(self.spark, self.segments[since:]).keys(), segment)
        return VisitedSet(self.spark, (*self.segments[:since], segment), self.filter, self.bits)

    def asked(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``maybe``: False for keys that are new for sure."""
        if self.filter is None:
            return rows.withColumn("maybe", F.lit(bool(self.segments)))
        # never broadcast: sparse bitmaps are small as files, and not in the driver
        return let_through(rows, self.spark.read.schema(FILTER).parquet(self.filter).hint("merge"), F.col("dedup_key"), self.bits)

    def flagged(self, rows: DataFrame, every: DataFrame | None = None) -> tuple[DataFrame, dict[str, int], list[int]]:
        """(``rows`` with ``maybe``, counts: how many keys were ``asked`` for, how many the
        filter let through as ``maybe``, and how many ``buckets`` are to be read for them, those
        buckets). What a filter said is stored. Without one all keys are to be tested: they are counted by
        their hash, in ``every`` (rows before duplicates went) if given, and ``rows`` are as they were."""
        if self.filter is None:
            rows = self.asked(rows)
            keys = (rows if every is None else every).select(F.xxhash64("dedup_key").alias("hash")).distinct()
            told = keys.select(_range(F.col("hash")).alias("bucket"), F.lit(bool(self.segments)).alias("maybe"))
        else:
            told = rows = stored(self.asked(rows.withColumn("bucket", bucket(F.col("dedup_key")))))
        # a row for each bucket
        found = {r["bucket"]: r for r in told.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("maybe").alias("maybe")).collect()}
        hit = [b for b, r in found.items() if b is not None and r["maybe"]]
        said = {"asked": sum(r["n"] for r in found.values()), "maybe": sum(r["maybe"] for r in found.values()), "buckets": len(hit)}
        return rows.drop("bucket"), said, hit

    def without(self, flagged: DataFrame, hit: list[int], besides: DataFrame | None = None) -> DataFrame:
        """The rows of ``flagged`` whose key is neither in the buckets ``hit`` nor among ``besides``
        (dedup_key). Rows without a key are new."""
        # joined by the key alone: a bucket before it would be all that the sort's prefixes hold
        taken = [] if besides is None else [besides.select("dedup_key")]
        if not hit:
            parts = [(flagged, taken)]
        elif self.filter is None:
            parts = [(flagged, [self.keys(hit).select("dedup_key"), *taken])]
        else:
            parts = [(flagged.filter("not coalesce(maybe, false)"), taken), (flagged.filter("maybe"), [self.keys(hit).select("dedup_key"), *taken])]
        # each part is shuffled once
        new = [rows.join(reduce(DataFrame.unionByName, known).hint("merge"), "dedup_key", "left_anti").select(*rows.columns) if known else rows for rows, known in parts]
        return reduce(DataFrame.unionByName, new).drop("maybe")

    def unseen(self, rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """(the ``rows`` whose key is new, the counts of ``flagged``)."""
        flagged, said, hit = self.flagged(stored(rows) if self.filter is None else rows)
        return self.without(flagged, hit).select(*rows.columns), said

"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n of N rows and target share w has the mean repetition rate
lambda = epochs * w * N / n. Each document draws its count from the Poisson
distribution of its source by inversion: the number of cumulative probabilities at or
below a number in [0, 1) that is a hash of seed and id. It is then exploded by that
count, and all copies are dealt and ordered by another hash.

Defined results: a null source is a source of its own. Rows with equal ids draw equal
counts; null ids share one draw. A source without a positive share yields nothing.
Columns of the input named like the ones added are replaced. An empty table gives an
empty result. Texts are carried whole and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spooled, unit_hash

#: Probabilities of all sources together that are broadcast (16 MB); with more, documents and
#: distributions meet by a salted join.
BROADCAST_NUMBERS = 2_000_000
SALT = 64

ADDED = ("copy", "shuffle_key")


def _label(source: Column) -> Column:
    """A join key that tells a null source from an empty one."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def rates(docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, source: str = "source") -> tuple[DataFrame, int]:
    """(``label, n, rate`` of each source, how many probabilities their distributions have).
    Shares follow ``weights``, or else the source's number of rows to the power ``alpha`` (1: as
    they are, 0: all alike). Only sums reach the driver."""
    counted = docs.groupBy(_label(F.col(source)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow("n", F.lit(alpha))
    elif weights:
        share = F.coalesce(F.create_map(*[F.lit(v) for k, w in weights.items() for v in (f"+{k}", float(w))])[F.col("label")], F.lit(0.0))
    else:
        share = F.lit(0.0)
    counted = spooled(counted.withColumn("share", share))
    sums = counted.agg(F.sum("n").alias("n"), F.sum("share").alias("share")).first()
    rate = F.col("share") / F.lit(sums["share"] or 1.0) * F.lit(sums["n"] or 0) * F.lit(float(epochs)) / F.col("n")
    found = counted.select("label", "n", rate.alias("rate")).filter("rate > 0")
    return found, found.agg(F.sum(_top(F.col("rate")) + 1)).first()[0] or 0


def _top(rate: Column) -> Column:
    """The largest count whose cumulative probability a double can tell from 1."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")


def distributions(rate: DataFrame) -> DataFrame:
    """``label, cdf``: the cumulative Poisson probabilities of 0, 1, 2, ... as far as
    a double can tell them from 1. Kept as logarithms until summed, so high rates do not
    vanish."""
    upto = Window.partitionBy("label").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = rate.select("label", "rate", F.explode(F.sequence(F.lit(0), _top(F.col("rate")))).alias("k"))
    steps = steps.withColumn("fact", F.sum(F.ln(F.greatest(F.col("k"), F.lit(1)))).over(upto))
    steps = steps.withColumn("p", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("fact")))
    steps = steps.withColumn("c", F.sum("p").over(upto))
    return steps.groupBy("label").agg(F.sort_array(F.collect_list("c")).alias("cdf"))


def _at_or_below(cdf: Column, u: Column) -> Column:
    """How many of the rising probabilities are ``u`` or less, by halving."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cdf) + 1)).cast("int"))

    def narrowed(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(cdf, middle) <= u
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high")))

    return F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size(cdf).alias("high")), narrowed, lambda s: s["low"])


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 42, key: str = "doc_id", source: str = "source") -> DataFrame:
    """All columns of ``docs``, with ``copy`` (from 1) and ``shuffle_key``, replicated and
    shuffled: rows are dealt by ``shuffle_key`` and ordered by it in each partition."""
    rate, numbers = rates(docs, weights=weights, alpha=alpha, epochs=epochs, source=source)
    drawn = distributions(rate)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("row"), _label(F.col(source)).alias("label"), F.col(key).alias("id"))
    if numbers <= BROADCAST_NUMBERS:
        met = rows.join(F.broadcast(drawn), "label")
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
        met = rows.withColumn("salt", salt).join(drawn.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["label", "salt"])
    # the number is drawn once a row, not once for each probability it is held against
    drawn_once = F.transform(F.array(unit_hash(F.lit(seed), F.col("id"))), lambda u: _at_or_below(F.col("cdf"), u))
    count = F.get(drawn_once, F.lit(0))
    copies = met.select("row", "id", F.posexplode(F.array_repeat(F.lit(True), count)).alias("place", "one"))
    copies = copies.select("row", "id", (F.col("place") + 1).alias("copy"))
    keyed = copies.select("row.*", "copy", unit_hash(F.lit(seed), F.lit("shuffle"), F.col("id"), F.col("copy")).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")

"""Probing of integer ranges that ends after a gap of failures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored


@dataclass(frozen=True)
class SpeculativeRange:
    """Numbers from ``min`` up to, not including, ``soft_max`` are probed first; with
    ``should_advance`` on beyond it, until ``gap`` failures stand after the last success.
    A gap of 0 probes the first range only."""

    min: int = 1
    soft_max: int = 2
    should_advance: bool = True
    gap: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.min <= self.soft_max or self.gap < 0:
            raise ValueError(f"no range to probe: {self}")


def seed_numbers(low: Column, soft_max: Column) -> Column:
    """``low`` to ``soft_max`` - 1; empty if there are none."""
    return F.when(soft_max > low, F.sequence(low, F.greatest(soft_max - 1, low))).otherwise(F.expr("cast(array() as array<bigint>)"))


def templates(spark: SparkSession, entries: list[tuple[str, int, SpeculativeRange]]) -> DataFrame:
    """``entry, param_index, min, soft_max, gap`` of each stored template."""
    rows = [(e, i, r.min, r.soft_max, r.gap * r.should_advance) for e, i, r in entries]
    return spark.createDataFrame(rows, "entry STRING, param_index INT, min BIGINT, soft_max BIGINT, gap INT")


def started_at(of: DataFrame, n: Column) -> DataFrame:
    """Templates that start at ``n`` instead, with one number to probe at least."""
    return of.withColumns({"min": n.cast("bigint"), "soft_max": F.greatest("soft_max", n.cast("bigint") + 1)})


def seeds(of: DataFrame) -> DataFrame:
    """The first probes of each template: ``entry, param_index, n``."""
    return of.select("entry", "param_index", F.explode(seed_numbers(F.col("min"), F.col("soft_max"))).alias("n"))


def failures_beyond(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """``outcomes`` (keys, n, ok) with ``beyond``: how many probes failed after the highest
    success up to each n. Before any success all failures count."""
    upto = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.count_if(~F.col("ok"))
    rows = outcomes.withColumn("_failed", failed.over(upto))
    at = F.max(F.when(F.col("ok"), F.col("_failed"))).over(upto)
    return rows.withColumn("beyond", F.col("_failed") - F.coalesce(at, F.lit(0))).drop("_failed")


def stops(outcomes: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """``keys, stop_n, highest_success``: where each probing ends, null while it goes on."""
    rows = failures_beyond(outcomes, keys)
    stop = rows.groupBy(*keys).agg(F.min(F.when(F.col("beyond") >= gap, F.col("n"))).alias("stop_n"))
    # successes after the stop are never probed
    kept = rows.join(stop.hint("merge"), keys).filter(F.col("stop_n").isNull() | (F.col("n") <= F.col("stop_n")))
    return kept.groupBy(*keys, "stop_n").agg(F.max(F.when(F.col("ok"), F.col("n"))).alias("highest_success"))


def state(outcomes: DataFrame, of: DataFrame) -> DataFrame:
    """The state of each template after ``outcomes`` (entry, param_index, n, ok):
    ``highest_success, consecutive_failures, next_n, done``."""
    keys = ["entry", "param_index"]
    high = outcomes.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.col("n"))).alias("highest_success"), F.max("n").alias("last"))
    after = outcomes.join(high.hint("merge"), keys).groupBy(*keys).agg(F.count_if(~F.col("ok") & (F.col("n") > F.coalesce("highest_success", F.lit(0)))).alias("consecutive_failures"))
    met = of.join(high.hint("merge"), keys, "left").join(after.hint("merge"), keys, "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
    nxt = F.greatest(F.coalesce(F.col("last") + 1, F.col("min")), F.when(F.col("last").isNull(), F.col("min")).otherwise(F.col("soft_max")))
    done = (F.col("consecutive_failures") >= F.col("gap")) & (nxt >= F.col("soft_max"))
    return met.select(*keys, "highest_success", "consecutive_failures", nxt.alias("next_n"), done.alias("done"), "gap")


def next_probes(now: DataFrame) -> DataFrame:
    """The next window of each template that goes on: as many numbers as failures are left."""
    left = F.col("gap") - F.col("consecutive_failures")
    return now.filter(~F.col("done") & (left > 0)).select("entry", "param_index", F.explode(F.sequence(F.col("next_n"), F.col("next_n") + F.greatest(left, F.lit(1)) - 1)).alias("n"))


def with_windows(now: DataFrame, outcomes: DataFrame, how: str = "inner") -> DataFrame:
    """Templates with what one more window of ``outcomes`` said: ``_n`` outcomes, the number ``_last`` and the
    highest success ``_high``. Joined by shuffles: the states of all templates, broadcast in each
    round, would pass through the driver."""
    keys = ["entry", "param_index"]
    window = outcomes.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.col("n"))).alias("_high"), F.max("n").alias("_last"), F.count(F.lit(1)).alias("_n"))
    return now.join(window.hint("merge"), keys, how)


def after_window() -> dict[str, Column]:
    """The states of ``with_windows`` after their window."""
    failed = F.when(F.col("_high").isNull(), F.col("consecutive_failures") + F.col("_n")).otherwise(F.col("_last") - F.col("_high"))
    return {"highest_success": F.coalesce("_high", "highest_success"), "consecutive_failures": failed, "next_n": F.col("_last") + 1}


def advanced(now: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Templates with their state (``highest_success, consecutive_failures, next_n``) after one
    more window of ``outcomes``, which has an outcome for each number from ``next_n`` on to
    its last. Only the window is looked at, however much was probed before."""
    return with_windows(now, outcomes).withColumns(after_window()).select(*now.columns)


def probe(of: DataFrame, outcomes_of: Callable[[DataFrame], DataFrame], *, rounds: int = 1000) -> DataFrame:
    """The state of all templates when none goes on: first probes, then window after window.

    ``outcomes_of`` turns probes (entry, param_index, n) into outcomes (with ``ok``). A round
    probes the windows of all templates that go on at once and writes their states; those
    that are done take no part in later ones.
    """
    start = of.select("entry", "param_index", "gap", "soft_max", F.lit(None).cast("bigint").alias("highest_success"), F.lit(0).cast("bigint").alias("consecutive_failures"), F.col("min").alias("next_n"))
    # a range without first probes goes straight to its windows
    now = start.filter("next_n >= soft_max").unionByName(advanced(start, outcomes_of(seeds(of))))
    over = F.col("consecutive_failures") >= F.col("gap")
    states = []
    for _ in range(rounds):
        now = stored(now)
        states.append(now.filter(over))
        now = now.filter(~over)
        if now.isEmpty():
            break
        now = advanced(now, outcomes_of(next_probes(now.withColumn("done", F.lit(False)))))
    else:
        states.append(stored(now))
    return reduce(DataFrame.unionByName, states).withColumn("done", over).drop("soft_max")

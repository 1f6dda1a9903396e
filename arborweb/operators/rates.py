"""Request rates: how many fell into a sliding window, and which a limit would let through."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship


def window_counts(requests: DataFrame, seconds: int, *, keys: list[str], at: str = "ts") -> DataFrame:
    """``requests`` with ``n_window``: requests of the same keys in the ``seconds`` up to each,
    itself and those at the same instant included.

    The requests of a key are dealt over blocks of the window's length, each with the block
    before it, which holds all else that its windows reach. So a key with any number of
    requests is spread over as many tasks as it has blocks. Requests without a time stand in
    no window: their ``n_window`` is null, and each is a block of its own.
    """
    width = seconds * 1_000_000
    time, block, shown = unused(requests.columns, "time", "block", "shown")
    rows = requests.withColumn(time, F.unix_micros(F.col(at).cast("timestamp")))
    rows = rows.withColumn(block, F.coalesce(F.floor(F.col(time) / width).cast("long"), -1 - F.monotonically_increasing_id()))
    both = rows.withColumn(shown, F.explode(F.when(F.col(time).isNull(), F.array(block)).otherwise(F.array(F.col(block), F.col(block) + 1))))
    own = Window.partitionBy(*keys, shown).orderBy(time).rangeBetween(-width, 0)
    counted = both.withColumn("n_window", F.when(F.col(time).isNotNull(), F.count(F.lit(1)).over(own))).filter(F.col(shown) == F.col(block))
    return counted.select(*requests.columns, "n_window")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores until none of ``columns`` is one of them in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def admit(requests: DataFrame, limit: int, seconds: float, *, keys: list[str], at: str = "ts", bypass: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """``admit_all`` with one rate."""
    return admit_all(requests, [(limit, seconds)], keys=keys, at=at, bypass=bypass, ties=ties)


def admit_all(requests: DataFrame, rates: list[tuple[int, float]], *, keys: list[str], at: str = "ts", bypass: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` with ``admitted``: for each (limit, seconds) of ``rates``, at most ``limit`` of
    the same keys in any ``seconds``; those refused do not count, those that ``bypass`` the
    rates always pass and count not. A request without a time is in no window, so no rate
    can tell: ``admitted`` is null, or true with ``bypass``. ``ties`` order requests of one instant.

    Admission depends on each earlier one, but only as far back as the longest window, and
    where no window held more requests than its limit, all of them passed. So the time of a
    key is cut into blocks of that length, and wherever every request of a block passes for
    sure, what follows it starts anew with that block as its history (``stretches``). Stretches
    are read each in order, as columns; of all that went before, only the last ``limit`` times
    are held, and what is refused between two admissions is passed over by a binary search. A key of any size is spread over as many tasks as it has stretches; one whose
    limits are exceeded in every block is one stretch, as all that it lets through hangs
    together. The requests are read twice: store them first if they are dear to make.
    """
    if not rates or any(n < 1 or s <= 0 for n, s in rates):
        raise ValueError("a rate is a positive number in a positive time")
    ship(requests.sparkSession)
    time, key, free = F.unix_micros(F.col(at).cast("timestamp")), F.to_json(F.struct(*keys)), F.coalesce(F.col(bypass), F.lit(False)) if bypass else F.lit(False)
    tied = [f"tie{k}" for k in range(len(ties))]
    marked = requests.select(F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("row"), key.alias("key"), time.alias("time"), free.alias("free"), *[F.col(t).alias(k) for k, t in zip(tied, ties, strict=True)])
    spans = [(n, math.ceil(s * 1_000_000)) for n, s in rates]
    width = max(s for _, s in spans)
    timed = marked.filter("time is not null").withColumn("block", F.floor(F.col("time") / width).cast("long"))
    goals = F.array(F.struct(F.col("stretch"), F.lit(False).alias("before")), F.when(F.col("serves").isNotNull() & ~F.col("free"), F.struct(F.col("serves").alias("stretch"), F.lit(True).alias("before"))))
    dealt = timed.join(stretches(timed.filter(~F.col("free")).select("key", "time"), spans, timed.select("key", "block").distinct()), ["key", "block"])
    each = dealt.withColumn("goal", F.explode(F.array_compact(goals))).select(F.when(~F.col("goal.before"), F.col("row")).alias("row"), "key", "time", "free", F.col("goal.stretch").alias("stretch"), *tied)
    ordered = each.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "time", *tied).select("row", "key", "time", "free", "stretch")
    longest = max(n for n, _ in rates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passed = None, deque(maxlen=longest)
        for batch in batches:
            shown = batch.column(0).is_valid()
            keys, stretch = batch.column(1).dictionary_encode().indices.to_numpy(), batch.column(4).to_numpy()
            times, free, asks = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), shown.to_numpy(zero_copy_only=False)
            said = free | ~asks
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (stretch[1:] != stretch[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(times)], strict=True):
                if lo == hi:
                    continue
                if (mine := (batch.column(1)[lo].as_py(), int(stretch[lo]))) != now:
                    now, passed = mine, deque(maxlen=longest)
                # what serves as history was let through; it comes before all that asks
                first = lo + int(np.searchsorted(asks[lo:hi], True))
                passed.extend(times[max(lo, first - longest) : first].tolist())
                waits = first + np.flatnonzero(~free[first:hi])
                due, at = times[waits], 0
                while True:
                    # of a rate's last admissions, the one ``limit`` back must lie a full window ago:
                    # all before that instant are refused at once
                    least = [passed[-n] + s for n, s in spans if len(passed) >= n]
                    if least:
                        at += int(np.searchsorted(due[at:], max(least)))
                    if at >= len(due):
                        break
                    said[waits[at]] = True
                    passed.append(int(due[at]))
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(shown), pa.array(said, pa.bool_()).filter(shown)], names=["row", "admitted"])

    schema = T.StructType([T.StructField("row", requests.schema), T.StructField("admitted", T.BooleanType())])
    never = marked.filter("time is null").select("row", F.when(F.col("free"), True).alias("admitted"))
    return ordered.mapInArrow(run, schema).unionByName(never).select("row.*", "admitted")


def stretches(requests: DataFrame, spans: list[tuple[int, int]], blocks: DataFrame) -> DataFrame:
    """For each ``key, block`` of ``blocks``: ``stretch``, the block that its stretch starts with,
    and ``serves``, the stretch that it is the history of, if it is one's. Blocks are as long
    as the longest of ``spans`` (limit, microseconds); ``requests`` (key, time) are those that count.

    A block passes for sure if none of its requests has more than ``limit`` in the window that
    ends with it, those at its own instant included: if the request ``limit`` before it, of its
    block or the one before, lies a full window ago. That is one row looked up, however many
    the window holds. Requests are counted by instant before they are shuffled, and of an
    instant one more than the largest limit tells all; the order of a key's blocks takes one
    row for each block, however many requests it has.
    """
    width = max(s for _, s in spans)
    block = F.floor(F.col("time") / width).cast("long")
    instants = requests.groupBy("key", "time").agg(F.count(F.lit(1)).alias("n")).withColumn("block", block)
    each = instants.withColumn("n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(max(n for n, _ in spans) + 1)))))
    both = each.withColumn("shown", F.explode(F.array(F.col("block"), F.col("block") + 1)))
    over, line = F.lit(False), Window.partitionBy("key", "shown").orderBy("time")
    for limit, span in spans:
        # no block has as many requests as Spark looks back at most
        over |= F.coalesce(F.col("time") - F.lag("time", min(limit, 2**31 - 1)).over(line) < span, F.lit(False))
    full = both.withColumn("over", over).filter("shown = block").groupBy("key", "block").agg(F.bool_or("over").alias("over"))
    # a block of requests that do not count passes for sure
    known = blocks.join(full, ["key", "block"], "left").withColumn("over", F.coalesce("over", F.lit(False)))
    order = Window.partitionBy("key").orderBy("block")
    begins = F.coalesce((F.lag("block").over(order) < F.col("block") - 1) | ~F.lag("over").over(order), F.lit(True))
    serves = F.when(~F.col("over") & (F.lead("block").over(order) == F.col("block") + 1), F.col("block") + 1)
    return known.withColumns({"begins": begins, "serves": serves}).withColumn("stretch", F.last(F.when(F.col("begins"), F.col("block")), ignorenulls=True).over(order)).select("key", "block", "stretch", "serves")

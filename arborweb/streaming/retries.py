"""Requests and their outcomes as one stream: each key is sent once, again after transient
failures, and forgotten in time.

State is kept for each key (``transformWithState``): how often it was sent, when it is due again,
when something was last heard of it. Event-time timers send what is due and forget what is old,
so the state is bounded by the keys of the last ``keep``, whether or not they are seen again. What
is said does not hang on when a batch ends: a row that comes after a due time, or after a key
is to be forgotten, finds that done as of its time, timer or not.

Spark asks for the RocksDB state store here; ``rocksdb`` names it while a stream is started.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..shipping import ship

#: What a stream is told of a key, in the order in which rows of one millisecond are taken.
KINDS = ("request", "ok", "failed")
SENDS = "dedup_key STRING, decision STRING, attempt INT, at TIMESTAMP"
STATE = "attempts INT, due BIGINT, last BIGINT, done BOOLEAN, timer BIGINT"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Rules:
    """At most ``retries`` after the first attempt, the k-th ``delay`` * 2^(k-1) after the failure before
    it; a key is forgotten when nothing was heard of it for more than ``keep``. Milliseconds."""

    retries: int
    delay: int
    keep: int

    def __post_init__(self) -> None:
        if self.retries < 0 or self.delay <= 0 or self.keep <= 0:
            raise ValueError("retries are not negative, times are positive")


@dataclass(frozen=True)
class Sent:
    """A key's state: attempts so far, when the next is due, the last time that something was
    sent or answered, and whether it is done with."""

    attempts: int
    last: int
    due: int | None = None
    done: bool = False


Said = tuple[str, int, int]


def settled(state: Sent | None, now: int, rules: Rules) -> tuple[Sent | None, list[Said]]:
    """The state as of ``now``, with the attempt that fell due, or forgotten."""
    said: list[Said] = []
    if state and state.due is not None and state.due <= now:
        state = Sent(state.attempts + 1, state.due)
        said.append(("send", state.attempts, state.last))
    if state and state.due is None and now - state.last > rules.keep:
        state = None
    return state, said


def told(state: Sent | None, kind: str, now: int, rules: Rules) -> tuple[Sent | None, list[Said]]:
    """The state after a row, and what is done about it (decision, attempt, time). Outcomes of keys that are
    unknown, done with or waiting say nothing new."""
    state, said = settled(state, now, rules)
    if kind == "request" and state is None:
        return Sent(1, now), [*said, ("send", 1, now)]
    if kind == "request" or state is None or state.done or state.due is not None:
        return state, said
    if kind == "ok":
        return replace(state, last=now, done=True), said
    if state.attempts <= rules.retries:
        return replace(state, last=now, due=now + rules.delay * 2 ** (state.attempts - 1)), said
    return replace(state, last=now, done=True), [*said, ("give up", state.attempts, now)]


class Sender(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("sent", STATE)

    def read(self) -> tuple[Sent | None, int | None]:
        if not self.kept.exists():
            return None, None
        attempts, due, last, done, timer = self.kept.get()
        return Sent(attempts, last, None if due < 0 else due, done), timer

    def write(self, state: Sent | None, timer: int | None) -> None:
        """The state, with one timer for what comes next."""
        wanted = None if state is None else state.due if state.due is not None else state.last + self.rules.keep + 1
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if state is None:
            self.kept.clear()
            return
        if timer != wanted:
            self.handle.registerTimer(wanted)
        self.kept.update((state.attempts, -1 if state.due is None else state.due, state.last, state.done, wanted))

    @staticmethod
    def rows(key: str, said: list[Said]) -> pd.DataFrame:
        at = pd.to_datetime([t for _, _, t in said], unit="ms")
        return pd.DataFrame({"dedup_key": [key] * len(said), "decision": [d for d, _, _ in said], "attempt": pd.array([n for _, n, _ in said], dtype="int32"), "at": at})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # of a key's rows in a batch, two numbers are held for each
        batch = pd.concat([pd.DataFrame({"ms": f["ms"], "kind": f["kind"].astype("int8")}) for f in rows]).sort_values(["ms", "kind"], kind="stable")
        state, timer = self.read()
        out: list[Said] = []
        for ms, kind in zip(batch["ms"].tolist(), batch["kind"].tolist(), strict=True):
            state, said = told(state, KINDS[kind], ms, self.rules)
            out += said
        self.write(state, timer)
        if out:
            yield self.rows(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, timer = self.read()
        now = expiredTimerInfo.getExpiryTimeInMs()
        state, said = settled(state, now, self.rules)
        # this timer is gone already
        self.write(state, None if timer == now else timer)
        if said:
            yield self.rows(key[0], said)

    def close(self) -> None:
        pass


def stream_sends(rows: DataFrame, *, retries: int, delay: float, keep: float, late: str, at: str = "at") -> DataFrame:
    """What to do about the keys of a stream of ``dedup_key``, ``kind`` (``KINDS``) and a time: rows of ``SENDS``,
    sent or given up. ``delay`` and ``keep`` are seconds, as in ``Rules``; ``late`` is the watermark's. Rows
    without a key, a time or a known kind say nothing. Requests that skip deduplication
    have no place here."""
    ship(rows.sparkSession)
    rules = Rules(retries, round(delay * 1000), round(keep * 1000))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    told = rows.select("dedup_key", F.col(at).cast("timestamp").alias("at"), kind.alias("kind")).filter("dedup_key is not null and at is not null and kind >= 0")
    marked = told.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return marked.groupBy("dedup_key").transformWithStateInPandas(Sender(rules), SENDS, "append", "eventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)

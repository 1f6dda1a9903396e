"""The traversal of a site in rounds: deduplicate, order, fetch, run steps, go on.

A round takes what is due: the frontier, the retries and waits whose time has come, the windows
of templates that are probed. It sends them, runs their steps, acts on what those say (retry,
await, skip, halt, a probe's success or failure) and makes the next frontier: new requests
whose key was never sent, and the next windows.

Each round writes its tables into a folder of its own attempt, and counts once its manifest
appears in the run's folder. That happens as a whole or not at all, and only once for each
number: a run that was killed anywhere is taken up from its last manifest by the same call,
and of two drivers on one folder one goes on, the other gets ``RunConflict``.

What grows with a run is joined by shuffles (``merge``): by their size as compressed files, tables
of millions of keys would be broadcast, once or more a round, through the driver.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators import speculate
from ..operators.requests import effective_priority, first_of_key, met_above, next_batch, reseed_points
from ..storage import commit_text, read_text, run_dir, stored, written
from .visited import BITS, VisitedSet

#: What the crawl adds to each request: a name of its own, that of the request which led to it (null
#: if no round said so), which attempt this is, the seconds it has waited for its page so far,
#: and the probe that it is, if it is one.
OWN = "crawl_id STRING, led_by STRING, attempt INT, waited DOUBLE, probe STRUCT<entry: STRING, param_index: INT, n: BIGINT>"
OWN_COLUMNS = ("crawl_id", "led_by", "attempt", "waited", "probe")
#: What a round says about a request that it sent.
ACTIONS = ("step", "retry", "await", "skip", "halt", "error", "failed_probe")
OUTCOMES = "crawl_id STRING, dedup_key STRING, attempt INT, action STRING, decision STRING, reason STRING"
#: Those columns of outcomes that stand in the requests.
STEPPED = "crawl_id STRING, dedup_key STRING, attempt INT"
TEMPLATES = "entry STRING, param_index INT, gap INT, highest_success BIGINT, consecutive_failures BIGINT, next_n BIGINT, asked BIGINT"
ANSWERS = "entry STRING, param_index INT, n BIGINT, ok BOOLEAN"
#: Rounds whose small tables are written as one.
MERGED = 16


class RunConflict(RuntimeError):
    """Another driver has advanced the run in this folder."""


@dataclass(frozen=True)
class Retry:
    """How often and when a request is sent again. The wait before attempt n + 1 is ``base`` times
    ``factor`` to the power n - 1, at most ``longest`` seconds, unless the outcome names one.
    A step that awaits its page is tried again every ``interval`` seconds, until ``patience``
    seconds have gone. What waits lies in buckets of ``width`` seconds; later ones are not read."""

    attempts: int = 3
    base: float = 1.0
    factor: float = 2.0
    longest: float = 3600.0
    interval: float = 1.0
    patience: float = 0.0
    width: float = 1.0


@dataclass(frozen=True)
class Probing:
    """Templates (entry, param_index, min, soft_max, gap) to be probed beside what is followed.
    ``requests`` turns probes (entry, param_index, n) into requests with the columns of the
    seeds and those three. A probe is sent whether or not its key was, and counts as a success
    if its outcome is ``step``, as a failure once it is given up."""

    templates: DataFrame
    requests: Callable[[DataFrame], DataFrame]


@dataclass
class Crawl:
    """``results`` and ``errors`` are None if there was no round. ``outcomes`` has a row for each
    time a request was sent, with what was decided; ``templates`` the last states of those probed,
    ``waiting`` the requests that are still to be sent again; ``halted`` what stopped the run."""

    visited: DataFrame
    results: DataFrame | None
    errors: DataFrame | None
    left: DataFrame
    rounds: int
    outcomes: DataFrame
    templates: DataFrame
    waiting: DataFrame
    halted: str | None
    #: A row of counts for each round: sent, keys asked for, let through by the filter, buckets read.
    told: list[dict] = field(default_factory=list)


@dataclass
class _State:
    """What a manifest says: paths of tables, and counts."""

    round: int
    frontier: str
    left: int
    tables: dict[str, list[str]]
    #: How many paths of each table are merged ones.
    merged: dict[str, int]
    filter: str | None
    #: Due bucket -> paths of what waits for it.
    waiting: dict[str, list[str]]
    templates: str | None
    answers: str | None
    halted: str | None
    told: list[dict]


def crawl(
    seeds: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    run: Callable[[DataFrame], tuple],
    *,
    rounds: int = 100,
    batch: int | None = None,
    visited: DataFrame | None = None,
    folder: str | None = None,
    retry: Retry | None = None,
    probing: Probing | None = None,
    clock: Callable[[], float] = time.time,
    sleep: Callable[[float], None] = time.sleep,
    filter_bits: int = BITS,
) -> Crawl:
    """Rounds from ``seeds`` until nothing is left, nothing waits and no template goes on, or
    ``rounds`` are over, or a step halts the run.

    ``fetch`` turns requests into responses; ``run`` turns those into (results, requests, errors)
    or, to be acted on, (results, requests, errors, outcomes): ``crawl_id``, ``action`` (of
    ``ACTIONS``), and if there are any ``wait`` (seconds) and ``reason``. Requests have at least
    ``dedup_key, skip_dedup, priority, seq``; those sent have ``OWN`` as well, and those that ``run``
    gives may say in ``led_by`` which of them they come from (for ``reseed``). ``batch`` requests are
    sent in a round, the best by priority first; by default all. ``visited`` (dedup_key) are keys of
    another run. ``folder`` holds the run's tables, in a store that all executors share: a run
    that is there already goes on where it was. By default a folder of the application, gone
    with it. ``clock`` and ``sleep`` tell the time and pass it, while all that is left waits.
    """
    clash = [c for c in seeds.columns if c in OWN_COLUMNS]
    if clash:
        raise ConfigError(f"requests have columns {clash}, which the crawl adds")
    it = _Run(seeds, fetch, run, batch, folder or run_dir(seeds.sparkSession), retry or Retry(), probing, clock, sleep, filter_bits)
    state = it.last() or it.begin(visited)
    while state.round < rounds and state.halted is None:
        following = it.round(state)
        if following is None:
            break
        state = following
    return it.told(state)


def below(tree: DataFrame, points: DataFrame) -> DataFrame:
    """``crawl_id`` of the ``points`` and of all below them in a tree (request_id, parent_id). Each round
    doubles the reach of every request, so a chain of n takes log n joins; a circle ends with them."""
    marked = points.select(F.col("crawl_id").alias("request_id"), F.lit(True).alias("hit"))
    up = tree.select("request_id", F.col("parent_id").alias("above")).join(marked, "request_id", "left").select("request_id", "above", F.coalesce("hit", F.lit(False)).alias("hit"))
    most, reach = tree.count(), 1
    while True:
        up = stored(up.withColumn("above", F.when(~F.col("hit"), F.col("above"))))
        if reach > most or up.filter("above is not null").isEmpty():
            return up.filter("hit").select(F.col("request_id").alias("crawl_id"))
        other = up.select(F.col("request_id").alias("above"), F.col("above").alias("next"), F.col("hit").alias("found"))
        up = met_above(up, other).select("request_id", F.col("next").alias("above"), (F.col("hit") | F.coalesce("found", F.lit(False))).alias("hit"))
        reach *= 2


def reseed(seeds: DataFrame, folder: str, *, failed: DataFrame | None = None, filter_bits: int = BITS) -> int:
    """Takes back what failed in the run in ``folder``, so that ``crawl`` with that folder does it
    again: for each of ``failed`` (crawl_id; by default those decided ``error``) the nearest request
    above it, itself included, that may be sent again (``reseedable`` of the requests: true
    yes, false never, null asks the one above; without the column all may); everything below
    those is withdrawn, its results, errors, outcomes and what waits, and the keys that no other
    request has are visited no more. How many are sent again. ``seeds`` are those of the run, of
    which only the columns count."""
    it = _Run(seeds, lambda r: r, lambda r: (), None, folder, Retry(), None, time.time, time.sleep, filter_bits)
    state = it.last()
    if state is None:
        raise ConfigError(f"there is no run in {folder}")
    return it.reseeded(state, failed)[1].count()


class _Run:
    def __init__(self, seeds: DataFrame, fetch: Callable, run: Callable, batch: int | None, folder: str, retry: Retry, probing: Probing | None, clock: Callable[[], float], sleep: Callable[[float], None], bits: int):
        self.spark: SparkSession = seeds.sparkSession
        self.seeds, self.fetch, self.run, self.batch, self.folder = seeds, fetch, run, batch, folder
        self.retry, self.probing, self.clock, self.sleep, self.bits = retry, probing, clock, sleep, bits
        self.columns = [F.col(f"`{c}`") for c in seeds.columns]
        self.schema = seeds.limit(0).selectExpr("*", *[f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.split(" ", 1) for x in _parts(OWN))]).schema

    # manifests

    def manifest(self, k: int) -> str:
        return f"{self.folder}/manifest/{k:06d}.json"

    def last(self) -> _State | None:
        k, found = 0, None
        while (text := read_text(self.spark, self.manifest(k))) is not None:
            k, found = k + 1, text
        if found is None:
            return None
        state = _State(**json.loads(found))
        # a run of an earlier version wrote the outcomes of all rounds
        state.tables.setdefault("stepped", [])
        # a filter of an earlier version has its bits elsewhere: it is made anew from the keys
        return state if state.filter is None or state.filter.endswith("/bitmaps") else replace(state, filter=None)

    def commit(self, state: _State) -> _State:
        if not commit_text(self.spark, self.manifest(state.round), json.dumps(vars(state))):
            raise RunConflict(f"round {state.round} of {self.folder} was made by another driver")
        return state

    def attempt(self, k: int) -> str:
        return f"{self.folder}/round={k}/{uuid.uuid4().hex}"

    def read(self, path: str | None, schema: object) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    # the start

    def begin(self, visited: DataFrame | None) -> _State:
        at = self.attempt(0)
        seen = VisitedSet(self.spark, bits=self.bits)
        tables: dict[str, list[str]] = {"visited": [], "sent": [], "results": [], "errors": [], "outcomes": [], "stepped": [], "finished": [], "withdrawn": []}
        if visited is not None:
            seen = seen.add(visited, f"{at}/visited", f"{at}/bitmaps")
        templates = None
        seeds = stored(self.led(self.seeds))
        flagged, _, hit = seen.flagged(self.keyed(seeds))
        first = self.fresh(seeds, seen.without(flagged, hit), 0)
        if self.probing is not None:
            of = self.probing.templates
            asked = F.greatest(F.col("soft_max") - F.col("min"), F.lit(0))
            start = of.select("entry", "param_index", "gap", F.lit(None).cast("bigint").alias("highest_success"), F.lit(0).cast("bigint").alias("consecutive_failures"), F.col("min").alias("next_n"), asked.cast("bigint").alias("asked"))
            first, templates = self.next_windows(first, start, at, 0)
        frontier = written(first, f"{at}/frontier")
        return self.commit(_State(0, f"{at}/frontier", frontier.count(), tables | {"visited": list(seen.segments)}, {}, seen.filter, {}, templates, None, None, []))

    def led(self, requests: DataFrame) -> DataFrame:
        return requests.select(*self.columns, (F.col("led_by") if "led_by" in requests.columns else F.lit(None)).cast("string").alias("led_by"))

    def keyed(self, more: DataFrame) -> DataFrame:
        """The first request of each key, of those that have one and do not skip deduplication."""
        return first_of_key(more.filter(~_free()))

    def fresh(self, more: DataFrame, new: DataFrame, k: int) -> DataFrame:
        """New requests with their names: those of ``new`` keys, and all that have none or skip
        deduplication."""
        rows = new.select(*more.columns).unionByName(more.filter(_free()))
        return rows.select("*", *self.named(k, "n"), F.expr("CAST(NULL AS STRUCT<entry: STRING, param_index: INT, n: BIGINT>)").alias("probe"))

    def named(self, k: int, kind: str) -> list[Column]:
        return [F.concat(F.lit(f"{k}{kind}"), F.monotonically_increasing_id().cast("string")).alias("crawl_id"), F.lit(1).alias("attempt"), F.lit(0.0).alias("waited")]

    # a round

    def round(self, state: _State) -> _State | None:
        """The state after one more round; None if there is nothing to do."""
        now, due = self.clock(), []
        if not state.left and state.waiting:
            first = min(map(int, state.waiting)) * self.retry.width
            while (now := self.clock()) < first:
                self.sleep(first - now)
        due = [b for b in state.waiting if int(b) * self.retry.width <= now]
        if not state.left and not due:
            return None
        k, at = state.round, self.attempt(state.round + 1)
        queue = self.read(state.frontier, self.schema)
        for path in [p for b in due for p in state.waiting[b]]:
            queue = queue.unionByName(self.read(path, self.schema))
        sent, rest = queue, None
        if self.batch is not None or due:
            sent = written(queue if self.batch is None else next_batch(queue, self.batch), f"{at}/sent")
        if self.batch is not None:
            rest = queue.join(sent.select("crawl_id").hint("merge"), "crawl_id", "left_anti").select(*queue.columns)

        seen = VisitedSet(self.spark, tuple(state.tables["visited"]), state.filter, self.bits)
        found, more, bad, *said = self.run(self.fetch(sent))
        # none of these needs another
        seen, outcomes, more, _, _ = together(
            self.spark,
            lambda: seen.add(sent.filter((F.col("attempt") == 1) & ~F.coalesce("skip_dedup", F.lit(False))), f"{at}/visited", f"{at}/bitmaps"),
            lambda: written(self.decided(said[0], sent), f"{at}/outcomes") if said else self.decided(None, sent),
            lambda: stored(self.led(more)),
            lambda: written(found, f"{at}/results"),
            lambda: written(bad, f"{at}/errors"),
        )
        kept = {b: p for b, p in state.waiting.items() if b not in due}
        probing = self.probing is not None and state.templates
        # nor of these
        (halted, waiting), (flagged, counts, hit), probed = together(
            self.spark,
            lambda: self.settled(outcomes, sent, kept, now, at) if said else (None, kept),
            lambda: seen.flagged(self.keyed(more), more.filter(~_free())),
            lambda: self.probed(state, outcomes, at, k + 1) if probing else (None, state.templates, state.answers, None),
        )
        probes, templates, answers, finished = probed
        # keys that the next frontier has already
        taken = [x.select("dedup_key") for x in (probes, None if rest is None else rest.filter("not coalesce(skip_dedup, false)")) if x is not None]
        following = self.fresh(more, seen.without(flagged, hit, reduce(DataFrame.unionByName, taken) if taken else None), k + 1)
        for other in (probes, rest):
            following = following if other is None else following.unionByName(other)
        frontier = written(following, f"{at}/frontier")
        log = state.frontier if sent is queue else f"{at}/sent"
        # a round that says nothing has no outcomes but what it sent
        added = {n: f"{at}/{n}" for n in ("visited", "results", "errors")} | {"sent": log} | ({"outcomes": f"{at}/outcomes"} if said else {"stepped": log}) | ({"finished": finished} if finished else {})
        tables = {n: [*p, *([added[n]] if n in added else [])] for n, p in state.tables.items()}
        done = _State(k + 1, f"{at}/frontier", frontier.count(), tables, dict(state.merged), seen.filter, waiting, templates, answers, halted, [*state.told, {"round": k, **counts}])
        return self.commit(self.compacted(done, seen, at))

    def decided(self, said: DataFrame | None, sent: DataFrame) -> DataFrame:
        """What is done about each request sent: an action that may not be repeated any more is an
        ``error``. Requests that nothing was said of count as ``lost``."""
        own = sent.select("crawl_id", "dedup_key", "attempt", "waited", "probe")
        if said is None:
            rows = own.withColumns({"action": F.lit("step"), "wait": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")})
        else:
            extra = [F.col("wait").cast("double").alias("wait") if "wait" in said.columns else F.lit(None).cast("double").alias("wait"), F.col("reason").cast("string").alias("reason") if "reason" in said.columns else F.lit(None).cast("string").alias("reason")]
            # the names of a round begin alike: sorted by them alone, rows would be compared letter by letter
            own, said = (x.withColumn("_hash", F.xxhash64("crawl_id")) for x in (own, said.select("crawl_id", "action", *extra)))
            rows = own.join(said.hint("merge"), ["_hash", "crawl_id"], "left").drop("_hash").withColumn("action", F.coalesce("action", F.lit("lost")))
        again = (F.col("action") == "retry") & (F.col("attempt") < self.retry.attempts)
        waits = (F.col("action") == "await") & (F.col("waited") + self.retry.interval <= self.retry.patience)
        kept = F.col("action").isin("step", "skip", "halt", "failed_probe")
        decision = F.when(kept, F.col("action")).when(again, "retry").when(waits, "await").otherwise(F.when(F.col("probe").isNotNull(), "failed_probe").otherwise("error"))
        return rows.withColumn("decision", decision)

    def settled(self, outcomes: DataFrame, sent: DataFrame, before: dict[str, list[str]], now: float, at: str) -> tuple[str | None, dict[str, list[str]]]:
        """(why the run is halted, if it is, what waits after the round, by bucket)."""
        said = outcomes.filter("decision IN ('halt', 'retry', 'await')")
        if said.isEmpty():
            return None, before
        halted = said.filter("decision = 'halt'").select("reason").first()
        return None if halted is None else halted["reason"] or "halted", self.delayed(outcomes, sent, before, now, at)

    def delayed(self, outcomes: DataFrame, sent: DataFrame, before: dict[str, list[str]], now: float, at: str) -> dict[str, list[str]]:
        """What waits after the round, by bucket: the rows of each are written to their own folder."""
        backoff = F.least(F.lit(self.retry.longest), self.retry.base * F.pow(F.lit(self.retry.factor), F.col("attempt") - 1))
        wait = F.when(F.col("decision") == "await", F.lit(self.retry.interval)).otherwise(F.coalesce("wait", backoff))
        again = outcomes.filter("decision IN ('retry', 'await')").select("crawl_id", "decision", F.ceil((F.lit(now) + wait) / self.retry.width).cast("bigint").alias("due_bucket"))
        awaits = F.col("decision") == "await"
        rows = sent.join(again.hint("merge"), "crawl_id").withColumns({"attempt": F.when(awaits, F.col("attempt")).otherwise(F.col("attempt") + 1), "waited": F.when(awaits, F.col("waited") + self.retry.interval).otherwise(F.lit(0.0))})
        rows.select(*sent.columns, "due_bucket").write.mode("overwrite").partitionBy("due_bucket").parquet(f"{at}/waiting")
        out = {b: list(p) for b, p in before.items()}
        # as many as there are buckets within the longest wait
        for r in again.select("due_bucket").distinct().collect():
            out.setdefault(str(r["due_bucket"]), []).append(f"{at}/waiting/due_bucket={r['due_bucket']}")
        return out

    # templates

    def probed(self, state: _State, outcomes: DataFrame, at: str, k: int) -> tuple[DataFrame | None, str | None, str | None, str | None]:
        """(next probes, path of the templates that go on, path of the answers to windows that are
        not complete, path of the templates that ended in this round). Answers are counted once, and
        meet their templates once."""
        now = self.read(state.templates, TEMPLATES)
        keys = ["entry", "param_index"]
        fresh = outcomes.filter("probe IS NOT NULL AND decision NOT IN ('retry', 'await')").select("probe.*", (F.col("decision") == "step").alias("ok"))
        answers = self.read(state.answers, ANSWERS).unionByName(fresh) if state.answers else fresh
        whole = F.coalesce("_n", F.lit(0)) >= F.col("asked")
        met = speculate.with_windows(now, answers, "left").withColumns({"_whole": whole, "_open": ~whole & F.col("_n").isNotNull()})
        moved = met.withColumns({c: F.when(F.col("_whole"), v).otherwise(F.col(c)) for c, v in speculate.after_window().items()})
        left = F.greatest(F.col("gap") - F.col("consecutive_failures"), F.lit(1)).cast("bigint")
        over = F.col("_whole") & (F.col("consecutive_failures") >= F.col("gap"))
        moved = stored(moved.withColumns({"asked": F.when(F.col("_whole"), left).otherwise(F.col("asked")), "_over": over}).select(*now.columns, "_whole", "_open", "_over"))
        windows = moved.filter("_whole AND NOT _over").select(*keys, F.explode(F.sequence(F.col("next_n"), F.col("next_n") + F.col("asked") - 1)).alias("n"))

        def unanswered() -> str | None:
            open_ = moved.filter("_open").select(*keys)
            if open_.isEmpty():
                return None
            written(answers.join(open_.hint("merge"), keys).select(*answers.columns), f"{at}/answers")
            return f"{at}/answers"

        going, probes, open_, _ = together(
            self.spark,
            lambda: not written(moved.filter("NOT _over").select(*now.columns), f"{at}/templates").isEmpty(),
            lambda: stored(self.as_probes(windows, k)),
            unanswered,
            lambda: written(moved.filter("_over").select(*now.columns), f"{at}/finished"),
        )
        return probes, f"{at}/templates" if going else None, open_, f"{at}/finished"

    def next_windows(self, first: DataFrame, start: DataFrame, at: str, k: int) -> tuple[DataFrame, str]:
        """The frontier with the first probes, and the path of the templates. One without first
        probes begins with its window; one with neither has nothing to ask for."""
        gap = F.greatest(F.col("gap"), F.lit(0)).cast("bigint")
        states = start.withColumn("asked", F.when(F.col("asked") > 0, F.col("asked")).otherwise(gap)).filter("asked > 0")
        written(states, f"{at}/templates")
        windows = states.select("entry", "param_index", F.explode(F.sequence(F.col("next_n"), F.col("next_n") + F.col("asked") - 1)).alias("n"))
        probes = stored(self.as_probes(windows, k))
        keyed = first.join(probes.filter("dedup_key is not null").select("dedup_key").distinct().withColumn("_probe", F.lit(True)).hint("merge"), "dedup_key", "left")
        kept = keyed.filter(F.col("_probe").isNull() | F.coalesce("skip_dedup", F.lit(False)))
        return kept.select(*first.columns).unionByName(probes), f"{at}/templates"

    def as_probes(self, windows: DataFrame, k: int) -> DataFrame:
        asked = self.probing.requests(windows)
        return asked.select(*self.columns, F.lit(None).cast("string").alias("led_by"), *self.named(k, "p"), F.struct(F.col("entry").cast("string").alias("entry"), F.col("param_index").cast("int").alias("param_index"), F.col("n").cast("bigint").alias("n")).alias("probe"))

    # storage

    def compacted(self, state: _State, seen: VisitedSet, at: str) -> _State:
        """The state with the tables of the last ``MERGED`` rounds written as one each, when there
        are as many. What they were stays for whoever reads it."""
        for name, paths in state.tables.items():
            done = state.merged.get(name, 0)
            if len(paths) - done < MERGED:
                continue
            if name == "visited":
                state.tables[name] = list(VisitedSet(self.spark, tuple(paths), seen.filter, self.bits).merged(done, f"{at}/merged/{name}").segments)
            else:
                rows = self.stepped(paths[done:]) if name == "stepped" else self.gathered(paths[done:])
                rows.hint("rebalance").write.mode("overwrite").parquet(f"{at}/merged/{name}")
                state.tables[name] = [*paths[:done], f"{at}/merged/{name}"]
            state.merged[name] = done + 1
        return state

    def gathered(self, paths: list[str]) -> DataFrame | None:
        if not paths:
            return None
        schema = self.spark.read.parquet(paths[0]).schema
        return self.spark.read.schema(schema).parquet(*paths)

    def stepped(self, paths: list[str]) -> DataFrame | None:
        """The columns of outcomes that requests have which were sent in rounds that said nothing."""
        return self.spark.read.schema(STEPPED).parquet(*paths) if paths else None

    def outcomes(self, state: _State) -> DataFrame:
        """All outcomes, those of rounds that said nothing as well."""
        names = [x.split()[0] for x in OUTCOMES.split(", ")]
        said, rest = self.kept("outcomes", state), self.kept("stepped", state)
        given = [] if said is None else [said.select(*names)]
        if rest is not None:
            step = F.lit("step")
            given.append(rest.withColumns({"action": step, "decision": step, "reason": F.lit(None).cast("string")}).select(*names))
        return reduce(DataFrame.unionByName, given) if given else self.spark.createDataFrame([], OUTCOMES)

    def kept(self, name: str, state: _State) -> DataFrame | None:
        """All rows of a table, but those of requests that were withdrawn."""
        rows, gone = (self.stepped if name == "stepped" else self.gathered)(state.tables[name]), state.tables["withdrawn"]
        if rows is None or not gone or "crawl_id" not in rows.columns:
            return rows
        return rows.join(self.gathered(gone), "crawl_id", "left_anti").select(*rows.columns)

    # reseeding

    def reseeded(self, state: _State, failed: DataFrame | None) -> tuple[_State, DataFrame]:
        """(the state with the subtrees below the reseed points of ``failed`` taken back, those points)."""
        k, at = state.round + 1, self.attempt(state.round + 1)
        if state.tables["results"] and "crawl_id" not in self.gathered(state.tables["results"]).columns:
            raise ConfigError("results need the crawl_id of their request to be withdrawn")
        live = self.kept("sent", state)
        log = stored(live.groupBy("crawl_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in live.columns if c != "crawl_id"]), "attempt").alias("r")).select("crawl_id", "r.*").select(*live.columns))
        if failed is None:
            failed = self.outcomes(state).filter("decision = 'error'").select("crawl_id").distinct()
        marks = F.col("reseedable") if "reseedable" in log.columns else F.lit(True)
        tree = log.select(F.col("crawl_id").alias("request_id"), F.col("led_by").alias("parent_id"), marks.alias("reseedable"))
        points = stored(reseed_points(tree, failed.select(F.col("crawl_id").alias("request_id"))).select(F.col("reseed_id").alias("crawl_id")).filter("crawl_id is not null").distinct())
        gone = written(below(tree, points), f"{at}/withdrawn")
        again = log.join(points, "crawl_id")
        # of points below one another the highest is enough: the others are found again from it
        up = again.join(gone.select(F.col("crawl_id").alias("led_by"), F.lit(True).alias("_within")), "led_by", "left").filter("_within is null")
        first = up.select(*log.columns).withColumns({"attempt": F.lit(1), "waited": F.lit(0.0), "crawl_id": F.concat(F.col("crawl_id"), F.lit(f"/{k}"))})
        frontier = written(first.unionByName(self.read(state.frontier, self.schema).join(gone.select(F.col("crawl_id").alias("led_by")), "led_by", "left_anti").select(*first.columns)), f"{at}/frontier")
        # keys that only withdrawn requests had are no longer visited
        named = log.filter(~F.coalesce("skip_dedup", F.lit(False)))
        lost = named.join(gone, "crawl_id").select("dedup_key").distinct()
        others = named.join(gone, "crawl_id", "left_anti").select("dedup_key").distinct()
        forgotten = lost.join(others, "dedup_key", "left_anti")
        keys = VisitedSet(self.spark, tuple(state.tables["visited"])).keys().select("dedup_key").distinct().join(forgotten, "dedup_key", "left_anti")
        seen = VisitedSet(self.spark, bits=self.bits).add(keys, f"{at}/visited", f"{at}/bitmaps")
        waiting: dict[str, list[str]] = {}
        for due, paths in state.waiting.items():
            rows = reduce(DataFrame.unionByName, [self.read(p, self.schema) for p in paths])
            written(rows.join(gone, "crawl_id", "left_anti").select(*rows.columns), f"{at}/waiting/{due}")
            waiting[due] = [f"{at}/waiting/{due}"]
        tables = state.tables | {"visited": list(seen.segments), "withdrawn": [*state.tables["withdrawn"], f"{at}/withdrawn"]}
        done = _State(k, f"{at}/frontier", frontier.count(), tables, state.merged | {"visited": 0}, seen.filter, waiting, state.templates, state.answers, None, [*state.told, {"round": state.round, "withdrawn": gone.count()}])
        return self.commit(done), points

    def told(self, state: _State) -> Crawl:
        results, errors = (self.kept(n, state) for n in ("results", "errors"))
        waiting = [self.read(p, self.schema) for paths in state.waiting.values() for p in paths]
        over = [self.read(p, TEMPLATES) for p in state.tables["finished"]]
        states = reduce(DataFrame.unionByName, [x.withColumn("done", F.lit(True)) for x in over] + [self.read(state.templates, TEMPLATES).withColumn("done", F.lit(False))])
        return Crawl(
            VisitedSet(self.spark, tuple(state.tables["visited"])).keys().select("dedup_key"),
            results,
            errors,
            self.read(state.frontier, self.schema).select(*self.columns),
            state.round,
            self.outcomes(state),
            states.drop("asked"),
            reduce(DataFrame.unionByName, waiting) if waiting else self.spark.createDataFrame([], self.schema),
            state.halted,
            state.told,
        )


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """What each of some jobs gives, run at once: small ones wait for the scheduler, not for
    each other. The first that fails is raised when all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def _free() -> Column:
    """Requests that are sent whatever was: those without a key, and those that skip deduplication."""
    return F.col("dedup_key").isNull() | F.coalesce(F.col("skip_dedup"), F.lit(False))


def _parts(ddl: str) -> list[str]:
    """The columns of a schema's text, split at commas that stand in no brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def queue_order(frontier: DataFrame) -> DataFrame:
    """The frontier as it would be sent."""
    return frontier.withColumn("effective_priority", effective_priority()).orderBy("effective_priority", "seq")

"""Crawls that act on what steps say: retries, waits, halts, probing; storage of runs."""

import glob

import pytest
from pyspark.sql import functions as F

from arborweb.errors import ConfigError
from arborweb.plans import frontier
from arborweb.plans.frontier import Probing, Retry, RunConflict, crawl
from arborweb.plans.visited import VisitedSet

REQUEST = "seq LONG, n LONG, dedup_key STRING, skip_dedup BOOLEAN, priority INT"


class Clock:
    def __init__(self):
        self.now, self.slept = 1000.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def rows(spark, ids):
    return spark.createDataFrame([(i, i, f"k{i}", False, None) for i in ids], REQUEST)


def asked(df):
    return df.select(F.col("n").alias("seq"), "n", F.concat(F.lit("k"), F.col("n").cast("string")).alias("dedup_key"), F.lit(False).alias("skip_dedup"), F.lit(None).cast("int").alias("priority"))


def nothing(got):
    return got.select("n"), asked(got.filter("false")), got.select("n").filter("false")


def test_a_set_of_visited_keys(spark, tmp_path):
    def keys(a, b):
        return spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_key"))

    seen = VisitedSet(spark, bits=1 << 20)
    assert seen.unseen(keys(0, 5))[0].count() == 5
    for k in range(3):
        seen = seen.add(keys(1000 * k, 1000 * k + 1500), f"{tmp_path}/s{k}", f"{tmp_path}/f{k}")
    new, said = seen.unseen(keys(3400, 4000).unionByName(spark.createDataFrame([(None,)], "dedup_key STRING")))
    assert new.count() == 501 and said["asked"] == 601 and 100 <= said["maybe"] <= 110
    new, said = seen.unseen(keys(0, 2))
    assert new.count() == 0 and said["buckets"] <= 2
    # a filter that is far too small answers maybe, and the set still knows
    small = VisitedSet(spark, bits=64).add(keys(0, 500), f"{tmp_path}/s", f"{tmp_path}/f")
    new, said = small.unseen(keys(400, 600))
    assert new.count() == 100 and said["maybe"] > 190
    merged = seen.merged(1, f"{tmp_path}/m")
    assert len(merged.segments) == 2 and merged.unseen(keys(3400, 4000))[0].count() == 500


def test_a_round_reads_what_its_keys_can_hit(spark):
    """A chain of pages: no key comes again, so no round reads what was visited."""

    def run(got):
        return got.select("n"), asked(got.filter("n < 9").select((F.col("n") + 1).alias("n"))), got.select("n").filter("false")

    done = crawl(rows(spark, [1]), lambda r: r, run)
    assert done.rounds == 9 and sorted(r["n"] for r in done.results.collect()) == list(range(1, 10))
    assert all(t["buckets"] == 0 for t in done.told) and done.visited.count() == 9


def test_retries_waits_skips_and_failures(spark):
    """n % 5: 0 at once, 1 after two retries, 2 never, 3 skipped, 4 awaited twice."""
    clock = Clock()
    sent = []

    def run(got):
        sent.append((clock.now, sorted((r["n"], r["attempt"]) for r in got.select("n", "attempt").collect())))
        k = F.col("n") % 5
        action = F.when(k == 0, "step").when(k == 1, F.when(F.col("attempt") > 2, "step").otherwise("retry")).when(k == 2, "retry").when(k == 3, "skip").when(F.col("waited") >= 4, "step").otherwise("await")
        said = got.select("crawl_id", action.alias("action"), F.concat(F.lit("because "), F.col("n").cast("string")).alias("reason"), F.when(F.col("n") == 6, 7.0).alias("wait"))
        more = asked(got.filter("n = 0").select(F.explode(F.array(*[F.lit(x).cast("long") for x in (10, 0, 3)])).alias("n")))
        return got.select("n", "attempt"), more, got.select("n").filter("false"), said

    done = crawl(rows(spark, range(7)), lambda r: r, run, retry=Retry(attempts=3, base=2.0, factor=3.0, interval=2.0, patience=4.0, width=1.0), clock=clock, sleep=clock.sleep)
    assert sent == [
        (1000.0, [(n, 1) for n in range(7)]),
        (1000.0, [(10, 1)]),
        (1002.0, [(1, 2), (2, 2), (4, 1)]),
        (1004.0, [(4, 1)]),
        (1007.0, [(6, 2)]),
        (1008.0, [(1, 3), (2, 3)]),
        (1014.0, [(6, 3)]),
    ]
    assert done.halted is None and done.waiting.count() == 0
    last = {r["dedup_key"]: (r["n"], r["attempts"], r["d"]) for r in done.outcomes.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"), F.max("attempt").alias("attempts"), F.max_by("decision", F.struct(F.col("attempt"), F.col("decision") != "await")).alias("d")).collect()}
    assert last == {"k0": (1, 1, "step"), "k1": (3, 3, "step"), "k2": (3, 3, "error"), "k3": (1, 1, "skip"), "k4": (3, 1, "step"), "k5": (1, 1, "step"), "k6": (3, 3, "step"), "k10": (1, 1, "step")}
    assert {r["reason"] for r in done.outcomes.filter("decision = 'skip'").collect()} == {"because 3"}


def test_patience_ends(spark):
    clock = Clock()

    def run(got):
        return (*nothing(got), got.select("crawl_id", F.lit("await").alias("action")))

    done = crawl(rows(spark, [1]), lambda r: r, run, retry=Retry(interval=1.0, patience=2.5), clock=clock, sleep=clock.sleep)
    assert [r["decision"] for r in done.outcomes.orderBy("decision").collect()] == ["await", "await", "error"]


def test_a_halt_ends_the_run_and_what_was_not_answered_is_lost(spark, tmp_path):
    calls = []

    def run(got):
        calls.append(1)
        more = asked(got.select((F.col("n") + 10).alias("n")))
        return got.select("n"), more, got.select("n").filter("false"), got.filter("n <> 3").select("crawl_id", F.when(F.col("n") == 12, "halt").otherwise("step").alias("action"), F.lit("enough").alias("reason"))

    done = crawl(rows(spark, [1, 2, 3]), lambda r: r, run, folder=str(tmp_path / "r"))
    assert (done.halted, done.rounds, len(calls)) == ("enough", 2, 2) and done.left.count() == 3
    assert [r["dedup_key"] for r in done.outcomes.filter("action = 'lost' and decision = 'error'").collect()] == ["k3"]
    again = crawl(rows(spark, [1, 2, 3]), lambda r: r, run, folder=str(tmp_path / "r"))
    assert (again.halted, len(calls)) == ("enough", 2)


@pytest.mark.parametrize("batch", [None, 3])
def test_templates_are_probed_beside_what_is_followed(spark, batch):
    """Template t has pages up to t * 3; a page t, n leads to a page 1000 * t + n, which is a link."""
    of = spark.createDataFrame([("a", 1, 1, 3, 2), ("a", 2, 1, 1, 2), ("b", 0, 2, 4, 3)], "entry STRING, param_index INT, min BIGINT, soft_max BIGINT, gap INT")

    def probes(windows):
        made = windows.withColumn("page", F.col("param_index") * 100 + F.col("n") + F.when(F.col("entry") == "b", 50).otherwise(0))
        return made.select("entry", "param_index", F.col("n"), F.col("page").alias("seq"), F.concat(F.lit("k"), F.col("page").cast("string")).alias("dedup_key"), F.lit(False).alias("skip_dedup"), F.lit(None).cast("int").alias("priority"), F.lit("p").alias("kind"))

    flaky = F.col("probe.n") == 2

    def run(got):
        there = F.col("kind") == "l"
        there = there | ((F.col("probe.entry") == "a") & (F.col("probe.n") <= F.col("probe.param_index") * 3))
        action = F.when(flaky & (F.col("attempt") == 1), "retry").when(there, "step").otherwise("failed_probe")
        ok = got.withColumn("action", action)
        more = ok.filter("action = 'step' and kind = 'p'").select("n", (F.col("seq") + 1000).alias("seq"), F.concat(F.lit("k"), (F.col("seq") + 1000).cast("string")).alias("dedup_key"), F.lit(False).alias("skip_dedup"), F.lit(None).cast("int").alias("priority"), F.lit("l").alias("kind"))
        # a link to a page that a template probes as well is not followed again
        twice = ok.filter("seq = 1101").select("n", F.lit(102).cast("long").alias("seq"), F.lit("k102").alias("dedup_key"), F.lit(False).alias("skip_dedup"), F.lit(None).cast("int").alias("priority"), F.lit("l").alias("kind"))
        return ok.filter("action = 'step'").select("seq"), more.unionByName(twice), got.select("seq").filter("false"), ok.select("crawl_id", "action")

    seeds = spark.createDataFrame([], "n LONG, seq LONG, dedup_key STRING, skip_dedup BOOLEAN, priority INT, kind STRING")
    clock = Clock()
    done = crawl(seeds, lambda r: r, run, probing=Probing(of, probes), batch=batch, clock=clock, sleep=clock.sleep)
    pages = [101, 102, 103, *range(201, 207)]
    assert sorted(r["seq"] for r in done.results.collect()) == pages + [p + 1000 for p in pages]
    states = {(r["entry"], r["param_index"]): (r["highest_success"], r["consecutive_failures"], r["done"]) for r in done.templates.collect()}
    assert states == {("a", 1): (3, 2, True), ("a", 2): (6, 2, True), ("b", 0): (None, 3, True)}


def test_a_run_that_is_killed_between_any_two_writes(spark, tmp_path, monkeypatch):
    def run(got):
        more = asked(got.filter("n < 12").select(F.explode(F.array(F.col("n") * 2 + 1, F.col("n") * 2 + 2, F.col("n"))).alias("n")))
        return got.select("n"), more, got.filter("n % 7 = 0").select("n"), got.select("crawl_id", F.when((F.col("n") % 4 == 1) & (F.col("attempt") == 1), "retry").otherwise("step").alias("action"))

    def told(done):
        return [sorted(map(str, t.collect())) for t in (done.results, done.errors, done.visited, done.outcomes.drop("crawl_id"))]

    clock = Clock()
    whole = told(crawl(rows(spark, [0]), lambda r: r, run, clock=clock, sleep=clock.sleep))
    real, budget = frontier.written, [0]

    def dying(df, path):
        budget[0] -= 1
        if budget[0] < 0:
            raise KeyboardInterrupt
        return real(df, path)

    monkeypatch.setattr(frontier, "written", dying)
    folder, clock, died = str(tmp_path / "run"), Clock(), 0
    for k in range(60):
        budget[0] = 1 + 7 * k % 11
        try:
            done = crawl(rows(spark, [0]), lambda r: r, run, folder=folder, clock=clock, sleep=clock.sleep)
            break
        except KeyboardInterrupt:
            died += 1
    assert died > 3 and told(done) == whole


def test_two_drivers_in_one_folder(spark, tmp_path):
    folder, other = str(tmp_path / "run"), []

    def run(got):
        if not other and got.filter("n = 2").count():
            other.append(None)
            other[0] = crawl(rows(spark, [1]), lambda r: r, run, folder=folder)
        return got.select("n"), asked(got.filter("n < 4").select((F.col("n") + 1).alias("n"))), got.select("n").filter("false")

    with pytest.raises(RunConflict):
        crawl(rows(spark, [1]), lambda r: r, run, folder=folder)
    assert sorted(r["n"] for r in other[0].results.collect()) == [1, 2, 3, 4]
    names = sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{folder}/manifest/*"))
    assert names == [f"{k:06d}.json" for k in range(5)]


def test_small_rounds_are_merged(spark, monkeypatch):
    monkeypatch.setattr(frontier, "MERGED", 3)

    def run(got):
        return got.select("n"), asked(got.filter("n < 8").select(F.explode(F.array(F.col("n") + 1, F.lit(1).cast("long"))).alias("n"))), got.select("n").filter("false")

    done = crawl(rows(spark, [1]), lambda r: r, run)
    assert sorted(r["n"] for r in done.results.collect()) == list(range(1, 9)) and done.rounds == 8 and done.outcomes.count() == 8
    assert len(done.results.inputFiles()) < 8 and sorted(r["dedup_key"] for r in done.visited.collect()) == [f"k{k}" for k in range(1, 9)]


def test_names_that_the_crawl_adds(spark):
    with pytest.raises(ConfigError):
        crawl(rows(spark, [1]).withColumn("attempt", F.lit(1)), lambda r: r, nothing)
    assert crawl(rows(spark, []), lambda r: r, nothing).results is None


def test_a_failed_subtree_is_taken_back_and_run_again(spark, tmp_path):
    """A tree in which pages below 2 are broken at first; after reseeding the run is as one that never
    failed."""
    broken = [True]

    def run(got):
        # n links to 2n + 1 and 2n + 2, and to the root; pages of 13 and 14 fail at first, and 5 gives wrong links
        bad = F.col("n").isin(13, 14) if broken[0] else F.lit(False)
        wrong = (F.col("n") == 5) & F.lit(broken[0])
        to = F.array(F.col("n") * 2 + 1 + F.when(wrong, 100).otherwise(0), F.col("n") * 2 + 2, F.lit(0).cast("long"))
        more = got.filter(~bad & (F.col("n") < 15)).select(F.col("crawl_id").alias("led_by"), F.explode(to).alias("n"))
        may = F.when(F.col("n") == 2, True).when(F.col("n") < 2, False)
        more = more.select("led_by", may.alias("reseedable"), F.col("n").alias("seq"), "n", F.concat(F.lit("k"), F.col("n").cast("string")).alias("dedup_key"), F.lit(False).alias("skip_dedup"), F.lit(None).cast("int").alias("priority"))
        said = got.select("crawl_id", F.when(bad, "error").otherwise("step").alias("action"))
        return got.filter(~bad).select("crawl_id", "n"), more, got.filter(bad).select("crawl_id", "n"), said

    seeds = rows(spark, [0]).withColumn("reseedable", F.lit(False))
    folder = str(tmp_path / "run")
    first = crawl(seeds, lambda r: r, run, folder=folder)
    assert first.errors.count() == 2 and 111 in {r["n"] for r in first.results.collect()}
    assert frontier.reseed(seeds, folder) == 1
    broken[0] = False
    again = crawl(seeds, lambda r: r, run, folder=folder)
    clean = crawl(seeds, lambda r: r, run)
    told = [[sorted(r[c] for r in t.collect()) for t, c in ((d.results, "n"), (d.errors, "n"), (d.visited, "dedup_key"), (d.outcomes, "dedup_key"))] for d in (again, clean)]
    assert told[0] == told[1] and again.errors.count() == 0 and again.left.count() == 0
    # nothing failed since: nothing is taken back
    assert frontier.reseed(seeds, folder) == 0
    with pytest.raises(ConfigError):
        frontier.reseed(seeds, str(tmp_path / "none"))


def test_the_filter_is_never_broadcast(spark, tmp_path):
    """Four broadcasts of its bitmaps a round filled the driver."""
    keys = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_key"))
    seen = VisitedSet(spark).add(spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_key")), f"{tmp_path}/s", f"{tmp_path}/f")
    plan = seen.asked(keys)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    # a set made before its filter's layout changed has none: all keys are tested exactly, and the next filter has all
    old = VisitedSet(spark, seen.segments)
    assert old.unseen(keys)[0].count() == seen.unseen(keys)[0].count() == 1000
    again = old.add(keys.limit(0), f"{tmp_path}/s2", f"{tmp_path}/f2")
    assert again.asked(keys).filter("maybe").count() >= 1000 and again.unseen(keys)[0].count() == 1000


def test_a_round_of_probes_does_each_thing_once(spark, tmp_path):
    """Answers were shuffled anew for each of five tables, and all that was sent for retries that nobody asked for."""
    of = spark.createDataFrame([(f"e{k}", 0, 1, 4, 3) for k in range(20)], "entry STRING, param_index INT, min BIGINT, soft_max BIGINT, gap INT")
    rest = (F.col("n").alias("seq"), F.lit(False).alias("skip_dedup"), F.lit(None).cast("int").alias("priority"))

    def probes(windows):
        return windows.select("entry", "param_index", "n", F.concat_ws("/", "entry", "n").alias("dedup_key"), *rest)

    def run(got):
        said = got.select("crawl_id", F.when(F.col("n") <= F.substring("probe.entry", 2, 2).cast("int"), "step").otherwise("failed_probe").alias("action"))
        return got.select("n"), got.filter("false").drop("crawl_id", "led_by", "attempt", "waited", "probe"), got.select("n").filter("false"), said

    sc, folder = spark.sparkContext, str(tmp_path / "run")
    seeds = probes(spark.createDataFrame([], "entry STRING, param_index INT, n BIGINT")).drop("entry", "param_index")
    sc.setJobGroup("probes", "")
    try:
        done = crawl(seeds, lambda r: r, run, probing=Probing(of, probes), folder=folder)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r["entry"]: r["highest_success"] for r in done.templates.collect()} == {f"e{k}": k or None for k in range(20)}
    jobs = len(sc.statusTracker().getJobIdsForGroup("probes"))
    assert jobs / done.rounds < 40, (jobs, done.rounds)
    assert not glob.glob(f"{folder}/round=*/*/waiting") and done.waiting.count() == 0


def test_a_filter_of_too_many_keys_is_given_up(spark, tmp_path):
    """It was asked in every round, though it let all keys through."""

    def keys(a, b):
        return spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_key"))

    seen = VisitedSet(spark, bits=1024).add(keys(0, 500), f"{tmp_path}/s0", f"{tmp_path}/f0")
    assert seen.filter is not None
    seen = seen.add(keys(500, 600), f"{tmp_path}/s1", f"{tmp_path}/f1").add(keys(600, 700), f"{tmp_path}/s2", f"{tmp_path}/f2")
    assert seen.filter is None
    flagged, said, hit = seen.flagged(keys(650, 800))
    assert said["maybe"] == said["asked"] == 150
    assert seen.without(flagged, hit).count() == 100 and seen.without(flagged, hit, keys(790, 900)).count() == 90


def test_visited_keys_are_sorted_by_the_key_alone(spark, tmp_path):
    """Sorted by their bucket first, keys of one bucket were compared letter by letter."""
    keys = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_key"))
    seen = VisitedSet(spark, bits=64).add(keys, f"{tmp_path}/s", f"{tmp_path}/f")
    new = seen.unseen(keys.unionByName(spark.createDataFrame([("k",)], "dedup_key STRING")))[0]
    joins = [line for line in new._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
    assert joins and not any("bucket" in line for line in joins) and [r["dedup_key"] for r in new.collect()] == ["k"]


def test_a_set_without_a_filter_shuffles_its_rows_once(spark, tmp_path):
    """They were written, read and shuffled again between losing their duplicates and meeting what was visited."""
    from arborweb.operators.requests import first_of_key

    keys = F.sha2((F.col("id") % 100).cast("string"), 256).alias("dedup_key")
    more = spark.range(300).select(F.col("id").alias("seq"), keys)
    seen = VisitedSet(spark, bits=64).add(spark.range(40).select(keys), f"{tmp_path}/s", f"{tmp_path}/f")
    assert seen.filter is None
    flagged, said, hit = seen.flagged(first_of_key(more))
    new = seen.without(flagged, hit)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and plan.count("Exchange hashpartitioning") == 2
    assert sorted(r["seq"] for r in new.collect()) == list(range(40, 100)) and said["asked"] == said["maybe"] == 100
    assert seen.flagged(first_of_key(more), more)[1:] == (said, hit)


def test_a_round_that_says_nothing_writes_no_outcomes(spark, tmp_path, monkeypatch):
    """Every request was written once more, with its key, to say that it was sent."""
    monkeypatch.setattr(frontier, "MERGED", 3)
    folder = str(tmp_path / "run")

    def run(got):
        found = got.select("crawl_id", "n")
        given = found, asked(got.filter("n < 6").select((F.col("n") + 1).alias("n"))), found.filter("false")
        return (*given, got.select("crawl_id", F.lit("skip").alias("action"), F.lit("5").alias("reason"))) if got.filter("n = 5").count() else given

    crawl(rows(spark, [1]), lambda r: r, run, folder=folder, rounds=0)
    # as an earlier version would have begun it
    real = frontier.read_text
    monkeypatch.setattr(frontier, "read_text", lambda *given: (text := real(*given)) and text.replace('"stepped": [], ', ""))
    done = crawl(rows(spark, [1]), lambda r: r, run, folder=folder)
    assert len(glob.glob(f"{folder}/round=*/*/outcomes")) == 1
    told = sorted((r["dedup_key"], r["attempt"], r["action"], r["decision"], r["reason"]) for r in done.outcomes.collect())
    assert told == [(f"k{n}", 1, *(("skip", "skip", "5") if n == 5 else ("step", "step", None))) for n in range(1, 7)]
    assert sorted(r["crawl_id"] for r in done.outcomes.collect()) == sorted(r["crawl_id"] for r in done.results.collect())
    # of a run without any outcome nothing failed
    assert frontier.reseed(rows(spark, [1]), folder) == 0


def test_of_a_ranged_table_the_range_asked_for_is_read(spark):
    """A round of one request read all pages."""
    from arborweb.storage import met_in_range, ranged

    table = ranged(spark.range(10_000).select(F.pmod(F.col("id") * 7, F.lit(10_000)).alias("id")), "id")
    rows = spark.createDataFrame([(k,) for k in (20, 30, 30, 25_000)], "id LONG")
    assert sorted(r["id"] for r in met_in_range(rows, table, "id").collect()) == [20, 30, 30]
    met = met_in_range(rows.filter("id < 100"), table, "id")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,20), LessThanOrEqual(id,30)" in plan and "Broadcast" not in plan
    assert sorted(r["id"] for r in met.collect()) == [20, 30, 30]
    assert met_in_range(rows.filter("false"), table, "id").count() == 0

"""What must not grow with the input: broadcasts, rows that meet in one task, rows read one by one."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from arborweb import oracles, queries
from arborweb.operators import speculate

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_states_of_templates_are_never_broadcast(spark):
    """Of all templates, in each round: 2.4 GB through the driver for 15,000 of them."""
    of = spark.createDataFrame([("a", 0, 3, 2, None, 0, 1)], "entry STRING, param_index INT, gap INT, soft_max LONG, highest_success LONG, consecutive_failures LONG, next_n LONG")
    outcomes = spark.createDataFrame([("a", 0, 1, True), ("a", 0, 2, False)], "entry STRING, param_index INT, n LONG, ok BOOLEAN")
    moved = speculate.advanced(of, outcomes)
    assert "Broadcast" not in plan(moved)
    assert [(r["highest_success"], r["consecutive_failures"], r["next_n"]) for r in moved.collect()] == [(1, 1, 3)]


def test_specs_with_much_in_common_are_filed_apart(spark):
    """Sixty globs of one site with one campaign were all held against each capture."""
    from arborweb.operators import specs

    rows = [(f"s{k}", f"*.example.com/en/{k % 30:02}*", None, None, {"utm_source": "feed"}, None, None, None) for k in range(60)]
    table = spark.createDataFrame(rows, specs.SPEC)
    keys = [r["key"] for r in specs.filed_apart(table).collect()]
    assert len(set(keys)) == 30 and all(k.startswith("u:") for k in keys)
    captured = spark.createDataFrame([(n, f"http://a.example.com/en/{n:02}?utm_source=feed", None, None, None, None) for n in range(20)], "n INT, url STRING, method STRING, resource_type STRING, headers MAP<STRING, STRING>, body BINARY")
    assert sorted((r["spec_id"], r["n"]) for r in specs.matches(captured, table).collect()) == sorted((f"s{k}", k % 30) for k in range(60) if k % 30 < 20)


def test_files_of_pages_with_one_url(spark, tmp_path):
    """A page took the file of another page with its URL, against the SQL."""
    pages = spark.createDataFrame([(k, f"http://x/{k // 4}" if k else None) for k in range(24)], "page_id LONG, url STRING")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.q_archive_decisions(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT request_id, download, file_url FROM ({oracles.SQL['archive_decisions']})").fetchall())


def test_pages_of_small_rows_are_dealt_over_tasks(spark):
    """One row group was one task's, whatever work its rows are."""
    assert queries._form_pages(spark, SF).rdd.getNumPartitions() >= 4


def test_a_key_past_its_rates_is_passed_over(spark, tmp_path):
    """A row each was read for all that is refused; many keys, free rows, batches and ties as the plain rule has them."""
    import random
    from datetime import datetime, timezone

    from arborweb.operators import rates

    draw = random.Random(4)
    rows = sorted((draw.choice("ab"), draw.randrange(90), draw.random() < 0.2, k) for k in range(900))
    df = spark.createDataFrame([(k, datetime.fromtimestamp(t, timezone.utc), f, i) for k, t, f, i in rows], "k STRING, ts TIMESTAMP, free BOOLEAN, i INT")
    limits = [(2, 3), (5, 20)]
    want = {}
    for key in "ab":
        passed = []
        for _, t, free, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            want[i] = free or all(len(passed) < n or passed[-n] <= t - s for n, s in limits)
            if want[i] and not free:
                passed.append(t)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", was):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = rates.admit_all(df, limits, keys=["k"], bypass="free", ties=("i",))
            assert {r["i"]: r["admitted"] for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_windows_of_a_busy_key_are_looked_up(spark):
    """Each instant summed its whole window anew, so a key's time grew with the square of its requests."""
    import random

    from arborweb.operators import rates

    draw = random.Random(7)
    rows = [(k, draw.choice(range(lo, lo + 20)) if k == "a" or lo % 60 else lo) for k in "abc" for lo in range(-400, 1200, 20) for _ in range(draw.choice((0, 1, 2, 2, 3, 9)))]
    spans = [(2, 7), (3, 7), (6, 20)]
    blocks = sorted({(k, t // 20) for k, t in rows} | {("a", 70), ("d", 0)})
    over = {(k, t // 20) for k, t in rows if any(sum(x == k and t - s < u <= t for x, u in rows) > n for n, s in spans)}
    want, stretch = [], None
    for k, b in blocks:
        if (k, b - 1) not in blocks or (k, b - 1) not in over:
            stretch = b
        want.append((k, b, stretch, b + 1 if (k, b) not in over and (k, b + 1) in blocks else None))
    asked = spark.createDataFrame(rows, "key STRING, time LONG").repartition(3)
    got = rates.stretches(asked, spans, spark.createDataFrame(blocks, "key STRING, block LONG"))
    assert "RangeFrame, -" not in plan(got)
    assert sorted(map(tuple, got.collect())) == want and 0 < len(over) < len(blocks)
    # a limit past what Spark looks back
    assert rates.stretches(asked, [(10**12, 20)], asked.selectExpr("key", "floor(time / 20) AS block").distinct()).filter("stretch <> block").isEmpty()


def test_rows_of_one_root_stay_where_they_are(spark, monkeypatch):
    """All rows of a tree met its root in one task."""
    from arborweb.operators import requests

    monkeypatch.setattr(requests, "HOT", 10)
    rows = spark.range(3000).selectExpr("id AS request_id", "CASE WHEN id > 0 THEN 0L END AS parent_id")
    up = rows.select("request_id", F.col("parent_id").alias("above"), F.lit(1).alias("depth"))
    other = up.filter("above is not null").select(F.col("request_id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
    met = requests.met_above(up, other)
    assert "BroadcastHashJoin" in plan(met) and met.count() == 3000 and met.filter("next is null").count() == 3000
    deep = spark.range(3000).selectExpr("id AS request_id", "CASE WHEN id > 0 THEN greatest(id - 2900, 0) END AS parent_id")
    assert requests.chains(deep).filter("root_id <> 0 OR depth < 0 OR depth > 40").isEmpty()

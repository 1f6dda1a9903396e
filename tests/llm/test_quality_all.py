"""The model and the threshold come from all labelled documents."""

import random

import numpy as np

from arborweb.llm import quality


def test_every_label_counts(spark):
    """At most 20,000 of each kind did: here half of 25,000 trusted ids must be counted."""
    n = 25_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id) AS text", "'x' AS source")
    rules = quality.fit(docs, docs.selectExpr("doc_id", "1 AS quality"))
    ids = quality.labelled(docs.selectExpr("doc_id", "1 AS quality")).filter("half = 0")
    assert ids.count() > 12_000
    words = quality.Words()
    t, _ = quality.buckets(*words.number([b"w%d" % r["k"] for r in ids.collect()]))
    r, _ = quality.buckets(*words.number([b"w%d" % k for k in range(n)]))
    trusted, raw = (np.bincount(x, minlength=quality.BUCKETS) for x in (t, r))
    want = np.log((trusted + 1) / (trusted.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert np.allclose(rules.ratio, want)


def test_ranks_are_exact(spark):
    draw = random.Random(5)
    scores = np.array([draw.gauss(0, 1) for _ in range(997)] + [0.0, -0.5, -0.5, 1e-300])
    rows = spark.createDataFrame([(int(k),) for k in quality._ordered(scores)], "ordered LONG")
    got = [quality.at_rank(rows, k) for k in (0, 3, 500, 1000)]
    assert got == [float(np.sort(scores)[k]) for k in (0, 3, 500, 1000)]


def test_texts_without_a_label_are_not_shuffled(spark, monkeypatch):
    """All texts were, to meet labels too many to broadcast."""
    seen = []
    real = quality.let_through

    def counted(*given):
        seen.append(real(*given))
        return seen[-1]

    monkeypatch.setattr(quality, "let_through", counted)
    pairs = spark.range(5000).selectExpr("nullif(id % 4000, 7) AS k", "concat('t', id) AS t")
    marks = spark.range(0, 40_000, 100).selectExpr("id AS k", "id % 200 = 0 AS good", "false AS counted")
    got = quality.marked(pairs, marks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.join(marks, "k").collect()))
    assert 50 <= seen[0].filter("maybe").count() < 100

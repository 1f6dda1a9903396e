import hashlib
import math
from collections import Counter

import pytest

from arborweb.llm import mixing

SCHEMA = "doc_id LONG, text STRING, source STRING, copy STRING"


def unit(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


@pytest.fixture(scope="module")
def rows():
    hot = [(i, f"t{i}", "hot", "clash") for i in range(300)]
    return hot + [(1000 + i, None if i % 5 else "x", "small", "clash") for i in range(60)] + [(2000 + i, "n", None, "clash") for i in range(20)] + [(3000, "", "", "clash"), (None, "no id", "small", "clash"), (5, "t5", "hot", "clash")]


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "small": 3.0, "absent": 2.0}])
def test_counts_follow_the_inverted_distribution(spark, rows, weights):
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r["doc_id"], r["source"]) for r in mixing.mix(df, weights=weights, epochs=2.0).collect())
    n = Counter(r[2] for r in rows)
    share = {s: (n[s] ** 0.5 if weights is None else weights.get(s, 0.0)) for s in n}
    want = Counter()
    for i, _, s, _ in rows:
        rate = share[s] / sum(share.values()) * len(rows) * 2.0 / n[s]
        want[(i, s)] += poisson(rate, unit("42", "" if i is None else str(i))) if rate else 0
    assert got == +want


def test_columns_and_shuffle(spark, rows):
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), alpha=1.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    got = out.collect()
    for r in got:
        assert r["shuffle_key"] == unit("42", "shuffle", "" if r["doc_id"] is None else str(r["doc_id"]), str(r["copy"]))
    # of what each task holds, the order is that of the keys
    parts = out.rdd.glom().collect()
    assert all([r["shuffle_key"] for r in p] == sorted(r["shuffle_key"] for r in p) for p in parts)


def test_a_high_rate_does_not_vanish(spark):
    df = spark.createDataFrame([(1, "a", "tiny", "")] + [(i, "b", "big", "") for i in range(2, 2001)], SCHEMA)
    got = mixing.mix(df, weights={"tiny": 1.0, "big": 1e-9}).filter("source = 'tiny'").count()
    assert 1700 < got < 2300


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mix(spark.createDataFrame([(1, "a", "s", "")], SCHEMA), weights={}).collect() == []


def test_many_sources_meet_by_a_salted_join(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((str(r["doc_id"]), r["copy"]) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    assert sorted((str(r["doc_id"]), r["copy"]) for r in mixing.mix(df).collect()) == want


def test_what_is_broadcast_is_bounded_by_its_numbers(spark, monkeypatch):
    """One rare source beside a large one has a long distribution: it counts, not the sources."""
    df = spark.createDataFrame([(1, "a" * 100_000, "rare", "")] + [(i, "b", "large", "") for i in range(2, 3001)], SCHEMA)
    weights = {"rare": 1.0, "large": 1.0}
    rate, numbers = mixing.rates(df, weights=weights)
    assert rate.count() == 2 and 1500 < numbers < 2500
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix(df, weights=weights).select("doc_id", "copy").collect())
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 1000)
    other = mixing.mix(df, weights=weights)
    assert "BroadcastHashJoin" not in other._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["doc_id"], r["copy"]) for r in other.select("doc_id", "copy").collect()) == want

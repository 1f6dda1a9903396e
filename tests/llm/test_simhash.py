import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arborweb.llm import simhash

SCHEMA = "doc_id LONG, text STRING, fp STRING"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 4:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[top(k)] = min(first.get(top(k), 1 << 60), i)
    return [(rows[k][0], f"{fp[k]:016x}", first.get(top(k))) for k in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    out = []
    for _ in range(25):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([2, 5, 60, 200]))]
        for _ in range(draw.randrange(1, 5)):
            out.append((len(out) + 1, " ".join(words)))
            words[draw.randrange(len(words))] = f"x{draw.randrange(99)}"
    out += [(900, None), (901, ""), (902, " \n\t "), (903, "One two THREE"), (904, "one  two\nthree"), (905, "café Été d x y z"), (None, "nobody has an id here at all"), (None, out[0][1]), out[3], out[3]]
    out.append((906, "long words repeat here " * 20000))
    return out


def test_fingerprints(spark, rows):
    for _, t in rows:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    h = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert simhash.fingerprint("One two THREE") == h % 2**64


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(brute(rows), key=key)


def test_every_pair_within_four_bits_shares_a_bucket(spark):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base:
        for n in (1, 2, 3, 4):
            bits = draw.choice(64, n, replace=False)
            fps.append(int(x) ^ sum(1 << int(b) for b in bits))
    signed = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp LONG")).collect()
    at = {f: k for k, f in enumerate(signed)}
    from arborweb.llm.components import roots

    up = roots(len(signed), np.array([at[e["a"]] for e in edges]), np.array([at[e["b"]] for e in edges]))
    u = np.array(signed, np.int64).view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    assert np.array_equal(up, roots(len(signed), a, b))


def test_large_buckets_are_cut_finer(monkeypatch):
    draw = np.random.default_rng(9)
    center = np.uint64(0x0123456789ABCDEF)
    fp = np.unique(np.array([center ^ np.uint64(sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 6), replace=False))) for _ in range(300)], np.uint64))
    bucket = np.zeros(len(fp), np.int64)
    from arborweb.llm.components import roots

    want = roots(len(fp), *np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4))
    assert np.array_equal(roots(len(fp), *simhash.near_pairs(bucket, fp)), want)
    monkeypatch.setattr(simhash, "BUCKET", 20)
    assert np.array_equal(roots(len(fp), *simhash.near_pairs(bucket, fp)), want)


def test_keep_one_of_each_group(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept.collect())
    want = {}
    for (i, t), (_, _, c) in zip(rows, brute(rows)):
        if i == c:
            want.setdefault((c, slow_fingerprint(t) if c is None else 0), (i is None, i or 0, t))
    assert got == sorted(want.values())


def test_hot_buckets_are_dealt_over_finer_ones(spark, rows, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    for few in (simhash.BROADCAST_BUCKETS, 0):
        monkeypatch.setattr(simhash, "BROADCAST_BUCKETS", few)
        got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
        assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_names_of_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7, 8, 9), (1, "a b c d e", 7, 8, 9), (2, "a b c d e", 1, 2, 3)], "doc_id LONG, text STRING, k LONG, h LONG, `row.x` LONG")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c d e", 7, 8, 9)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one(df).collect() == []

import random
import re
from collections import Counter, defaultdict

import pytest

from arborweb.llm import phrases


def brute(rows, least=10, top=2000):
    """Every contiguous phrase counted in a dictionary."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    f[(lang, *words[k : k + size])] += 1
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = defaultdict(int)
    for p, a in candidates.items():
        if len(p) == 4:
            for inner in (p[:3], (p[0], *p[2:])):
                longer[inner] = max(longer[inner], a)
    of = defaultdict(list)
    for p, a in candidates.items():
        if len(p) == 3 and 100 * longer[p] >= 50 * a:
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
        of[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -score) for lang, found in of.items() for k, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "lang STRING, text STRING, leaf STRING, n INT")
    got = phrases.collocations(docs, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


WORDS = ["of", "off", "the", "The", "a", "é", "a\x00b", "a\x01", "\x00", "\x01\x02", "x y", "中", "it's"]


def random_rows(seed, n):
    draw = random.Random(seed)
    return [(draw.choice(["en", "en", "de", None, "und", "e\x00n"]), "".join(draw.choice(WORDS) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!"]) for _ in range(draw.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("batch", [7, 10_000])
def test_against_a_dictionary(spark, batch, monkeypatch):
    rows = random_rows(4, 300) + [(None, None), ("en", ""), ("fr", "only once here")] + [("sp", "a b c d")] * 12
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = found(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows) and {r[0] for r in got} == {"en", "de", "und", "e\x00n", "sp"}
    assert found(spark, rows, least=3, top=5) == brute(rows, least=3, top=5)


def test_tries_of_small_batches_merge_to_the_same(spark, monkeypatch):
    rows = random_rows(8, 60)
    a = [t for t in rows]
    import pyarrow as pa

    whole = Counter()
    for leaves, n in phrases.trie(pa.array([t for _, t in a]), pa.array([x or "und" for x, _ in a])):
        assert leaves.to_pylist() == sorted(leaves.to_pylist(), key=str.encode)
        whole.update(dict(zip(leaves.to_pylist(), n.to_pylist())))
    parts = Counter()
    for lang, text in a:
        for leaves, n in phrases.trie(pa.array([text]), pa.array([lang or "und"])):
            parts.update(dict(zip(leaves.to_pylist(), n.to_pylist())))
    assert whole == parts


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 5_000_000_007), (10**15 - 1, 10**15 - 1, 10**15 - 1), (10, 11, 13)], "a LONG, l LONG, r LONG")
    got = df.select(phrases._score(df["a"], df["l"], df["r"]).alias("s")).collect()
    assert [r["s"] for r in got] == [1_000_000 * 3_000_000_000**2 // (4_000_000_000 * 5_000_000_007), 1_000_000, 1_000_000 * 100 // 143]


def test_an_empty_table(spark):
    assert found(spark, []) == [] == found(spark, [("en", None), (None, " ., ")])

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from arborweb.llm import ppm

SCHEMA = "doc_id LONG, text STRING, score STRING"


def base(rows):
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    den = n + 0.5 * (v + 1)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / den) for w in ws)) for ws, h in zip(tokens, held)]


class Plain:
    """The model by the book: dictionaries, one symbol after the other."""

    def __init__(self, texts):
        self.count = Counter()
        for t in texts:
            data = ppm.spelled(ppm.words_of(t))
            for at in range(ppm.ORDER, len(data)):
                for k in range(ppm.ORDER + 1):
                    self.count[data[at - k : at + 1]] += 1
        self.children = {}
        for g in self.count:
            self.children.setdefault(g[:-1], {})[g[-1]] = self.count[g] - ppm.DISCOUNT

    def probability(self, context, symbol):
        gone, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            seen = self.children.get(context[ppm.ORDER - k :])
            if seen is None:
                continue
            left = {s: n for s, n in seen.items() if s not in gone}
            total = sum(left.values()) + ppm.DISCOUNT * len(left)
            if symbol in left:
                return p * left[symbol] / total
            if left:
                p *= ppm.DISCOUNT * len(left) / total
            gone |= set(seen)
        return p / (ppm.SYMBOLS - len(gone))

    def log10(self, text):
        data = ppm.spelled(ppm.words_of(text))
        return sum(math.log10(self.probability(data[at - ppm.ORDER : at], data[at])) for at in range(ppm.ORDER, len(data)))


TEXTS = ["the cat sat on the mat", "The  cat\nran", "", "a dog and a cat and the rest", "zzz", "the the the the", "été à la mer", "cat"]


@pytest.fixture(scope="module")
def rows():
    return [(i, TEXTS[i % len(TEXTS)]) for i in range(24)] + [(100, None), (101, "the cat " * 3000), (None, "no id"), (3, TEXTS[3]), (3, TEXTS[3])]


@pytest.fixture(scope="module")
def scored(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    return df, ppm.score(df).collect()


def test_base_score_and_counts(rows, scored):
    want = sorted((("" if i is None else str(i)), *b) for (i, _), b in zip(rows, base(rows)))
    got = sorted((("" if r["doc_id"] is None else str(r["doc_id"])), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in scored[1])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_model_against_dictionaries(rows, scored):
    model = Plain([t for (i, t) in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1])
    by = {r["doc_id"]: r["score"] for r in scored[1]}
    for i, t in rows:
        assert by[i] == pytest.approx(model.log10(t), rel=1e-9), (i, t)


def test_probabilities_of_all_symbols_add_up(rows):
    texts = [t for _, t in rows[:20]]
    model = Plain(texts)
    for context in (b"the c", b"\xfe" * 5, b"qqqqq", b" cat "):
        assert sum(model.probability(context, s) for s in range(256) if s != ppm.START) == pytest.approx(1)


def test_no_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ppm.score(empty).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = ppm.score(spark.createDataFrame([(held, "a b", "x")], SCHEMA)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert r["score"] == pytest.approx(-4 * math.log10(255))


def test_pruned_trie_still_adds_up(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS * 5], "text STRING")
    counts = ppm.corpus_counts(texts)
    total = counts.filter("gram is not null").agg({"n": "sum"}).first()[0]
    trie = ppm.fit(counts, total, most=60)
    context = int.from_bytes(b"he ca", "big") << 8
    keys = np.array([context | s for s in range(256) if s != ppm.START], np.int64)
    assert (10 ** trie.log10(keys)).sum() == pytest.approx(1, abs=1e-6)


def test_long_text_in_blocks(spark, monkeypatch):
    texts = TEXTS + ["the cat sat " * 500]
    keys = [ppm.spelled(ppm.words_of(t)) for t in texts]
    counts = ppm.corpus_counts(spark.createDataFrame([(t,) for t in TEXTS], "text STRING"))
    trie = ppm.fit(counts, 1000)
    whole = ppm.code_lengths(trie, keys)
    monkeypatch.setattr(ppm, "BLOCK", 100)
    assert np.allclose(ppm.code_lengths(trie, keys), whole)


def test_no_gram_is_dropped(spark, rows, monkeypatch):
    """Whatever share of the n-grams is sent to the workers, the model is the whole one."""
    monkeypatch.setattr(ppm, "GRAMS", 20)
    monkeypatch.setattr(ppm.fit, "__defaults__", (20,))
    model = Plain([t for (i, t) in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1])
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    texts = dict(rows)
    for r in ppm.score(df).collect():
        assert r["score"] == pytest.approx(model.log10(texts[r["doc_id"]]), rel=1e-9), r["doc_id"]

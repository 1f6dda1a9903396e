import random

import pytest

from arborweb.llm import quality

DOCS = "doc_id LONG, text STRING, kept STRING"


def slow(text):
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    good = [" ".join(draw.choice(vocabulary) for _ in range(80)) for _ in range(40)]
    poor = [" ".join(draw.choice(vocabulary) + "###" for _ in range(80)) for _ in range(20)]
    odd = [None, "", "a b c " * 40, "x\ny\nx\n\n \n", "it's #1 & <b> café 　end", "one two three one two three", "word " * 5000]
    return [(i, t) for i, t in enumerate(good + poor + odd)]


def test_counts_and_verdicts(spark, corpus):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in [*corpus, corpus[0], (None, corpus[1][1])]], DOCS)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 60, 2)] + [(None, 1), (4, None)], "doc_id LONG, quality INT")
    got = quality.judge(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(corpus) + 2
    text = dict(corpus)
    for r in got:
        t = text[r["doc_id"]] if r["doc_id"] is not None else corpus[1][1]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == slow(t)
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["kept"] == (r["doc_id"] < 40)


def test_keep_returns_the_kept_rows_whole(spark, corpus):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in corpus], DOCS)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)], "doc_id LONG, quality INT")
    kept = quality.keep(docs, quality.fit(docs, labels))
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def test_without_labels_the_base_rule_decides(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x") for i, t in corpus], DOCS)
    none = spark.createDataFrame([], "doc_id LONG, quality INT")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.judge(docs, quality.fit(docs, none)).collect())
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), none)).collect() == []


def test_a_text_is_counted_by_itself_beside_one_of_many_words():
    many = " ".join(map(str, range(1 << 21))) + " x y x y"
    small = " ".join(f"w{k}" for k in range(60))
    twice = "a b c d e f a b c " + small
    together = quality.Rules().judge([many, small, twice])
    assert together["n_repeat_words"] == [0, 0, 6]
    assert [quality.Rules().judge([t])["n_repeat_words"][0] for t in (small, twice)] == [0, 6]
    # words beyond 21 bits within one text: pairs are numbered first
    import numpy as np

    own = np.concatenate([np.arange((1 << 21) + 5), np.arange((1 << 21) - 5, (1 << 21) + 2)])
    assert quality.repeated_words(own) == 14


def test_threshold():
    assert quality.threshold([], [1.0], 0.0) == float("-inf")
    assert quality.threshold([1.0, 2.0], [], 0.0) == 1.0
    assert quality.threshold([1.0, 2.0], [-1.0, -3.0], 0.0) == 0.0
    assert quality.threshold([1.0, 2.0], [1.5], 0.0) == 1.0


def test_ratio_is_the_quotient_of_two_multinomials(spark):
    import numpy as np

    docs = spark.createDataFrame([(1, "a b a", "x"), (2, "c c", "x")], DOCS)
    rules = quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id LONG, quality INT"))
    words = quality.Words()
    b, _ = quality.buckets(*words.number([b"a b a", b"c c"]))
    t, _ = quality.buckets(*words.number([b"a b a"]))
    raw, trusted = (np.bincount(x, minlength=quality.BUCKETS) for x in (b, t))
    want = np.log((trusted + 1) / (trusted.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert np.allclose(rules.ratio, want)

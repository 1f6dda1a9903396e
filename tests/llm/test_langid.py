import random
import zlib

import numpy as np
import pytest

from arborweb.llm import langid

SCHEMA = "doc_id LONG, text STRING, lang STRING, score STRING"
WORDS = {"aa": "the and with from that this there where have".split(), "bb": "für und nicht eine über wären schön".split(), "cc": "pas être où déjà ça nous vous".split()}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    out = [(k, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randrange(3, 60))), lang) for k, lang in enumerate(draw.choice(list(WORDS)) for _ in range(300))]
    return out + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !! \n 45", "bb"), (1003, "nicht und über", None), (None, "the and with that", "aa"), (1004, "the and " * 20000, "aa"), out[0], (1005, "the\0and with\0that there", "aa")]


@pytest.fixture(scope="module")
def model(spark, rows):
    return langid.train(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), steps=120)


def test_held_out_accuracy(spark, rows, model):
    got = langid.predict(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), model).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004, 1005)] == ["und", "und", "und", "bb", "aa", "aa"]
    assert by[1000]["score"] == 0


def test_numeric_characters_are_no_letters(model):
    texts = ["½", "²", "①", "Ⅷ", "٣", "１２", "_", "½ a", "ª", "Ω", "字"]
    said = [lang for lang, _ in langid._judge(model, texts)]
    assert [s == "und" for s in said] == [True] * 7 + [False] * 4


def test_a_result_depends_on_the_text_alone(model):
    texts = [b"the and with", b"eine sch\xc3\xb6n " * 30, b"x"]
    together = langid.pooled(model, texts)
    for t, row in zip(texts, together):
        assert np.allclose(langid.pooled(model, [t])[0], row, atol=1e-5)


def test_gradients_against_differences():
    m = langid.fresh(["a", "b"], hidden=3)
    draw = np.random.default_rng(0)
    data = draw.integers(97, 100, (6, 4)).astype(np.uint8)
    data[4:, 1] = 0
    label = np.array([0, 1, 1, 0])
    for w in m.weights():
        w[...] = draw.standard_normal(w.shape) * 0.3

    def loss():
        p = langid.position_probabilities(m, data).astype(float)
        real = data > 0
        return -np.mean([np.log(p[t, label[k], k]) for t in range(6) for k in range(4) if real[t, k]])

    for w, g in zip(m.weights(), langid._gradients(m, data, label)):
        flat = np.argsort(-np.abs(g.ravel()))[:4]
        for k in flat:
            at = np.unravel_index(k, w.shape)
            old, step = w[at], 1e-2
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert (up - down) / (2 * step) == pytest.approx(g[at], abs=2e-3)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "text", None, "")], SCHEMA)
    assert langid.train(none) is None
    assert [tuple(r)[2:] for r in langid.predict(none, None).collect()] == [("und", 0.0)]
    assert langid.predict(none.limit(0), None).collect() == []


def test_keep(spark, rows, model):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    kept = langid.keep(df, model)
    assert kept.schema == df.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i, _, _ in rows} - {1000, 1001, 1002}
    assert {r["lang"] for r in langid.keep(df, model, langs=["bb"]).collect() if r["lang"]} == {"bb"}


def test_every_language_is_learned(spark):
    rows = [(i, f"word{i % 70} text", f"l{i % 70:02}") for i in range(700)]
    model = langid.train(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"), steps=1)
    assert sorted(model.langs) == sorted({r[2] for r in rows})


@pytest.mark.parametrize("key", [k for k in range(20) if zlib.crc32(str(k).encode()) % 5][:4])
def test_rows_of_one_id_are_drawn_each_by_itself(spark, key, monkeypatch):
    """3,000 labelled rows of one id, and one row 500 times: about ``per_lang`` of them are learned
    from, whatever the id."""
    taken = []
    monkeypatch.setattr(langid, "fit", lambda rows, steps: taken.extend(rows))
    rows = [(key, f"text number {i}", "aa") for i in range(3000)] + [(key, "the same again", "aa")] * 500
    langid.train(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"), per_lang=100)
    assert 40 < len(taken) < 200 and len(set(taken)) == len(taken)

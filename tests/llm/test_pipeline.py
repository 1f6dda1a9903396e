import random

import pytest

import corpus_pipeline
from arborweb.llm import queries
from test_bpe import reference  # noqa: F401
from test_simhash import brute as groups

WORDS = {"en": [f"en{i}the" for i in range(90)], "de": [f"ü{i}sch" for i in range(90)]}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small corpus: clean documents, copies, near copies, junk, and texts that are none."""
    draw = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randrange(60, 200))), lang, f"s{i % 4 and 1}"))
        if i % 2:
            labels.append((i, 1, 0))
    for i in range(160, 200):
        rows.append((i, " ".join(draw.choice(WORDS["en"]) + "###" for _ in range(80)), "en", "s2"))
        labels.append((i, 0, 0))
    for i in range(200, 215):
        rows.append((i, rows[i - 200][1], rows[i - 200][2], "s3"))
    for i in range(215, 220):
        text = rows[i - 200][1].split()
        rows.append((i, " ".join([*text, text[0]]), rows[i - 200][2], None))
    rows += [(300, None, "en", "s1"), (301, "", None, "s1"), (302, "12 34 !!", "de", "s1"), (303, "too short", "en", "s1"), (None, rows[3][1], "en", "s1"), rows[4], (304, "wort für wort " * 4000, "de", "s1")]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "kept") for r in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, kept STRING")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def ids(df):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect())


def test_the_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mix_sources", "encode"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert stages[5].columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_language(stages):
    assert set(ids(stages[0])) - set(ids(stages[1])) == {300, 301, 302}


def test_quality_keeps_clean_documents(stages):
    gone = set(ids(stages[1])) - set(ids(stages[2]))
    assert gone == {*range(160, 200), 303, 304}


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = sorted({c for _, _, c in groups(rows)})
    assert ids(stages[3]) == want
    assert not set(range(200, 215)) & set(want) and set(range(160)) >= set(want) - {*range(215, 220)}


def test_mixing_replicates_rows_whole(spark, stages):
    from arborweb.llm import mixing

    want = sorted((r["doc_id"], r["text"]) for r in mixing.mix(stages[3]).collect())
    assert sorted((r["doc_id"], r["text"]) for r in stages[4].collect()) == want


def test_encoding(stages, reference):  # noqa: F811
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    got = stages[5].collect()
    assert len(got) == stages[4].count()
    assert all(list(r["ids"]) == reference.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in got)


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    key = lambda r: (r["doc_id"], r["n_tokens"], r["decoded_sha256"])
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, stages[5].collect()))


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_its_query():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{n}" for n in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert all(isinstance(sql, str) for sql in queries.oracle_sql().values())

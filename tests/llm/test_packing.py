import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborweb.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "a ", "a  b", " a", "a\n b", "x. y", "don't. I'll, we've.'", "a.,b .c ,., x.,.", "<|endoftext|> hi", "word\x85 x", "a\x1c b", "a \x0b", "ß. é, 中文. 😀", "x" * 5000, "a b " * 3000]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(open(PATH, encoding="utf-8").read())


def ids_of(encoder, texts):
    return [x.tolist() for ids, n in encoder.encode(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]


def test_ids_are_those_of_the_tokenizer(encoder, plain, monkeypatch):
    draw = random.Random(3)
    pool = list("abcXYZ019.,;'! \n\t é中😀\x85 \x1c\x0bßsdtll") + [" "] * 8
    texts = ODD + ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(4000)]
    want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids_of(encoder, texts) == want
    # what is remembered, or forgotten, changes nothing
    monkeypatch.setattr(packing, "MEMO", 50)
    assert ids_of(encoder, texts[::-1]) == want[::-1] and ids_of(encoder, []) == []


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_the_curve_visits_each_cell_and_its_neighbour_next(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = packing.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert set(np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1)) == {1}


def test_what_is_left_falls_into_powers_of_two():
    assert packing.ends_of(2048, 1024) == [2048] and packing.ends_of(0, 1024) == [0]
    assert packing.ends_of(1024 + 700, 1024) == [1024, 1536, 1664, 1696, 1712, 1720, 1724]
    assert np.diff(packing.ends_of(10 * 100 + 37, 100)).tolist() == [32, 4, 1]


def check(rows, want, length):
    """Pieces hold every document whole, and sequences have no gaps and no padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    got = []
    for key, pieces in docs.items():
        pieces.sort(key=lambda r: r["start"])
        own = [x for r in pieces for x in struct.unpack(f"<{r['length']}I", r["ids"])]
        assert all(len(own) == r["doc_tokens"] for r in pieces) or key in (None, 7)
        got.append((str(key), own))
    assert sum(len(x) for _, x in got) == sum(map(len, want))
    sizes = []
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        sizes.append(at)
    assert all(s == length or s & (s - 1) == 0 for s in sizes) and sum(s == length for s in sizes) == sum(map(len, want)) // length
    return dict(got)


def test_packing_whole_documents(spark, plain):
    texts = ODD + ["the same text", "the same text", "other words here"] * 40
    docs = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts, 100)], "doc_id LONG, text STRING, ids STRING, row INT").repartition(5)
    pieces = packing.pack(docs, PATH, length=64)
    want = {str(k): e.ids + [0] for k, e in enumerate(plain.encode_batch([t or "" for t in texts], add_special_tokens=False), 100)}
    assert check(pieces.collect(), want.values(), 64) == want
    whole = packing.sequences(pieces).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] == 4 * sum(p["length"] for p in r["pieces"]) for r in whole)


def test_repeated_rows_and_null_ids_are_documents_of_their_own(spark, plain):
    docs = spark.createDataFrame([(7, "twice told")] * 3 + [(None, "no id")] * 2, "doc_id LONG, text STRING")
    rows = packing.pack(docs, PATH, length=8).collect()
    two, none = (len(plain.encode(t).ids) + 1 for t in ("twice told", "no id"))
    check(rows, [[0] * two] * 3 + [[0] * none] * 2, 8)
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == 3 * two and {r["doc_tokens"] for r in rows} == {two, none}


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert packing.pack(docs, PATH).collect() == []


def test_neighbours_on_the_curve_are_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    of = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    documents = packing.tokenized(docs, open(PATH, encoding="utf-8").read()).cache()
    where, total = packing.placed(documents)
    order = [of[r["doc_id"]] for r in documents.join(where, "row").orderBy("at").select("doc_id").collect()]
    assert total == documents.agg(F.sum("n")).first()[0]
    same = np.mean([a == b for a, b in zip(order, order[1:])])
    chance = sum(order.count(x) ** 2 for x in set(order)) / len(order) ** 2
    assert same > chance + 0.2
    documents.unpersist()

import base64
import random

import public_tokenizers
import pytest
import tiktoken

from arborweb.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", "a", " ", "  \n\n  x", "it's we'LL I'd", "héllo wörld 中文字 😀👍🏽", "\u0085  x", "<|endoftext|> text", "1234567 ٣٤٥ ½", "x" * 3000, "!!!???..." * 50, "\x00\x01\x1f\x7f", "é‍", "ÀÉ" * 700]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), PATTERN)


def test_ids_are_those_of_the_ranks(codec, reference):
    draw = random.Random(7)
    pool = [chr(draw.randrange(0x20, 0x7F)) for _ in range(50)] + list("éü中😀 \n\t'sdll ")
    texts = ODD + ["".join(draw.choice(pool) for _ in range(draw.randrange(80))) for _ in range(3000)]
    assert codec.ids(texts) == [reference.encode_ordinary(t) for t in texts]


def test_round_trip_and_spans(codec):
    for t in ODD:
        (ids,) = codec.ids([t])
        assert codec.text_bytes(ids) == t.encode()
        spans = codec.spans(t, ids)
        assert all(a < b for a, b in spans)
        covered = {k for a, b in spans for k in range(a, b)}
        assert covered == set(range(len(t)))


def test_a_character_split_over_ids(codec):
    (ids,) = codec.ids(["👍🏽"])
    assert len(ids) > 2
    assert codec.text_bytes(ids[:1]).decode("utf-8", "replace").startswith("�")
    assert codec.spans("👍🏽", ids)[0] == (0, 1)


def test_memory_starts_afresh(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    for t in ("one two three four five six seven", "eight nine ten eleven", "one nine " * 9):
        assert codec.ids([t, "a b"]) == [reference.encode_ordinary(t), reference.encode_ordinary("a b")]


def test_table(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(100, None, "clash"), (None, "no id", "clash"), (1, "a", "clash"), (101, "long text é " * 20000, "clash")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, ids STRING")
    coded = bpe.encode(df, PATH, PATTERN, decoded=True)
    got = coded.collect()
    text = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == reference.encode_ordinary(text[r["doc_id"]])
        assert bytes(r["decoded"]) == text[r["doc_id"]].encode()
    back = bpe.decode(coded.select("doc_id", "ids"), PATH, PATTERN).collect()
    assert all(r["text"] == text[r["doc_id"]] for r in back)
    assert bpe.encode(df.limit(0), PATH, PATTERN).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id LONG, ids ARRAY<INT>")
    assert [tuple(r) for r in bpe.decode(nulls, PATH, PATTERN).collect()] == [(1, bytearray(b""), "")]


def test_offsets_of_each_row(spark, codec):
    df = spark.createDataFrame([*enumerate(ODD), (100, None)], "doc_id LONG, text STRING")
    text = dict([*enumerate(ODD), (100, None)])
    for r in bpe.encode(df, PATH, PATTERN, offsets=True).collect():
        assert [(o["start"], o["end"]) for o in r["offsets"]] == codec.spans(text[r["doc_id"]], r["ids"])

"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The merge table comes from a file of public ranks (``base64-token rank`` lines). A
text is cut by the pattern, each match is mapped byte by byte to printable
characters and merged on its own. Decoding maps the characters of each id back to
bytes and joins the bytes before any UTF-8 is read, so characters that are split
over several ids come back whole.

Defined results: a null or empty text has no ids, and decodes to no bytes. Repeated
rows and ids are handled row by row. Texts of any length are coded whole. Columns other
than the key and the text are not read, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from .common import map_arrow, slices, utf8

#: Different matches a worker remembers; beyond it the memory starts afresh.
MEMO = 250_000

#: After a match longer than this the memory starts afresh: such matches are rare, and
#: would fill it if kept.
MEMO_CHARS = 256


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand
    for themselves, the rest take the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder for one rank table. ``ids`` of a text, ``spans`` of its ids,
    ``text_bytes`` of ids."""

    def __init__(self, ranks: bytes, pattern: str):
        chars = byte_chars()
        self.back = {c: b for b, c in enumerate(chars)}
        self.find = regex.compile(pattern).findall
        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        said = {t: "".join([chars[b] for b in t]) for t in tokens}
        # every pair that forms a token may merge, in the order of the token's rank
        merges = [(said[t[:k]], said[t[k:]]) for t in sorted(tokens, key=tokens.get) for k in range(1, len(t)) if t[:k] in said and t[k:] in said]
        self.tokenizer = Tokenizer(models.BPE({said[t]: r for t, r in tokens.items()}, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = [b""] * (max(tokens.values(), default=-1) + 1)
        for word, r in self.tokenizer.get_vocab(with_added_tokens=False).items():
            spelled[r] = bytes([self.back[c] for c in word])
        # the bytes of all ids in a row, and where those of each begin
        self.table = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(w) for w in spelled], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self._forget()

    def _forget(self) -> None:
        """Empties the memory of matches: ``memo`` numbers them, and the ids of match k are
        ``pool[start[k] : start[k] + count[k]]``."""
        self.full = False
        self.memo: dict[str, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): all ids of the texts in a row, and where those of each text end."""
        cut = [self.find(t) if t else [] for t in texts]
        parts = list(chain.from_iterable(cut))
        if self.full or len(self.memo) > MEMO:
            self._forget()
        match = np.fromiter(map(self.memo.get, parts, repeat(-1)), np.int64, len(parts))
        missed = np.flatnonzero(match < 0)
        if len(missed):
            unknown = [parts[k] for k in missed.tolist()]
            new = list(dict.fromkeys(unknown))
            made = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
            self.count = np.concatenate([self.count, sizes])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))])
            match[missed] = np.fromiter(map(self.memo.__getitem__, unknown), np.int64, len(unknown))
            if max(map(len, new)) > MEMO_CHARS:
                self.full = True
        counts = self.count[match]
        done = np.cumsum(counts)
        ids = self.pool[_gather(self.start[match], counts, done)]
        last = np.cumsum([len(x) for x in cut])
        return np.concatenate([[0], done])[last], ids

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text, given as from ``encode``."""
        counts = self.sizes[ids]
        done = np.cumsum(counts)
        data = self.table[_gather(self.begins[ids], counts, done)].tobytes()
        stops = np.concatenate([[0], done])[ends].tolist()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        ends, ids = self.encode(texts)
        return [x.tolist() for x in np.split(ids, ends[:-1])] if len(ends) else []

    def spans(self, text: str | None, ids: list[int]) -> list[tuple[int, int]]:
        """For each id, the characters [start, end) that its bytes touch; a character split
        over ids is in the span of each."""
        starts, at = [], 0
        for c in text or "":
            starts += [at] * len(utf8(c))
            at += 1
        out, b = [], 0
        for i in ids:
            n = int(self.sizes[i])
            out.append((starts[b], starts[b + n - 1] + 1))
            b += n
        return out

    def text_bytes(self, ids: list[int]) -> bytes:
        return self.decode(np.array(ids, np.int64), np.array([len(ids)]))[0]


def _gather(start: np.ndarray, counts: np.ndarray, done: np.ndarray) -> np.ndarray:
    """The places start[k] to start[k] + counts[k] - 1 for each k in turn; ``done`` is the
    running sum of ``counts``."""
    return np.repeat(start - (done - counts), counts) + np.arange(done[-1] if len(done) else 0)


@lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False, offsets: bool = False) -> DataFrame:
    """``key, ids ARRAY<INT>`` of each row of ``docs``, with ``decoded`` also
    ``decoded BINARY``, the bytes that the ids decode to, and with ``offsets`` also
    ``offsets ARRAY<STRUCT<start INT, end INT>>``, the characters that each id touches.

    The driver reads the rank file (under 1 MB) and sends it to the workers, which
    need no file of their own.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    fields = [pa.field("ids", pa.list_(pa.int32()))] + [pa.field("decoded", pa.binary())] * decoded
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    fields += [pa.field("offsets", pa.list_(span))] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        for batch in slices(batches, 64):
            texts = batch.column(1).to_pylist()
            ends, ids = codec.encode(texts)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                columns.append(pa.array(codec.decode(ids, ends), pa.binary()))
            if offsets:
                parts = np.split(ids, ends[:-1]) if len(ends) else []
                found = [codec.spans(t, part.tolist()) for t, part in zip(texts, parts, strict=True)]
                columns.append(pa.array([[{"start": a, "end": b} for a, b in f] for f in found], pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(0), *fields]))

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decoded + [T.StructField("offsets", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))] * offsets)
    return map_arrow(docs.select(key, text), run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, decoded BINARY, text STRING`` of each row's ids. Bytes that are no UTF-8, as
    from ids cut off inside a character, become U+FFFD in ``text`` only. Null ids
    decode to nothing."""
    sent = encoded.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        for batch in slices(batches):
            raw = [codec.text_bytes(i or []) for i in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(0), ("decoded", pa.binary()), ("text", pa.string())]))

    schema = T.StructType([encoded.schema[key], T.StructField("decoded", T.BinaryType()), T.StructField("text", T.StringType())])
    return map_arrow(encoded.select(key, ids), run, schema)

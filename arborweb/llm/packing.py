"""Packing documents into token sequences along a space-filling curve.

Each document is tokenized once. Its hashed vector (logarithms of the counts of hashed token
ids, of length one) is projected to four fixed random directions; the projections are put on
one scale by their mean and deviation over all documents and read as a cell of a Hilbert curve.
Documents are range-sorted by the cell's place on the curve, ties by row, and their tokens
laid end to end in that order; the stream is cut at every ``length`` tokens, and what is
left at its end at powers of two. So neighbours on the curve share sequences, no sequence but
the last few is shorter than the rest, and none is padded.

The order is global: each range of the curve sums its own documents, and the sums of the
ranges before it, as many as there are partitions, say where it begins.

Defined results: a null or empty text is the closing id alone. Rows of one id, and repeated
rows, are documents of their own. Documents of equal texts (a third of all rows, say) have one
cell and are told apart by row, so their range is split like any other. Texts of any length
are read whole. The strings of special tokens in a text are ordinary text. An empty table gives
an empty result. Columns other than the key and the text are not read, whatever their names.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import in_bytes, map_arrow, stored

LENGTH = 1024
#: The id that closes a document.
END = 0
#: Hashed features of a document's vector, directions it is projected to, bits of each.
FEATURES, AXES, BITS = 1024, 4, 15
#: Bytes of text that are tokenized together: parts that occur more than once are merged once.
TEXT_BYTES = 1 << 24
#: Different words whose ids a worker remembers; beyond it the memory starts afresh.
MEMO = 500_000
#: Words longer than this are not remembered.
MEMO_CHARS = 64
#: Different parts that are given to the tokenizer as one text.
JOINED = 1000
#: Documents whose ids are gathered together.
DOCS = 256
#: White space, for RE2: what any reading of the pattern may take as such.
WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


class Encoder:
    """Ids of texts by a byte-level tokenizer file whose pattern has a space at the head of a
    match only, and letters and digits, other characters and white space in matches of their
    own. A single space between two other characters then always begins a match, and so does
    a stop or comma after a letter or digit: texts are cut there, and of equal parts one is
    tokenized."""

    def __init__(self, file: str):
        # tasks are the unit of parallel work here
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        # a byte-level token has a character for each byte
        self.sizes = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
        for word, k in vocab.items():
            self.sizes[k] = len(word)
        self._forget()

    def _forget(self) -> None:
        """Empties the memory of words: ``memo`` numbers them, and the ids of word k are
        ``count[k]`` from ``start[k]`` on in ``pool``."""
        self.memo: dict[str, int] = {}
        self.pool, self.start, self.count = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def kind(self) -> np.dtype:
        """What holds an id: two bytes, if the vocabulary allows."""
        return np.dtype("<u2" if len(self.sizes) <= 1 << 16 else "<u4")

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of texts, each by itself."""
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), self.kind, int(counts.sum())), counts

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words with a space before each, that neither begin nor end with white
        space: many are tokenized as one text, and their bytes say whose each id is."""
        texts = ["".join([" " + w for w in words[at : at + JOINED]]) for at in range(0, len(words), JOINED)]
        ids, _ = self.whole(texts)
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1, prepend=0)

    def words(self, words: pa.Array, seen: np.ndarray) -> np.ndarray:
        """The numbers of different words, ``seen`` so often, in the memory. Those it lacks are
        added; for later texts only those seen more than once, so that rare words do not fill it."""
        if len(self.memo) > MEMO or len(self.count) > 3 * MEMO:
            self._forget()
        said = words.to_pylist()
        number = np.fromiter(map(self.memo.get, said, repeat(-1)), np.int64, len(said))
        missed = np.flatnonzero(number < 0)
        plain = ~(_fits(words, f"^({WHITE}|$)") | _fits(words, f"({WHITE}|^)$"))[missed]
        for some, make in ((missed[plain], self.joined), (missed[~plain], lambda odd: self.whole([" " + w for w in odd]))):
            new = [said[k] for k in some.tolist()]
            ids, count = make(new)
            number[some] = np.arange(len(self.count), len(self.count) + len(new))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(count) - count])
            self.count, self.pool = np.concatenate([self.count, count]), np.concatenate([self.pool, ids])
            self.memo.update((w, k) for w, k, n in zip(new, number[some].tolist(), seen[some].tolist(), strict=True) if n > 1 and len(w) <= MEMO_CHARS)
        return number

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) of the texts, ``DOCS`` at a time; a null one is empty."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        begin = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        parts, place = coded.dictionary, coded.indices.to_numpy()
        opens, shuts = _fits(parts, f"^({WHITE}|$)"), _fits(parts, f"({WHITE}|^)$")
        first, last = np.zeros(len(place), bool), np.zeros(len(place), bool)
        first[begin[:-1]], last[begin[1:] - 1] = True, True
        # white space beside a cut: a text whose cuts are not sure is tokenized whole
        loose = np.concatenate([[0], np.cumsum((opens[place] & ~first) | (shuts[place] & ~last))])
        unsure = loose[begin[1:]] > loose[begin[:-1]]

        stems = pc.utf8_rtrim(parts, ".,")
        stems = pc.if_else(pc.match_substring_regex(stems, "[A-Za-z0-9ß-öø-ÿ]$"), stems, parts)
        sizes = (pc.binary_length(parts).to_numpy() - pc.binary_length(stems).to_numpy()).astype(np.int64)
        stems = stems.dictionary_encode()
        # what follows a stem: nothing, a stop, a comma, or more of them
        more = np.flatnonzero(sizes > 1)
        others = pa.array([w[-n:] for w, n in zip(parts.take(pa.array(more)).to_pylist(), sizes[more].tolist(), strict=True)], pa.string()).dictionary_encode()
        tail = np.where(sizes == 0, 0, np.where(pc.ends_with(parts, ".").to_numpy(zero_copy_only=False), 1, 2))
        tail[more] = 3 + others.indices.to_numpy()

        # the ids of words in memory, of tails and of heads of texts in a row
        stem = stems.indices.to_numpy()
        number = self.words(stems.dictionary, np.bincount(stem, np.bincount(place, minlength=len(parts)), len(stems.dictionary)))[stem]
        tails, tail_counts = self.whole(["", ".", ",", *others.dictionary.to_pylist()])
        heads, head_counts = self.whole(lists.values.take(pa.array(begin[:-1])).to_pylist())
        at = len(self.count)
        ids = np.concatenate([self.pool, tails, heads])
        count = np.concatenate([self.count, tail_counts, head_counts])
        start = np.concatenate([self.start, len(self.pool) + np.cumsum(count[at:]) - count[at:]])
        tail += at
        at_heads = at + len(tail_counts)

        for lo in range(0, len(texts), DOCS):
            hi = min(lo + DOCS, len(texts))
            some = place[begin[lo] : begin[hi]]
            piece = np.stack([number[some], tail[some]], 1)
            piece[begin[lo:hi] - begin[lo]] = np.stack([np.arange(at_heads + lo, at_heads + hi), np.full(hi - lo, at)], 1)
            n = count[piece.ravel()]
            done = np.cumsum(n)
            made = ids[np.repeat(start[piece.ravel()] - (done - n), n) + np.arange(done[-1] if len(done) else 0)]
            per = np.diff(np.concatenate([[0], done])[2 * (begin[lo : hi + 1] - begin[lo])])
            if unsure[lo:hi].any():
                own = np.split(made, np.cumsum(per)[:-1])
                for k in np.flatnonzero(unsure[lo:hi]).tolist():
                    own[k] = self.whole([texts[lo + k].as_py()])[0]
                made, per = np.concatenate(own), np.array([len(x) for x in own])
            yield made, per


def _fits(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


@lru_cache(maxsize=1)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


def directions(features: int = FEATURES, axes: int = AXES) -> np.ndarray:
    """Fixed random directions, one column for each axis."""
    return np.random.default_rng(20240601).standard_normal((features, axes))


def projected(ids: np.ndarray, counts: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The projections of the hashed vectors of documents, given as from ``Encoder.encode``."""
    n, features = len(counts), len(axes)
    bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % features
    seen = np.log1p(np.bincount(np.repeat(np.arange(n), counts) * features + bucket, minlength=n * features).reshape(n, features))
    norm = np.sqrt((seen * seen).sum(1, keepdims=True))
    return (seen / np.where(norm > 0, norm, 1)) @ axes


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places on a Hilbert curve of cells, a row of coordinates below 2^bits each; cells
    that follow each other on the curve are neighbours in one coordinate."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(axes):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inside, q - 1, swap)
            x[i] ^= swap if i else 0
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turned
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def tokenized(docs: DataFrame, file: str, *, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """``key, row, n, x ARRAY<DOUBLE>, ids BINARY`` of each document: how many ids it has with
    the closing one, its projections and its ids, two little-endian bytes each if the
    vocabulary allows. ``row`` is its place in the input; store the table to keep it."""
    sent = docs.sparkSession.sparkContext.broadcast(file)
    axes = directions()
    whole = pa.schema([("n", pa.int64()), ("x", pa.list_(pa.float64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in in_bytes(batches, TEXT_BYTES, 1):
            at = 0
            for ids, counts in encoder.encode(batch.column(1)):
                x = projected(ids, counts, axes)
                stops = np.cumsum(counts)
                closed = np.insert(ids, stops, end).astype(encoder.kind).tobytes()
                width = encoder.kind.itemsize
                edges = (np.concatenate([[0], stops + np.arange(1, len(stops) + 1)]) * width).tolist()
                blobs = pa.array([closed[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), pa.array(counts + 1), flat, blobs], schema=pa.schema([batch.schema.field(0), *whole]))
                at += len(counts)

    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("n BIGINT, x ARRAY<DOUBLE>, ids BINARY").fields])
    return map_arrow(docs.select(key, text), run, schema).withColumn("row", F.monotonically_increasing_id())


def placed(documents: DataFrame) -> tuple[DataFrame, int]:
    """(``row, at``, all ids): where each of the ``tokenized`` documents begins in the stream of
    all, in the order of the curve."""
    spark = documents.sparkSession
    scale = documents.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(AXES) for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = np.array([scale[0::2], scale[1::2]], float)
    spread = np.where(spread > 0, spread, 1.0)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, AXES)
            inside = 1 / (1 + np.exp(-1.7 * (x - mean) / spread))
            cells = np.minimum((inside * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert(cells))], names=["row", "n", "place"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = total + np.cumsum(batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(upto), part)), pa.array(upto - batch.column(1).to_numpy()), pa.array(upto)], names=["row", "part", "before", "upto"])
            total = int(upto[-1]) if len(upto) else total

    on_curve = map_arrow(documents.select("row", "n", "x"), places, T.StructType.fromDDL("row BIGINT, n BIGINT, place BIGINT"))
    ordered = on_curve.repartitionByRange("place", "row").sortWithinPartitions("place", "row").select("row", "n")
    local = stored(map_arrow(ordered, summed, T.StructType.fromDDL("row BIGINT, part BIGINT, before BIGINT, upto BIGINT")))
    # a number for each partition
    sums = sorted((r["part"], r["n"]) for r in local.groupBy("part").agg(F.max("upto").alias("n")).collect())
    begins = np.concatenate([[0], np.cumsum([n for _, n in sums])]).astype(int).tolist()
    parts = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, begins, strict=False)], "part BIGINT, base BIGINT")
    return local.join(F.broadcast(parts), "part").select("row", (F.col("base") + F.col("before")).alias("at")), begins[-1]


def ends_of(total: int, length: int) -> list[int]:
    """The cuts after the last full sequence of a stream: what is left falls into powers of two."""
    at = total - total % length
    out = [at]
    for k in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> k & 1:
            at += 1 << k
            out.append(at)
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """``key, start, length, ids BINARY, doc_tokens, sequence_id, offset``: the pieces of
    documents that sequences are made of. ``ids`` are four little-endian bytes each; the
    pieces of a sequence follow each other without gaps from offset 0.

    The driver reads the tokenizer file (a few MB) and sends it to the workers.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        file = f.read()
    documents = stored(tokenized(docs, file, key=key, text=text, end=end))
    where, total = placed(documents)
    rest = ends_of(total, length)
    kind = Encoder(file).kind
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, DOCS):
                batch = big.slice(lo, DOCS)
                owner, rows = [], []
                for k, (at, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    ids = np.frombuffer(batch.column(3)[k].as_buffer(), kind).astype("<u4").tobytes()
                    full = range((at // length + 1) * length, min(at + n, rest[0]) + 1, length)
                    edges = sorted({at, at + n, *full, *[e for e in rest if at < e < at + n]})
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        tail = bisect_right(rest, a) - 1
                        sequence = a // length if tail < 0 else rest[0] // length + tail
                        begin = a - a % length if tail < 0 else rest[tail]
                        owner.append(k)
                        rows.append((a - at, b - a, ids[4 * (a - at) : 4 * (b - at)], n, sequence, a - begin))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], schema=pa.schema([batch.schema.field(0), *fields]))

    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("start BIGINT, length BIGINT, ids BINARY, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT").fields])
    return map_arrow(documents.join(where, "row").select(key, "at", "n", "ids"), run, schema)


def sequences(pieces: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``sequence_id, n_tokens, ids BINARY, pieces``: the sequences of ``pack``, ready to be
    read as little-endian 32-bit ids, with where each document's tokens stand in them."""
    some = F.sort_array(F.collect_list(F.struct("offset", "length", F.col(key).alias(key), "start", "ids")))
    whole = pieces.groupBy("sequence_id").agg(some.alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), ""))
    return whole.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("p", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p[key].alias(key), p["start"].alias("start"))).alias("pieces"))

"""Language-model scoring by prediction by partial matching.

A byte-context trie of up to ``ORDER`` bytes of context is counted over the training
documents. A byte is predicted in the longest context that the trie knows; a byte
unseen there escapes to the next shorter one, whose bytes seen in the longer context
are excluded. The escape takes ``DISCOUNT`` from each count, as method D takes a half,
and the counts that were pruned from a context. Below the empty context the bytes never
seen share the rest evenly. The score of a document is the log10 probability of its
tokens, spelled with one space between words, and of the end of the text: a pretrained
code length.

No n-gram is dropped: what ``score`` gathers grows with the corpus. The n-grams of each
length are a table dealt over buckets by context. The longest n-grams that make up at
least one in ``GRAMS`` of the training bytes, at most that many, are sent to the workers
with their probabilities; what else a text holds meets the tables bucket by bucket, from
the longest context down, until its byte is found. N-grams of one and two bytes, at most
65,792, are sent as well.

The baseline beside it is a smoothed unigram model of tokens. Counts of the words that
make up at least one in ``WORDS`` of the training tokens, at most that many, are sent to
the workers; all other words meet their counts in a shuffled join.

``fit`` makes a trie for one process. As it is closed under suffixes, the bytes excluded
at a context are known from the longer one alone. So the probability of each n-gram is one
number, and each context needs two more: what an escape from it adds if the byte is found
in the next shorter context, and if it is not. Such a trie may be pruned; ``score`` does
not use it.

Defined results: A-Z are lower-cased; words are runs of bytes other than space and
U+0009 to U+000D; a null text is empty and has the end token only. Without training
documents a byte's probability is 1/255. Repeated rows and ids are scored row by row. Texts
of any length are scored whole. Columns other than the key and the text are not read,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, remainder, slices, spooled, utf8

ORDER = 5
GRAMS = 1 << 22
WORDS = 1 << 20
#: What is taken from each count for the escape.
DISCOUNT = 0.3
#: Bytes that never stand in UTF-8: before a text, and after it.
START, END = 0xFE, 0xFF
#: Symbols that can be coded: all bytes but START.
SYMBOLS = 255
#: Bytes that are scored together.
BLOCK = 1 << 20
#: Training bytes for each bucket of the n-gram tables.
BUCKET = 1 << 23
#: Texts, and n-grams of theirs, that ask the tables together.
ASK_ROWS, ASK_GRAMS = 1 << 16, 1 << 20
#: Of the levels, context lengths up to this one are sent to the workers whole.
SENT = 1

_PAD = bytes([START]) * ORDER
_END = bytes([END])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def spelled(words: list[bytes]) -> bytes:
    """The coded bytes of a text between its marks."""
    return _PAD + b" ".join(words) + _END


def gram_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte to be coded (all but START): the number made of it and the ``ORDER``
    bytes before it, and its place in ``data``."""
    n = len(data) - ORDER
    key = np.zeros(max(n, 0), np.int64)
    for i in range(ORDER + 1):
        key <<= 8
        key |= data[i : i + n]
    coded = np.flatnonzero(data[ORDER:] != START)
    return key[coded], coded + ORDER


class Index:
    """A hash table of int64 keys, with a float64 value and the place of each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * max(len(keys), 1)))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.value = np.zeros(1 << bits)
        self.place = np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.key[slot] == -1
            taken, one = np.unique(slot[free], return_index=True)
            now = left[free][one]
            self.key[taken], self.value[taken], self.place[taken] = keys[now], values[now], now
            again = ~np.isin(left, now)
            left, slot = left[again], (slot[again] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _FACTOR) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the slot of each key, whether it is there)."""
        slot = self._slot(keys)
        held = self.key[slot]
        hit = held == keys
        more = np.flatnonzero(~hit & (held != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            held = self.key[slot[more]]
            hit[more] = held == keys[more]
            more = more[(held != keys[more]) & (held != -1)]
        return slot, hit


@dataclass
class Trie:
    """By context length k: ``grams`` with the log10 probability of their last byte,
    ``contexts`` with their places in ``found`` and ``unfound``, what an escape from the
    context adds when the byte is, or is not, in the next shorter context. ``rest``: log10
    probability of a byte that the empty context lacks."""

    grams: list[Index]
    contexts: list[Index]
    found: list[np.ndarray]
    unfound: list[np.ndarray]
    rest: float

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each n-gram given its context."""
        slot, hit = self.grams[ORDER].find(keys)
        out = np.where(hit, self.grams[ORDER].value[slot], 0.0)
        at = np.flatnonzero(~hit)
        left = keys[at]
        entered, context = self._enter(ORDER, left)
        for k in range(ORDER - 1, -1, -1):
            if not len(at):
                return out
            left = left & ((1 << (8 * (k + 1))) - 1)
            slot, hit = self.grams[k].find(left)
            add = np.where(hit, self.found[k + 1][context], self.unfound[k + 1][context]) if len(self.found[k + 1]) else np.zeros(len(at))
            out[at] += np.where(entered, add, 0.0) + np.where(hit, self.grams[k].value[slot], 0.0)
            at, left = at[~hit], left[~hit]
            entered, context = self._enter(k, left)
        out[at] += np.where(entered, self.rest, -np.log10(SYMBOLS))
        return out

    def _enter(self, k: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot, there = self.contexts[k].find(grams >> 8)
        return there, np.where(there, self.contexts[k].place[slot], 0)


def build(levels: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """The trie of kept n-grams and counts by context length (``levels``), and the total
    counts of contexts, pruned n-grams included (``totals``)."""
    grams, contexts, found, unfound = [], [], [], []
    below: tuple = ()
    rest = -np.log10(SYMBOLS)
    for k in range(ORDER + 1):
        order = np.argsort(levels[k][0])
        g, n = levels[k][0][order], levels[k][1][order] - DISCOUNT
        x, first, own = np.unique(g >> 8, return_index=True, return_inverse=True)
        kinds = np.bincount(own, minlength=len(x)).astype(np.float64)
        seen = np.add.reduceat(n, first) if len(x) else n
        by = np.argsort(totals[k][0])
        total = totals[k][1][by][np.searchsorted(totals[k][0][by], x)] if len(x) else seen
        pruned = total - (seen + DISCOUNT * kinds)
        escape = DISCOUNT * kinds + pruned
        grams.append(Index(g, np.log10(n / (seen + escape)[own])))
        contexts.append(Index(x, np.zeros(len(x))))
        if k == 0:
            found.append(np.zeros(len(x)))
            unfound.append(np.zeros(len(x)))
            if len(x):
                rest = float(np.log10(escape[0] / (seen + escape)[0]) - np.log10(max(1.0, SYMBOLS - kinds[0])))
        else:
            g1, n1, x1, seen1, kinds1, pruned1, escape1 = below
            low = (1 << (8 * k)) - 1
            shorter = np.searchsorted(x1, x & (low >> 8))
            excluded = np.add.reduceat(n1[np.searchsorted(g1, g & low)], first) if len(x) else n
            left_n = seen1[shorter] - excluded
            left_e = DISCOUNT * (kinds1[shorter] - kinds) + pruned1[shorter]
            left = left_n + left_e
            gone = left < 1e-9
            safe = np.where(gone, 1.0, left)
            out = escape / (seen + escape)
            all1 = seen1[shorter] + escape1[shorter]
            with np.errstate(divide="ignore"):
                found.append(np.log10(out * all1 / safe))
                unfound.append(np.log10(out * np.where(gone, 1.0, left_e / safe) / (escape1[shorter] / all1)))
        below = (g, n, x, seen, kinds, pruned, escape)
    return Trie(grams, contexts, found, unfound, rest)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, first = np.unique(keys[order], return_index=True)
    return keys, np.add.reduceat(n[order], first) if len(keys) else n


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``gram, word, n`` over all rows of ``texts (text)``: n-grams of ``ORDER`` + 1 bytes
    (word null) and words (gram null; empty for the end). Counts are summed in each task
    before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[bytes] = []
        size = 0

        def count() -> None:
            nonlocal size
            keys, _ = gram_keys(np.frombuffer(b"".join(held), np.uint8))
            parts.append(np.unique(keys, return_counts=True))
            held.clear()
            size = 0
            if sum(len(p[0]) for p in parts) > 2_000_000:
                parts[:] = [_merge(parts)]

        def rows(done: bool) -> Iterator[pa.RecordBatch]:
            if words and (done or len(words) > 400_000):
                n = len(words)
                yield pa.RecordBatch.from_pydict({"gram": pa.nulls(n, pa.int64()), "word": pa.array(list(words), pa.binary()), "n": pa.array(list(words.values()), pa.int64())})
                words.clear()
            if parts and (done or len(parts[0][0]) > 4_000_000):
                keys, n = _merge(parts)
                parts.clear()
                yield pa.RecordBatch.from_pydict({"gram": keys, "word": pa.nulls(len(keys), pa.binary()), "n": n})

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                own = words_of(text)
                words.update(own)
                words[b""] += 1
                held.append(spelled(own))
                size += len(held[-1])
                if size > BLOCK:
                    count()
            yield from rows(False)
        if held:
            count()
        yield from rows(True)

    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
    return map_arrow(texts, run, schema).groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().columns]


def fit(counts: DataFrame, total: int, most: int = GRAMS) -> Trie:
    """The trie of a table of ``corpus_counts``, ``total`` n-grams in all. Only n-grams and
    contexts of at least one in ``most`` of them reach the driver."""
    least = -(-total // most)
    grams = counts.filter("gram is not null").select("gram", "n")
    levels, totals = [], []
    for k in range(ORDER + 1):
        own = grams if k == ORDER else grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        levels.append(tuple(_arrays(own.filter(F.col("n") >= least))))
        totals.append(tuple(_arrays(own.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least))))
    return build(levels, totals)


def _bucket(context, buckets: int):
    """The bucket of a context, a column or an array."""
    return context % 1_000_003 % buckets


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes before all second ones: easier to compress."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted numbers of 64 bits and how often each occurs."""
    return _planes(np.diff(codes, prepend=np.uint64(0))) + _planes(times.astype(np.uint32))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.cumsum(_unplanes(raw[: 8 * n], "<u8"), dtype=np.uint64), _unplanes(raw[8 * n :], "<u4")


def descend(k: int, keys: np.ndarray, counts: np.ndarray, gram: np.ndarray, p: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step for each of the n-grams ``gram``, of log10 probability ``p`` so far, with the
    bytes ``seen`` (a row of 32 bytes of bits each) excluded: its byte is looked for in the
    context of ``k`` bytes among the sorted n-grams ``keys`` with their ``counts``.
    (whether it was found, p, seen) after it; a context that is not there changes nothing."""
    found, p, seen = np.zeros(len(gram), bool), p.copy(), seen.copy()
    if not len(keys):
        return found, p, seen
    own = gram & ((1 << (8 * (k + 1))) - 1)
    first = np.searchsorted(keys, own >> 8 << 8)
    size = np.searchsorted(keys, (own >> 8 << 8) + 256) - first
    for lo in range(0, len(gram), 16384):
        part = slice(lo, lo + 16384)
        n, f = size[part], first[part]
        gone = np.unpackbits(seen[part], axis=1).astype(bool)
        done = np.cumsum(n)
        ask = np.repeat(np.arange(len(n)), n)
        at = np.repeat(f - (done - n), n) + np.arange(done[-1])
        byte = keys[at] & 255
        new = ~gone[ask, byte]
        total = np.bincount(ask, counts[at] * new, len(n))
        kinds = np.bincount(ask, new, len(n))
        hit = byte == (own[part] & 255)[ask]
        yes = np.zeros(len(n), bool)
        yes[ask[hit]] = True
        here = np.zeros(len(n))
        here[ask[hit]] = counts[at[hit]] - DISCOUNT
        here = np.where(yes, here, DISCOUNT * kinds)
        p[part] += np.where(kinds > 0, np.log10(np.where(kinds > 0, here, 1.0) / np.where(kinds > 0, total, 1.0)), 0.0)
        gone[ask, byte] = True
        seen[part] = np.packbits(gone, axis=1)
        found[part] = yes
    return found, p, seen


_OPEN = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("gram", pa.int64()), ("times", pa.int64()), ("p", pa.float64()), ("seen", pa.binary()), ("back", pa.binary())])
_OPEN_TYPE = T.StructType([T.StructField(c, t) for c, t in (("bucket", T.LongType()), ("block", T.LongType()), ("place", T.IntegerType()), ("gram", T.LongType()), ("times", T.LongType()), ("p", T.DoubleType()), ("seen", T.BinaryType()), ("back", T.BinaryType()))])


def _answers(block: np.ndarray, place: np.ndarray, add: np.ndarray) -> pa.Table:
    """What the n-grams found add to the texts: one row for each block."""
    blocks, which = np.unique(block, return_inverse=True)
    code, own = np.unique(which.astype(np.int64) << 16 | place, return_inverse=True)
    sums = np.bincount(own, add, len(code)) if len(code) else np.zeros(0)
    ends = np.searchsorted(code >> 16, np.arange(len(blocks) + 1))
    raw = [_planes((code[i:j] & 0xFFFF).astype(np.uint16)) + sums[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
    n = len(blocks)
    return pa.table([pa.nulls(n, t.type) if t.name not in ("block", "back") else pa.array(blocks if t.name == "block" else raw, t.type) for t in _OPEN], schema=_OPEN)


def _opened(k: int, buckets: int, block: np.ndarray, place: np.ndarray, gram: np.ndarray, times: np.ndarray, p: np.ndarray, seen: np.ndarray) -> pa.Table:
    """N-grams still to be found, in contexts of ``k`` bytes."""
    masks = pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer(np.arange(0, 32 * len(gram) + 1, 32, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(seen).tobytes())])
    bucket = _bucket((gram & ((1 << (8 * (k + 1))) - 1)) >> 8, buckets)
    return pa.table([pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(place, pa.int32()), pa.array(gram, pa.int64()), pa.array(times, pa.int64()), pa.array(p, pa.float64()), masks, pa.nulls(len(gram), pa.binary())], schema=_OPEN)


def _level(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = table["gram"].to_numpy(), table["n"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _state(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    masks = np.frombuffer(b"".join(table["seen"].to_pylist()), np.uint8).reshape(-1, 32)
    return *(table[c].to_numpy() for c in ("block", "place", "gram", "times", "p")), masks


def _first(buckets: int):
    """The longest n-grams of a bucket meet what the texts ask of it."""

    def run(level: pa.Table, asked: pa.Table) -> pa.Table:
        keys, counts = _level(level)
        x, first, own = np.unique(keys >> 8, return_index=True, return_inverse=True)
        total = np.add.reduceat(counts, first) if len(x) else counts
        out, left = [], []
        for block, raw in zip(asked["block"].to_pylist(), asked["asked"].to_pylist(), strict=True):
            codes, times = _unpack(raw)
            gram, place = (codes >> np.uint64(16)).astype(np.int64), (codes & np.uint64(0xFFFF)).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, gram), max(0, len(keys) - 1))
            hit = keys[at] == gram if len(keys) else np.zeros(len(gram), bool)
            at = at[hit]
            if len(at):
                out.append(_answers(np.full(len(at), block), place[hit], times[hit] * np.log10((counts[at] - DISCOUNT) / total[own[at]])))
            if not hit.all():
                miss = ~hit
                left.append((np.full(miss.sum(), block), place[miss], gram[miss], times[miss]))
        if left:
            block, place, gram, times = (np.concatenate(c) for c in zip(*left, strict=True))
            _, p, seen = descend(ORDER, keys, counts, gram, np.zeros(len(gram)), np.zeros((len(gram), 32), np.uint8))
            out.append(_opened(ORDER - 1, buckets, block, place, gram, times, p, seen))
        return pa.concat_tables(out) if out else _OPEN.empty_table()

    return run


def _next(k: int, buckets: int):
    """The n-grams of a bucket in contexts of ``k`` bytes meet those still to be found."""

    def run(level: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _OPEN.empty_table()
        block, place, gram, times, p, seen = _state(asked)
        found, p, seen = descend(k, *_level(level), gram, p, seen)
        more = ~found
        return pa.concat_tables([_answers(block[found], place[found], (times * p)[found]), _opened(k - 1, buckets, block[more], place[more], gram[more], times[more], p[more], seen[more])])

    return run


def _look_up(asked: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``row, add``: what the n-grams that texts ask for (``block, bucket, asked``) add to
    their scores, from the whole table of ``corpus_counts``."""
    spark = asked.sparkSession
    buckets = _buckets(total)
    grams = counts.filter("gram is not null").select("gram", "n")
    backs = []

    def dealt(level: DataFrame):
        return level.withColumn("bucket", _bucket(F.shiftright("gram", 8), buckets)).groupBy("bucket")

    def shorter(level: DataFrame, k: int) -> DataFrame:
        return level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n"))

    met = spooled(dealt(grams).cogroup(asked.groupBy("bucket")).applyInArrow(_first(buckets), _OPEN_TYPE))
    level = grams
    for k in range(ORDER - 1, SENT, -1):
        backs.append(met.filter("back is not null").select("block", "back"))
        level = spooled(shorter(level, k))
        met = spooled(dealt(level).cogroup(met.filter("back is null").groupBy("bucket")).applyInArrow(_next(k, buckets), _OPEN_TYPE))
    backs.append(met.filter("back is not null").select("block", "back"))
    low = [_level(shorter(level, k).toArrow()) for k in range(SENT, -1, -1)]
    sent = spark.sparkContext.broadcast(low)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, place, gram, times, p, seen = _state(batch)
            p, seen, at = p.copy(), seen.copy(), np.arange(len(gram))
            for k, (keys, n) in zip(range(SENT, -1, -1), sent.value, strict=True):
                found, p[at], seen[at] = descend(k, keys, n, gram[at], p[at], seen[at])
                at = at[~found]
            p[at] -= np.log10(np.maximum(1, SYMBOLS - np.unpackbits(seen[at], axis=1).sum(axis=1)))
            yield from _answers(block, place, times * p).select(["block", "back"]).to_batches()

    backs.append(map_arrow(met.filter("back is null"), last, T.StructType([_OPEN_TYPE["block"], _OPEN_TYPE["back"]])))

    def gather(table: pa.Table) -> pa.Table:
        sums, there = np.zeros(ASK_ROWS), np.zeros(ASK_ROWS, bool)
        for raw in table["back"].to_pylist():
            n = len(raw) // 10
            place = _unplanes(raw[: 2 * n], "<u2")
            sums[place] += np.frombuffer(raw[2 * n :], np.float64)
            there[place] = True
        at = np.flatnonzero(there)
        return pa.table({"row": table["block"][0].as_py() + at, "add": sums[at]})

    every = backs[0]
    for b in backs[1:]:
        every = every.unionByName(b)
    return every.groupBy("block").applyInArrow(gather, T.StructType([T.StructField("row", T.LongType()), T.StructField("add", T.DoubleType())]))


def _buckets(total: int) -> int:
    return max(4, -(-total // BUCKET)) | 1


def _frequent(counts: DataFrame, total: int) -> Index:
    """The longest n-grams that make up one in ``GRAMS`` of all, with the log10 probability
    of their last byte in the whole model."""
    often = F.col("n") * GRAMS >= total
    grams = counts.filter("gram is not null").select("gram", "n")
    g, n = _arrays(grams.filter(often))
    x, sums = _arrays(grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("n")).filter(often))
    by = np.argsort(x)
    return Index(g, np.log10((n - DISCOUNT) / sums[by][np.searchsorted(x[by], g >> 8)]) if len(g) else np.zeros(0))


def _known_lengths(index: Index, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the n-grams in ``index`` add to each text, and the others: (text, n-gram)."""
    out, owners, asked = np.zeros(len(coded)), [], []
    at = 0
    while at < len(coded):
        size, end = 0, at
        while end < len(coded) and (end == at or size + len(coded[end]) <= BLOCK):
            size += len(coded[end])
            end += 1
        data = np.frombuffer(b"".join(coded[at:end]), np.uint8)
        ends = np.cumsum([len(c) for c in coded[at:end]])
        for lo in range(0, len(data), BLOCK):
            piece = data[max(0, lo - ORDER) : lo + BLOCK] if lo else data[:BLOCK]
            keys, places = gram_keys(piece)
            owner = np.searchsorted(ends, places + max(0, lo - ORDER), side="right")
            slot, hit = index.find(keys)
            out[at:end] += np.bincount(owner[hit], index.value[slot[hit]], end - at)
            owners.append(owner[~hit] + at)
            asked.append(keys[~hit])
        at = end
    return out, np.concatenate(owners), np.concatenate(asked)


def _base(n: Column, total: int, kinds: int) -> Column:
    return F.log10((n + 0.5) / F.lit(total + 0.5 * (kinds + 1)))


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", modulus: int = 5, held: int = 1) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row,
    learned from the rows whose crc32(key) mod ``modulus`` is not ``held``."""
    spark = docs.sparkSession
    out = remainder(F.col(key), modulus) == held
    counts = spooled(corpus_counts(docs.filter(~out).select(text)))
    row = counts.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("tokens"), F.count("word").alias("kinds"), F.sum(F.when(F.col("gram").isNotNull(), F.col("n"))).alias("grams")).first()
    tokens, kinds = row["tokens"] or 0, row["kinds"]
    words = counts.filter("word is not null").select("word", "n")
    frequent = F.col("n") * WORDS >= tokens
    known = words.filter(frequent).select("word", _base(F.col("n"), tokens, kinds).alias("p")).toArrow()
    sent = spark.sparkContext.broadcast((_frequent(counts, row["grams"] or 0), dict(zip(known["word"].to_pylist(), known["p"].to_pylist(), strict=True))))

    buckets = _buckets(row["grams"] or 0)
    kinds_of = {"row": pa.int64(), "key": None, "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "rare": pa.list_(pa.binary()), "times": pa.list_(pa.int64()), "block": pa.int64(), "bucket": pa.int64(), "asked": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base = sent.value
        asked: list[np.ndarray] = []
        block, size, key_type = 0, 0, None

        def ask() -> Iterator[pa.RecordBatch]:
            nonlocal size
            codes, often = np.unique(np.concatenate(asked), return_counts=True)
            asked.clear()
            size = 0
            bucket = _bucket((codes >> np.uint64(24)).astype(np.int64), buckets)
            order = np.argsort(bucket, kind="stable")
            codes, often, bucket = codes[order], often[order], bucket[order]
            to, first = np.unique(bucket, return_index=True)
            for lo in range(0, len(to), 64):
                ends = [*first[lo : lo + 65].tolist(), len(codes)][: len(to[lo : lo + 64]) + 1]
                raw = [_pack(codes[i:j], often[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                own = {"block": pa.array([block] * len(raw), pa.int64()), "bucket": pa.array(to[lo : lo + 64], pa.int64()), "asked": pa.array(raw, pa.binary())}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(len(raw), t or key_type) for c, t in kinds_of.items()], names=list(kinds_of))

        for batch in slices(batches):
            key_type = batch.schema.field(1).type
            numbers = batch.column(0).to_numpy()
            if asked and (size > ASK_GRAMS or numbers[-1] - block >= ASK_ROWS):
                yield from ask()
            if not asked:
                block = int(numbers[0])
            tokens_of, known_of, base_of, rare, times, coded = [], [], [], [], [], []
            for t in batch.column(3).to_pylist():
                own = words_of(t)
                coded.append(spelled(own))
                tally = Counter(own)
                tally[b""] = 1
                k, p, unknown, often = 0, 0.0, [], []
                for w, n in tally.items():
                    if (q := base.get(w)) is None:
                        unknown.append(w)
                        often.append(n)
                    else:
                        k += n
                        p += n * q
                tokens_of.append(len(own) + 1)
                known_of.append(k)
                base_of.append(p)
                rare.append(unknown)
                times.append(often)
            lengths, owner, keys = _known_lengths(index, coded)
            if len(keys):
                asked.append(keys.astype(np.uint64) << np.uint64(16) | (numbers[owner] - block).astype(np.uint64))
                size += len(keys)
            values = [*batch.columns[:3], pa.array(tokens_of, pa.int64()), pa.array(known_of, pa.int64()), pa.array(base_of), pa.array(lengths), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*values, *(pa.nulls(batch.num_rows, kinds_of[c]) for c in ("block", "bucket", "asked"))], names=list(kinds_of))
        if asked:
            yield from ask()

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("rare", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.LongType())), ("block", T.LongType()), ("bucket", T.LongType()), ("asked", T.BinaryType()))]])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), out.alias("held_out"), F.col(text).alias("text"))
    made = spooled(map_arrow(numbered, run, schema))
    rows = made.filter("asked is null").drop("block", "bucket", "asked")
    adds = _look_up(made.filter("asked is not null").select("block", "bucket", "asked"), counts, row["grams"] or 0)
    # the other words: each meets its count, and what they add is summed by row
    apart = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    met = apart.join(words.filter(~frequent), "word", "left")
    more = met.select("row", F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"), (F.col("times") * _base(F.coalesce("n", F.lit(0)), tokens, kinds)).alias("base"), F.lit(0.0).alias("add"))
    more = more.unionByName(adds.select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "add"))
    more = more.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("add").alias("more_score"))
    return rows.join(more, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def code_lengths(trie: Trie, coded: list[bytes]) -> np.ndarray:
    """log10 probability of each text, given as from ``spelled``."""
    out = np.zeros(len(coded))
    at = 0
    while at < len(coded):
        size, end = 0, at
        while end < len(coded) and (end == at or size + len(coded[end]) <= BLOCK):
            size += len(coded[end])
            end += 1
        data = np.frombuffer(b"".join(coded[at:end]), np.uint8)
        # a text above BLOCK is scored piece by piece
        for lo in range(0, len(data), BLOCK):
            piece = data[max(0, lo - ORDER) : lo + BLOCK] if lo else data[:BLOCK]
            keys, places = gram_keys(piece)
            owner = np.searchsorted(np.cumsum([len(c) for c in coded[at:end]]), places + max(0, lo - ORDER), side="right")
            out[at:end] += np.bincount(owner, trie.log10(keys), end - at)
        at = end
    return out

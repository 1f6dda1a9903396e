"""Quality rules by the log-likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` hashed word uni- and bigrams are counted: one of
trusted documents, one of the whole raw corpus. A document's score is the mean log
ratio over its n-grams. Every document is held against one threshold, which comes
from labelled documents; there is no sampling in the decision.

Beside it, four counts of each whole text and a base rule on them.

Words are runs of characters other than space and U+0009 to U+000D, case kept.

Defined results: a null or empty text has no words, so it fails the base rule. With
no trusted document the ratio says nothing and the base rule alone decides.
Repeated rows are judged row by row, each text by itself whatever stands beside it in
a batch. A score equal to the threshold is kept. A null id matches no label. An empty
table gives an empty result. Texts of any length are read whole. Columns other than the
key and the text are not read, whatever their names; ``keep`` hands them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.visited import bitmaps, let_through
from .common import map_arrow, slices, stored, utf8

BUCKETS = 1 << 16
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Different words that a worker remembers; with more, the memory starts afresh at the next batch.
VOCABULARY = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Words of a worker numbered as they come, with a 64-bit hash of each."""

    def __init__(self) -> None:
        self.hashes: list[int] = []
        self.known = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, seed=42))
        return k

    def number(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """The word numbers of each text, and the hashes by number."""
        if len(self) > VOCABULARY:
            self.clear()
            self.hashes.clear()
            self.known = self.known[:0]
        numbers = [np.fromiter(map(self.__getitem__, words := t.split()), np.int64, len(words)) for t in texts]
        self.known = np.concatenate([self.known, np.array(self.hashes[len(self.known) :], np.uint64)])
        return numbers, self.known


def buckets(numbers: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all uni- and bigrams of the texts, and the text that each is of."""
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
    h = hashes[flat] if len(flat) else np.zeros(0, np.uint64)
    one = (h * _MIX) >> np.uint64(48)
    both = ((h[:-1] * _MIX + h[1:]) * _MIX) >> np.uint64(48)
    within = owner[:-1] == owner[1:]
    return np.concatenate([one, both[within]]).astype(np.int64), np.concatenate([owner, owner[:-1][within]])


def repeated_words(numbers: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    if len(numbers) < 4:
        return 0
    # by the text's own words: the window's number depends on nothing beside the text
    own, numbers = np.unique(numbers, return_inverse=True)
    if len(own) < 1 << 21:
        key = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:  # three of them would not fit in 63 bits: pairs are numbered first
        _, pair = np.unique(numbers[:-1] * len(own) + numbers[1:], return_inverse=True)
        key = pair[:-1] * len(own) + numbers[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = twice[at] == key
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


@dataclass
class Rules:
    """``ratio``: log ratio by bucket, or None; ``threshold``: least score that is kept;
    ``fewest`` words, ``repeats``: most repeated words in a hundred."""

    ratio: np.ndarray | None = None
    threshold: float = float("-inf")
    fewest: int = 50
    repeats: int = 50
    words: Words = field(default_factory=Words, repr=False)

    def scores(self, numbers: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The mean log ratio of each text's n-grams; 0 for none."""
        if self.ratio is None:
            return np.zeros(len(numbers))
        b, owner = buckets(numbers, hashes)
        total = np.bincount(owner, self.ratio[b], len(numbers))
        return total / np.maximum(1, np.bincount(owner, minlength=len(numbers)))

    def judge(self, texts: list[str | None]) -> dict[str, list]:
        numbers, hashes = self.words.number([utf8(t) for t in texts])
        texts = [t or "" for t in texts]
        n = [len(x) for x in numbers]
        repeated = [repeated_words(x) for x in numbers]
        failed = [w < self.fewest or 100 * r > self.repeats * w for w, r in zip(n, repeated, strict=True)]
        score = self.scores(numbers, hashes)
        return {
            "n_words": n,
            "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": [repeated_lines(t) for t in texts],
            "n_repeat_words": repeated,
            "base_failed": failed,
            "kept": [not f and bool(s >= self.threshold) for f, s in zip(failed, score, strict=True)],
            "score": list(score),
        }


COLUMNS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    + [T.StructField("score", T.DoubleType())]
)
_ARROW = [(f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.dataType.simpleString()]) for f in COLUMNS]


def labelled(labels: DataFrame, *, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """``k, good, half`` of every labelled id; trusted ones are halved by a hash of the id. An id with
    labels of both kinds counts as poor."""
    each = labels.filter(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.min(quality).alias("q"))
    return each.select("k", (F.col("q") > 0).alias("good"), F.pmod(F.xxhash64("k"), F.lit(2)).cast("int").alias("half"))


def marked(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """``pairs`` (k, t) joined to ``marks`` by ``k``, in a shuffle of few texts beside those with a mark: a filter
    of all marked ids (8 MB at most, broadcast) is asked first. A filter that is full lets more through;
    the join decides."""
    maybe = let_through(pairs, F.broadcast(bitmaps(marks, F.col("k"))), F.col("k")).filter("maybe").drop("maybe")
    # never broadcast: labels grow with the documents
    return maybe.join(marks.hint("merge"), "k")


#: Scores as whole numbers of the same order, and the digits of a rank's search: one table of counts a digit.
_DIGIT, _DIGITS = 16, 4


def _ordered(scores: np.ndarray) -> np.ndarray:
    bits = scores.astype(np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _score(ordered: int) -> float:
    bits = np.int64(ordered)
    return float((bits if bits >= 0 else bits ^ np.int64((1 << 63) - 1)).view(np.float64))


def at_rank(rows: DataFrame, place: int) -> float:
    """The score at a place from 0 in the order of ``rows`` (ordered), exactly: digit by digit, each by counts of
    at most 2^16 values, however many rows there are."""
    found = 0
    for k in range(_DIGITS):
        down = 64 - _DIGIT * (k + 1)
        # the first digit has the sign
        digit = F.shiftright("ordered", down) if k == 0 else F.shiftright("ordered", down).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        here = rows if k == 0 else rows.filter(F.shiftright("ordered", down + _DIGIT) == found)
        for r in sorted(here.groupBy(digit.alias("d")).count().collect(), key=lambda r: r["d"]):
            if place < r["count"]:
                found = r["d"] if k == 0 else (found << _DIGIT) | r["d"]
                break
            place -= r["count"]
    return _score(found)


def fit(docs: DataFrame, labels: DataFrame, *, smoothing: float = 1.0, spare: float = 0.002, key: str = "doc_id", text: str = "text") -> Rules:
    """Count both multinomials and choose the threshold.

    The raw counts are over every document; the trusted ones over one half of all trusted ids
    (``labelled``). The other half and all poor ones
    calibrate the threshold: scores of documents that were counted would be too high to
    compare with. Among those that pass the base rule, the threshold leaves a share ``spare`` of the trusted scores below it; if the poor ones,
    but for such a share, all lie lower still, it is midway in the gap. Labelled documents meet
    their labels in a join (``marked``). Only ``BUCKETS`` counts and the counts of ``at_rank`` reach the driver.
    """
    marks = stored(labelled(labels, key=key))
    halves = sorted(r["half"] for r in marks.filter("good").select("half").distinct().collect())
    if not halves:
        return Rules()
    spark = docs.sparkSession
    pairs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    counted = F.col("good") & (F.col("half") == halves[0])
    mine = stored(marked(pairs, marks.select("k", "good", counted.alias("counted"))).select("t", "good", "counted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = Words(), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            n += np.bincount(buckets(*words.number([utf8(t) for t in batch.column(0).to_pylist()]))[0], minlength=BUCKETS)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int32()), "n": n[seen]})

    def counts(texts: DataFrame) -> np.ndarray:
        n = np.zeros(BUCKETS)
        for r in map_arrow(texts, count, T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            n[r["bucket"]] = r["n"]
        return n

    trusted = counts(mine.filter("counted").select("t"))
    if not trusted.sum():
        return Rules()
    raw = counts(pairs.select("t"))
    ratio = np.log((trusted + smoothing) / (trusted.sum() + smoothing * BUCKETS)) - np.log((raw + smoothing) / (raw.sum() + smoothing * BUCKETS))
    rules = spark.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Rules(rules.value)
        for batch in slices(batches):
            said = judge.judge(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"good": batch.column(1), "failed": said["base_failed"], "ordered": _ordered(np.array(said["score"], np.float64))})

    kinds = T.StructType([T.StructField("good", T.BooleanType()), T.StructField("failed", T.BooleanType()), T.StructField("ordered", T.LongType())])
    rows = stored(map_arrow(mine.filter("not counted").select("t", "good"), score, kinds).filter("not failed").select("good", "ordered"))
    n = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if not n.get(True):
        return Rules(ratio)
    least = at_rank(rows.filter("good"), math.floor(spare * (n[True] - 1)))
    most = at_rank(rows.filter("not good"), math.ceil((1 - spare) * (n[False] - 1))) if n.get(False) else least
    return Rules(ratio, (least + min(least, most)) / 2)


def threshold(good: list[float], poor: list[float], spare: float) -> float:
    """See ``fit``. Without poor documents, the trusted quantile; without trusted ones, none."""
    if not good:
        return float("-inf")
    least = float(np.quantile(good, spare, method="lower"))
    most = float(np.quantile(poor, 1 - spare, method="higher")) if poor else least
    return (least + min(least, most)) / 2


def judge(docs: DataFrame, rules: Rules, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``COLUMNS`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((rules.ratio, rules.threshold, rules.fewest, rules.repeats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Rules(*sent.value)
        for batch in slices(batches):
            said = own.judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(said[c], kind) for c, kind in _ARROW)], schema=pa.schema([batch.schema.field(0), *_ARROW]))

    return map_arrow(docs.select(key, text), run, T.StructType([docs.schema[key], *COLUMNS]))


def keep(docs: DataFrame, rules: Rules, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    sent = docs.sparkSession.sparkContext.broadcast((rules.ratio, rules.threshold, rules.fewest, rules.repeats))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Rules(*sent.value)
        for batch in slices(batches):
            yield batch.filter(pa.array(own.judge(batch.column(at).to_pylist())["kept"], pa.bool_()))

    return map_arrow(docs, run, docs.schema)

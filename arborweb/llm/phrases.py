"""Collocations: phrases whose words come together more often than their parts suggest.

Each shard of the texts makes tries of counts, three words deep: every place in a text adds to
the leaf of the words that follow there, so an inner node's count is the sum of its leaves, and
the root of a language has all its words. A trie is written as its leaves in order. The sorted
runs of all shards are dealt by ranges of prefixes, merged, and walked: what ends inside
a batch of leaves is complete, and kept if frequent; the few nodes that reach over its edges are
partial sums, added up afterwards. No part of a phrase is rarer than the phrase, so the
frequent nodes are all that is needed from there on.

A second walk, over the frequent nodes in order, hands each node the counts on the path to it:
its left parts. Where a range begins inside a subtree the path, at most three nodes, is
looked up. Suffix links (the node without the first word) give the right parts: that of a
phrase of three words has the count of its last two, and its own link that of the last.

Defined results: a null text is empty, a null language ``und``; repeated rows count each. Words
may hold any character but space, tab and the marks and line ends that texts are split at. A text of any
length is read whole. Ties are ordered by count, then by phrase. An empty table gives an empty
result. Columns other than text and language are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_bytes, map_arrow, stored

#: Words of a phrase at most, and how often it occurs at least.
DEPTH, LEAST = 3, 10
#: Phrases of a language that are reported.
TOP = 2000
#: A phrase goes if one that holds it has so many hundredths of its count.
INSIDE = 50
#: Bytes of text in a trie.
TRIE_BYTES = 1 << 24
#: Leaves that are written together.
LEAVES = 50_000
#: Parts of a language that are ranked by themselves first.
RANKED = 64
#: Between the words of a leaf: lower than any byte of a word, so that leaves in order are a walk
#: of the trie. The bytes 0 and 1 inside a word are spelled 1 1 and 1 2.
GAP = "\x00"

NODE = ["lang", "w1", "w2", "w3"]


def tries(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """``leaf, n``: the leaves of each trie in order, as language and words joined by ``GAP``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_bytes(batches, TRIE_BYTES, 0):
            for leaves, n in trie(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([leaves, n], names=["leaf", "n"])

    return map_arrow(docs.select(text, F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")), run, T.StructType.fromDDL("leaf STRING, n BIGINT"))


def _spelled(words: pa.Array) -> pa.Array:
    if pc.any(pc.match_substring_regex(words, r"[\x00\x01]")).as_py():
        words = pc.replace_substring(pc.replace_substring(words, "\x01", "\x01\x02"), "\x00", "\x01\x01")
    return words


def trie(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(leaves in order, how often each was reached) of some texts, ``LEAVES`` at a time."""
    known, languages, head, rest, n = _counted(texts, langs)
    size = len(known) + 1

    def named(code: np.ndarray) -> pa.Array:
        return known.take(pa.array(code - 1, mask=code == 0))

    for lo in range(0, len(n), LEAVES):
        h, r = head[lo : lo + LEAVES], rest[lo : lo + LEAVES]
        words = (languages.take(pa.array(h // size)), known.take(pa.array(h % size)), named(r // size), named(r % size))
        yield pc.binary_join_element_wise(*words, GAP, null_handling="skip"), pa.array(n[lo : lo + LEAVES])


def _counted(texts: pa.Array, langs: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, languages, leaves as two numbers: language and first word, second and third or 0
    for none; counts), all in order."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[.,;:!?\n\x0b\x0c\r]")
    split = pc.split_pattern_regex(pieces.values, "[ \t]+")
    real = np.flatnonzero(pc.not_equal(split.values, "").to_numpy(zero_copy_only=False))
    piece = np.repeat(np.arange(len(split), dtype=np.int32), np.diff(split.offsets.to_numpy()))[real]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(pieces.offsets.to_numpy()))
    known, word = _ordered(split.values.take(pa.array(real)).dictionary_encode())
    languages, language = _ordered(langs.dictionary_encode())
    del split, real
    size = len(known) + 1
    head = language[text[piece]].astype(np.int64) * size + word
    # the words that follow in the same piece
    rest = np.zeros(len(word), np.int64)
    for k, times in ((1, size), (2, 1)):
        same = np.flatnonzero(piece[k:] == piece[:-k])
        rest[same] += (word[same + k].astype(np.int64) + 1) * times
    del piece, text, word
    order = np.lexsort((rest, head))
    head, rest = head[order], rest[order]
    begins = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (rest[1:] != rest[:-1])])[: len(head)])
    return known, languages, head[begins], rest[begins], np.diff(np.append(begins, len(order)))


def _ordered(coded: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray]:
    """(different values in the order of their bytes, the place of each value among them)."""
    values = _spelled(coded.dictionary)
    order = pc.sort_indices(values)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order))
    return values.take(order), place[coded.indices.to_numpy()]


def merged(leaves: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, w1, w2, w3, f`` of the nodes that ``least`` places or more reach; words below a
    node are null, and the node of a language alone has all its words. ``leaves`` are read
    twice: for the ranges, and to be dealt."""
    nodes = map_arrow(leaves.repartitionByRange("leaf").sortWithinPartitions("leaf"), lambda batches: _sums(batches, least), T.StructType.fromDDL("lang STRING, w1 STRING, w2 STRING, w3 STRING, n BIGINT"))
    return nodes.groupBy(*NODE).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def _sums(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        split = pc.split_pattern(batch.column(0), GAP)
        offset, n = split.offsets.to_numpy().astype(np.int64), batch.column(1).to_numpy()
        size = np.diff(offset)
        parts = [split.values.take(pa.array(offset[:-1] + k, mask=size <= k)) for k in range(DEPTH + 1)]
        new = np.zeros(len(n), bool)
        new[0] = True
        for depth, names in enumerate(parts):
            here = pc.fill_null(names, "")  # no word is empty
            new[1:] |= pc.not_equal(here.slice(1), here.slice(0, len(n) - 1)).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(new)
            sums = np.add.reduceat(n, begins)
            # what touches an edge of the batch may go on beyond it
            kept = sums >= least
            kept[[0, -1]] = True
            kept &= size[begins] > depth
            at = pa.array(begins[kept])
            empty = pa.nulls(len(at), pa.string())
            yield pa.RecordBatch.from_arrays([*(p.take(at) if k <= depth else empty for k, p in enumerate(parts)), pa.array(sums[kept])], names=[*NODE, "n"])


def with_left_parts(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``n``, ``left1`` and ``left2``: the counts of its language, its first word
    and its first two words, where they stand above it. ``nodes`` are read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str | None] = [None] * DEPTH
        counts: list[int | None] = [None] * DEPTH
        for batch in batches:
            above: tuple[list, ...] = ([], [], [])
            columns = [c.to_pylist() for c in batch.columns]
            for *node, f in zip(*columns, strict=True):
                depth = sum(x is not None for x in node) - 1
                for k in range(DEPTH):
                    if names[k] != node[k]:
                        names[k:], counts[k:] = node[k:DEPTH], [None] * (DEPTH - k)
                        break
                for k in range(DEPTH):
                    above[k].append(counts[k] if k < depth else None)
                if depth < DEPTH:
                    counts[depth] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(a, pa.int64()) for a in above)], names=[*NODE, "f", "n", "left1", "left2"])

    ordered = nodes.select(*NODE, "f").repartitionByRange(*NODE).sortWithinPartitions(*NODE)
    walked = stored(map_arrow(ordered, run, T.StructType.fromDDL("lang STRING, w1 STRING, w2 STRING, w3 STRING, f BIGINT, n BIGINT, left1 BIGINT, left2 BIGINT")))
    filled = walked
    for depth, name in enumerate(("n", "left1", "left2")):
        path, below = NODE[: depth + 1], F.col(NODE[depth + 1]).isNotNull()
        # one for each range at most
        lost = walked.filter(below & F.col(name).isNull()).select(*path).distinct()
        found = walked.filter(F.col(path[-1]).isNotNull() & ~below).join(F.broadcast(lost), path).select(*path, F.col("f").alias("_found"))
        filled = filled.join(F.broadcast(found), path, "left").withColumn(name, F.when(below, F.coalesce(name, "_found"))).drop("_found")
    return filled.select(*walked.columns)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly up to counts of 10^15."""
    wide = F.lit(1_000_000).cast("decimal(8,0)") * (a.cast("decimal(15,0)") * a.cast("decimal(15,0)"))
    return F.call_function("div", wide.cast("decimal(38,0)"), (left.cast("decimal(18,0)") * right.cast("decimal(18,0)")).cast("decimal(38,0)"))


def _cut(k: int, left: str, right: str) -> Column:
    return F.struct(_score(F.col("f"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def scored(nodes: DataFrame, inside: int = INSIDE) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of all candidates that no longer one explains."""
    walked = stored(with_left_parts(nodes))
    ones = walked.filter("w1 is not null and w2 is null").select("lang", F.col("w1").alias("w2"), F.col("f").alias("right1"))
    twos = stored(walked.filter("w2 is not null and w3 is null").join(ones, ["lang", "w2"]))
    links = twos.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("right2"), "right1")
    threes = stored(walked.filter("w3 is not null").join(links, ["lang", "w2", "w3"]))
    holds = threes.select("lang", "f", F.explode(F.array(F.struct(F.col("w1"), F.col("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    holds = holds.groupBy("lang", "p.w1", "p.w2").agg(F.max("f").alias("longer"))
    kept = twos.join(holds, ["lang", "w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < inside * F.col("f"), F.lit(True)))
    two = kept.select(*NODE, "f", "n", _cut(1, "left1", "right1").alias("cut"))
    three = threes.select(*NODE, "f", "n", F.least(_cut(1, "left1", "right2"), _cut(2, "left2", "right1")).alias("cut"))
    words = [F.replace(F.replace(F.col(w), F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01")) for w in NODE]
    return two.unionByName(three).select(words[0].alias("lang"), F.concat_ws(" ", *words[1:]).alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language. Parts of
    a language are ranked first, so that no task ever ranks more than ``RANKED`` times ``top``."""
    leaves = stored(tries(docs, text=text, lang=lang), codec="zstd")
    found = scored(stored(merged(leaves, least)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(RANKED))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

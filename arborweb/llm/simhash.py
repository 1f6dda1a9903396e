"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits of a document's four-word shingles. Two that differ in at
most four bits, cut into three segments, have a segment that differs in at most one.
So each segment is indexed once for each of its bits with that bit left out; equal
keys are joined and verified. Documents of equal fingerprints are one class before
that, so copies cost nothing; within a bucket only a spanning forest of the links is
passed on, never all pairs.

Defined results: a text is cut into words at space and U+0009 to U+000D after A-Z are
lower-cased. Fewer than four words make one shingle; none (also null or empty text)
gives fingerprint zero, which links like any other. A row without an id is compared
like others but names no group; a group without any id has a null component. Repeated
rows are rows of their own, of one class. Texts of any length are read whole. An empty
table gives an empty result. Columns other than the key and the text are not read,
whatever their names; ``keep_one`` hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, met_by_key, slices, spooled, stored, utf8
from .components import components, roots

SHINGLE = 4
SEED = 42
BITS = 64
NEAR = 4
#: First bit of each segment, and the end.
CUTS = (0, 22, 43, 64)
#: A larger bucket is cut into finer buckets before pairs are compared.
BUCKET = 2048
#: Hot buckets that are broadcast; with more, they meet the fingerprints by a shuffled join.
BROADCAST_BUCKETS = 100_000
#: Rows that are compared together.
CHUNK = 200_000


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint: a bit is 1 if set in over half of the shingles' XXH64."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    set_bits, n = np.zeros(BITS, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), ends[at + SHINGLE - 1 : at + SHINGLE - 1 + CHUNK].tolist(), strict=False)
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp BIGINT (the 64 bits), text_hash`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(1)], schema=pa.schema([batch.schema.field(0), ("fp", pa.int64()), ("text_hash", pa.int64())]))

    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType()), T.StructField("text_hash", T.LongType())])
    return map_arrow(docs.select(key, F.xxhash64(text).alias("text_hash"), text), run, schema)


def _pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places that hold equal values of ``group``, which is in order."""
    first = np.arange(len(group))
    step = 1
    while True:
        first = first[: np.searchsorted(first, len(group) - step)]
        first = first[group[first] == group[first + step]]
        if not len(first):
            return
        yield first, first + step
        step += 1


def near_pairs(bucket: np.ndarray, fp: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Edges between places of ``fp`` (uint64) whose bucket is equal (``bucket`` is in order)
    and that differ in at most ``near`` bits: links enough to connect all that links connect.

    The rows of a bucket of over ``BUCKET`` are dealt once for each of ``near`` + 1 pieces
    of the fingerprint: of two that differ in ``near`` bits, one piece is equal.
    """
    n = len(fp)
    ends = np.flatnonzero(np.diff(bucket)) + 1
    sizes = np.diff(np.concatenate([[0], ends, [n]])) if n else np.zeros(0, np.int64)
    large = np.repeat(sizes > BUCKET, sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(group: np.ndarray, place: np.ndarray) -> None:
        up = np.arange(n)
        for i, j in _pairs(group):
            a, b = place[i], place[j]
            linked = (np.bitwise_count(fp[a] ^ fp[b]) <= near) & (up[a] != up[b])
            if linked.any():
                a, b = a[linked], b[linked]
                found.append((a, b))
                np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))

    small = np.flatnonzero(~large)
    if len(small):
        compare(bucket[small], small)
    if large.any():
        rows = np.flatnonzero(large)
        bounds = np.linspace(0, BITS, near + 2).astype(int)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            piece = (fp[rows] >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            order = np.lexsort((piece, bucket[rows]))
            b, p = bucket[rows][order], piece[order]
            group = np.concatenate([[0], np.cumsum((np.diff(b) != 0) | (np.diff(p) != 0))])
            compare(group, rows[order])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _forest(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Edges from each fingerprint to the smallest place of its component in these buckets."""
    a, b = near_pairs(bucket, fp.view(np.uint64))
    # equal fingerprints in different buckets are one node
    node, place = np.unique(fp, return_inverse=True)
    top = roots(len(node), place[a], place[b])
    moved = np.flatnonzero(top != np.arange(len(node)))
    return pa.RecordBatch.from_pydict({"a": node[moved], "b": node[top[moved]]})


def _finer(rows: DataFrame) -> DataFrame:
    """``fp, bucket`` with the rows of buckets of over ``BUCKET`` dealt over finer ones, once
    for each of ``NEAR`` + 1 pieces of the fingerprint: of two that differ in ``NEAR`` bits,
    one piece is equal. So no hot bucket comes to one task."""
    hot = spooled(rows.groupBy("bucket").count().filter(F.col("count") > BUCKET).select("bucket"))
    n = hot.count()
    if not n:
        return rows
    hot = F.broadcast(hot) if n <= BROADCAST_BUCKETS else hot
    bounds = [BITS * k // (NEAR + 1) for k in range(NEAR + 2)]
    pieces = [F.struct(F.lit(lo).alias("at"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("bits")) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    cut = rows.join(hot, "bucket").select("fp", "bucket", F.explode(F.array(*pieces)).alias("piece"))
    return rows.join(hot, "bucket", "left_anti").select("fp", "bucket").unionByName(cut.select("fp", F.xxhash64("bucket", "piece").alias("bucket")))


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: edges between different fingerprints (``fp``, each once) that connect all
    that differ in at most ``NEAR`` bits."""
    keys = []
    for lo, hi in zip(CUTS[:-1], CUTS[1:], strict=True):
        segment = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
        for bit in range(hi - lo):
            keys.append(F.lit((lo + bit) << 22).cast("long") + segment.bitwiseAND(F.lit(((1 << (hi - lo)) - 1) & ~(1 << bit)).cast("long")))
    rows = _finer(fps.select("fp", F.explode(F.array(*keys)).alias("bucket")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            bucket = np.concatenate([bucket, batch.column(1).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(0).to_numpy(zero_copy_only=False)])
            if len(bucket) >= CHUNK:  # all but the last bucket, which may go on
                whole = int(np.searchsorted(bucket, bucket[-1]))
                if whole:
                    yield _forest(bucket[:whole], fp[:whole])
                    bucket, fp = bucket[whole:], fp[whole:]
        if len(bucket):
            yield _forest(bucket, fp)

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def classes(rows: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``fp, n, label, component_id`` of each fingerprint in ``rows (key, fp)``: ``n`` is how
    many rows have it, ``label`` the smallest fingerprint reachable, ``component_id`` the
    smallest key."""
    fps = spooled(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")))
    named = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    linked = spooled(fps.join(named, "fp").select("fp", "label", "first"))
    groups = spooled(linked.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    moved = met_by_key(linked.select("fp", "label"), groups, "label").select("fp", "label", "component_id")
    each = fps.join(moved, "fp", "left")
    return stored(each.select("fp", "n", F.coalesce("label", "fp").alias("label"), F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")), fps.count())


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint (hex), component_id, label, text_hash`` of each row."""
    rows = spooled(fingerprints(docs, key=key, text=text))
    met = met_by_key(rows, classes(rows, key=key), "fp")
    return met.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "label", "text_hash")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest key of each group of near
    duplicates. Of repeated rows one stays; rows of a group without keys are told apart by
    a hash of the text."""
    rows = near_duplicates(docs, key=key, text=text).select(F.col(key).alias("k"), "component_id", "label", "text_hash")
    first = rows.filter(F.col("k").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min(F.struct("k", "text_hash")).alias("one"), F.count(F.lit(1)).alias("n"))
    chosen = spooled(first.select(F.col("one.k").alias("k"), F.col("one.text_hash").alias("h"), "n"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("id"), F.xxhash64(f"`{text}`").alias("hash"))
    on = F.col("id").eqNullSafe(F.col("k")) & F.col("hash").eqNullSafe(F.col("h"))
    kept = whole.join(chosen.select("k", "h").distinct().hint("shuffle_hash"), on, "left_semi")
    if not chosen.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "hash"])
    return kept.select("row.*")

"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits vectors again and again by a random direction at the median; a vector
nearer to a split than the spill width goes to both sides. Vectors that share a leaf and
a label are compared in double precision. Links are summed and joined into components.

Trees are grown in two parts. The upper part is for labels of over ``BLOCK`` vectors: it
is fitted on a bounded sample, sent to the workers, and routes ids, not vectors, to blocks
of about ``BLOCK``. The lower part is grown in the task that holds a block, by the medians
of the block itself, down to leaves of ``LEAF``; there, what spills over is a copy of a
row number in memory. So each vector is shuffled once for each block it is in: once for
a label of one block. A pair that shares several blocks belongs to the first.

Spill of the upper part is bounded: over all its levels a tree sends about ``SPREAD``
copies of a vector, whatever the depth, and with the depth the number of trees rises
instead, to keep the recall of pairs at ``NEAR`` (``trees_for``). A node is split as
long as the sample has ``FEWEST`` vectors there, so the tables that are sent are smaller
than the sample. A block of over twice ``BLOCK`` vectors is dealt over cells, one for each
pair of its pieces, so no task gets a whole large one. Equal vectors are one class before
that. A cell passes on counts and a spanning forest of its links, never all pairs.

Defined results: a vector that is null, empty or zero or has a null or non-finite
component, or whose label is null, links with nothing. Vectors of different length
link with nothing. Repeated rows are vectors of their own. A row without an id links
like any other; a component without any id has a null id, and no row of it is kept
unless its own id is null too. An empty table gives an empty result. Columns other than
the key, the vector and the label are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, met_by_key, spooled, stored
from .components import components, roots

NEAR = 0.93
#: Vectors that the upper parts are fitted on, and numbers they hold at most.
SAMPLE = 65_536
SAMPLE_NUMBERS = 1 << 23
#: Vectors of a label or block that one task grows trees over.
BLOCK = 2048
#: Trees of a block, and the vectors of a leaf.
TREES = 5
LEAF = 24
#: Half the spill zone of those trees, in standard deviations of the difference of two vectors at NEAR.
SPILL = 0.75
#: Copies of a vector that the upper part of a tree makes, about, and the largest spill zone.
SPREAD = 2.0
ZONE = 0.25
#: Recall of pairs at NEAR that the upper parts are made for, and the most trees.
RECALL = 0.97
MOST_TREES = 32
#: Sample vectors that a node of the upper part needs to be split.
FEWEST = 8
#: Labels of several blocks that are broadcast; with more, they meet the vectors by a shuffled join.
BROADCAST_LABELS = 100_000


def unit(v: np.ndarray) -> np.ndarray:
    """The rows of ``v`` in double precision at length one."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def together(share: float) -> float:
    """How often one split keeps two vectors at ``NEAR`` on a common side, where the spill zone
    holds ``share`` of the vectors: by the normal distribution of their projections."""
    x = np.linspace(-6, 6, 2401)
    density = np.exp(-x * x / 2)
    zone = np.cumsum(density) / density.sum()
    width = max(0.0, float(x[np.searchsorted(zone, 0.5 + share / 2)]))
    side = np.sqrt(1 - NEAR * NEAR)
    # y = NEAR x + side z: apart if x > width and y < -width, or the other way round
    below = np.array([zone[min(len(x) - 1, np.searchsorted(x, (-width - NEAR * a) / side))] for a in x])
    return 1 - 2 * float((density * below)[x > width].sum() / density.sum())


def trees_for(depth: int) -> tuple[int, float]:
    """(trees, share of a spill zone) of the upper part for so many levels."""
    if not depth:
        return 1, 0.0
    share = min(ZONE, SPREAD ** (1 / depth) - 1)
    found = min(together(share) ** depth, 1 - 1e-9)
    return min(MOST_TREES, max(2, ceil(log(1 - RECALL) / log(1 - found)))), share


class Forest:
    """Upper parts of trees over vectors of one length. Nodes are numbered as in a heap: the
    root is 1, and below k are 2k and 2k + 1. For each tree: a direction for each level,
    and by level the nodes that are split, in order, with cut and half width."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 42):
        dim = sample.shape[1]
        draw = np.random.default_rng(seed + dim)
        self.depth = depth
        trees, share = trees_for(depth)
        self.trees: list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = []
        for _ in range(trees):
            directions = unit(draw.standard_normal((max(depth, 1), dim))).T
            projected = sample @ directions
            node = np.ones(len(sample), np.int64)
            levels = []
            for level in range(depth):
                p = projected[:, level]
                order = np.lexsort((p, node))
                which, first, size = np.unique(node[order], return_index=True, return_counts=True)
                split = size >= FEWEST
                which, first, size = which[split], first[split], size[split]
                if not len(which):
                    break
                ordered = p[order]
                cuts = ordered[first + size // 2]
                low = ordered[first + (size * (0.5 - share / 2)).astype(int)]
                high = ordered[np.minimum(first + size - 1, first + (size * (0.5 + share / 2)).astype(int))]
                levels.append((which, cuts, (high - low) / 2))
                at = np.minimum(np.searchsorted(which, node), len(which) - 1)
                known = which[at] == node
                node = np.where(known, 2 * node + (p > cuts[at]), -1)
            self.trees.append((directions, levels))

    def blocks(self, vectors: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, codes): the blocks of each vector, which goes ``depth`` levels down; a code is
        the tree's number above 40 bits of node."""
        rows, codes = [], []
        for tree, (directions, levels) in enumerate(self.trees):
            projected = vectors @ directions
            row, node = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
            for level, (which, cuts, widths) in enumerate(levels):
                at = np.minimum(np.searchsorted(which, node), len(which) - 1)
                split = (which[at] == node) & (depth[row] > level)
                p = np.where(split, projected[row, level] - cuts[at], 0.0)
                left, right = split & (p <= widths[at]), split & (p >= -widths[at])
                row, node = np.concatenate([row[~split], row[left], row[right]]), np.concatenate([node[~split], 2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            codes.append((tree << 40) | node)
        return np.concatenate(rows), np.concatenate(codes)


def fit(vectors: DataFrame, sizes: DataFrame, sample: int = SAMPLE) -> dict[int, Forest]:
    """A forest by vector length from ``vectors (label, v, h)`` of the labels in ``sizes (label,
    dim, n)``, those of several blocks: fitted on about ``sample`` of their rows by the hash
    ``h``, as deep as the largest needs."""
    known = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.max("dim").alias("dim")).first()
    depth = min(30, ceil(log2(known["most"] / BLOCK)))
    share = int(min(1.0, min(sample, SAMPLE_NUMBERS / known["dim"]) / known["n"]) * (1 << 40))
    rows = vectors.filter(F.pmod("h", F.lit(1 << 40)) < share).orderBy("h").select("v").toArrow().combine_chunks()["v"]
    dims = np.array(rows.combine_chunks().value_lengths()) if len(rows) else np.zeros(0, int)
    out = {}
    for dim in np.unique(dims).tolist():
        own = rows.filter(pa.array(dims == dim)).combine_chunks()
        out[dim] = Forest(unit(own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)), depth)
    return out


def route(vectors: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """``cid, code, before`` once for each block of ``vectors (cid, v, n)``, where ``n`` is the
    size of the label; ``before`` are the codes of its blocks of lower number. Vectors of a
    length that the sample lacks share one block."""
    sent = vectors.sparkSession.sparkContext.broadcast(forests)
    names = ["cid", "code", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2048):
                batch = big.slice(lo, 2048)
                sizes = np.array(batch.column(1).value_lengths())
                for dim in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == dim))
                    v = unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                    depth = np.ceil(np.log2(part.column(2).to_numpy() / BLOCK)).astype(int)
                    forest = sent.value.get(int(dim))
                    rows, codes = forest.blocks(v, depth) if forest else (np.arange(len(v)), np.ones(len(v), np.int64))
                    order = np.lexsort((codes, rows))
                    rows, codes = rows[order], codes[order]
                    begins = np.searchsorted(rows, rows)
                    before = [codes[a:b] for a, b in zip(begins.tolist(), range(len(rows)), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(codes), pa.array(before, pa.list_(pa.int64()))], names=names)

    return map_arrow(vectors.select("cid", "v", "n"), run, T.StructType.fromDDL("cid bigint, code bigint, before array<bigint>"))


def leaves(v: np.ndarray, seed: int, depth: list[int] | None = None) -> Iterator[np.ndarray]:
    """The leaves of one tree over the rows of ``v``, as row numbers. ``depth`` gets the level
    of each leaf."""
    draw = np.random.default_rng(seed)
    width = SPILL * sqrt(2 - 2 * NEAR)
    open_ = [(np.arange(len(v)), 0)]
    while open_:
        rows, level = open_.pop()
        parts = []
        if len(rows) > LEAF:
            p = v[rows] @ draw.standard_normal(v.shape[1])
            cut = np.partition(p, len(p) // 2)[len(p) // 2]
            parts = [rows[p <= cut + width], rows[p >= cut - width]]
        # where the spill zone holds nearly all, as among near copies, no split parts them
        if not parts or max(map(len, parts)) > 0.95 * len(rows):
            if depth is not None:
                depth.append(level)
            yield rows
        else:
            open_ += [(x, level + 1) for x in parts]


def compare(v: np.ndarray, copies: np.ndarray, before: list[np.ndarray] | None, block: np.ndarray | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each class in a cell: how many vectors of other classes it links to
    here, and the place of the smallest class it is connected to here.

    Pairs with an earlier block in common (``before``) belong there. Where ``block`` is
    given, only classes of different ``block`` are compared.
    """
    n = len(v)
    linked = np.zeros((n, n), bool)
    for tree in range(TREES):
        for rows in leaves(v, seed + tree):
            for lo in range(0, len(rows), BLOCK // 4):
                some = rows[lo : lo + BLOCK // 4]
                linked[np.ix_(some, rows)] |= v[some] @ v[rows].T >= NEAR
    np.fill_diagonal(linked, False)
    if block is not None:
        linked &= block[:, None] != block[None, :]
    if before is not None:
        kinds, at = np.unique(np.concatenate(before), return_inverse=True)
        shares = np.zeros((n, len(kinds)), np.float32)
        shares[np.repeat(np.arange(n), [len(b) for b in before]), at] = 1
        for lo in range(0, n, BLOCK // 4):
            linked[lo : lo + BLOCK // 4] &= shares[lo : lo + BLOCK // 4] @ shares.T < 0.5
    a, b = np.nonzero(np.triu(linked))
    return linked @ copies, roots(n, a, b)


def cells(classes: DataFrame) -> DataFrame:
    """``cid, copies, v, before, piece, cell``: each of ``classes (cid, label, dim, v, h, copies)``
    once for each cell it is compared in."""
    label = F.col("label").cast("string")
    none = F.lit(None).cast("array<bigint>")
    large = spooled(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK))
    labels = large.count()
    one = F.struct(label.alias("label"), "dim", F.lit(1).cast("long").alias("code"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    if not labels:
        return classes.select("cid", "copies", "v", none.alias("before"), F.lit(0).alias("piece"), one.alias("cell"))
    known = F.broadcast(large) if labels <= BROADCAST_LABELS else large
    small = classes.join(known.select("label", "dim"), ["label", "dim"], "left_anti").select("cid", "copies", "v", none.alias("before"), F.lit(0).alias("piece"), one.alias("cell"))
    big = classes.join(known, ["label", "dim"])
    ids = spooled(route(big, fit(big, large)))
    wide = big.select("cid", "label", "dim").join(ids, "cid")
    counts = wide.groupBy("label", "dim", "code").agg(F.count(F.lit(1)).alias("here")).filter(F.col("here") > 2 * BLOCK)
    met = wide.join(counts, ["label", "dim", "code"], "left")
    pieces = F.coalesce(F.ceil(F.col("here") / BLOCK), F.lit(1)).cast("int")
    met = met.withColumn("piece", F.pmod(F.xxhash64("cid"), pieces.cast("long")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    cell = F.struct(label.alias("label"), "dim", "code", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"))
    met = met.select("cid", "before", "piece", cell.alias("cell"))
    return small.unionByName(met.join(classes.select("cid", "copies", "v"), "cid").select(small.columns))


def links(dealt: DataFrame) -> DataFrame:
    """``a, b, n``: class ``a`` links to ``n`` vectors in a cell and is connected to ``b`` there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def one(part: pa.Table) -> pa.RecordBatch:
            cell = part["cell"][0].as_py()
            n = part.num_rows
            v = unit(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part["v"].chunks]).reshape(n, -1))
            before = None if cell["code"] == 1 else [np.array(c, np.int64) for c in part["before"].to_pylist()]
            cid = part["cid"].to_numpy()
            apart = part["piece"].to_numpy() if cell["i"] != cell["j"] else None
            count, root = compare(v, part["copies"].to_numpy(), before, apart, cell["code"] % (1 << 32))
            some = np.flatnonzero(count)
            return pa.RecordBatch.from_pydict({"a": cid[some], "b": cid[root[some]], "n": count[some]})

        def groups(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """All cells of ``table`` but the last, which may go on; that one too if ``last``."""
            keys = table["cell"].combine_chunks().to_pylist() if table.num_rows else []
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if k == len(keys) and not last:
                        break
                    if k - start > 1:
                        yield one(table.slice(start, k - start))
                    start = k
            held[:] = table.slice(start).to_batches()

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                yield from groups(pa.Table.from_batches([*held, batch.slice(lo, BLOCK)]), False)
        if held:
            yield from groups(pa.Table.from_batches(held), True)

    hashed = dealt.withColumn("cell_hash", F.xxhash64("cell"))
    ordered = hashed.repartition("cell_hash").sortWithinPartitions("cell_hash", "cell").drop("cell_hash")
    return map_arrow(ordered, run, T.StructType.fromDDL("a bigint, b bigint, n bigint"))


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, n_links, component_id, kept`` of each row of ``vectors``."""
    e = F.col(vector)
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), e.alias("v"), (e.isNotNull() & F.col(label).isNotNull() & finite & F.exists(e, lambda x: x != 0)).alias("valid"))
    # equal vectors of a label are one class, known by two hashes
    rows = rows.withColumn("h", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(1), "v", "label"))
    valid = rows.filter("valid")
    grouped = valid.groupBy("h", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    classes = stored(grouped.withColumn("dim", F.size("v")).withColumn("cid", F.monotonically_increasing_id()))
    found = spooled(links(cells(classes)))
    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    group = components(found.select("a", "b")).withColumnRenamed("node", "cid")
    slim = classes.select("h", "h2", "cid", "copies", "first")
    labelled = slim.join(group, "cid", "left").withColumn("group", F.coalesce("label", "cid")).drop("label")
    labelled = spooled(labelled.join(counts, "cid", "left").select("h", "h2", "copies", "group", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    ids = spooled(labelled.groupBy("group").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    known = stored(met_by_key(labelled, ids, "group").select("h", "h2", "copies", "n_links", "component_id"), classes.count())
    met = met_by_key(valid.select("id", "h", "h2"), known, ["h", "h2"], "copies")
    out = met.select("id", "n_links", "component_id").unionByName(rows.filter("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

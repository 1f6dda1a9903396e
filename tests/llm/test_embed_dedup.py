import numpy as np
import pytest

from arborweb.llm import embed_dedup
from arborweb.llm.components import components, roots

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, kept STRING"


def brute(rows):
    n = len(rows)
    ok = [e is not None and lab is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e) for _, e, lab in rows]
    links = np.zeros(n, int)
    a, b = [], []
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i] += 1
                    a.append(i)
                    b.append(j)
    up = roots(n, np.array(a, int), np.array(b, int))
    first = {}
    for k in range(n):
        if rows[k][0] is not None:
            first[up[k]] = min(first.get(up[k], 1 << 60), rows[k][0])
    return [(rows[k][0], links[k], first.get(up[k])) for k in range(n)]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    out, k = [], 0
    for label in (1, 2):
        for _ in range(12):
            center = draw.standard_normal(16)
            for _ in range(draw.integers(1, 7)):
                out.append((k, [float(x) for x in center + draw.standard_normal(16) * draw.choice([0.02, 0.15, 0.3])], label))
                k += 1
    out += [(k + 1, None, 1), (k + 2, [0.0] * 16, 1), (k + 3, [float("nan")] + [1.0] * 15, 1), (k + 4, [None] + [1.0] * 15, 2), (k + 5, [float("inf")] * 16, 2), (k + 6, [], 1), (k + 7, [1.0] * 16, None), (k + 8, [1.0] * 8, 1), (k + 9, [1.0] * 8, 1)]
    out += [out[0], out[0], (k + 10, out[0][1], 1), (k + 11, out[0][1], 2)]
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect())


def test_against_brute_force(spark, rows):
    want = sorted((i, n, c, i == c) for i, n, c in brute(rows))
    assert result(spark, rows) == want


def recall(got, want):
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    return sum(g[1] for g in got) / sum(w[1] for w in want)


def test_labels_of_several_blocks(spark, rows, monkeypatch):
    want = sorted((i, n, c, i == c) for i, n, c in brute(rows))
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    monkeypatch.setattr(embed_dedup, "FEWEST", 4)
    assert recall(result(spark, rows), want) >= 0.9
    monkeypatch.setattr(embed_dedup, "BROADCAST_LABELS", 0)
    assert recall(result(spark, rows), want) >= 0.9


def test_large_blocks_are_dealt_over_pieces(spark, rows, monkeypatch):
    want = sorted((i, n, c, i == c) for i, n, c in brute(rows))
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    # no node is split: each label is one block, in pieces
    monkeypatch.setattr(embed_dedup, "FEWEST", 1000)
    assert result(spark, rows) == want


def near(n, dim, seed=3):
    """Unit vectors and partners at a cosine of 0.93 exactly."""
    draw = np.random.default_rng(seed)
    x = embed_dedup.unit(draw.standard_normal((n, dim)))
    z = draw.standard_normal((n, dim))
    z = embed_dedup.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    return x, 0.93 * x + np.sqrt(1 - 0.93**2) * z


@pytest.mark.parametrize("depth", [1, 3, 5, 8])
def test_upper_part_keeps_pairs_together_at_a_bounded_spill(depth):
    x, y = near(20_000, 64)
    forest = embed_dedup.Forest(x, depth)
    at = np.full(len(x), depth)
    rows, codes = forest.blocks(np.concatenate([x, y]), np.concatenate([at, at]))
    assert len(rows) / (2 * len(x)) <= 1.15 * embed_dedup.SPREAD * len(forest.trees)
    assert sum(len(c) for _, levels in forest.trees for c, _, _ in levels) <= len(forest.trees) * len(x) / embed_dedup.FEWEST * 2
    pairs = np.unique(np.stack([rows % len(x), codes, rows // len(x)]), axis=1)
    both = (pairs[0, 1:] == pairs[0, :-1]) & (pairs[1, 1:] == pairs[1, :-1])
    assert len(np.unique(pairs[0, 1:][both])) / len(x) >= 0.9


def test_trees_of_a_block_are_deep_and_find_the_links():
    x, y = near(100, 64)
    v = np.concatenate([x, y])
    depth = []
    for _ in embed_dedup.leaves(v, 1, depth):
        pass
    assert max(depth) >= 5
    count, root = embed_dedup.compare(v, np.ones(len(v), int), None, None, 1)
    want = v @ v.T >= embed_dedup.NEAR
    np.fill_diagonal(want, False)
    assert count.sum() >= 0.99 * want.sum()


def test_empty_and_all_invalid(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None, 1), (2, [0.0], 1)]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components(spark):
    draw = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in draw.integers(-50, 150, (120, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7)]
    names = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(names)}
    up = roots(len(names), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    want = {names[k]: names[up[k]] for k in range(len(names))}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert all(want[n] == label for n, label in got.items())
    assert all(want[n] == n for n in want if n not in got)
    assert components(spark.createDataFrame([], "a LONG, b LONG")).collect() == []

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import ann
from marginalia.llm.queries import op8_ann


def exact(ids, vectors, queries, k):
    out = {}
    for q in queries:
        s = vectors @ vectors[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [ids[i] for i in order]
    return out


def lists(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_recall(spark):
    d = "/root/testdata/sf0.1"
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect())
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    got, want = lists(op8_ann(spark, d)), exact(ids, v, [i for i in ids if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    assert all([r["rank"] for r in x] == list(range(1, 21)) for x in got.values())
    assert np.mean([len({r["vec_id"] for r in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    for q, x in got.items():
        assert all(abs(r["score"] - v[ids.index(q)] @ v[ids.index(r["vec_id"])]) < 1e-12 for r in x)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, leaf int")


@pytest.mark.parametrize("part", [1 << 20, 7 * 8 * 4])
def test_all_leaves_are_exact_with_ties(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "PART_BYTES", part)
    monkeypatch.setattr(ann, "LEAVES", 16)
    monkeypatch.setattr(ann, "share_for", lambda *_: 1e9)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)] if i % 3 else [1.0, 1.0, 0.0, 0.0]) for i in range(400)]
    rows = [(i, v) for i, v in rows if any(v)]
    got = lists(ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=7))
    ids = [i for i, _ in rows]
    want = exact(ids, np.array([v for _, v in rows]), [i for i in ids if i % 20 == 0], 7)
    assert {q: [r["vec_id"] for r in x] for q, x in got.items()} == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (8, [1.0, 0.0, 0.0]), (40, None)]
    got = lists(ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20))
    assert {q: [r["vec_id"] for r in x] for q, x in got.items()} == {0: [7, 20], 20: [7, 0]}
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_forest_leaves_and_search():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(500, 8))
    forest = ann.grow(sample, trees=3, leaves=16)
    assert forest.n_leaves == 48
    others = rng.normal(size=(500, 8))  # members of the sample may lie on a plane
    leaf = forest.leaf_of(others)
    sizes = np.bincount(leaf.ravel(), minlength=48)
    margins = others @ forest.normals.T - forest.cuts
    for i in range(20):
        order = forest.search(margins[i], sizes, 1e9)
        assert sorted(order) == list(range(48))
        assert set(order[:3]) == set(leaf[i].tolist())  # its own leaves come first


def test_share_follows_the_vectors():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(60, 16)) * 4
    clustered = middle[np.arange(6000) % 60] + rng.normal(size=(6000, 16)) * 0.3
    forest, share = ann.fitted(clustered, 64, 20)
    assert share < 0.1
    leaf, queries = forest.leaf_of(clustered), range(0, 6000, 50)
    sizes = np.bincount(leaf.ravel(), minlength=forest.n_leaves)
    hit = []
    for q in queries:
        s = clustered @ clustered[q]
        s[q] = -np.inf
        visited = set(forest.search(forest.margins(clustered[q : q + 1])[0], sizes, share * len(clustered)))
        hit += [bool(visited & set(leaf[i].tolist())) for i in np.argsort(-s)[:20]]
    assert np.mean(hit) >= 0.9
    assert ann.fitted(rng.normal(size=(3000, 16)), 16, 20)[1] > share  # without structure more rows are visited

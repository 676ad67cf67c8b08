"""Nearest neighbours by a forest of random-projection trees.

Each tree splits a bounded sample (about FIT_ROWS vectors, by a hash of their id) at the
median of its projection on the difference of two random members, down to LEAVES leaves (fewer for a small sample), so the
leaves that a query visits don't grow in number with the table.
Every vector is indexed: it goes to one leaf of each tree. A query searches all trees
through one priority queue, ordered by the largest distance to a split plane on the way,
until the leaves it has taken hold ``share`` of the rows of one tree. Queries and vectors
then meet by leaf, leaves are scored exactly as matrix products in double precision, and
only the best k of a leaf leave it. That is done in two turns: the first leaves of the queue, as
many as there are trees, give each query a bound, its k-th best score there; what the other
leaves hold must reach it. So the number of candidates per query doesn't grow with the
rows. The final rank is over all candidates of a query.

The share is the least that finds RECALL of the true neighbours of sampled queries within the sample. Embeddings without structure need a large share, clustered ones a few percent. Leaves and their queries
are cut into parts of bounded bytes. Queries never are broadcast.

Nulls and ties: vectors that are null, zero, or hold null or non-finite components take no part; so do null ids, and vectors of
another length than the sample's most common one, which have no inner product with the others. Of rows with equal ids the one with the greatest vector, entry by entry, counts.
Equal scores rank by id. With fewer than k candidates all are returned. Very long vectors only make parts smaller. Other columns of any
name are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIT_ROWS, TREES, LEAVES = 16_384, 4, 256
#: The share of true neighbours that a search of the sample must find, and sampled queries.
RECALL, TRIALS = 0.96, 300
#: Queries that one task searches the trees for.
SEARCHES = 200
#: Bytes of the vectors of a part of a leaf, and of its queries, as doubles; small leaves share a part.
PART_BYTES = 32 << 20


@dataclass
class Forest:
    normals: np.ndarray
    cuts: np.ndarray
    sides: np.ndarray
    roots: list[int]
    n_leaves: int

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree; leaves are numbered over all trees."""
        out = np.empty((len(vectors), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            stack = [(root, np.arange(len(vectors)))]
            while stack:
                node, at = stack.pop()
                if node < 0:
                    out[at, t] = -1 - node
                elif len(at):
                    far = vectors[at] @ self.normals[node] > self.cuts[node]
                    stack += [(self.sides[node, 0], at[~far]), (self.sides[node, 1], at[far])]
        return out

    def margins(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.normals.T - self.cuts if len(self.cuts) else np.zeros((len(queries), 0))

    def search(self, margins: np.ndarray, sizes: np.ndarray, enough: float) -> list[int]:
        """Leaves of one query in the order of the queue. margins: to each plane; sizes: rows of each leaf."""
        heap, found, rows = [(0.0, r) for r in self.roots], [], 0
        while heap and rows < enough:
            way, node = heapq.heappop(heap)
            if node < 0:
                found.append(-1 - node)
                rows += sizes[-1 - node]
                continue
            m = margins[node]
            near = int(m > 0)
            heapq.heappush(heap, (way, int(self.sides[node, near])))
            heapq.heappush(heap, (max(way, abs(m)), int(self.sides[node, 1 - near])))
        return found


def share_for(forest: Forest, sample: np.ndarray, k: int, recall: float) -> float:
    """Rows that a search must visit, as a share of the rows of one tree, to find so much of the neighbours within the sample."""
    leaf = forest.leaf_of(sample)
    sizes = np.bincount(leaf.ravel(), minlength=forest.n_leaves)
    needed = []
    asked = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
    margins = forest.margins(sample[asked])
    for q, m in zip(asked.tolist(), margins, strict=True):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        k_q = min(k, len(sample) - 1)
        if not k_q:
            continue
        near = np.argpartition(-scores, k_q - 1)[:k_q]
        order = forest.search(m, sizes, np.inf)
        rows_by = np.empty(forest.n_leaves)
        rows_by[order] = np.cumsum(sizes[order])
        needed.append(rows_by[leaf[near]].min(1))
    needed = np.sort(np.concatenate(needed)) if needed else np.ones(1)
    return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] / len(sample))


def fitted(sample: np.ndarray, leaves: int, k: int, recall: float = RECALL) -> tuple[Forest, float]:
    """The forest, and the share of rows that a search visits."""
    forest = grow(sample, TREES, leaves)
    return forest, share_for(forest, sample, k, recall)


def grow(sample: np.ndarray, trees: int, leaves: int, seed: int = 5) -> Forest:
    rng = np.random.default_rng(seed)
    normals, cuts, sides, count = [], [], [], 0

    def split(at: np.ndarray, left: int) -> int:
        nonlocal count
        if left > 1 and len(at) > 1:
            for _ in range(3):
                a, b = rng.choice(at, 2, replace=False)
                normal = sample[a] - sample[b]
                size = np.linalg.norm(normal)
                if not size:
                    continue
                normal /= size
                p = sample[at] @ normal
                cut = float(np.median(p))
                far = p > cut
                if far.any() and not far.all():
                    node = len(normals)
                    normals.append(normal)
                    cuts.append(cut)
                    sides.append([0, 0])
                    sides[node] = [split(at[~far], left // 2), split(at[far], left // 2)]
                    return node
        count += 1
        return -count

    roots = [split(np.arange(len(sample)), leaves) for _ in range(trees)]
    dim = sample.shape[1]
    return Forest(np.array(normals).reshape(-1, dim), np.array(cuts), np.array(sides, np.int32).reshape(-1, 2), roots, count)


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best(queries: np.ndarray, names: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query name, id, score) of each query's best k vectors that reach its bound, itself left out."""
    rough = queries @ vectors.T
    if len(ids) > k + 1:  # the query itself may be among the best; ids don't repeat
        bounds = np.maximum(bounds, np.partition(rough, -k - 1, axis=1)[:, -k - 1])
    q, v = np.nonzero((rough >= bounds[:, None] - 1e-9) & (names[:, None] != ids[None]))
    score = np.empty(len(q))
    for at in range(0, len(q), 1 << 16):  # one sum per pair, so equal vectors have equal scores
        some = slice(at, at + (1 << 16))
        score[some] = (queries[q[some]] * vectors[v[some]]).sum(1)
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    top = place < k
    return names[q[top]], ids[v[top]], score[top]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows by inner product."""
    spark = vectors.sparkSession
    clean = vectors.where(usable(embedding) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), is_query.alias("is_query"))
    if clean.count() > clean.select("vec_id").distinct().count():
        clean = written(clean.groupBy("vec_id").agg(F.max("v").alias("v"), F.max("is_query").alias("is_query")), "ann-rows")
    sample = _sample(clean)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sample["v"].map(len).mode()[0])
    clean = clean.where(F.size("v") == dim)
    held = _matrix(sample[sample["v"].map(len) == dim]["v"])
    leaves = LEAVES
    while leaves > 1 and len(held) < (k + 1) * leaves:  # a leaf has the wanted rows and the query itself
        leaves //= 2
    forest, share = fitted(held, leaves, k, recall)
    trees = len(forest.roots)
    known = spark.sparkContext.broadcast(forest)
    kind = clean.schema["v"].dataType.simpleString()

    def index(frames):
        for pdf in frames:
            leaf = known.value.leaf_of(_matrix(pdf["v"]))
            yield pd.DataFrame({"leaf": leaf.ravel(), "vec_id": np.repeat(pdf["vec_id"].to_numpy(), leaf.shape[1]), "v": np.repeat(pdf["v"].to_numpy(), leaf.shape[1])})

    indexed = written(clean.select("vec_id", "v").mapInPandas(index, f"leaf int, vec_id long, v {kind}"), "ann-index")
    sizes = np.zeros(forest.n_leaves, np.int64)
    for row in indexed.groupBy("leaf").count().collect():  # one row per leaf: at most trees * leaves
        sizes[row["leaf"]] = row["count"]
    enough = share * sizes.sum() / trees

    def probe(frames):
        forest = known.value
        for pdf in frames:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                q = _matrix(some["v"])
                lists = [forest.search(m, sizes, enough) for m in forest.margins(q)]
                n = [len(x) for x in lists]
                place = np.concatenate([np.arange(x) for x in n])
                yield pd.DataFrame({"leaf": np.concatenate(lists).astype(np.int32), "query_id": np.repeat(some["vec_id"].to_numpy(np.int64), n), "v": np.repeat(some["v"].to_numpy(), n), "first": place < trees})

    asked = clean.where("is_query").select("vec_id", "v")
    asked = asked.repartition(max(1, -(-asked.count() // SEARCHES)), "vec_id").dropDuplicates(["vec_id"])
    probes = written(asked.mapInPandas(probe, f"leaf int, query_id long, v {kind}, first boolean"), "ann-probes")

    def meet(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_leaf = dict(list(rows.groupby("leaf")))
        for leaf, some in wanted.groupby("leaf"):
            if leaf in by_leaf:
                own = by_leaf[leaf]
                v, ids = _matrix(own["v"]), own["vec_id"].to_numpy(np.int64)
                step = max(1, (1 << 21) // len(v))
                for at in range(0, len(some), step):
                    part = some.iloc[at : at + step]
                    out.append(best(_matrix(part["v"]), part["query_id"].to_numpy(np.int64), part["bound"].to_numpy(), v, ids, k))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    plan = _parts(sizes, probes, dim)  # a row per leaf

    def parted(rows: DataFrame, name: str, is_row: bool) -> DataFrame:
        """Rows of a leaf in part i and queries in part j: rows come once per j, queries once per i."""
        rows = rows.join(F.broadcast(spark.createDataFrame(plan, "leaf int, group int, n_i int, n_j int")), "leaf")
        own = lambda n: F.pmod(F.xxhash64(name), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        if is_row:
            return rows.withColumn("i", own(F.col("n_i"))).withColumn("j", every("n_j"))
        return rows.withColumn("j", own(F.col("n_j"))).withColumn("i", every("n_i"))

    group = ["group", "i", "j"]

    def turn(wanted: DataFrame) -> DataFrame:
        left = parted(indexed, "vec_id", True).select(*group, "leaf", "vec_id", "v").groupBy(*group)
        right = parted(wanted, "query_id", False).select(*group, "leaf", "query_id", "v", "bound").groupBy(*group)
        met = left.cogroup(right).applyInPandas(meet, "query_id long, vec_id long, score double")
        return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = written(turn(probes.where("first").withColumn("bound", F.lit(float("-inf")))), "ann-first")
    bounds = first.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    rest = probes.where("not first").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    found = first.unionByName(turn(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parts(sizes: np.ndarray, probes: DataFrame, dim: int) -> list[tuple[int, int, int, int]]:
    """(leaf, group, parts of its rows, parts of its queries): small leaves share a group, and large ones are cut."""
    most = max(1, PART_BYTES // (8 * dim))
    asked = np.zeros(len(sizes), np.int64)
    for row in probes.groupBy("leaf").count().collect():  # one row per leaf
        asked[row["leaf"]] = row["count"]
    out, group, rows, wanted = [], -1, most, most
    for leaf, (n, q) in enumerate(zip(sizes.tolist(), asked.tolist(), strict=True)):
        if rows + n > most or wanted + q > most:
            group, rows, wanted = group + 1, 0, 0
        rows, wanted = rows + n, wanted + q
        out.append((leaf, group, max(1, -(-n // most)), max(1, -(-q // most))))
    return out


def _sample(clean: DataFrame) -> pd.DataFrame:
    """About FIT_ROWS vectors by hash of their id, all if there are fewer."""
    n = clean.count()
    few = clean.select("vec_id", "v")
    if n > FIT_ROWS:
        few = few.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(FIT_ROWS / n * (1 << 30)))
    return few.limit(2 * FIT_ROWS).toPandas().sort_values("vec_id").drop_duplicates("vec_id")

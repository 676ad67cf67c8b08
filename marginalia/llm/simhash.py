"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints: a text's words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) give shingles of
``width`` words, repeats included; a bit is 1 if it is set in over half of the shingles'
XXH64 (seed 42). A text of fewer words has its whole sequence as one shingle; a text
without words has fingerprint 0 and is linked like any other.

Search: fingerprints are cut into ``blocks`` of bits. Two of them that differ in at most r
bits differ in at most r // blocks bits of some block, so each block has a vantage-point
tree of its own, over that block's Hamming distance, with that smaller radius. A tree
node has a vantage point and a median distance mu; the search with radius b goes to both
sides only if the triangle inequality allows points there (d - b <= mu < d + b). A leaf is a
shard: the fingerprints that live there, and those from other leaves whose search overlaps
it. Leaves are numbered; a fingerprint visits only leaves behind its own, as the pair is
then found from the other side. Within a shard pairs are compared on all bits, in
blocks of numpy rows, a large shard by a further tree on its own points, and only a spanning star of each local component
leaves it, never the pairs. The trees are fitted on a bounded sample of fingerprints (``SAMPLE``);
any tree is exact, a poor one is only slower.

Components: the stars are joined by alternating large-star and small-star steps on
DataFrames, each step written to the shared folder. All labels are minima, which combine
before they are shuffled.

Nulls and ties: a null text is an empty one; rows with equal texts share a fingerprint,
which enters the search once. A null doc_id takes part in linking, but never is a component
id unless all ids of the component are null. Very long texts are hashed whole, in blocks of shingles. Columns besides doc_id and
text may have any names; those that begin with two underscores are the stage's own. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_table, lean, lean_driver, map_rows, slices, with_fields, written

SEED = 42
#: About so many fingerprints, and never twice as many, are fetched to fit the trees on.
SAMPLE = 262_144
#: Fingerprints that a leaf should hold.
LEAF = 1_024
#: Rows of a leaf that one task takes; a larger leaf is cut into parts that meet pair by pair.
PART = 100_000
#: Shingles that are held at once.
AT_ONCE = 1 << 16


def shingle_hashes(text: str, width: int) -> np.ndarray:
    w = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII spaces only
    digest, join = xxhash.xxh64_intdigest, b" ".join
    out = np.empty(max(1, len(w) - width + 1) if w else 0, np.uint64)
    for at in range(0, len(out), AT_ONCE):
        out[at : at + AT_ONCE] = [digest(join(w[i : i + width]), SEED) for i in range(at, min(at + AT_ONCE, len(out)))]
    return out


def _remix(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further hash of a hash (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(n)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, from the highest bit on."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), AT_ONCE):
        bits = np.unpackbits(h[at : at + AT_ONCE].astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # eight counters of a byte in a word
        total += sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None, width: int = 3, n_words: int = 1) -> list[int]:
    """n_words times 64 bits, as signed integers; the first is the fingerprint, the others a finer sketch."""
    h, out = shingle_hashes(text or "", width), []
    if not len(h):
        return [0] * n_words
    for n in range(n_words):
        bits = _bit_counts(_remix(h, n) if n else h) * 2 > len(h)
        out.append(int(np.packbits(bits).view(">i8")[0]))
    return out


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3, n_words: int = 1) -> DataFrame:
    """keep, fp long, and for n_words > 1 sketch array<long>."""

    def make():
        def step(batch):
            rows = [fingerprint(t.as_py(), width, n_words) for t in batch.column(text)]
            return {"fp": [r[0] for r in rows]} | ({"sketch": [r[1:] for r in rows]} if n_words > 1 else {})

        return step

    extra = "fp long" + (", sketch array<long>" if n_words > 1 else "")
    return map_rows(docs.select(*dict.fromkeys([*keep, text])), with_fields(docs, keep, extra), make)


class Tree:
    """Vantage-point tree over codes of one block; leaves are numbered from 0."""

    def __init__(self, codes: np.ndarray, leaf: int, seed: int = 1):
        self.vantage, self.mu, self.near, self.far = [], [], [], []
        self.leaves, self.rng = 0, np.random.default_rng(seed)
        self.root = self._grow(codes, leaf)

    def _grow(self, codes: np.ndarray, leaf: int) -> int:
        """A node's number, or -1 - the number of a leaf."""
        if len(codes) > leaf:
            for v in self.rng.choice(codes, 3):
                d = np.bitwise_count(codes ^ v).astype(np.int64)
                mu = int(np.sort(d)[(len(d) - 1) // 2])
                if d.max() == mu:
                    mu -= 1
                if mu >= d.min():
                    node = len(self.vantage)
                    for x, y in ((self.vantage, v), (self.mu, mu), (self.near, 0), (self.far, 0)):
                        x.append(y)
                    self.near[node] = self._grow(codes[d <= mu], leaf)
                    self.far[node] = self._grow(codes[d > mu], leaf)
                    return node
        self.leaves += 1
        return -self.leaves

    def visits(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into codes, leaf, whether it is the home leaf) of all leaves that a search overlaps."""
        out, stack = [], [(self.root, np.arange(len(codes)), np.ones(len(codes), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), -1 - node, np.int32), home))
                continue
            d = np.bitwise_count(codes[at] ^ self.vantage[node]).astype(np.int64)
            mu = self.mu[node]
            inner, outer = d - radius <= mu, d + radius > mu
            stack.append((self.near[node], at[inner], (home & (d <= mu))[inner]))
            stack.append((self.far[node], at[outer], (home & (d > mu))[outer]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool))


def cut(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of blocks of nearly equal width."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def code(fp: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    return (fp >> np.uint64(block[0])) & np.uint64((1 << block[1]) - 1)


def link_shard(fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root), as positions, of the points that have a link to a home point, without the roots."""
    where = np.flatnonzero(home)
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    homes = fps[where]
    step = max(1, (1 << 20) // max(1, len(homes)))
    for at in range(0, len(fps), step):
        close = np.bitwise_count(fps[at : at + step, None] ^ homes[None]) <= radius
        own = np.flatnonzero(home[at : at + step])
        close[own, np.searchsorted(where, at + own)] = False
        for i in np.flatnonzero(close.any(1)):
            others = where[close[i]]
            tops = parent[others]  # mostly one and the same root already
            for t in {root(int(j)) for j in np.unique(tops)}:
                a, b = root(int(at + i)), root(t)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            parent[others] = root(int(at + i))
    roots = np.array([root(i) for i in range(len(fps))], np.int64) if len(fps) else parent
    moved = roots != np.arange(len(fps))
    return np.flatnonzero(moved), roots[moved]


def link_leaf(fps: np.ndarray, home: np.ndarray, radius: int, block: tuple[int, int], within: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(member, root) of a leaf's links. A large leaf gets a tree of its own on its home points, so that not all of its pairs are compared."""
    codes = code(fps, block)
    if len(fps) <= 2 * LEAF:
        return [link_shard(fps, home, radius)]
    at, to, own = Tree(np.unique(codes[home]), LEAF // 2).visits(codes, within)
    out, order = [], np.lexsort((at, to))
    at, to, own = at[order], to[order], own[order]
    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        some = at[a:b]
        member, top = link_shard(fps[some], own[a:b] & home[some], radius)
        out.append((some[member], some[top]))
    return out


def links(fps: DataFrame, radius: int = 3, blocks: int = 2, leaf: int = LEAF, words: int = 1, name: str = "fp") -> DataFrame:
    """a, b: stars that connect exactly what is linked by fingerprints (fp, distinct rows) within radius.

    words: fingerprints of so many kinds (word, from 0) are searched at once, each kind by itself. name: the column that stands for a fingerprint in the result.
    """
    spark = fps.sparkSession
    n = fps.count()
    parts = cut(64, blocks) * words
    within = radius // blocks
    fps = fps.select(*dict.fromkeys(["fp", name]), F.col("word") if words > 1 else F.lit(0).alias("word"))
    few = fps
    if n > SAMPLE:  # those whose hash is low
        few = few.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
    drawn = few.select("fp", "word").limit(2 * SAMPLE).toArrow()  # without a Python object for each row
    kind = drawn["word"].to_numpy()
    samples = [np.sort(drawn["fp"].to_numpy()[kind == w]).view(np.uint64) for w in range(words) for _ in range(blocks)]
    least = max(4, leaf * len(kind) // max(n, 1))
    scale = n / max(len(kind), 1)
    del drawn, kind
    trees = [Tree(np.unique(code(x, p)) if len(x) else np.zeros(1, np.uint64), least) for x, p in zip(samples, parts, strict=True)]
    sizes = [t.leaves for t in trees]
    first = np.concatenate([[0], np.cumsum(sizes)])
    per_shard = max(1, int(first[-1]) * leaf // max(blocks * n, 1))  # small leaves share a group
    n_i, n_j = _cuts(trees, parts, first, samples, scale, within)
    known = spark.sparkContext.broadcast((trees, n_i, n_j))
    del samples

    kept = list(dict.fromkeys(["fp", name]))

    def route(batches):
        trees, n_i, n_j = known.value
        for pdf in (of_kind for whole in batches for _, of_kind in whole.groupby("word")):
            held, names = pdf["fp"].to_numpy(np.int64).view(np.uint64), {c: pdf[c].to_numpy(np.int64) for c in kept}
            start = int(pdf["word"].iloc[0]) * blocks
            for b, p in enumerate(parts[start : start + blocks], start):
                who, to, home = trees[b].visits(code(held, p), within)
                own = np.zeros(len(held), np.int64)
                own[who[home]] = to[home]
                keep = home | (to > own[who])
                who, to, home = who[keep], first[b] + to[keep], home[keep]
                mixed = _remix(held[who], 1)
                i, j = (mixed % n_i[to].astype(np.uint64)).astype(np.int64), (mixed % n_j[to].astype(np.uint64)).astype(np.int64)
                # all points of a leaf go to their part j, once for each part of home points; home points to their part i, once for each part j
                times = n_i[to]
                meet = _repeated(times)
                yield pd.DataFrame({"shard": np.repeat(to // per_shard, times), "leaf": np.repeat(to, times), "i": meet, "j": np.repeat(j, times), "home": np.repeat(home & (n_j[to] == 1), times) & (np.repeat(i, times) == meet), **{c: x[np.repeat(who, times)] for c, x in names.items()}})
                split = home & (n_j[to] > 1)
                if split.any():
                    who, to, i, times = who[split], to[split], i[split], n_j[to[split]]
                    yield pd.DataFrame({"shard": np.repeat(to // per_shard, times), "leaf": np.repeat(to, times), "i": np.repeat(i, times), "j": _repeated(times), "home": True, **{c: x[np.repeat(who, times)] for c, x in names.items()}})

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves, fp, home, named = pdf["leaf"].to_numpy(), pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool), pdf[name].to_numpy(np.int64)
        order = np.lexsort((home, fp, leaves))
        leaves, fp, home, named = leaves[order], fp[order], home[order], named[order]
        last = np.append((leaves[1:] != leaves[:-1]) | (fp[1:] != fp[:-1]), True)  # a home point may also stand there as one of all points
        leaves, fp, home, named = leaves[last], fp[last], home[last], named[last]
        block = np.searchsorted(first, leaves, "right") - 1
        edges = np.flatnonzero(np.diff(leaves, prepend=leaves[0] - 1, append=leaves[-1] + 1))
        found = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                own = named[a:b]
                for member, top in link_leaf(fp[a:b].view(np.uint64), home[a:b], radius, parts[block[a]], within):
                    found.append(pd.DataFrame({"a": own[top], "b": own[member]}))
        return pd.concat(found)

    routed = fps.mapInPandas(route, f"shard long, leaf long, i long, j long, home boolean, {', '.join(f'{c} long' for c in kept)}")
    return written(routed.groupBy("shard", "i", "j").applyInPandas(shard, "a long, b long"), "simhash-stars")


def _repeated(times: np.ndarray) -> np.ndarray:
    """0 to times - 1 for each of times."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _cuts(trees: list[Tree], parts: list[tuple[int, int]], first: np.ndarray, samples: list[np.ndarray], scale: float, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the home points and of all points of each leaf, each pair of which meets in a task of its own.

    Expected from the samples, one a tree, whose points stand for scale points each: leaves of up to PART points stay whole.
    """
    homes, all_of = np.zeros(int(first[-1])), np.zeros(int(first[-1]))
    for b, (tree, p, sample) in enumerate(zip(trees, parts, samples, strict=True)):
        _, to, home = tree.visits(code(sample, p), within)
        homes += np.bincount(first[b] + to[home], minlength=len(homes))
        all_of += np.bincount(first[b] + to, minlength=len(homes))
    parts_of = lambda x: np.maximum(1, np.ceil(x * scale / PART)).astype(np.int64)
    large = all_of * scale > PART
    return np.where(large, parts_of(homes), 1), np.where(large, parts_of(all_of), 1)


def components(stars: DataFrame) -> DataFrame:
    """node, root (the least node that is reachable) of all nodes in stars (a, b)."""
    edges = written(stars.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node go to the least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written_large = written(large, "cc-large")
        # small star: a node and its neighbours below it go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small = written(small.select("e.u", "e.v").where("u <> v").distinct(), "cc-small")
        discard(edges)
        discard(written_large)
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node above another (u) has one edge, to a node (v) that is above none. Components are then read off the edges."""
    ends = edges.select("u", F.lit(1).alias("above")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("above")))
    odd = ends.groupBy("u").agg(F.sum("above").alias("above"), F.min("above").alias("least")).where("above > 1 or above > 0 and least = 0")
    return odd.limit(1).count() == 0


def _with_roots(points: DataFrame, stars: DataFrame, name: str) -> DataFrame:
    found = components(stars)
    return points.join(found, points[name] == found["node"], "left").withColumn("root", F.coalesce("root", name)).drop("node")


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that is reachable) of every row."""
    rows = written(with_fingerprints(docs, ["doc_id"], text, width), "simhash-rows")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    rooted = written(_with_roots(points, links(points.select("fp"), radius), "fp"), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


#: The deduplicating stage: rows are linked if the sets of their five-word shingles have a Jaccard similarity of at least NEAR.
STAGE = {"width": 5}
NEAR = (4, 5)
#: Words of the stage's fingerprints, bits of all of them in which two sets so similar differ at most, and the size below which sets are
#: compared whatever their fingerprints say. The angle of similar sets is at most acos(8/9), so a bit differs with a probability of 0.151, that is, 38.8 of 256
#: with a deviation of 5.7, if a bit sums many shingles; FAR is 7.2 deviations more. Bits of small sets are no such sums.
WORDS, FAR, SMALL = 4, 80, 64
#: Texts that are sampled to find frequent shingles, in how many of them one is frequent, and how many are known at most.
HOT_TEXTS, HOT_LEAST, HOT_MOST = 10_000, 5, 50_000
#: Shared shingles, 16 bytes each, that may be sent to all tasks; a list of more sets than HOT_LIST is joined by sending its row to all tasks.
SHARED_SENT, HOT_LIST = 500_000, 5_000
#: Pairs of one point that a task compares, and sets of a family, or rows of a list, that one task takes.
PIVOT_PAIRS, TILE = 2_000, 1_500
#: Pairs that are looked at at once by size and fingerprint, those that are compared at once, and bytes that the sets of a family may take as bits.
CLOSE_PAIRS, EXACT_PAIRS, SET_BYTES = 1 << 19, 1 << 14, 32 << 20
#: Rows of small lists, and of small families, that one group of a task should have.
LIST_ROWS, FAMILY_ROWS = 20_000, 1_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", width))


def set_name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def set_sketch(s: np.ndarray) -> list[int]:
    """WORDS times 64 bits of a set's fingerprint."""
    return [int(np.packbits(_bit_counts(_remix(s, n + 1)) * 2 > len(s)).view(">i8")[0]) for n in range(WORDS)]


def frequent_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Hashes that many texts of a sample have, the rarest first. They only decide an order: any order finds all pairs."""
    n = docs.count()
    some = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < max(1, int(min(1.0, HOT_TEXTS / max(n, 1)) * (1 << 30)))).dropDuplicates()

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = [shingle_set(t.as_py(), width) for t in batch.column(text)]
            yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())})

    counts = some.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_LEAST)
    hot = counts.orderBy(F.desc("n"), "token").limit(HOT_MOST).select("token").toArrow()
    return hot["token"].to_numpy()[::-1].copy().view(np.uint64)


def prefix_tokens(docs: DataFrame, hot: np.ndarray, text: str, width: int) -> DataFrame:
    """token, pid, rest: the first shingles of each set, so many that of two sets with a similarity of NEAR one is common, and how many of the set there are from it on.

    All sets are in one order, frequent shingles last. A task leaves out sets that it has had among its last ones.
    """
    by_hash = np.argsort(hot)
    known = docs.sparkSession.sparkContext.broadcast((hot[by_hash], by_hash))

    def run(batches):
        lean()
        values, rank = known.value
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            tokens, pids, rests = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for t in batch.column(text):
                s = shingle_set(t.as_py(), width)
                pid = set_name(s)
                if pid in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(pid)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    is_hot = values[at] == s
                    s = np.concatenate([s[~is_hot], s[is_hot][np.argsort(rank[at[is_hot]])]])
                first = s[: len(s) - -(-len(s) * NEAR[0] // NEAR[1]) + 1]
                tokens.append(first.view(np.int64))
                pids.append(np.full(len(first), pid, np.int64))
                rests.append(len(s) - np.arange(len(first), dtype=np.int32))
            yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(tokens)), "pid": pa.array(np.concatenate(pids)), "rest": pa.array(np.concatenate(rests))})

    return docs.select(text).mapInArrow(run, "token long, pid long, rest int")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of at least NEAR. A frequent a is dealt over tasks."""
    deals = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_PAIRS).alias("deals")), "simhash-pivots")
    left = sets.join(deals, sets["pid"] == deals["a"]).select("a", F.col("hashes").alias("of_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    right = sets.select(F.col("pid").alias("b"), F.col("hashes").alias("of_b"))
    dealt = pairs.join(deals, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("deals")).alias("deal"))
    both = dealt.join(right, "b").join(left, ["a", "deal"])
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common * NEAR[1] >= (F.size("of_a") + F.size("of_b") - common) * NEAR[0]).select("a", "b")


def _by_token(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Joins rows (token, n, ..) with lists (token, ..), n being about the rows of a token: at most rows / HOT_LIST lists are hot, and only these are sent to all tasks."""
    hot = rows.where(F.col("n") > HOT_LIST)
    return rows.where(F.col("n") <= HOT_LIST).join(lists, "token").unionByName(hot.join(F.broadcast(lists.where(F.col("size_of") > HOT_LIST)), "token"))


def candidates(sketch: np.ndarray, size: np.ndarray, root: np.ndarray, rest: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs that may be similar enough and have different roots, each once, CLOSE_PAIRS at a time.

    Sets are sorted by size, so a set's partners are a range. rest: how many of a set's shingles there are from the one on that all
    share; if that is the first that a pair shares, it shares no more than the smaller rest. That bounds the range: pages with much
    in common but too much of their own in front have none. The largest group of equal roots isn't compared with itself.
    """
    order = np.argsort(size, kind="stable")
    sketch, size = sketch[order], size[order]
    _, name, count = np.unique(root[order], return_inverse=True, return_counts=True)
    most = size * NEAR[1] // NEAR[0]
    if rest is not None:
        rest = rest[order]
        most = np.minimum(most, rest * sum(NEAR) // NEAR[0] - size)
    main = name == count.argmax()
    places = np.arange(len(size))
    for own, others in ((places[~main], places), (places[main], places[~main])):
        low = np.searchsorted(others, own, "right")
        many = np.maximum(0, np.searchsorted(size[others], most[own], "right") - low)
        ends, at = np.cumsum(many), 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CLOSE_PAIRS, "right")))
            n = many[at:to]
            i = np.repeat(own[at:to], n)
            j = others[np.repeat(low[at:to] - np.cumsum(n) + n, n) + np.arange(len(i))]
            at = to
            if rest is not None:
                ok = np.flatnonzero(np.minimum(rest[i], rest[j]) * sum(NEAR) >= (size[i] + size[j]) * NEAR[0])
                i, j = i[ok], j[ok]
            ok = np.flatnonzero(name[i] != name[j])
            i, j = i[ok], j[ok]
            differ = sum(np.bitwise_count(sketch[i, w] ^ sketch[j, w]).astype(np.int16) for w in range(WORDS))
            ok = np.flatnonzero((differ <= FAR) | (size[i] < SMALL) | (size[j] < SMALL))
            yield order[i[ok]], order[j[ok]]


def similar(sets: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells of pairs (i, j) of sets whether their Jaccard similarity is at least NEAR, exactly.

    What only one set has is in no intersection. The rest become columns, and a set a row of bits, if that takes at most
    SET_BYTES; else sets are intersected pair by pair.
    """
    size = np.array([len(x) for x in sets])
    flat = np.concatenate([np.empty(0, np.int64), *sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    width = -(-(int(number[-1]) + 1 if len(number) else 0) // 64) * 64
    enough = lambda i, j, common: common * sum(NEAR) >= (size[i] + size[j]) * NEAR[0]
    if len(sets) * width > 8 * SET_BYTES:
        return lambda i, j: enough(i, j, np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]))
    shared, row = count[column] > 1, np.repeat(np.arange(len(sets)), size)
    row, column, bits = row[shared], number[column[shared]], np.empty((len(sets), width // 64), np.uint64)
    for at in range(0, len(sets), 64):
        own = slice(*np.searchsorted(row, (at, at + 64)))
        block = np.zeros((min(64, len(sets) - at), width), bool)
        block[row[own] - at, column[own]] = True
        bits[at : at + 64] = np.packbits(block, axis=1).view(np.uint64)
    return lambda i, j: enough(i, j, np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64))


def spanning(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]], right: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions of the components of pairs; right(i, j), if given, is asked for pairs that aren't connected yet."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for one, other in pairs:
        step = EXACT_PAIRS if right else max(1, len(one))
        for at in range(0, len(one), step):
            i, j = one[at : at + step], other[at : at + step]
            if right:
                now = np.array([root(x) for x in range(n)])
                apart = now[i] != now[j]
                i, j = i[apart], j[apart]
                ok = right(i, j) if len(i) else np.zeros(0, bool)
                i, j = i[ok], j[ok]
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(n)], np.int64)
    moved = np.flatnonzero(roots != np.arange(n))
    return moved, roots[moved]


def _edges(names: np.ndarray) -> zip:
    """(start, end) of runs of equal names."""
    at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]])) if len(names) else np.zeros(1, int)
    return zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def _stars(pid: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    member = np.concatenate([np.empty(0, np.int64), *(m for m, _ in found)])
    top = np.concatenate([np.empty(0, np.int64), *(t for _, t in found)])
    return pd.DataFrame({"a": pid[top], "b": pid[member]})


def _tiled(rows: DataFrame, name: str, size: str, packs: int) -> DataFrame:
    """Adds pack, i, j: groups of more than TILE rows (size) are cut into parts that meet pair by pair; small groups share one of the packs."""
    parts = F.ceil(F.col(size) / F.lit(TILE)).cast("int")
    own = F.pmod(F.xxhash64("pid"), parts).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pack = F.pmod(F.xxhash64(name), F.lit(1 << 40))
    pack = F.when(parts > 1, pack + F.lit(packs)).otherwise(F.pmod(F.xxhash64(name), F.lit(packs)))
    return rows.withColumns({"pack": pack, "i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other")


def families(lists: DataFrame, packs: int) -> DataFrame:
    """a, b: stars that connect sets which are in one list (token, pid, rest, n, root, size, sketch) and may be similar by size, place and fingerprints."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["token", "pid"], kind="stable")
        pid, size, root, rest = (pdf[c].to_numpy(np.int64) for c in ("pid", "size", "root", "rest"))
        sketch = np.stack(pdf["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
        found = []
        for a, b in _edges(pdf["token"].to_numpy(np.int64)):
            member, top = spanning(b - a, candidates(sketch[a:b], size[a:b], root[a:b], rest[a:b])) if b - a > 1 else (np.empty(0, np.int64),) * 2
            found.append((a + member, a + top))
        out = _stars(pid, found).drop_duplicates()
        del pdf, pid, size, root, rest, sketch, found
        lean()
        return out

    return _tiled(lists, "token", "n", packs).groupBy("pack", "i", "j").applyInPandas(run, "a long, b long")


def family_links(members: DataFrame, packs: int) -> DataFrame:
    """a, b: stars of the links between members (family, n, pid, root, size, sketch, hashes) of each family, confirmed on their sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["family", "pid"], kind="stable")
        pid, size, root = (pdf[c].to_numpy(np.int64) for c in ("pid", "size", "root"))
        sketch, sets = np.stack(pdf["sketch"].to_numpy()).astype(np.int64).view(np.uint64), pdf["hashes"].to_numpy()

        found = []
        for a, b in _edges(pdf["family"].to_numpy(np.int64)):
            member, top = spanning(b - a, candidates(sketch[a:b], size[a:b], root[a:b]), similar(list(sets[a:b])))
            found.append((a + member, a + top))
        out = _stars(pid, found)
        del pdf, pid, size, root, sketch, sets, found
        lean()
        return out

    return _tiled(members, "family", "n", packs).groupBy("pack", "i", "j").applyInPandas(run, "a long, b long")


def _sets(docs: DataFrame, owners: DataFrame, text: str, width: int) -> DataFrame:
    """pid, hashes of the sets of one row each. owners: pid and key, a written table; docs: key and text."""

    def make():
        def step(batch):
            sets = [shingle_set(t.as_py(), width) for t in batch.column(text)]
            return {"pid": [set_name(s) for s in sets], "hashes": [s.view(np.int64) for s in sets]}

        return step

    rows = join_table(docs, owners.select("key"), ["key"], "left_semi", hot=False).select(text)
    return map_rows(rows, with_fields(rows, [], "pid long, hashes array<long>"), make).dropDuplicates(["pid"])


def tree_pairs(points: DataFrame) -> DataFrame:
    """a, b: pairs of sets that operator 3's trees bring together, as the search of each of the WORDS fingerprints of a sketch finds them.

    Sets with one fingerprint stand for it by the least of them. points: pid, sketch; a written table.
    """
    held = points.select("pid", F.posexplode("sketch").alias("word", "fp"))
    first = written(held.groupBy("word", "fp").agg(F.min("pid").alias("of"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    stars = links(first.select("word", "fp", "of"), words=WORDS, name="of")  # one search for all words: four made four times the jobs, which the driver remembers
    same = join_table(held, first.where("n > 1").drop("n"), ["word", "fp"], "inner").where("pid <> of").select(F.col("of").alias("a"), F.col("pid").alias("b"))
    found = written(stars.unionByName(same).distinct(), "simhash-trees")
    discard(first)
    return found


def jaccard_links(docs: DataFrame, points: DataFrame, text: str, width: int) -> DataFrame:
    """a, b: links between sets (named by pid) with the components that all pairs with a similarity of at least NEAR make.

    Candidates come from the trees first (tree_pairs), whose radius finds the closest; the rest, which no such radius holds, is found exactly by shingles:
    two similar sets have one of their first shingles in common; the first of these leaves both enough others to share. The pivot of a shingle's list is the set with which most others share
    shingles, as with the origin of many copies; first each set meets one pivot, the one that most of its lists have. Lists whose sets
    are all linked then drop out. Sets of the other lists that may be similar by their fingerprints make families, and
    within these the pairs that are not connected yet are compared. Every link is confirmed on the sets themselves, and only spanning
    stars leave a task, never pairs. docs: text and key; points: pid, size, sketch and the key of one row with it.
    """
    hot = frequent_shingles(docs, text, width)
    tokens = lambda: prefix_tokens(docs, hot, text, width)  # noqa: E731  made twice from the texts, which takes less than storing them
    shared = tokens().groupBy("token").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = written(shared.where("lo < hi").select("token", "n"), "simhash-shared")
    few = shared.limit(SHARED_SENT + 1).count() <= SHARED_SENT
    met = written(tokens().join(F.broadcast(shared) if few else shared, "token").distinct(), "simhash-met")
    discard(shared)
    fame = written(met.groupBy("pid").agg(F.sum("n").alias("fame")), "simhash-fame")
    of_set = written(fame.join(points.select("pid", "size", "sketch"), "pid"), "simhash-sizes")
    owner = points.select("pid", "key")
    ranked = join_table(met, of_set.select("pid", "size", "fame"), ["pid"], "inner", hot=False)
    order = F.struct((-F.col("fame")).alias("h"), F.col("pid").alias("a"), F.col("size").alias("size_a"), F.col("rest").alias("rest_a"))
    pivots = ranked.groupBy("token").agg(F.min(order).alias("p"), F.max("n").alias("size_of")).select("token", "size_of", "p.*")
    both = _by_token(ranked, written(pivots, "simhash-pivots"))
    fits = (F.col("pid") != F.col("a")) & (F.least("size", "size_a") * NEAR[1] >= F.greatest("size", "size_a") * NEAR[0])
    fits &= F.least("rest", "rest_a") * sum(NEAR) >= (F.col("size") + F.col("size_a")) * NEAR[0]
    shared_with = both.where(fits).groupBy(F.col("pid").alias("b"), "a").agg(F.count(F.lit(1)).alias("c"))
    pairs = shared_with.groupBy("b").agg(F.max(F.struct("c", "a")).alias("p")).select("p.a", "b")
    sketch = lambda name: of_set.select(F.col("pid").alias(name), F.col("sketch").alias(f"of_{name}"), F.col("size").alias(f"size_{name}"))
    differ = sum((F.bit_count(F.get("of_a", F.lit(i)).bitwiseXOR(F.get("of_b", F.lit(i)))) for i in range(WORDS)), F.lit(0))
    pairs = pairs.join(sketch("b"), "b").join(sketch("a"), "a").where((differ <= FAR) | (F.least("size_a", "size_b") < SMALL)).select("a", "b")
    near = tree_pairs(points)
    lean_driver(docs.sparkSession)
    pairs = written(near.unionByName(pairs).distinct(), "simhash-pairs")
    lean_driver(docs.sparkSession)
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("pid")).distinct().join(owner, "pid"), "simhash-asked")
    sets = written(_sets(docs, asked, text, width), "simhash-sets")
    first = written(_confirmed(pairs, sets), "simhash-links")
    discard(sets)
    roots = written(components(first).withColumnRenamed("node", "pid"), "simhash-turn")
    now = written(join_table(met, roots, ["pid"], hot=False).withColumn("root", F.coalesce("root", "pid")), "simhash-lists")
    discard(met)
    mixed = now.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("n").alias("size_of")).where("lo < hi").select("token", "size_of")
    left = _by_token(now, written(mixed, "simhash-mixed")).drop("size_of")
    left = join_table(left, of_set.select("pid", "size", "sketch"), ["pid"], "inner", hot=False)
    lean_driver(docs.sparkSession)
    near = written(families(left, now.count() // LIST_ROWS + 1), "simhash-near")
    family = written(components(near).select(F.col("node").alias("pid"), F.col("root").alias("family")), "simhash-families")
    counts = written(family.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "simhash-counts")
    members = _sets(docs, written(family.join(owner, "pid"), "simhash-asked"), text, width)
    members = join_table(members.join(family, "pid").join(of_set.select("pid", "size", "sketch"), "pid"), roots, ["pid"], hot=False).withColumn("root", F.coalesce("root", "pid"))
    second = family_links(join_table(members, counts, ["family"], "inner"), family.count() // FAMILY_ROWS + 1)
    return written(first.unionByName(second), "simhash-links")


def keep_one(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without all but one row of each group of near-duplicates.

    Links are pairs whose sets of shingles have a Jaccard similarity of at least NEAR, computed on the
    sets; a group is a component of them. The row with the smallest doc_id stays (null ids last, then by
    the text's MD5); of rows that agree in id and text, one stays. Only ids and digests of rows that go are
    joined with the texts.
    """
    width = (STAGE | options)["width"]
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))))

    def make():
        def step(batch):
            sets = [shingle_set(t.as_py(), width) for t in batch.column("text")]
            return {"pid": [set_name(s) for s in sets], "size": [len(s) for s in sets], "sketch": [set_sketch(s) for s in sets]}

        return step

    keyed = docs.select("doc_id", key.alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))
    rows = written(map_rows(keyed, with_fields(keyed, ["doc_id", "key", "digest"], "pid long, size long, sketch array<long>"), make), "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "digest", "key")
    lean_driver(docs.sparkSession)  # before this stage it may have trained a model
    points = written(rows.groupBy("pid").agg(F.min(first).alias("first"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "simhash-points")
    links_found = jaccard_links(keyed.select("key", "text"), points.select("pid", "size", "sketch", "first.key"), "text", width)
    rooted = written(_with_roots(points, links_found, "pid"), "simhash-rooted")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"), F.lit(True).alias("kept"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    marks = counted.join(kept, "key", "left").where("kept is null or copies > 1")
    marks = written(marks.select(F.col("key").alias("__key"), F.coalesce("kept", F.lit(False)).alias("__twice")), "simhash-marks")
    marked = join_table(docs.withColumn("__key", key), marks, ["__key"], hot=False)
    alone = marked.where("__twice is null").select(*docs.columns)
    return alone.unionByName(marked.where("__twice").dropDuplicates(["__key"]).select(*docs.columns))

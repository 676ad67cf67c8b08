import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import common as llm_common
from marginalia.llm import simhash
from marginalia.llm.queries import op3_simhash

from .helpers import docs_table, odd_rows


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps, radius):
    """Least position that is reachable, for each fingerprint."""
    top = list(range(len(fps)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fps))]


@given(st.text(alphabet="aB \n\té漢.", max_size=80), st.integers(1, 5))
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width)[0] % (1 << 64) == plain_fingerprint(text, width)


def test_fingerprint_of_many_shingles(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(2000))
    assert simhash.fingerprint(text)[0] % (1 << 64) == plain_fingerprint(text, 3)
    whole = simhash.fingerprint(text, 3, 4)
    monkeypatch.setattr(simhash, "AT_ONCE", 300)
    assert simhash.fingerprint(text, 3, 4) == whole


@pytest.mark.parametrize("bits,leaf,radius", [(32, 8, 1), (64, 4, 3), (10, 1, 1), (8, 1, 2)])
def test_tree_visits_all_that_is_near(bits, leaf, radius):
    rng = np.random.default_rng(1)
    some = rng.integers(0, 1 << min(bits, 62), 300, dtype=np.uint64) & np.uint64((1 << bits) - 1)
    near = some ^ (np.uint64(1) << rng.integers(0, bits, 300).astype(np.uint64))
    codes = np.unique(np.concatenate([some, near]))
    tree = simhash.Tree(codes[::3], leaf)
    at, to, home = tree.visits(codes, radius)
    own = np.full(len(codes), -1)
    own[at[home]] = to[home]
    assert (own >= 0).all() and home.sum() == len(codes)
    seen = set(zip(at.tolist(), to.tolist(), strict=True))
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= radius):
            assert (i, own[j]) in seen


@settings(max_examples=40)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=40, unique=True), st.integers(0, 3), st.randoms())
def test_shard_links(values, radius, rng):
    fps = np.array(values, np.uint64)
    home = np.array([rng.random() < 0.6 for _ in values])
    member, top = simhash.link_shard(fps, home, radius)
    got = np.arange(len(fps))
    got[member] = top
    want = list(range(len(fps)))

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    for i in range(len(fps)):
        for j in range(len(fps)):
            if i != j and home[j] and int(fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                want[max(a, b)] = min(a, b)
    assert got.tolist() == [root(i) for i in range(len(fps))]


def chain(rng, n):
    """Fingerprints with clusters, chains of small steps, and strangers."""
    out = []
    for _ in range(n // 20):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(10):
            out.append(x)
            for b in rng.integers(0, 64, 2):
                x ^= 1 << int(b)
        out += [int(rng.integers(0, 1 << 62)) for _ in range(10)]
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("radius,blocks,leaf,part", [(3, 2, 16, 50_000), (3, 2, 4, 50_000), (11, 6, 16, 50_000), (3, 4, 16, 50_000), (3, 2, 16, 20)])
def test_links_lose_nothing(spark, monkeypatch, radius, blocks, leaf, part):
    monkeypatch.setattr(simhash, "PART", part)
    fps = sorted(chain(np.random.default_rng(radius + blocks), 600))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    stars = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, blocks, leaf=leaf)
    found = {r["node"]: r["root"] for r in simhash.components(stars).collect()}
    groups = {}
    for x, top in zip(signed, plain_components(fps, radius), strict=True):
        groups.setdefault(top, set()).add(x)
    got = {}
    for x in signed:
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_large_leaves_have_a_tree_of_their_own(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 20)
    fps = np.array(sorted(chain(np.random.default_rng(3), 900)), np.uint64)
    home = np.random.default_rng(4).random(len(fps)) < 0.5
    found = simhash.link_leaf(fps, home, 3, (0, 32), 1)
    assert len(found) > 3
    got = {(int(a), int(b)) for member, top in found for a, b in zip(member, top, strict=True)}
    linked = {(a, b) for a, b in got if (fps[a] ^ fps[b]).bit_count() <= 3}
    top = list(range(len(fps)))

    def root(top, i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in got:
        x, y = root(top, a), root(top, b)
        top[max(x, y)] = min(x, y)
    assert linked
    low = np.uint64((1 << 32) - 1)
    for i in range(len(fps)):
        near = (np.bitwise_count(fps ^ fps[i]) <= 3) & (np.bitwise_count((fps ^ fps[i]) & low) <= 1) & home
        assert all(root(top, i) == root(top, int(j)) for j in np.flatnonzero(near))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(d["text"], 3) for d in docs]
    tops = plain_components(fps, 3)
    want = sorted((d["doc_id"], f"{f:016x}", docs[t]["doc_id"]) for d, f, t in zip(docs, fps, tops, strict=True))
    assert sorted(map(tuple, op3_simhash(spark, sf_dir).collect())) == want


def test_components_of_a_path(spark):
    rows = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 98)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}


def test_odd_rows(spark):
    docs = docs_table(spark, odd_rows())
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows())
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in got if r["fp"] == 0} == {3}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in kept.collect()) == sorted([(1, 33), (3, 0), (-1, 20), (5, len(odd_rows()[7][1])), (7, len(odd_rows()[9][1]))])


def test_stage_catches_near_copies_and_keeps_others(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(5000)]
    originals = [list(rng.choice(words, 300)) for _ in range(40)]
    rows = []
    for i, w in enumerate(originals):
        rows.append((i, " ".join(w), "en", "a"))
        copy = list(w)
        copy[int(rng.integers(0, 300))] = "changed"  # Jaccard similarity of five-word shingles about 0.97
        rows += [(100 + i, " ".join(copy), "en", "a"), (200 + i, " ".join(w), "en", "a")]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs_table(spark, rows)).collect())
    assert kept == list(range(40))


def test_stage_finds_close_copies_by_the_trees(spark, monkeypatch):
    """Without any candidates from shingles the trees alone bring close copies together."""
    found = spark.createDataFrame([], "token long, pid long, rest int")
    monkeypatch.setattr(simhash, "prefix_tokens", lambda *_: found)
    rng = np.random.default_rng(5)
    originals = [[f"word{x}" for x in rng.integers(0, 5000, 900)] for _ in range(20)]
    texts = [" ".join(w) for w in originals] + [" ".join([*w[:450], "changed", *w[451:]]) for w in originals]
    kept = simhash.keep_one(docs_table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_words_of_a_sketch_are_searched_at_once(spark, monkeypatch):
    """One search, fetched without a Python object for each row, links what each word links by itself."""
    rng, calls, search = np.random.default_rng(6), [], simhash.links
    words = [chain(rng, 140)[:100] for _ in range(simhash.WORDS)]
    words[1][:40] = [words[1][0]] * 40  # one fingerprint of many sets
    signed = [[int(np.uint64(x).astype(np.int64)) for x in w] for w in words]
    points = spark.createDataFrame([(pid, [w[pid] for w in signed]) for pid in range(100)], "pid long, sketch array<long>")

    def once(*args, **options):
        calls.append(args)
        return search(*args, **options)

    def refused(*_):
        raise AssertionError("rows are fetched one by one")

    monkeypatch.setattr(simhash, "links", once)
    monkeypatch.setattr(type(points), "toPandas", refused)
    found = simhash.tree_pairs(simhash.written(points, "points"))
    assert len(calls) == 1
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    near = {(a, b): min((w[a] ^ w[b]).bit_count() for w in words) <= 3 for a in range(100) for b in range(100)}
    edges = lambda ps: spark.createDataFrame(list(ps), "a long, b long")
    roots = lambda ps: {r["node"]: r["root"] for r in simhash.components(edges(ps)).collect()}
    assert roots(pairs) == roots([p for p, ok in near.items() if ok and p[0] < p[1]])


def test_stars_take_no_step(spark, monkeypatch):
    names, write = [], simhash.written

    def named(table, name):
        names.append(name)
        return write(table, name)

    monkeypatch.setattr(simhash, "written", named)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame([(1, 2), (3, 1), (9, 8)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert names == ["cc-edges"]


def test_empty(spark):
    docs = docs_table(spark, [])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_text(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in a third of all rows").otherwise(F.concat(F.lit("other text number "), F.md5(F.col("id").cast("string")))).alias("text"))
    got = simhash.near_duplicates(docs)
    assert got.where("doc_id % 3 = 0").select("component_id").distinct().count() == 1


def plain_kept(texts, width=5):
    """Positions that stay: the least of each component of pairs with a Jaccard similarity of at least 0.8."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return [i for i in range(len(texts)) if root(i) == i]


@pytest.mark.parametrize("tile,sent", [(1_500, 10**6), (4, 0)])
def test_stage_equals_brute_force_jaccard(spark, monkeypatch, tile, sent):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "LIST_ROWS", 50)
    monkeypatch.setattr(simhash, "FAMILY_ROWS", 20)
    monkeypatch.setattr(simhash, "SHARED_SENT", sent)
    monkeypatch.setattr(simhash, "HOT_LIST", 10**6 if sent else 3)
    monkeypatch.setattr(simhash, "PIVOT_PAIRS", 3)
    if not sent:
        monkeypatch.setattr(llm_common, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    common = list(rng.choice(words, 40))
    texts = []
    for _ in range(60):
        base = list(rng.choice(words, 120)) + common
        for changes in (0, 2, 3, 4, 5, 6):  # similarities on both sides of 0.8
            copy = list(base)
            for at in rng.integers(0, len(copy), changes):
                copy[at] = f"x{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs_table(spark, rows)).collect()) == plain_kept(texts)


def test_small_sets_at_exactly_the_threshold(spark):
    """Pairs of 4 to 40 shingles that share exactly four fifths of what they have, and pairs just below."""
    rows, want, n = [], set(), 0
    for common in range(4, 41, 4):
        for left in range(common // 4 + 1):
            for more in (0, 1):
                names = [f"{n}w{i}" for i in range(common + 4)]
                one = [f"{n}a{i}" for i in range(left)]
                two = [f"{n}b{i}" for i in range(common // 4 - left + more)]
                rows += [(2 * n, " ".join(one + names), "en", "a"), (2 * n + 1, " ".join(two + names), "en", "a")]
                sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t, _, _ in rows[-2:]]
                if 9 * len(sets[0] & sets[1]) >= 4 * (len(sets[0]) + len(sets[1])):
                    want.add(2 * n + 1)
                n += 1
    kept = {r["doc_id"] for r in simhash.keep_one(docs_table(spark, rows)).collect()}
    assert {i for i, *_ in rows} - kept == want and want


def template_pages(n):
    """Pages of 86 shared and 18 own shingles, as sorted sets with what is left of each from the first shared one on."""
    rng = np.random.default_rng(1)
    shared = np.arange(86)
    return [np.concatenate([shared, 1000 + 18 * i + np.arange(18)]) for i in range(n)], rng.integers(0, 1 << 62, (n, 4)).astype(np.uint64)


def test_pages_of_one_template_are_not_compared_in_pairs(monkeypatch):
    sets, sketch = template_pages(3000)
    size, root = np.full(3000, 104), np.arange(3000)
    assert sum(len(i) for i, _ in simhash.candidates(sketch, size, root, np.full(3000, 86))) == 0
    monkeypatch.setattr(simhash, "FAR", 256)
    assert sum(len(i) for i, _ in simhash.candidates(sketch[:200], size[:200], root[:200])) == 200 * 199 // 2  # each pair once


def test_candidates_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    bases = [rng.choice(60, rng.integers(4, 50), replace=False) for _ in range(15)]
    sets = [np.sort(rng.choice(b, max(1, len(b) - rng.integers(0, 5)), replace=False)) for b in bases for _ in range(10)]
    size, root = np.array([len(s) for s in sets]), rng.integers(0, 60, 150)
    sketch = np.zeros((150, 4), np.uint64)
    tells = simhash.similar(sets)
    want = {(i, j) for i in range(150) for j in range(i) if root[i] != root[j] and tells(np.array([i]), np.array([j]))[0]}
    found = set()
    for token in range(60):  # the list of each token, with what is left from it on
        own = np.array([k for k, s in enumerate(sets) if token in s])
        rest = np.array([len(sets[k]) - int(np.searchsorted(sets[k], token)) for k in own])
        for i, j in simhash.candidates(sketch[own], size[own], root[own], rest) if len(own) > 1 else ():
            found |= {(max(a, b), min(a, b)) for a, b in zip(own[i].tolist(), own[j].tolist(), strict=True)}
    assert want and want <= found


def test_similar_by_bits_and_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(300, rng.integers(1, 200), replace=False)) for _ in range(130)] + [np.arange(5), np.arange(4)]
    i, j = np.divmod(np.arange(len(sets) ** 2), len(sets))
    by_bits = simhash.similar(sets)(i, j)
    monkeypatch.setattr(simhash, "SET_BYTES", 0)
    assert (by_bits == simhash.similar(sets)(i, j)).all()
    plain = [len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8 for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert by_bits.tolist() == plain and by_bits[-2]

"""Hand-written inputs for the retrieval operators."""

import hashlib
import shutil
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameWriter, Observation
from pyspark.sql import functions as F

from marginalia.config import ChunkConfig, CollectionConfig, Config, EmbedConfig, SearchConfig
from marginalia.functions import text as tx
from marginalia.functions import vectors
from marginalia.operators import answer, chunk, collections, embed, index, points, search
from marginalia.plans.registry import QUERIES
from marginalia.sources.documents import extract_text, of_manifest, reject_bad_documents, scan_documents, strict_utf8_text, write_files
from marginalia.streaming.incremental import PER_DOCUMENT, document_stream, index_stream, newest, stream_ids


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")


LENGTHS = {1: 1, 1023: 1, 1024: 1, 1025: 2, 1792: 2, 1793: 3, 5000: 7}


def test_chunk_counts(spark):
    rows = docs(spark, *("x" * n for n in LENGTHS))
    for chunker in (chunk.chunk_window, chunk.chunk_recursive):
        counts = [r["count"] for r in chunker(rows).groupBy("doc_id").count().orderBy("doc_id").collect()]
        assert counts == list(LENGTHS.values())
    same = chunk.chunk_window(rows).exceptAll(chunk.chunk_recursive(rows))
    assert same.count() == 0


def test_windows_are_cut_from_blocks(spark):
    texts = ["a é漢😀\n"[i % 5 :] * i for i in range(0, 90, 7)] + [" " * 50]
    rows = docs(spark, *texts)
    for size, overlap in ((4, 1), (9, 8), (5, 0)):
        stride = size - overlap
        want = []
        for i, t in enumerate(texts):
            cut = [t[a : a + size].strip() for a in range(0, max(len(t) - size, 0) + stride, stride)]
            want += [(i, k, w) for k, w in enumerate(w for w in cut if w)]
        got = chunk.chunk_window(rows, ChunkConfig(size=size, overlap=overlap))
        assert sorted((r["doc_id"], r["chunk_idx"], r["text"]) for r in got.collect()) == sorted(want)
    # a window is taken from a block, never from its whole text
    assert "flatten" in chunk.chunk_window(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_counted_by_one_worker_once(spark, sf_dir):
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    rows = docs(spark, "a b a", "c", None)
    entries = embed.embed_sparse(rows).select("doc_id", F.inline("entries"))
    assert plan(entries).count("ArrowEvalPython") == 1 and "md5" not in plan(entries)
    asked = embed.embed_sparse(rows.select(F.col("doc_id").alias("query_id"), "text"))
    points_ = rows.withColumnRenamed("doc_id", "id")
    found = search.knn_sparse(asked, embed.with_words(points_))
    assert "ArrowEvalPython" not in plan(found)
    assert sorted(found.collect()) == sorted(search.knn_sparse(asked, embed.embed_sparse(points_)).collect())
    plain = {(r["doc_id"], r["bucket"]): r["n"] for r in entries.collect()}
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1024
    assert plain == {(0, bucket("a")): 2, (0, bucket("b")): 1, (1, bucket("c")): 1}


def test_vectors_do_not_come_back_with_their_cell(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, [5.0, 5.0]), (2, None), (3, [1.0, 0.0])], "id long, vector array<float>")
    found = search.with_cells(rows, np.array([[0.0, 1.0], [1.0, 0.0], [5.0, 5.0]]), 1)
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["cell"] for r in found.collect()} == {0: 0, 1: 2, 3: 1}


def plain_split(text, config, separators=None):
    """The rules of recursive chunks, piece by piece."""
    separators = config.separators if separators is None else separators
    at = next((i for i, x in enumerate(separators) if not x or x in text), len(separators) - 1)
    later, out, held = separators[at + 1 :], [], []
    if separators[at]:
        first, *rest = text.split(separators[at])
        pieces = [p for p in (first, *(separators[at] + r for r in rest)) if p]
    else:
        pieces = list(text)

    def emit():
        if chunk := "".join(held).strip():
            out.append(chunk)

    for piece in pieces:
        if len(piece) >= config.size:
            emit()
            held.clear()
            out += plain_split(piece, config, later) if later else [piece]
            continue
        size = sum(map(len, held))
        if held and size + len(piece) > config.size:
            emit()
            while held and (size > config.overlap or size + len(piece) > config.size):
                size -= len(held.pop(0))
        held.append(piece)
    emit()
    return out


SEPARATORS = st.sampled_from([ChunkConfig().separators, ("\n\n", "\n", " "), ("ab", "b"), ("\n\n", ""), ("",), ("aba", "\n", "")])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\u00a0\U0001f600", max_size=120), max_size=5), st.integers(1, 30), st.integers(0, 20), SEPARATORS)
def test_a_batch_is_split_as_its_texts_are(texts, size, overlap, separators):
    config = ChunkConfig(size, min(overlap, size - 1), separators)
    assert chunk.split_batch(texts, config) == [plain_split(t, config) for t in texts]


def test_recursive_separators():
    small = ChunkConfig(20, 5)
    assert chunk.split_recursive("first part here\n\nsecond part", small) == ["first part here", "second part"]
    assert chunk.split_recursive("one line\nanother line\nthird", small) == ["one line", "another line\nthird"]
    assert chunk.split_recursive("aa bb cc dd ee ff gg hh ii", small) == ["aa bb cc dd ee ff gg", "gg hh ii"]
    assert chunk.split_recursive(" \n\n  ", small) == [] and chunk.split_recursive("", small) == []
    assert chunk.split_recursive("x" * 50, small) == ["x" * 20, "x" * 20, "x" * 20]


@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40), st.integers(0, 30))
def test_recursive_invariants(text, size, overlap):
    out = chunk.split_recursive(text, ChunkConfig(size, min(overlap, size - 1)))
    assert all(c and len(c) <= size and c in text and c == c.strip() for c in out)
    assert bool(out) == bool(text.strip())


def test_white_space_is_that_of_unicode(spark):
    rows = docs(spark, "\u00a0\u2003 text\u00a0here \u3000\n")
    for chunker in (chunk.chunk_window, chunk.chunk_recursive):
        assert [r["text"] for r in chunker(rows).collect()] == ["text\u00a0here"]
    assert rows.select(tx.word_count(F.col("text")).alias("n")).first()["n"] == 2


def test_recursive_query_equals_plain_splitter(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["chunk_recursive"](spark, sf_dir).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_idx"]] = r["text"]
    assert set(got) == {i for i, t in texts.items() if t and t.strip()}
    for i, chunks in got.items():
        found = [chunks[n] for n in range(len(chunks))]
        assert max(map(len, found)) <= 1024
        end = 0  # no gap but white space, and an overlap of 256 at most
        for c in found:
            start = texts[i].index(c, max(0, end - 256))
            assert start <= end or not texts[i][end:start].strip()
            end = start + len(c)
        assert not texts[i][end:].strip()


def test_null_and_odd_documents(spark):
    rows = docs(spark, None, "", " \n ", "é" * 2000)
    for chunker in (chunk.chunk_window, chunk.chunk_recursive):
        assert {r["doc_id"] for r in chunker(rows).collect()} == {3}
    assert points.assign_point_ids(chunk.chunk_window(rows.limit(0))).count() == 0


def test_sanitize(spark):
    cases = [(b"a\xffb", "ab"), ("x�y".encode(), "x�y"), ("привет".encode(), "привет")]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "id int, b binary")
    got = rows.select("id", tx.sanitized(F.col("b").cast("string")).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in got] == [w for _, w in cases]


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, body in (("a.pdf", b"one"), ("deep/b.pdf", b"tw\xffo"), ("c.txt", b"no"), ("d.pdf", "drei ä".encode())):
        (tmp_path / name).write_bytes(body)
    files = scan_documents(spark, str(tmp_path))
    assert files.count() == 3
    good, bad = reject_bad_documents(extract_text(files, strict_utf8_text))
    assert sorted(r["text"] for r in good.collect()) == ["drei ä", "one"]
    assert [r["source"].rpartition("/")[2] for r in bad.collect()] == ["b.pdf"] and "UnicodeDecodeError" in bad.first()["error"]
    assert sorted(r["text"] for r in extract_text(files).collect()) == ["drei ä", "one", "two"]


def test_a_file_per_row(spark, tmp_path):
    rows = [(1, b"aa"), (1, b"bbb"), (1, b"bbb"), (None, b"c\n"), (2, b""), (3, None)]
    table = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "doc_id long, content binary").repartition(3)
    path = f"file://{tmp_path}/files"
    manifest = write_files(table, path, ["doc_id"])
    (tmp_path / "files" / "left").mkdir()
    (tmp_path / "files" / "left" / "0.txt").write_bytes(b"of a task that was run again")
    found = of_manifest(scan_documents(spark, path, "*.txt"), manifest)
    assert sorted(((r["doc_id"], bytes(r["content"])) for r in found.collect()), key=repr) == sorted(((i, b) for i, b in rows if b is not None), key=repr)


def test_truncate(spark):
    rows = docs(spark, *(" ".join(["w"] * n) for n in (511, 512, 513)))
    assert [r["n"] for r in chunk.truncate_tokens(rows).select(F.size("tokens").alias("n")).collect()] == [511, 512, 512]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(vectors.normalized(a).alias("n"), vectors.cosine(a, b).alias("c"), vectors.euclidean(a, b).alias("e"), vectors.manhattan(a, b).alias("m")).collect()
    assert got[0]["n"] == [0.6, 0.8] and got[1]["n"] is None
    assert [r["c"] for r in got] == [1.0, None] and [r["e"] for r in got] == [5.0, 1.0] and [r["m"] for r in got] == [7.0, 1.0]


def vecs(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, vector array<float>")


@pytest.mark.parametrize("distance", ["cosine", "euclidean", "manhattan"])
def test_search(spark, distance, monkeypatch):
    rng = np.random.default_rng(2)
    stored = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(200)]
    asked = [(i, v) for i, v in stored if i % 40 == 0]
    p, q = vecs(spark, stored, "id"), vecs(spark, asked, "query_id")
    measure = vectors.METRICS[distance]

    def plain(v):
        def score(w):
            v_, w_ = np.array(v), np.array(w)
            if distance == "cosine":
                size = np.sqrt((v_ @ v_) * (w_ @ w_))
                return -(v_ @ w_) / size if size else None
            return np.linalg.norm(v_ - w_, 2 if distance == "euclidean" else 1)

        found = [(round(float(s), 9), i) for i, w in stored if (s := score(w)) is not None]
        return [i for _, i in sorted(found)[:7]]

    want = {i: plain(v) for i, v in asked}

    def lists(found):
        out = {}
        for r in found.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["id"])
        return out

    assert measure and lists(search.knn_exact(q, p, 7, distance)) == want
    assert lists(search.knn_ann(q, p, 7, distance, nlist=5, nprobe=5)) == want
    monkeypatch.setattr(search, "SENT_BYTES", 0)
    monkeypatch.setattr(search, "POINT_PART", 30)
    monkeypatch.setattr(search, "AT_ONCE", 50)
    assert lists(search.knn_exact(q, p, 7, distance)) == want
    assert lists(search.knn_ann(q, p, 7, distance, nlist=5, nprobe=5)) == want


def test_search_ties_nulls_and_small_tables(spark):
    p = vecs(spark, [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [0.0, 0.0]), (4, None)], "id")
    q = vecs(spark, [(1, [1.0, 0.0]), (2, None)], "query_id")
    assert [(r["query_id"], r["rank"], r["id"]) for r in search.knn_exact(q, p).orderBy("rank").collect()] == [(1, 1, 3), (1, 2, 5)]
    assert search.knn_exact(q.limit(0), p).count() == 0 and search.knn_exact(q, p.limit(0)).count() == 0


def test_recall_and_auto(spark):
    rng = np.random.default_rng(4)
    stored = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    p, q = vecs(spark, stored, "id"), vecs(spark, stored[:20], "query_id")
    exact = search.knn_exact(q, p)
    found = search.knn_ann(q, p, nlist=8, nprobe=3)
    assert 0.3 < np.mean([r["recall"] for r in search.ann_recall(found, exact).collect()]) <= 1
    index = search.knn_auto(q, p, SearchConfig(exact_below_bytes=1, nlist=8, nprobe=8))
    assert index.exceptAll(exact).count() == 0 or index.select("query_id", "rank", "id").exceptAll(exact.select("query_id", "rank", "id")).count() == 0


def test_auto_is_exact_beyond_the_bytes_that_are_searched_exactly(spark):
    rng = np.random.default_rng(9)
    stored = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(1500)]
    p, q = vecs(spark, stored, "id"), vecs(spark, stored[::10], "query_id")
    ids = lambda hits: hits.select("query_id", "rank", "id")
    assert ids(search.knn_auto(q, p, SearchConfig(exact_below_bytes=1))).exceptAll(ids(search.knn_exact(q, p))).count() == 0


def test_probes_follow_the_vectors(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(40, 12)) * 20
    clustered = vecs(spark, [(i, [float(x) for x in middle[i % 40] + rng.normal(size=12)]) for i in range(1200)], "id")
    centres = search.fit_cells(clustered, 40)
    assert search.fit_probes(clustered, centres, 5, "euclidean", 0.97) <= 4
    loose = vecs(spark, [(i, [float(x) for x in rng.normal(size=12)]) for i in range(1200)], "id")
    assert search.fit_probes(loose, search.fit_cells(loose, 40), 5, "euclidean", 0.97) > 4


def test_a_fit_leaves_its_samples_in_the_tasks(spark, monkeypatch):
    """The driver gets the questions of a sample and their hits, not its vectors, and k-means of many cells has no candidates there."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(30, 6)) * 20
    points = vecs(spark, [(i, [float(x) for x in middle[i % 30] + rng.normal(size=6)]) for i in range(1500)], "id")
    got, frame, starts = [], type(points), []
    whole = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda df: (rows := whole(df), got.append(len(rows) if "vector" in rows else 0))[0])
    monkeypatch.setattr(search, "PROBE_QUERIES", 10)
    monkeypatch.setattr(search, "SEEDED_CELLS", 20)
    monkeypatch.setattr(search, "KMeans", lambda make=search.KMeans, **said: (starts.append(said["initMode"]), make(**said))[1])
    few, many = search.fit_cells(points, 20), search.fit_cells(points, 30)
    assert starts == ["k-means||", "random"] and len(few) <= 20 and len(many) <= 30
    assert 1 <= search.fit_probes(points, many, 5, "euclidean", 0.97) <= 6
    assert max(got) == 10
    assert search.fit_probes(points.limit(0), many, 5, "euclidean", 0.97) == 1


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_fitted_recall(spark, d):
    assert np.mean([r["recall"] for r in QUERIES["ann_recall_fitted"](spark, d).collect()]) >= 0.9


@pytest.mark.parametrize("n,batches", [(0, 0), (31_999, 1), (32_000, 1), (32_001, 2)])
def test_batch_plan(spark, n, batches):
    assert points.batch_plan(spark.range(n)).count() == batches


def test_ids_are_dense(spark):
    rows = docs(spark, *("word " * (i * 37 % 900) + "x" for i in range(60)))
    got = points.assign_point_ids(chunk.chunk_window(rows)).orderBy("doc_id", "chunk_idx").collect()
    assert [r["id"] for r in got] == list(range(len(got)))


def test_ids_of_null_and_repeated_documents(spark):
    long = "a long text " * 200
    rows = [(1, "a", long), (1, "a", "another"), (1, "a", "another"), (None, "b", long), (None, None, "no id"), (2, None, "two")]
    chunks = chunk.chunk_window(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    numbered = points.assign_point_ids(chunks)
    got = numbered.orderBy("id").collect()
    assert len(got) == chunks.count() == 10 and [r["id"] for r in got] == list(range(10))
    assert [r["doc_id"] for r in got] == [1] * 5 + [2] + [None] * 4


def test_counts_while_indexing(spark):
    long = "a long text " * 200
    rows = [(1, "a", long), (1, "a", "another"), (1, "a", "another"), (None, "b", long), (None, None, "no id"), (2, None, " "), (3, None, None)]
    table, counts = spark.createDataFrame(rows, "doc_id long, source string, text string"), {}
    config = Config(collection=CollectionConfig(name="t_counts", dim=8), embed=EmbedConfig(dim=8))
    collections.setup_index(table, config, chunk.chunk_window, counts=counts)
    assert counts == {"n_documents": 7, "n_chunks": 9, "n_points": 9} and spark.table("t_counts").count() == 9
    collections.setup_index(table.limit(0), config, chunk.chunk_window, counts=counts)
    assert counts == {"n_documents": 0, "n_chunks": 0, "n_points": 0} and spark.table("t_counts").count() == 0
    collections.drop_collection(spark, config.collection)


RETRIED = """
import os, sys
import numpy as np
from pyspark.sql import SparkSession
from marginalia.config import CollectionConfig, Config, EmbedConfig
from marginalia.operators import chunk, collections
folder = sys.argv[1]
conf = {"spark.ui.enabled": "false", "spark.sql.warehouse.dir": folder + "/wh", "spark.checkpoint.dir": "file://" + folder + "/shared"}
spark = SparkSession.builder.master("local[2,4]").config(map=conf).getOrCreate()
def once(what):
    try:
        os.close(os.open(folder + "/" + what, os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        return
    raise OSError("fails once")
def make():
    def embed(texts):
        once("write")
        return np.ones((len(texts), 4), np.float32)
    return embed
def chunker(docs):
    def late(frames):
        for pdf in frames:
            yield pdf
            once("count")
    return chunk.chunk_window(docs.mapInPandas(late, docs.schema))
docs = spark.createDataFrame([(i, "s", "some words " * 300) for i in range(40)], "doc_id long, source string, text string").repartition(4)
counts = {}
config = Config(collection=CollectionConfig(name="c", dim=4), embed=EmbedConfig(dim=4, batch_size=3))
collections.setup_index(docs, config, chunker, make, counts)
print("COUNTS", counts, spark.table("c").count(), sorted(x for x in os.listdir(folder) if x in ("write", "count")))
"""


def test_counts_are_right_after_retried_tasks(tmp_path):
    out = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert "COUNTS {'n_documents': 40, 'n_chunks': 160, 'n_points': 160} 160 ['count', 'write']" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("sent", [500_000, 0])
def test_chunks_are_numbered_by_document(spark, monkeypatch, sent):
    monkeypatch.setattr(points, "SENT_KEYS", sent)
    long = "a long text " * 200
    rows = [(1, "a", long), (1, "a", "another"), (1, "a", "another"), (None, "b", long), (None, None, "no id"), (2, None, "two"), (2, None, None), (3, "c", " ")]
    rows += [(9, "hot", long)] * 40 + [(None, None, None)] * 3
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = points.number_chunks(table, chunk.chunk_window).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(got))) and len(got) == chunk.chunk_window(table).count()
    key = lambda r: ((r["doc_id"] is None, r["doc_id"] or 0), (r["source"] is None, r["source"] or ""))
    assert [key(r) for r in got] == sorted(map(key, got))
    hot = [r["chunk_idx"] for r in got if r["doc_id"] == 9]
    assert hot == list(range(len(hot) // 40)) * 40  # the chunks of one copy follow each other
    assert points.number_chunks(table.limit(0), chunk.chunk_window).count() == 0


def test_no_chunk_is_shuffled_to_be_numbered(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = points.number_chunks(table, chunk.chunk_window)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_upsert_and_validate(spark):
    old, new = vecs(spark, [(0, [1.0]), (1, [1.0]), (2, [1.0])], "id"), vecs(spark, [(2, [2.0]), (3, [2.0, 1.0])], "id")
    merged = points.upsert_points(old, new)
    assert sorted((r["id"], r["vector"][0]) for r in merged.collect()) == [(0, 1.0), (1, 1.0), (2, 2.0), (3, 2.0)]
    assert [r["id"] for r in points.invalid_vectors(merged, 1).collect()] == [3]
    with pytest.raises(PySparkException):
        points.validate_vectors(merged, 1).collect()
    twice = vecs(spark, [(3, [2.0]), (3, [5.0]), (3, [5.0]), (4, None)], "id")
    assert sorted((r["id"], r["vector"]) for r in points.upsert_points(old, twice).where("id > 2").collect()) == [(3, [5.0]), (4, None)]
    left = points.upsert_points(old, twice, F.col("id") % 2, spark.createDataFrame([(0,)], "g long"))
    assert sorted(r["id"] for r in left.collect()) == [1, 3, 4]


def test_collections(spark):
    own = CollectionConfig(name="t_lifecycle", dim=16, distance="euclidean")
    config = Config(collection=own, embed=EmbedConfig(dim=16), chunk=ChunkConfig(50, 10))
    off = Config(collection=CollectionConfig(name="t_absent", rebuild=False))
    rows = docs(spark, "some words to find. " * 10, "other words. " * 3)
    assert not collections.setup_index(rows, off) and not collections.collection_exists(spark, "t_absent")
    assert collections.setup_index(rows, config)
    assert "t_lifecycle" in collections.list_collections(spark)
    held = collections.properties(spark, "t_lifecycle")
    assert held["dim"] == "16" and held["distance"] == "euclidean"
    stored = spark.table("t_lifecycle")
    n = chunk.chunk_recursive(rows, config.chunk).count()
    assert stored.count() == n and stored.select(F.max("id")).first()[0] == n - 1
    assert not collections.create_collection(spark, own)
    assert collections.drop_collection(spark, own) and not collections.drop_collection(spark, own)


def some_points(spark, ids, text):
    return spark.createDataFrame([(i, [1.0, float(i)], (text, "s")) for i in ids], collections.SCHEMA)


def test_a_write_touches_its_partitions_only(spark):
    own = CollectionConfig(name="t_parts", dim=2, part_ids=10)
    collections.create_collection(spark, own)
    assert spark.table("t_parts").count() == 0
    collections.write_points(spark, own, some_points(spark, range(0, 40, 4), "old"), 100)
    files = lambda part: {f for f in spark.table("t_parts").inputFiles() if f"part={part}/" in f}
    before = files(3)
    collections.write_points(spark, own, some_points(spark, [4, 5, 12], "new"), 100)
    held = {r["id"]: r["payload"]["text"] for r in spark.table("t_parts").collect()}
    assert held == {i: "old" for i in range(0, 40, 4)} | {4: "new", 5: "new", 12: "new"} and files(3) == before
    collections.write_points(spark, own, some_points(spark, [5], "newer"), 100)
    collections.write_points(spark, own, some_points(spark, [5], "newest"), 100)
    assert len({f.rpartition("/")[0] for f in files(0)}) == 2  # the live version and the one before; older ones are removed
    assert spark.table("t_parts").where("id = 5").first()["payload"]["text"] == "newest"
    collections.drop_collection(spark, own)


def broken_writer(monkeypatch, at, half):
    """The at-th Parquet write from now on fails, before it begins or with its files written but not all that should follow."""
    calls, write = [], DataFrameWriter.parquet

    def parquet(self, path, *a, **b):
        calls.append(path)
        if len(calls) == at + 1:
            if half:
                write(self, path, *a, **b)
            raise OSError("broken off")
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return calls


@pytest.mark.parametrize("half", [False, True])
def test_a_write_that_breaks_off_anywhere(spark, monkeypatch, half):
    """Fails at every write in turn, and at the swap and behind it; the old state stays, and the next write goes on."""
    own = CollectionConfig(name=f"t_broken_{half}", dim=2, part_ids=10)
    collections.create_collection(spark, own)
    collections.write_points(spark, own, some_points(spark, range(0, 40, 4), "old"), 100)
    index.build_index(spark, own.name, SearchConfig(nprobe=2), np.array([[1.0, 0.0], [1.0, 30.0]]))
    held = lambda: {r["id"]: r["payload"]["text"] for r in spark.table(own.name).collect()}
    asked = vecs(spark, [(0, [1.0, 8.0]), (1, [0.0, 1.0])], "query_id")
    found = lambda: sorted((r["query_id"], r["rank"], r["id"]) for r in index.knn_stored(asked, own.name, 30).collect())
    exact = lambda: sorted((r["query_id"], r["rank"], r["id"]) for r in search.knn_exact(asked, spark.table(own.name), 30).collect())
    want, broken = held(), 0
    assert found() == exact()
    for at in range(9):
        with monkeypatch.context() as m:
            calls = broken_writer(m, at, half)
            try:
                collections.write_points(spark, own, some_points(spark, [8, 9, 31], f"try {at}"), 100)
            except OSError:
                broken += 1
                assert held() == want and found() == exact()
                continue
        assert len(calls) == at
        break
    assert broken >= 4  # the new points, their version, the index entries, the manifest
    want |= {8: f"try {at}", 9: f"try {at}", 31: f"try {at}"}
    assert held() == want and found() == exact()
    with monkeypatch.context() as m:
        m.setattr(collections, "_publish", lambda *_: (_ for _ in ()).throw(OSError("broken off")))
        with pytest.raises(OSError):
            collections.write_points(spark, own, some_points(spark, [4], "unseen"), 100)
    assert held() == want
    with monkeypatch.context() as m:
        m.setattr(collections, "_clean", lambda *_: (_ for _ in ()).throw(OSError("broken off")))
        with pytest.raises(OSError):
            collections.write_points(spark, own, some_points(spark, [4], "seen"), 100)
    assert held() == want | {4: "seen"}
    collections.write_points(spark, own, some_points(spark, [50], "last"), 100)
    assert held() == want | {4: "seen", 50: "last"} and found() == exact()
    live = {(r["version"], r["part"]) for r in collections.live_parts(spark, collections.own_properties(spark, own.name)).collect()}
    assert len(live) == 5 and len({f for f in spark.table(own.name).inputFiles() if "/points/" in f}) <= 2 * len(live) + 1
    assert collections.drop_collection(spark, own) and not collections.collection_exists(spark, own.name)


def test_another_write_in_between(spark):
    own = CollectionConfig(name="t_between", dim=2)
    collections.create_collection(spark, own)
    before = collections.own_properties(spark, own.name)
    collections.write_points(spark, own, some_points(spark, [1], "first"), 100)
    with pytest.raises(RuntimeError):
        collections.commit(spark, own.name, before, {}, collections.live_parts(spark, before))
    assert spark.table(own.name).count() == 1
    collections.drop_collection(spark, own)


def test_views_that_are_no_collections_are_not_listed(spark):
    spark.sql("CREATE OR REPLACE VIEW t_other AS SELECT 1 AS one")
    assert "t_other" not in collections.list_collections(spark)
    spark.sql("DROP VIEW t_other")


def stored_collection(spark, name, rows, **search_config):
    own = CollectionConfig(name=name, dim=len(rows[0][1]), distance="euclidean", part_ids=200)
    collections.create_collection(spark, own)
    collections.write_points(spark, own, spark.createDataFrame([(i, v, ("t", "s")) for i, v in rows], collections.SCHEMA), 100)
    index.build_index(spark, name, SearchConfig(**search_config))
    return own


def test_a_stored_index_is_read_by_cells_and_never_fitted_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(30, 8)) * 20
    rows = [(i, [float(x) for x in middle[i % 30] + rng.normal(size=8)]) for i in range(1500)]
    own = stored_collection(spark, "t_cells", rows, nlist=30)
    q = vecs(spark, rows[:4], "query_id")
    monkeypatch.setattr(search, "KMeans", None)
    monkeypatch.setattr(search, "fit_probes", None)
    hits = index.knn_stored(q, own.name)
    exact = search.knn_exact(q, spark.table(own.name), distance="euclidean")
    assert np.mean([r["recall"] for r in search.ann_recall(hits, exact).collect()]) >= 0.9
    held = collections.own_properties(spark, own.name)
    read = index.entries(spark, held, [3, 5])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and "cell#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert 0 < read.count() < 400 and int(held["nprobe"]) <= 10
    text = [str(r) for r in index.payloads(spark, own.name, hits).select("id", "text", "source").collect()]
    assert len(text) == hits.count()
    collections.drop_collection(spark, own)


def test_recall_of_a_stored_index_without_structure(spark):
    rows = [(r["id"], r["vector"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector").collect()]
    own = stored_collection(spark, "t_loose", rows)
    q = vecs(spark, rows[::50], "query_id")
    exact = search.knn_exact(q, spark.table(own.name), distance="euclidean")
    assert np.mean([r["recall"] for r in search.ann_recall(index.knn_stored(q, own.name), exact).collect()]) >= 0.9
    collections.drop_collection(spark, own)


def test_an_index_with_nulls_and_without_points(spark):
    own = CollectionConfig(name="t_none", dim=2, distance="euclidean")
    collections.create_collection(spark, own)
    index.build_index(spark, own.name)
    q = vecs(spark, [(1, [1.0, 0.0]), (2, None)], "query_id")
    assert index.knn_stored(q, own.name).count() == 0
    collections.write_points(spark, own, some_points(spark, [3], "x"), 10)
    index.build_index(spark, own.name)
    assert [(r["query_id"], r["id"]) for r in index.knn_stored(q, own.name).collect()] == [(1, 3)]
    assert index.knn_stored(q.limit(0), own.name).count() == 0
    collections.drop_collection(spark, own)


@pytest.mark.parametrize("distance", ["cosine", "euclidean", "manhattan"])
def test_balls_rule_cells_out_and_lose_nothing(spark, monkeypatch, distance):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(25, 6)) * 10
    rows = [(i, [float(x) for x in middle[i % 25] + rng.normal(size=6)]) for i in range(900)] + [(1000, [0.0] * 6)]
    p, q = vecs(spark, rows, "id"), vecs(spark, [*rows[::3], (5000, [0.0] * 6), (5001, None)], "query_id")
    want = sorted(map(tuple, search.knn_exact(q, p, 6, distance).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(search, "SENT_BYTES", 0)
    monkeypatch.setattr(search, "POINT_PART", 20)
    seen = Observation("balls")
    got = search.knn_exact(q, p, 6, distance, seen)
    assert sorted(map(tuple, got.select("query_id", "rank", "id").collect())) == want
    assert seen.get["visits"] < 0.5 * 301 * 29  # cells that aren't a question's own
    few = search.knn_exact(q, p.limit(3), 6, distance)  # fewer than k: nothing is ruled out
    assert few.where("query_id = 0").count() == 3


def test_answers_come_from_the_collection(spark, tmp_path):
    rows = docs(spark, "the first text is about apples. " * 3, "pears are in the second one. " * 60)
    rows.write.parquet(str(tmp_path / "docs"))
    config = Config(collection=CollectionConfig(name="t_answers", dim=64), embed=EmbedConfig(dim=64), search=SearchConfig(exact_below_bytes=0, nlist=2, nprobe=2))
    assert collections.setup_index(spark.read.parquet(str(tmp_path / "docs")), config)
    assert "index" in collections.properties(spark, "t_answers")
    shutil.rmtree(tmp_path / "docs")  # the second step reads nothing of it
    asked = spark.createDataFrame([(1, "what about apples?"), (2, "pears"), (3, "")], "query_id long, query string")
    state = {r["query_id"]: r for r in answer.answer_from(asked, config).collect()}
    assert state[1]["answer"] == "the first text is about apples." and state[1]["retrieved_docs"][0]["source"] == "s0"
    assert state[2]["retrieved_docs"][0]["source"] == "s1" and state[3]["retrieved_docs"] == [] and state[3]["context"] == ""
    collections.drop_collection(spark, config.collection)


def test_models_can_be_plugged_in(spark):
    def make_embedder():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], np.float32)

    def make_writer():
        return lambda prompts: np.array([f"{len(p)} characters" for p in prompts], dtype=object)

    rows = docs(spark, "abc", "de")
    assert [list(r["vector"]) for r in embed.embed_dense(rows, make_model=make_embedder).orderBy("doc_id").collect()] == [[3.0, 1.0], [2.0, 1.0]]
    prompts = spark.createDataFrame([(1, "q", "c", "four")], "query_id long, query string, context string, prompt string")
    assert answer.generate_batch(prompts, make_writer).first()["answer"] == "4 characters"


HITS = "query_id long, rank int, id long, score double, text string, source string"


def test_answers(spark):
    asked = spark.createDataFrame([(1, "one?"), (2, "none?")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 2, 7, 0.5, "Second text", None), (1, 1, 8, 0.98765, "First. More of it", "a")], HITS)
    retrieved = answer.retrieve_stage(asked, hits)
    contexts = {r["query_id"]: r["context"] for r in answer.assemble_context(retrieved).collect()}
    assert contexts == {1: "[Document 1 - a]\nFirst. More of it\n\n---\n\n[Document 2 - unknown]\nSecond text", 2: ""}
    state = {r["query_id"]: r for r in answer.run_queries(asked, hits).collect()}
    assert state[1]["answer"] == "First." and [d["rank"] for d in state[1]["retrieved_docs"]] == [1, 2] and state[2]["retrieved_docs"] == []
    stats = {r["query_id"]: tuple(r)[1:] for r in answer.context_stats(retrieved).collect()}
    assert stats == {1: (2, len(contexts[1])), 2: (0, 0)}
    words = spark.createDataFrame([(1, ""), (2, "  two   words ")], "query_id long, answer string")
    assert [r["n_words"] for r in answer.answer_stats(words).orderBy("query_id").collect()] == [0, 2]
    previews = answer.report_preview(hits.withColumn("text", F.when(F.col("rank") == 1, F.lit("x" * 500)).otherwise("x" * 10))).orderBy("rank").collect()
    assert [r["preview"] for r in previews] == ["x" * 200 + "...", "x" * 10 + "..."] and previews[0]["score"] == 0.9877


def test_stream_follows_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    own = CollectionConfig(name="t_stream", dim=16)
    config = Config(collection=own, embed=EmbedConfig(dim=16))
    long = "a text of several chunks. " * 150
    for texts, count in (((long, "b text"), 6), (("a newer text",), 2), ((" ", "b text"), 1)):
        docs(spark, *texts).coalesce(1).write.mode("append").parquet(str(folder))
        query = index_stream(document_stream(spark, str(folder)), str(tmp_path / "cp"), config)
        query.awaitTermination(120)
        spark.catalog.refreshTable("t_stream")
        assert spark.table("t_stream").count() == count
    assert {r["t"] for r in spark.table("t_stream").select("payload.text").toDF("t").collect()} == {"b text"}
    collections.drop_collection(spark, own)


def test_newest_version_of_a_document(spark):
    rows = [(1, "a", "old", 1), (1, "a", "new", 2), (1, "a", "also new", 2), (2, None, None, 1), (2, None, None, 1)]
    got = newest(spark.createDataFrame(rows, "doc_id long, source string, text string, version int"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "new"), (2, None, None)]


@pytest.mark.parametrize("doc_id,chunk_idx", [(None, 0), (1 << 50, 0), (1, PER_DOCUMENT)])
def test_stream_ids_that_do_not_exist(spark, doc_id, chunk_idx):
    rows = spark.createDataFrame([(doc_id, chunk_idx)], "doc_id long, chunk_idx int")
    with pytest.raises(PySparkException):
        stream_ids(rows).collect()

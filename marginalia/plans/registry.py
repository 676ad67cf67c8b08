"""All queries by name, each over its whole tables, and the SQL that says what they return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CollectionConfig, Config, SearchConfig
from ..functions import vectors
from ..functions.text import WHITE, sanitized
from ..operators import answer, chunk, collections, embed, index, points, search
from ..shared import new_path, written
from ..sources.documents import extract_text, load_table, of_manifest, reject_bad_documents, scan_documents, strict_utf8_text, write_files
from . import sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name or the given one; without SQL, it is tested against brute force."""

    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[name or f.__name__] = oracle
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_window(documents(spark, sf_dir))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.number_chunks(documents(spark, sf_dir), chunk.chunk_window)


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the chunks of all documents."""
    return points.build_points(embed.embed_dense(numbered(spark, sf_dir)))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest chunks of each question, with their payloads."""
    stored = numbered(spark, sf_dir)
    asked = embed.embed_sparse(questions(spark, sf_dir), text="query")
    hits = search.knn_sparse(asked, embed.with_words(stored))
    return search.project_payload(hits, stored.select("id", F.struct("text", "source").alias("payload")))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_vectors(spark, sf_dir).where(F.col("id") % 50 == 0)
    return rows.select(F.col("id").alias("query_id"), "vector")


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


# sources


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL", "scan_documents")
def scan_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes each document to a file of its own, scans the folder for these files and extracts their texts."""
    path = new_path(spark, "files")
    rows = load_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    manifest = write_files(rows, path, ["doc_id"])
    found = extract_text(of_manifest(scan_documents(spark, path, "*.txt"), manifest))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _encoded(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    """Documents as file contents; if asked for, with a byte that is no UTF-8 behind each German one."""
    docs = load_table(spark, sf_dir, "documents")
    body = F.encode("text", "UTF-8")
    if broken:
        body = F.when(F.col("lang") == "de", F.concat(body, F.lit(bytes([255])))).otherwise(body)
    return docs.select("doc_id", "source", body.alias("content"))


@query("SELECT doc_id, source, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, true AS readable FROM documents", "extract_text")
def extract_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(_encoded(spark, sf_dir, True))
    return out.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), F.col("error").isNull().alias("readable"))


@query("SELECT doc_id, lang = 'de' AS rejected FROM documents", "reject_bad_documents")
def reject_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = reject_bad_documents(extract_text(_encoded(spark, sf_dir, True), strict_utf8_text))
    return good.select("doc_id", F.lit(False).alias("rejected")).unionByName(bad.select("doc_id", F.lit(True).alias("rejected")))


@query(sql.with_chunks("SELECT (SELECT count(*) FROM documents)::BIGINT AS n_documents, count(*)::BIGINT AS n_chunks, max(id)::BIGINT + 1 AS n_points FROM numbered"))
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is counted while the documents are indexed."""
    own, counts = CollectionConfig(name=f"c_{uuid.uuid4().hex}"), {}
    collections.setup_index(documents(spark, sf_dir), Config(collection=own, search=SearchConfig(exact_below_bytes=1 << 62)), chunk.chunk_window, counts=counts)
    collections.drop_collection(spark, own)
    return spark.createDataFrame([(counts["n_documents"], counts["n_chunks"], counts["n_points"])], "n_documents long, n_chunks long, n_points long")


# text and chunks


@query("SELECT doc_id, text, length(text)::BIGINT AS n_chars FROM documents")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", sanitized(F.col("text")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query(None)
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_recursive(documents(spark, sf_dir)).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "text")


@query(sql.with_chunks("SELECT doc_id, chunk_idx, text FROM chunks"))
def chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "text")


@query(sql.with_chunks("SELECT doc_id, source, count(*)::BIGINT AS n_chunks FROM chunks GROUP BY doc_id, source"))
def chunk_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(sql.TRUNCATED)
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunk.truncate_tokens(documents(spark, sf_dir))
    return cut.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"), F.length("text").cast("long").alias("n_chars"))


# embeddings


def _entries(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.inline("entries")).select(key, F.col("bucket").cast("long").alias("bucket"), F.col("n").cast("double").alias("value"))


@query(sql.with_embeddings("SELECT id, bucket, n::DOUBLE AS value FROM embedded"))
def embed_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each vector that aren't zero."""
    return _entries(embed.embed_sparse(numbered(spark, sf_dir)), "id")


@query(sql.with_embeddings("SELECT query_id, bucket, n::DOUBLE AS value FROM asked"))
def embed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of dense vectors."""
    rows = embed.embed_query(questions(spark, sf_dir)).select("query_id", F.posexplode("vector").alias("bucket", "value")).where("value <> 0")
    return rows.select("query_id", F.col("bucket").cast("long").alias("bucket"), F.col("value").cast("double").alias("value"))


@query("SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 6) AS norm, 1.0::DOUBLE AS unit_norm, round(embedding[1]::DOUBLE / sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 6) AS first FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_table(spark, sf_dir, "embeddings").withColumn("unit", vectors.normalized(F.col("embedding")))
    norm = lambda c: F.round(F.sqrt(vectors.squares(F.col(c))), 6)
    return rows.select("vec_id", norm("embedding").alias("norm"), norm("unit").alias("unit_norm"), F.round(F.get("unit", F.lit(0)), 6).alias("first"))


# points


@query(sql.with_chunks("SELECT id, doc_id, chunk_idx FROM numbered"))
def assign_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("id", "doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"))


@query(sql.with_embeddings("SELECT c.id, c.text, c.source, 1024::BIGINT AS dim, e.mass FROM numbered c JOIN (SELECT id, sum(n)::DOUBLE AS mass FROM embedded GROUP BY id) e USING (id)"))
def build_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return indexed(spark, sf_dir).select("id", "payload.text", "payload.source", F.size("vector").cast("long").alias("dim"), mass.alias("mass"))


@query(sql.with_chunks("SELECT id // 1000 AS batch, count(*)::BIGINT AS n_points, min(id)::BIGINT AS first_id, max(id)::BIGINT AS last_id, ceil(count(*) / 256.0)::BIGINT AS n_wire FROM numbered GROUP BY id // 1000"))
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 1,000 here, so that the tables have several of them."""
    return points.batch_plan(numbered(spark, sf_dir), 1000, 256)


@query(sql.with_chunks("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE source END AS source, length(text)::BIGINT AS n_chars FROM numbered"))
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaces every third point."""
    old = numbered(spark, sf_dir).select("id", "source", "text")
    new = old.where(F.col("id") % 3 == 0).withColumn("source", F.lit("new"))
    return points.upsert_points(old, new).select("id", "source", F.length("text").cast("long").alias("n_chars"))


@query("SELECT vec_id AS id, (len(embedding) - vec_id % 2)::BIGINT AS size FROM embeddings WHERE vec_id % 2 = 1")
def validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second vector is cut by an entry and must be reported."""
    rows = stored_vectors(spark, sf_dir)
    cut = F.when(F.col("id") % 2 == 1, F.slice("vector", 1, F.size("vector") - 1)).otherwise(F.col("vector"))
    return points.invalid_vectors(rows.withColumn("vector", cut), 64).withColumn("size", F.col("size").cast("long"))


@query(sql.with_embeddings("SELECT c.source, count(*)::BIGINT AS n_points, sum(length(c.text))::BIGINT AS n_chars, sum(e.mass) AS mass FROM numbered c JOIN (SELECT id, sum(n)::DOUBLE AS mass FROM embedded GROUP BY id) e USING (id) GROUP BY c.source"))
def setup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds a collection from all documents, reads it back and drops it."""
    own = CollectionConfig(name=f"c_{uuid.uuid4().hex}")
    collections.setup_index(documents(spark, sf_dir), Config(collection=own), chunk.chunk_window)
    mass = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = spark.table(own.name).select("payload.source", F.length("payload.text").alias("n"), mass.alias("mass"))
    out = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_points"), F.sum("n").cast("long").alias("n_chars"), F.sum("mass").alias("mass")), "setup-index")
    collections.drop_collection(spark, own)
    return out


def _by_label(spark: SparkSession, sf_dir: str) -> dict[int, CollectionConfig]:
    """A collection of the vectors of each label (ten of them); its payload is the label."""
    rows = load_table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    label = F.coalesce(F.pmod("label", F.lit(10)), F.lit(0))
    run, own = uuid.uuid4().hex, {}
    for r in rows.groupBy(label.alias("label")).agg(F.max(F.size("embedding")).alias("dim")).collect():
        own[r["label"]] = config = CollectionConfig(name=f"c_{run}_{r['label']}", dim=r["dim"], distance="euclidean")
        collections.create_collection(spark, config)
        payload = F.struct(F.col("label").cast("string").alias("text"), F.lit("embeddings").alias("source")).alias("payload")
        collections.write_points(spark, config, rows.where(label == r["label"]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), payload), 32_000)
    return own


def _counted(spark: SparkSession, own: dict[int, CollectionConfig], says: Callable[[int, CollectionConfig], tuple], columns: str) -> DataFrame:
    """label, n_points and what is said of each collection; then all of them are dropped."""
    n = lambda c: spark.table(c.name).count() if collections.collection_exists(spark, c.name) else 0
    rows = [(label, n(config), *says(label, config)) for label, config in own.items()]
    for config in own.values():
        collections.drop_collection(spark, config)
    return spark.createDataFrame(rows, f"label int, n_points long, {columns}")


_PER_LABEL = "FROM (SELECT label, count(*)::BIGINT AS n, max(len(embedding))::BIGINT AS dim FROM embeddings GROUP BY label)"


@query(f"SELECT label::INTEGER AS label, n AS n_points, false AS again, dim, 'euclidean' AS distance {_PER_LABEL}")
def create_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creating what is there already does nothing."""

    def says(_: int, config: CollectionConfig) -> tuple:
        held = collections.properties(spark, config.name)
        return collections.create_collection(spark, config), int(held["dim"]), held["distance"]

    return _counted(spark, _by_label(spark, sf_dir), says, "again boolean, dim long, distance string")


@query(f"SELECT label::INTEGER AS label, n AS n_points, true AS listed {_PER_LABEL}")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _by_label(spark, sf_dir)
    names = collections.list_collections(spark)
    return _counted(spark, own, lambda _, config: (config.name in names,), "listed boolean")


@query(f"SELECT label::INTEGER AS label, n AS n_points, true AS there, false AS other {_PER_LABEL}")
def collection_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = lambda _, config: (collections.collection_exists(spark, config.name), collections.collection_exists(spark, config.name + "_other"))
    return _counted(spark, _by_label(spark, sf_dir), there, "there boolean, other boolean")


@query(f"SELECT label::INTEGER AS label, CASE WHEN label % 2 = 0 THEN 0 ELSE n END AS n_points, label % 2 = 1 AS there, false AS again {_PER_LABEL}")
def drop_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops the collections of even labels; dropping them again does nothing."""
    own = _by_label(spark, sf_dir)
    even = [c for label, c in own.items() if label % 2 == 0]
    done = all([collections.drop_collection(spark, c) for c in even])
    again = any([collections.drop_collection(spark, c) for c in even])
    return _counted(spark, own, lambda _, config: (collections.collection_exists(spark, config.name), again or not done), "there boolean, again boolean")


# scores and search


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the one with the next id."""
    rows = load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id")


def _measured(spark: SparkSession, sf_dir: str, distance: str) -> DataFrame:
    measure, _ = vectors.METRICS[distance]
    return _pairs(spark, sf_dir).select("vec_id", F.round(measure(F.col("embedding"), F.col("other")), 6).alias("score"))


@query(sql.pair_scores("cosine"))
def score_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, "cosine")


@query(sql.pair_scores("euclidean"))
def score_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, "euclidean")


@query(sql.pair_scores("manhattan"))
def score_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, "manhattan")


@query(sql.nearest("cosine"))
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn_exact(asked_vectors(spark, sf_dir), stored_vectors(spark, sf_dir)))


@query(sql.nearest("euclidean"))
def knn_exact_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn_exact(asked_vectors(spark, sf_dir), stored_vectors(spark, sf_dir), distance="euclidean"))


@query(sql.nearest("manhattan"))
def knn_exact_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn_exact(asked_vectors(spark, sf_dir), stored_vectors(spark, sf_dir), distance="manhattan"))


#: Cells of the queries below, and how many of them a question visits.
CELLS, PROBES = 16, 8


def _centres(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The vectors with the smallest ids as centres, so that SQL can say which cells there are."""
    rows = stored_vectors(spark, sf_dir).where("id is not null and vector is not null").orderBy("id").limit(CELLS).collect()
    return np.array([r["vector"] for r in rows], np.float64)


@query(sql.by_cells(CELLS, PROBES))
def knn_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn_ann(asked_vectors(spark, sf_dir), stored_vectors(spark, sf_dir), nprobe=PROBES, centres=_centres(spark, sf_dir)))


def _indexed_collection(spark: SparkSession, sf_dir: str) -> CollectionConfig:
    """The vectors as a collection with an inverted file. Half of them come after the index was built, with other vectors for a quarter that was there."""
    rows = stored_vectors(spark, sf_dir).where("id is not null and vector is not null").withColumn("payload", F.struct(F.lit("").alias("text"), F.lit("embeddings").alias("source")))
    own = CollectionConfig(name=f"c_{uuid.uuid4().hex}", dim=64, part_ids=100)
    collections.create_collection(spark, own)
    turned = F.when(F.col("id") % 4 == 0, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))
    collections.write_points(spark, own, rows.where("id % 2 = 0").withColumn("vector", turned), 1000)
    index.build_index(spark, own.name, SearchConfig(nprobe=PROBES), _centres(spark, sf_dir))
    collections.write_points(spark, own, rows.where("id % 4 <> 2"), 1000)
    return own


@query(sql.by_cells(CELLS, PROBES))
def knn_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches a stored inverted file: nothing is fitted, and only the cells that questions visit are read."""
    return _from_collection(spark, sf_dir, lambda asked, name: index.knn_stored(asked, name))


def _from_collection(spark: SparkSession, sf_dir: str, find: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    own = _indexed_collection(spark, sf_dir)
    out = written(rounded(find(asked_vectors(spark, sf_dir), own.name)), "from-collection")
    collections.drop_collection(spark, own)
    return out


@query(sql.by_cells(CELLS, PROBES))
def knn_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_collection(spark, sf_dir, lambda asked, name: index.overfetch_stored(asked, name, SearchConfig(nprobe=PROBES)))


@query(sql.nearest("cosine"))
def knn_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn_auto(asked_vectors(spark, sf_dir), stored_vectors(spark, sf_dir)))


@query(sql.by_cells(CELLS, PROBES), "knn_auto_index")
def knn_auto_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection beyond the bytes that are searched exactly."""
    config = SearchConfig(exact_below_bytes=0, nprobe=PROBES)
    return rounded(search.knn_auto(asked_vectors(spark, sf_dir), stored_vectors(spark, sf_dir), config, centres=_centres(spark, sf_dir)))


@query(sql.recall_by_cells(CELLS, PROBES))
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact neighbours are in the cells that each question visits."""
    asked, stored = asked_vectors(spark, sf_dir), stored_vectors(spark, sf_dir)
    found = search.knn_ann(asked, stored, nprobe=PROBES, centres=_centres(spark, sf_dir))
    return search.ann_recall(found, search.knn_exact(asked, stored)).select("query_id", F.round("recall", 6).alias("recall"))


@query(None, "ann_recall_fitted")
def fitted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with fitted cells and as many probes as a sample of the points asks for; a question's own point is left out."""
    asked, stored = asked_vectors(spark, sf_dir), stored_vectors(spark, sf_dir)
    k = SearchConfig().top_k
    others = lambda hits: hits.where("query_id <> id and rank <= %d" % (k + 1)).select("query_id", "id")
    return search.ann_recall(others(search.knn_ann(asked, stored, k + 1)), others(search.knn_exact(asked, stored, k + 1)))


# questions over the chunks


@query(sql.with_hits("SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score, text, source FROM hits"))
def project_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(found(spark, sf_dir))


@query(sql.with_hits("SELECT query_id, count(*)::BIGINT AS n_documents, string_agg(source, ',' ORDER BY rank) AS sources, string_agg(text, '|' ORDER BY rank) AS texts, round(max(score), 6) AS best FROM hits GROUP BY query_id"))
def to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = search.to_documents(found(spark, sf_dir))
    joined = lambda f, s: F.array_join(F.transform("documents", lambda d: d[f]), s)
    return listed.select("query_id", F.size("documents").cast("long").alias("n_documents"), joined("source", ",").alias("sources"), joined("text", "|").alias("texts"), F.round(F.element_at("documents", 1)["score"], 6).alias("best"))


@query(sql.with_hits("SELECT q.query_id, q.query, h.rank::INTEGER AS rank, h.id, round(h.score, 6) AS score, h.text, CASE WHEN h.rank IS NOT NULL THEN coalesce(h.source, 'unknown') END AS source FROM questions q LEFT JOIN hits h USING (query_id)"))
def retrieve_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(answer.retrieve_stage(questions(spark, sf_dir), found(spark, sf_dir)))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.retrieve_stage(questions(spark, sf_dir), found(spark, sf_dir))


@query(sql.with_contexts("SELECT query_id, query, context FROM contexts"))
def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.assemble_context(_retrieved(spark, sf_dir)).select("query_id", "query", "context")


@query(sql.with_contexts("SELECT query_id, n_documents, length(context)::BIGINT AS n_chars FROM contexts"))
def context_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.context_stats(_retrieved(spark, sf_dir))


@query(sql.with_contexts("SELECT query_id, prompt FROM prompts"))
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.build_prompt(answer.assemble_context(_retrieved(spark, sf_dir))).select("query_id", "prompt")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.generate_batch(answer.build_prompt(answer.assemble_context(_retrieved(spark, sf_dir))))


@query(sql.with_contexts("SELECT query_id, answer FROM answers"))
def generate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("query_id", "answer")


@query(sql.with_contexts(f"SELECT query_id, len([w for w in regexp_split_to_array(answer, '{WHITE}+') if w <> ''])::BIGINT AS n_words FROM answers"))
def answer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.answer_stats(_answers(spark, sf_dir))


@query(sql.with_contexts("SELECT a.query_id, a.query, a.n_documents, a.sources, a.context, a.answer FROM answers a"))
def run_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes the documents, then answers from the collection alone (exactly, so that SQL can say what is found)."""
    own = CollectionConfig(name=f"c_{uuid.uuid4().hex}")
    config = Config(collection=own, search=SearchConfig(exact_below_bytes=1 << 62))
    collections.setup_index(documents(spark, sf_dir), config, chunk.chunk_window)
    state = answer.answer_from(questions(spark, sf_dir), config)
    sources = F.array_join(F.transform("retrieved_docs", lambda d: d["source"]), ",")
    out = written(state.select("query_id", "query", F.size("retrieved_docs").cast("long").alias("n_documents"), sources.alias("sources"), "context", "answer"), "answers")
    collections.drop_collection(spark, own)
    return out


@query(sql.with_hits("SELECT query_id, rank::INTEGER AS rank, source, round(score, 4) AS score, substr(text, 1, 200) || '...' AS preview FROM hits"))
def report_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.report_preview(found(spark, sf_dir))



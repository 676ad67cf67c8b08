"""From hits to answers: sources, context, prompt, generated text and report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import Config
from ..functions.text import first_sentence, word_count
from .embed import embed_query
from .index import knn_stored, payloads

UNKNOWN = "unknown"
INSTRUCTION = "Answer from the documents below only. Say so if they do not hold the answer, and name the documents you used."
SEPARATOR = "\n\n---\n\n"


def retrieve_stage(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, query, rank, id, score, text, source; a question without hits has one row of nulls."""
    source = F.when(F.col("rank").isNotNull(), F.coalesce("source", F.lit(UNKNOWN)))
    return questions.select("query_id", "query").join(hits, "query_id", "left").withColumn("source", source)


def gathered(retrieved: DataFrame) -> DataFrame:
    """query_id, query, retrieved_docs: the hits of each question as an array, best first; empty without hits."""
    docs = F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "source", "text", "score")))
    return retrieved.groupBy("query_id", "query").agg(F.sort_array(docs).alias("retrieved_docs"))


def context_of(docs: Column) -> Column:
    """Numbered documents with their sources, in rank order; an empty text without documents."""
    head = lambda d: F.concat(F.lit("[Document "), d["rank"].cast("string"), F.lit(" - "), d["source"], F.lit("]"))
    return F.array_join(F.transform(docs, lambda d: F.concat(head(d), F.lit("\n"), d["text"])), SEPARATOR)


def assemble_context(retrieved: DataFrame) -> DataFrame:
    """query_id, query, retrieved_docs, context."""
    return gathered(retrieved).withColumn("context", context_of(F.col("retrieved_docs")))


def context_stats(retrieved: DataFrame) -> DataFrame:
    """query_id, n_documents, n_chars of each context."""
    docs = F.col("retrieved_docs")
    return gathered(retrieved).select("query_id", F.size(docs).cast("long").alias("n_documents"), F.length(context_of(docs)).cast("long").alias("n_chars"))


def build_prompt(contexts: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """Adds prompt."""
    parts = [F.lit(instruction), F.lit("Documents:"), F.col("context"), F.concat(F.lit("Question: "), F.col("query")), F.lit("Answer:")]
    return contexts.withColumn("prompt", F.concat_ws("\n", *parts))


def generate_batch(prompts: DataFrame, make_model: Callable | None = None, batch_size: int = 16) -> DataFrame:
    """Adds answer. make_model() gives a function from an array of prompts to an array of texts; the default
    model quotes the first sentence of the best document in retrieved_docs (null without any)."""
    if make_model is not None:
        model = predict_batch_udf(make_model, return_type=StringType(), batch_size=batch_size)
        return prompts.withColumn("answer", model("prompt"))
    return prompts.withColumn("answer", first_sentence(F.get("retrieved_docs", F.lit(0))["text"]))


def answer_stats(answers: DataFrame) -> DataFrame:
    """query_id, n_words of the answer."""
    return answers.select("query_id", word_count(F.col("answer")).alias("n_words"))


def run_queries(questions: DataFrame, hits: DataFrame, make_model: Callable | None = None) -> DataFrame:
    """query_id, query, retrieved_docs, context, answer: the whole state of every question, in one job."""
    answered = generate_batch(build_prompt(assemble_context(retrieve_stage(questions, hits))), make_model)
    return answered.select("query_id", "query", "retrieved_docs", "context", "answer")


def answer_from(questions: DataFrame, config: Config = Config(), make_embedder: Callable | None = None, make_model: Callable | None = None) -> DataFrame:
    """As run_queries, from a collection that setup_index() stored: its documents are neither read, chunked nor embedded.

    Questions are embedded, meet the collection's points (by its inverted file, if it has one), and payloads are read of the hits alone.
    """
    name = config.collection.name
    hits = knn_stored(embed_query(questions, config.embed, make_embedder), name, config.search.top_k, config.search.nprobe)
    return run_queries(questions, payloads(questions.sparkSession, name, hits), make_model)


def report_preview(hits: DataFrame, width: int = 200) -> DataFrame:
    """query_id, rank, source, score with 4 decimals, preview of the text."""
    preview = F.concat(F.substring("text", 1, width), F.lit("..."))
    return hits.select("query_id", "rank", "source", F.round("score", 4).alias("score"), preview.alias("preview"))

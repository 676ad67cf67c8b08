"""The operators over their whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, licenses, media, mixing, pieces, quality, repair, runs, secret_scan, simhash, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2).select("doc_id", "size", "source_size", "target", "taken")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_table(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), ["doc_id"], with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model, ["doc_id"])
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


#: The rules of the contract: (verdict, host/path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the quality of the document whose id its path ends in."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path_of("url"), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    pages = pages.withColumn("document", F.when(number != "", number.cast("long")))
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("document")).agg(F.min("quality").cast("int").alias("good"))
    return urls.filter_urls(pages.join(labels, "document", "left"), RULES, ["page_id"], good="good")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    chats = chat.format_records(chat.conversation_records(rows.unionByName(own)), ["conv_id"])
    return chat.read_back(chats, ["conv_id"])


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.classify(table(spark, sf_dir, "documents"), trusted).where("keep").drop("keep")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_rows(table(spark, sf_dir, "documents"), ["doc_id"])
    said = lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["stop"].cast("string"))
    base = F.filter("spans", lambda x: x["place"] < len(secret_scan.BASE))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["rule"] == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.wrapped(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs, ["doc_id"], shortest=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    said = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    milli = F.expr("1000 * best.length div -best.short")
    return out.select("doc_id", "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.repaired(repair.damaged(table(spark, sf_dir, "conversations"))))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return licenses.summary(found, ["doc_id"])


QUERIES = {f.__name__: f for f in (op1_mixing, op2_media, op3_simhash, op4_sentencepiece, op5_toxicity, op6_urls, op7_chat, op8_ann, op9_quality, op10_secrets, op11_runs, op12_repair, op13_licenses)}

#: What stands in the formatted text besides roles and texts: marks and escapes.
_ESCAPES = r"len(regexp_extract_all({0}, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))"

CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(role) + length(text) + {_ESCAPES.format("role")} + {_ESCAPES.format("text")} + length(role) - length(replace(role, chr(10), '')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLE_SQL = {
    "op1_mixing": mixing.SQL,
    "op7_chat": CHAT_SQL,
    "op12_repair": repair.SQL,
    "op13_licenses": licenses.SQL,
}

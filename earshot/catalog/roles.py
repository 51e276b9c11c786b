"""The driver tables in the roles of manifests, label files, logs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import PY_SPACE, split_words

# Fixed values of the registered queries.
PROMPT = "what is the speaker describing?"
SAMPLE_RATE = 16000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Tasks to deal CPU-heavy rows over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit("documents").alias("split"),
        F.col("doc_id").alias("line_no"),
        F.lit("/corpus").alias("root"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"),
        F.col("n_chars").alias("n_frames"),
        F.col("lang").alias("label"),
    )


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit("documents").alias("split"),
        F.col("doc_id").alias("line_no"),
        F.col("lang").alias("answer"),
        F.lit(PROMPT).alias("question"),
        "text",
    )


def doc_words(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *cols, split_words("text").alias("words"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "text", split_words("text").alias("words"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("truth"), F.col("embedding").alias("scores"))


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as sequences of ten positions, 64 scores each."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq"),
        (F.col("vec_id") % 10).alias("pos"),
        F.col("label").alias("target"),
        F.col("embedding").alias("scores"),
    )


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_id").alias("update"),
        F.col("user_id").alias("worker"),
        "event_type",
        F.col("value").alias("loss"),
        F.col("value").alias("total_loss"),
        F.lit(0.0).alias("diff_loss"),
        k.alias("ntokens"),
        F.lit(1).cast("bigint").alias("sample_size"),
        F.floor(k / 2).cast("bigint").alias("n_correct"),
        k.alias("total"),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# SQL fragments shared by the twins.
SPACE = _quoted(PY_SPACE)
RUN = _quoted("[" + PY_SPACE + "]+")


def sql_strip(c: str) -> str:
    return f"trim({c}, {SPACE})"


def sql_words(c: str) -> str:
    s = sql_strip(c)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split_regex({s}, {RUN}) END)"


def sql_md5_int(text: str, digits: int) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, {digits})) AS UBIGINT)"


SQL_LOG = """
  SELECT event_id AS update, user_id AS worker, event_type, value AS loss,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS ntokens, 1 AS sample_size,
         CAST(floor(CAST(json_extract_string(props, '$.k') AS BIGINT) / 2) AS BIGINT) AS n_correct,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS total
  FROM events
"""

"""From raw documents to packed token sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import decontaminate, jaccard, langid, packing, pii
from earshot.llm.common import settle, table, tokenizer_path

SMALL_SIDE = 1_000_000  # ids that may be broadcast
PII_KEY = "corpus"


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids`` (written, so that its size is known)."""
    ids = settle(ids.filter("doc_id is not null").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= SMALL_SIDE else ids, "doc_id", "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: null texts, texts without letters, scores below the level."""
    model = langid.train(docs)
    return langid.identify(docs, model).filter("not rejected").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts that share 0.8 or more of their five-word shingles.

    Rows that repeat a doc_id are one document, and one of them stays. Rows without doc_id stay.
    """
    found = settle(jaccard.ngram_jaccard(docs, k=5, percent=80).select("doc_id", "component_id"), "near")
    kept = _without(docs, found.filter("doc_id <> component_id").select("doc_id"))
    twice = settle(found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return _without(kept, twice).unionByName(again)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which tiles cover half or more of a benchmark item."""
    found = decontaminate.matched_items(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the new text."""
    new = pii.pseudonymize(docs, key=PII_KEY)
    changed = F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return new.withColumn("n_chars", changed).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their ids and their place in a sequence."""
    pieces = packing.cut_documents(docs, tokenizer_path())
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("PII surrogates", private),
    ("best-fit packing", packed),
]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

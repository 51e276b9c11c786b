"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import align, bpe, decontaminate, jaccard, langid, lm, negatives, outliers, packing, pii, token_files, toxicity, warc
from earshot.llm.common import remainder, settle, table, tokenizer_path


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matched_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return outliers.quality(docs).drop("lang", "source")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"))
    return lm.score(docs, tokenizer=tokenizer_path())


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, segments = warc.store(table(spark, sf_dir, "pages"))
    stored = warc.payloads(segments).select(F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("payload_bytes"))
    return (
        warc.fields(headers).join(stored, "digest")
        .select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    )


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, key="corpus")


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path())
    return bpe.decode_texts(encoded, tokenizer_path()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align_spans(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    spans = settle(found.withColumn("groups_sha256", digest).drop("groups"), "spans", compression="zstd")
    return align.count_links(spans, align.pair_counts(spans)).drop("row")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_decontamination, op3_jaccard_join, op4_best_fit_packing, op5_toxicity, op6_quality_rules,
        op7_language_id, op8_lm_scoring, op9_warc_archive, op10_pii_surrogates, op11_bpe_encoding,
        op12_token_alignment, op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {
    "op13_hard_negatives": """
      WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
      p AS (SELECT a, c AS p, score AS ps FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
      n AS (SELECT p.a, p.p, p.ps, s.c, s.score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.c) AS rank
            FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps)
      SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, c AS negative_id, ps AS positive_score, score AS negative_score
      FROM n WHERE rank <= 10""",
}

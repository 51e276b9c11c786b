"""Filters, guards and manifest bookkeeping (FL, WN-3, AG-12, JN-10)."""

from pyspark.sql import functions as F

from earshot.catalog.roles import SAMPLE_RATE, doc_words, manifest, sql_words, table
from earshot.functions.sequences import truncate_tokens, wrap_tokens
from earshot.operators import manifest as M
from earshot.operators.sampling import cap_rows

MIN_SIZE, LABELS = 400, ["en", "fr"]
SQL_REASON = "CASE WHEN n_chars < 400 THEN 'size' WHEN lang NOT IN ('en', 'fr') THEN 'label' END"


def fl1(spark, sf):
    kept = M.filter_manifest(manifest(spark, sf), MIN_SIZE, LABELS)
    return kept.select("line_no", "path", "n_frames", "label")


def fl1_reasons(spark, sf):
    m = manifest(spark, sf)
    return m.select("line_no", M.skip_reason("n_frames", "label", MIN_SIZE, LABELS).alias("reason"))


def fl2(spark, sf):
    return M.skip_report(manifest(spark, sf), MIN_SIZE, LABELS)


def fl3(spark, sf):
    """The three policies as sums over all documents, labels as groups."""
    m = manifest(spark, sf).select("label", "n_frames", F.col("n_frames").alias("out"))
    parts = []
    for policy, limit in (
        ("drop", M.MAX_EVAL_POSITIONS),
        ("null", M.MAX_GENERATION_POSITIONS),
        ("zero", M.MAX_TRAINING_POSITIONS),
    ):
        g = M.length_guard(m, "n_frames", limit, policy, ["out"])
        parts.append(
            g.groupBy("label").agg(
                F.count(F.lit(1)).alias("n"),
                F.count("out").alias("n_out"),
                F.coalesce(F.sum("out"), F.lit(0)).alias("total"),
            ).select(F.lit(policy).alias("policy"), "*")
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fl4(spark, sf):
    w = truncate_tokens("words", 1024)
    d = doc_words(spark, sf)
    return d.select(
        "doc_id",
        F.size(w).cast("bigint").alias("n_kept"),
        F.array_join(w, " ").alias("training"),
        F.array_join(wrap_tokens(w, "<bos>", "<eos>"), " ").alias("evaluation"),
    )


def fl5(spark, sf):
    m = manifest(spark, sf)
    size = M.crop_size("n_frames", 1000)
    return m.select("line_no", size.alias("size"), F.round(M.duration_s(size, SAMPLE_RATE), 6).alias("seconds"))


def fl6(spark, sf):
    return cap_rows(table(spark, sf, "documents").select("doc_id", "lang"), 0, 250, "doc_id")


def fl6_one_more(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return cap_rows(d, 0, 250, "doc_id", one_more=True)


def wn3(spark, sf):
    kept = M.filter_manifest(manifest(spark, sf), MIN_SIZE, LABELS)
    return M.dense_reindex(kept.select("split", "line_no", "label"), ["split"])


def ag12(spark, sf):
    r = M.duration_report(manifest(spark, sf), ["label"], sample_rate=SAMPLE_RATE)
    return r.withColumn("seconds", F.round("seconds", 6))


def jn10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return M.keep_collated(docs, table(spark, sf, "labels"), "doc_id")


def fl6_cell(spark, sf):
    """The first 40 events of every user, each user in an order of their own."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return cap_rows(e, "user_id", 40, "event_id", cell=["user_id"])


def fl6_cell_hot(spark, sf):
    """The first 1,200 of every event type: more than a window limit takes, so by counts per bucket."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return cap_rows(e, 5, 1200, "event_id", cell=["event_type"])


def fl6_cell_repeated(spark, sf):
    """The same where keys repeat: all events of a user share one key."""
    e = table(spark, sf, "events").select("user_id", "event_type")
    capped = cap_rows(e, 5, 1200, "user_id", one_more=True, cell=["event_type"])
    return capped.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "fl1_filter_manifest": fl1,
    "fl1_skip_reason": fl1_reasons,
    "fl2_skip_report": fl2,
    "fl3_length_guard": fl3,
    "fl4_truncate_tokens": fl4,
    "fl5_crop_size": fl5,
    "fl6_cap_rows": fl6,
    "fl6_cap_rows_one_more": fl6_one_more,
    "fl6_cap_per_cell": fl6_cell,
    "fl6_cap_per_cell_buckets": fl6_cell_hot,
    "fl6_cap_per_cell_repeated_keys": fl6_cell_repeated,
    "wn3_dense_reindex": wn3,
    "ag12_duration_report": ag12,
    "jn10_keep_collated": jn10,
}


def _cap_sql(n):
    return f"SELECT doc_id, lang FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT {n}"


def _guard_sql(policy, limit):
    where = f"WHERE n_chars <= {limit}" if policy == "drop" else ""
    over = {"drop": "n_chars", "null": "NULL", "zero": "0"}[policy]
    return f"""
      SELECT '{policy}' AS policy, lang AS label, count(*) AS n, count(out) AS n_out,
             CAST(coalesce(sum(out), 0) AS BIGINT) AS total
      FROM (SELECT lang, CASE WHEN n_chars > {limit} THEN {over} ELSE n_chars END AS out
            FROM documents {where}) GROUP BY lang"""


ORACLES = {
    "fl1_filter_manifest": f"""
      SELECT doc_id AS line_no, source || '/' || doc_id || '.wav' AS path, n_chars AS n_frames, lang AS label
      FROM documents WHERE {SQL_REASON} IS NULL""",
    "fl1_skip_reason": f"SELECT doc_id AS line_no, {SQL_REASON} AS reason FROM documents",
    "fl2_skip_report": f"SELECT coalesce({SQL_REASON}, 'loaded') AS outcome, count(*) AS n FROM documents GROUP BY 1",
    "fl3_length_guard": " UNION ALL ".join(
        _guard_sql(p, n) for p, n in (("drop", 900), ("null", 799), ("zero", 1023))
    ),
    "fl4_truncate_tokens": f"""
      WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents)
      SELECT doc_id, CAST(least(len(w), 1023) AS BIGINT) AS n_kept,
             array_to_string(w[1:1023], ' ') AS training,
             array_to_string(list_concat(['<bos>'], list_concat(w[1:1023], ['<eos>'])), ' ') AS evaluation
      FROM w""",
    "fl5_crop_size": """
      SELECT doc_id AS line_no, least(n_chars, 1000) AS size, round(least(n_chars, 1000) / 16000.0::DOUBLE, 6) AS seconds
      FROM documents""",
    "fl6_cap_rows": _cap_sql(250),
    "fl6_cap_rows_one_more": _cap_sql(251),
    "fl6_cap_per_cell": """
      SELECT event_id, user_id, event_type, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || ':' || event_id), event_id) <= 40""",
    "fl6_cap_per_cell_buckets": """
      SELECT event_id, user_id, event_type FROM events
      QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('5:' || event_id), event_id) <= 1200""",
    "fl6_cap_per_cell_repeated_keys": """
      SELECT event_type, user_id, count(*) AS n FROM (
        SELECT event_type, user_id FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('5:' || user_id), user_id) <= 1201)
      GROUP BY ALL""",
    "wn3_dense_reindex": f"""
      SELECT 'documents' AS split, doc_id AS line_no, lang AS label, row_number() OVER (ORDER BY doc_id) - 1 AS index
      FROM documents WHERE {SQL_REASON} IS NULL""",
    "ag12_duration_report": """
      SELECT lang AS label, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_frames,
             round(sum(n_chars) / 16000.0::DOUBLE, 6) AS seconds, min(n_chars) AS min_frames, max(n_chars) AS max_frames
      FROM documents GROUP BY lang""",
    "jn10_keep_collated": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
}

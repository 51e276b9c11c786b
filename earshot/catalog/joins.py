"""Joins: alignment, label tokens, probes, embeddings, pairs of rows (JN)."""

from pyspark.sql import functions as F

from earshot.catalog.roles import (
    PROMPT,
    label_lines,
    manifest,
    scores,
    sql_words,
    table,
    turns,
)
from earshot.operators import manifest as M
from earshot.operators.sampling import class_index
from earshot.operators.scoring import content_free_grid, map_label_tokens
from earshot.operators.sequences import embed_tokens, pair_adjacent

LABELS = ["en", "fr"]


def jn1(spark, sf):
    """Lines of two languages on both sides, positions kept."""
    kept = M.filter_manifest(manifest(spark, sf), 400, LABELS)
    lines = label_lines(spark, sf)
    rest = lines.join(kept.select("split", "line_no"), ["split", "line_no"], "left_semi")
    both = M.attach_labels(kept, rest)
    return both.select(
        "line_no", "path", "n_frames", "label", "answer", "question", F.md5("text").alias("text_md5")
    )


def jn1_report(spark, sf):
    """The manifest against the partial second label set."""
    second = table(spark, sf, "labels").select(
        F.lit("documents").alias("split"),
        F.col("doc_id").alias("line_no"),
        F.when(F.col("quality") == 1, "en").otherwise("fr").alias("answer"),
    )
    return M.alignment_report(manifest(spark, sf), second)


def jn6(spark, sf):
    """Conversations that hold fewer than three user turns of those they plan (longest turn number + 1)."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("split"), "turn", "role")
    plan = c.groupBy("split").agg((F.max("turn") + 1).alias("n_rows"))
    return M.incomplete_outputs(plan, c.filter(F.col("role") == "user"), 3)


def jn7(spark, sf):
    """Score rows against the classes found in the documents' languages."""
    langs = class_index(table(spark, sf, "documents"), "lang", "doc_id")
    classes = langs.select((F.col("class_id") * 2).alias("token_id"), "class_id")
    e = scores(spark, sf).select("id", F.col("truth").alias("token"))
    return map_label_tokens(e, classes, "token")


def jn8(spark, sf):
    inputs = table(spark, sf, "benchmark").select("item_id", "text")
    langs = table(spark, sf, "documents").select(F.col("lang").alias("label")).distinct()
    grid = content_free_grid(inputs, langs, "text", " " + PROMPT)
    return grid.select("item_id", "probe_label", "probe")


def jn9(spark, sf):
    """Turns as word-length tokens, replaced by 64-wide vectors: sums per component that depend on the
    order. Lengths without a vector give NULL, turns without words stay."""
    t = turns(spark, sf).select(
        "conv_id", "turn", F.transform("words", lambda w: F.length(w)).alias("tokens")
    )
    vecs = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec")
    )
    e = embed_tokens(t, vecs, ["conv_id", "turn"], "tokens", unknown="null")

    def weighted(c):
        parts = F.transform(
            "vectors", lambda v, i: F.coalesce(F.get(v, c).cast("double"), F.lit(0.0)) * (i + 1).cast("double")
        )
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    sums = F.transform(F.sequence(F.lit(0), F.lit(63)), weighted)
    return e.select(
        "conv_id",
        "turn",
        F.size("vectors").cast("bigint").alias("n"),
        F.size(F.filter("vectors", lambda v: v.isNull())).cast("bigint").alias("n_unknown"),
        F.posexplode(sums).alias("component", "value"),
    ).withColumn("value", F.round("value", 6))


def jn11(spark, sf):
    p = pair_adjacent(turns(spark, sf), ["conv_id"], "turn", "words")
    return p.select(
        "conv_id", "pair_no", "n_rows", F.size("words").cast("bigint").alias("n_words"),
        F.md5(F.array_join("words", " ")).alias("words_md5"),
    )


QUERIES = {
    "jn1_attach_labels": jn1,
    "jn1_alignment_report": jn1_report,
    "jn6_incomplete_outputs": jn6,
    "jn7_map_label_tokens": jn7,
    "jn8_content_free_grid": jn8,
    "jn9_embed_tokens": jn9,
    "jn11_pair_adjacent": jn11,
}

ORACLES = {
    "jn1_attach_labels": f"""
      SELECT m.doc_id AS line_no, m.source || '/' || m.doc_id || '.wav' AS path, m.n_chars AS n_frames,
             m.lang AS label, l.lang AS answer, '{PROMPT}' AS question, md5(l.text) AS text_md5
      FROM documents m JOIN documents l USING (doc_id)
      WHERE m.n_chars >= 400 AND m.lang IN ('en', 'fr')""",
    "jn1_alignment_report": """
      SELECT CASE WHEN l.doc_id IS NULL THEN 'manifest only' WHEN d.doc_id IS NULL THEN 'labels only' ELSE 'both' END AS match,
             count(*) AS n,
             count(CASE WHEN d.lang <> CASE WHEN l.quality = 1 THEN 'en' ELSE 'fr' END AND l.doc_id IS NOT NULL THEN 1 END) AS n_differ
      FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
    "jn6_incomplete_outputs": """
      WITH p AS (SELECT conv_id AS split, max(turn) + 1 AS n_rows,
                        count(CASE WHEN role = 'user' THEN 1 END) AS n_done FROM conversations GROUP BY conv_id)
      SELECT split, n_rows, n_done, least(n_rows, 3) AS n_wanted FROM p WHERE n_done < least(n_rows, 3)""",
    "jn7_map_label_tokens": """
      WITH c AS (SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS class_id
                 FROM (SELECT lang, min(doc_id) AS first FROM documents GROUP BY lang))
      SELECT e.vec_id AS id, e.label AS token, c.class_id AS truth
      FROM embeddings e LEFT JOIN c ON e.label = c.class_id * 2""",
    "jn8_content_free_grid": f"""
      SELECT item_id, lang AS probe_label, text || ' {PROMPT}' || ' ' || lang AS probe
      FROM benchmark, (SELECT DISTINCT lang FROM documents)""",
    "jn9_embed_tokens": f"""
      WITH t AS (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations),
      l AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
      n AS (SELECT t.conv_id, t.turn, count(word) AS n, count(word) - count(vec_id) AS n_unknown
            FROM t LEFT JOIN l USING (conv_id, turn) LEFT JOIN embeddings ON vec_id = length(word) GROUP BY ALL),
      v AS (SELECT conv_id, turn, i, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS component
            FROM l JOIN embeddings ON vec_id = length(word)),
      s AS (SELECT conv_id, turn, component, sum(x * i) AS value FROM v GROUP BY ALL)
      SELECT g.conv_id, g.turn, n, n_unknown, CAST(c AS INTEGER) AS component, round(coalesce(value, 0), 6) AS value
      FROM (SELECT * FROM n, range(64) r(c)) g
      LEFT JOIN s ON s.conv_id = g.conv_id AND s.turn = g.turn AND s.component = c""",
    "jn11_pair_adjacent": f"""
      WITH t AS (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations)
      SELECT conv_id, CAST(turn // 2 AS BIGINT) AS pair_no, count(*) AS n_rows, CAST(sum(len(w)) AS BIGINT) AS n_words,
             md5(string_agg(array_to_string(w, ' '), ' ' ORDER BY turn)) AS words_md5
      FROM t GROUP BY conv_id, turn // 2""",
}

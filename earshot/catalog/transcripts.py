"""Edit distances and error rates over whole texts (SC-1, SC-2, AG-5), and length-guarded sums."""

from pyspark.sql import functions as F

from earshot.catalog.roles import label_lines, manifest, sql_strip, sql_words, table, tasks
from earshot.functions.edits import char_edits, text_edits, word_edits
from earshot.functions.text import split_words
from earshot.operators.errors import error_rates
from earshot.plans.corpus import training_items

# A character that occurs in no text of the driver tables.
MARK = "¤"


def _doc_pairs(spark, sf):
    """Every document (white space evened out) against a damaged copy of itself.

    Every 7th word is left out and of the other words every 11th is overwritten with
    marks. A mark matches nothing and nothing was added, so the cheapest repair is
    known exactly: one edit per lost or overwritten symbol. Edit distance is CPU work
    out of proportion to the bytes read, so the texts are dealt over more tasks first.
    """
    w = split_words("text")
    kept = F.filter(
        F.transform(
            w,
            lambda x, i: F.when((i + 1) % 7 == 0, F.lit(None))
            .when((i + 1) % 11 == 0, F.repeat(F.lit(MARK), F.length(x)))
            .otherwise(x),
        ),
        lambda x: x.isNotNull(),
    )
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return d.repartition(4 * tasks(spark), "doc_id").select(
        "doc_id", "lang", F.array_join(w, " ").alias("ref"), F.array_join(kept, " ").alias("hyp")
    )


def _turn_pairs(spark, sf):
    """Each turn against the next one of its conversation, letters outside a-z evened out."""
    plain = F.regexp_replace(F.lower("text"), "[^a-z \n.,]", "?")
    c = table(spark, sf, "conversations").select("conv_id", "turn", plain.alias("ref"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    return c.join(nxt, ["conv_id", "turn"])


def sc1(spark, sf):
    p = _turn_pairs(spark, sf)
    return p.select("conv_id", "turn", char_edits("ref", "hyp").alias("edits"))


def sc2(spark, sf):
    p = _turn_pairs(spark, sf)
    return p.select("conv_id", "turn", word_edits("ref", "hyp").alias("edits"))


def sc_docs(spark, sf):
    p = _doc_pairs(spark, sf)
    chars, words = text_edits("ref", "hyp")
    return p.select("doc_id", chars.alias("char_edits"), words.alias("word_edits"))


def _rounded(r):
    return r.withColumns({"uer": F.round("uer", 6), "wer": F.round("wer", 6)})


def ag5(spark, sf):
    return _rounded(error_rates(_doc_pairs(spark, sf), "ref", "hyp", ["lang"]))


def ag5_total(spark, sf):
    """Over all turn pairs; pairs without a generated text (every user turn) add nothing."""
    p = _turn_pairs(spark, sf)
    given = F.when(F.col("turn") % 2 == 1, F.col("hyp"))
    return _rounded(error_rates(p.withColumn("hyp", given), "ref", "hyp"))


def items(spark, sf):
    """The training-side load: filter, align, normalise, crop."""
    m = manifest(spark, sf).withColumn("dataset", F.lit("flickr8k"))
    t = training_items(m, label_lines(spark, sf), "dataset", min_size=400)
    return t.select("line_no", "path", "size", F.md5("transcript").alias("transcript_md5"))


QUERIES = {
    "sc1_char_edits": sc1,
    "sc2_word_edits": sc2,
    "sc1_sc2_document_edits": sc_docs,
    "ag5_error_rates": ag5,
    "ag5_error_rates_total": ag5_total,
    "jn1_training_items": items,
}

SQL_TURN_PAIRS = r"""
  c AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z \n.,]', '?', 'g') AS ref FROM conversations),
  p AS (SELECT a.conv_id, a.turn, a.ref, b.ref AS hyp FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

# The dynamic program over words, one anti-diagonal of every pair per step: d1 and d2
# are the two diagonals before, indexed by the column.
SQL_WORD_EDITS = f"""
  w AS (SELECT conv_id, turn, ref, hyp, {sql_words('ref')} AS r, {sql_words('hyp')} AS h FROM p),
  dp AS (
    SELECT conv_id, turn, r, h, 0 AS k, len(r) AS n, len(h) AS m,
           list_transform(range(len(h) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE 1000000 END::BIGINT) AS d1,
           list_transform(range(len(h) + 1), lambda j: 1000000::BIGINT) AS d2
    FROM w
    UNION ALL
    SELECT conv_id, turn, r, h, k + 1, n, m,
           list_transform(range(m + 1), lambda j: CASE
             WHEN k + 1 - j < 0 OR k + 1 - j > n THEN 1000000
             WHEN j = 0 OR j = k + 1 THEN k + 1
             ELSE least(d1[j + 1] + 1, d1[j] + 1, d2[j] + CASE WHEN r[k + 1 - j] = h[j] THEN 0 ELSE 1 END) END::BIGINT),
           d1
    FROM dp WHERE k < n + m),
  e AS (SELECT conv_id, turn, n, d1[m + 1] AS edits FROM dp WHERE k = n + m)"""

SQL_DOC_EDITS = f"""
  w AS (SELECT doc_id, lang, {sql_words('text')} AS w FROM documents),
  u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
  s AS (SELECT doc_id, count(*) AS n, sum(length(x)) AS c,
               count(*) FILTER (i % 7 = 0) AS gone, sum(length(x)) FILTER (i % 7 = 0) AS gone_c,
               count(*) FILTER (i % 7 <> 0 AND i % 11 = 0) AS over, sum(length(x)) FILTER (i % 7 <> 0 AND i % 11 = 0) AS over_c
        FROM u GROUP BY doc_id),
  e AS (SELECT doc_id, lang, coalesce(n, 0) AS num_words, coalesce(c, 0) + greatest(coalesce(n, 0) - 1, 0) AS num_chars,
               coalesce(gone, 0) + coalesce(over, 0) AS word_edits,
               coalesce(gone_c, 0) + coalesce(gone, 0) + coalesce(over_c, 0) AS char_edits
        FROM documents LEFT JOIN s USING (doc_id))"""

SQL_RATES = """
  SELECT {by} CAST(sum(ce) AS BIGINT) AS num_char_errors, CAST(sum(c) AS BIGINT) AS num_chars,
         CAST(sum(we) AS BIGINT) AS num_word_errors, CAST(sum(w) AS BIGINT) AS num_words,
         round(sum(ce) * 100.0::DOUBLE / sum(c), 6) AS uer, round(sum(we) * 100.0::DOUBLE / sum(w), 6) AS wer"""

ORACLES = {
    "sc1_char_edits": f"WITH {SQL_TURN_PAIRS} SELECT conv_id, turn, levenshtein(ref, hyp) AS edits FROM p",
    "sc2_word_edits": f"WITH RECURSIVE {SQL_TURN_PAIRS}, {SQL_WORD_EDITS} SELECT conv_id, turn, edits FROM e",
    "sc1_sc2_document_edits": f"""
      WITH {SQL_DOC_EDITS}
      SELECT doc_id, CAST(char_edits AS BIGINT) AS char_edits, CAST(word_edits AS BIGINT) AS word_edits FROM e""",
    "ag5_error_rates": f"""
      WITH {SQL_DOC_EDITS} {SQL_RATES.format(by='lang,')}
      FROM (SELECT lang, char_edits AS ce, num_chars AS c, word_edits AS we, num_words AS w FROM e) GROUP BY lang""",
    "ag5_error_rates_total": f"""
      WITH RECURSIVE {SQL_TURN_PAIRS}, {SQL_WORD_EDITS} {SQL_RATES.format(by='')}
      FROM (SELECT levenshtein(ref, hyp) AS ce, length(ref) AS c, edits AS we, n AS w
            FROM p JOIN e USING (conv_id, turn) WHERE turn % 2 = 1)""",
    "jn1_training_items": f"""
      WITH t AS (SELECT doc_id, source, n_chars, {sql_strip('text')} AS t FROM documents WHERE n_chars >= 400)
      SELECT doc_id AS line_no, source || '/' || doc_id || '.wav' AS path, least(n_chars, 320000) AS size,
             md5(CASE WHEN t LIKE '%.' THEN t ELSE t || '.' END) AS transcript_md5 FROM t""",
}

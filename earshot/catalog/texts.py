"""Text functions over whole documents (TX)."""

from pyspark.sql import functions as F

from earshot.catalog.roles import SPACE, sql_strip, sql_words, table
from earshot.functions import text as T
from earshot.operators.manifest import split_segments, sum_segments


def _docs(spark, sf, **cols):
    return table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in cols.items()])


def _spelled():
    return F.regexp_replace(F.replace("text", F.lit(" "), F.lit("|")), "(?s)(.)", "$1 ")


SQL_SPELLED = "regexp_replace(replace(text, ' ', '|'), '(.)', '\\1 ', 'gs')"


def _letters_sql(c):
    return f"trim(translate(lower({c}), '|' || {SPACE}, ' '))"


def _period_sql(c):
    return f"(CASE WHEN {c} LIKE '%.' THEN {c} ELSE {c} || '.' END)"


def tx1(spark, sf):
    return _docs(spark, sf, transcript=T.normalize_letters(_spelled()))


def tx2(spark, sf):
    return _docs(spark, sf, label=T.ensure_period("text"))


def tx3(spark, sf):
    return _docs(spark, sf, body=T.strip_dots("text"))


def tx4(spark, sf):
    return _docs(spark, sf, hyp=T.unescape_hyp("text"))


def tx5(spark, sf):
    return _docs(
        spark,
        sf,
        first_sentence=T.first_sentence("text"),
        first_line=T.first_line("text"),
        target=T.clean_target("text"),
    )


def tx6(spark, sf):
    return _docs(spark, sf, answer=T.render_answer("lang"), probe=T.render_label("lang"))


def tx7(spark, sf):
    w = T.split_words("text")
    return _docs(
        spark, sf, n_words=F.size(w).cast("bigint"), words=F.array_join(w, "\x1e")
    )


def _dataset():
    n = F.substring("source", 4, 9).cast("int") % 3
    names = F.array(F.lit("librispeech100"), F.lit("flickr8k"), F.lit("voxceleb1"))
    return F.concat(F.get(names, n), F.lit("-"), F.col("source"))


def tx8(spark, sf):
    return _docs(spark, sf, dataset=_dataset(), transcript=T.normalizer_for(_dataset(), "text"))


def tx9(spark, sf):
    """Each conversation as one item whose segments are its turns."""
    c = table(spark, sf, "conversations").select(
        "conv_id",
        F.concat("conv_id", F.lit("_"), "turn", F.lit(".wav")).alias("name"),
        F.length("text").cast("bigint").alias("n_frames"),
    )
    items = c.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list("name")), ";").alias("path"),
        F.lit("/corpus").alias("root"),
    )
    segments = split_segments(items)
    sizes = c.select(F.concat_ws("/", F.lit("/corpus"), "name").alias("segment_path"), "n_frames")
    sized = segments.join(sizes, "segment_path")
    return sum_segments(sized, ["conv_id", "path"])


def tx10(spark, sf):
    """A checkpoint template per source, filled with each document's id."""
    template = F.concat(F.lit("outputs/wav-"), "source", F.lit("rf{v}/checkpoint_best_{v}.pt"))
    d = table(spark, sf, "documents").select("doc_id", template.alias("template"))
    path = T.checkpoint_path("template", "doc_id")
    return d.select("doc_id", path.alias("path"), T.model_tag(path).alias("model_tag"))


QUERIES = {
    "tx1_normalize_letters": tx1,
    "tx2_ensure_period": tx2,
    "tx3_strip_dots": tx3,
    "tx4_unescape_hyp": tx4,
    "tx5_first_sentence": tx5,
    "tx6_render_answer": tx6,
    "tx7_split_words": tx7,
    "tx8_normalizer_for": tx8,
    "tx9_split_segments": tx9,
    "tx10_model_key": tx10,
}

ORACLES = {
    "tx1_normalize_letters": f"SELECT doc_id, {_letters_sql(SQL_SPELLED)} AS transcript FROM documents",
    "tx2_ensure_period": f"SELECT doc_id, {_period_sql(sql_strip('text'))} AS label FROM documents",
    "tx3_strip_dots": "SELECT doc_id, trim(text, '.') AS body FROM documents",
    "tx4_unescape_hyp": "SELECT doc_id, replace(replace(trim(text, '.'), '#', chr(9)), '*', chr(10)) AS hyp FROM documents",
    "tx5_first_sentence": f"""
      SELECT doc_id,
             rtrim(split_part(text, '.', 1), {SPACE}) || '.' AS first_sentence,
             trim(trim(split_part(text, chr(10), 1), '.'), {SPACE}) AS first_line,
             trim({sql_strip('text')}, '.') AS target
      FROM documents""",
    "tx6_render_answer": "SELECT doc_id, ' ' || lang || chr(10) AS answer, ' ' || lang AS probe FROM documents",
    "tx7_split_words": f"""
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, chr(30)) AS words
      FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)""",
    "tx8_normalizer_for": f"""
      WITH d AS (
        SELECT doc_id, text, CAST(substr(source, 4) AS INTEGER) % 3 AS kind,
               ['librispeech100', 'flickr8k', 'voxceleb1'][CAST(substr(source, 4) AS INTEGER) % 3 + 1]
                 || '-' || source AS dataset FROM documents),
      n AS (
        SELECT doc_id, dataset,
               trim(CASE WHEN kind = 0 THEN {_letters_sql('text')} ELSE {sql_strip('text')} END, {SPACE}) AS t
        FROM d)
      SELECT doc_id, dataset, {_period_sql('t')} AS transcript FROM n""",
    "tx9_split_segments": """
      SELECT conv_id,
             string_agg(conv_id || '_' || turn || '.wav', ';' ORDER BY conv_id || '_' || turn || '.wav') AS path,
             CAST(sum(length(text)) AS BIGINT) AS n_frames, count(*) AS n_segments
      FROM conversations GROUP BY conv_id""",
    "tx10_model_key": """
      SELECT doc_id, 'outputs/wav-' || source || 'rf' || doc_id || '/checkpoint_best_' || doc_id || '.pt' AS path,
             'wav-' || source || 'rf' || doc_id AS model_tag
      FROM documents""",
}

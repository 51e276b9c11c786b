"""Sweep planning, stored runs and reports (JN-3 .. JN-5, FL-7, AG-8, AG-9, SNK, SRC)."""

from pyspark.sql import functions as F

from earshot.catalog.roles import SAMPLE_RATE, table
from earshot.catalog.scores import SQL_RUNS, runs
from earshot.functions.text import unescape_hyp
from earshot.operators import sweep as W
from earshot.operators.sampling import chop_size, class_index
from earshot.session import shared_dir
from earshot.sources.audio import parse_wav
from earshot.sources.manifests import read_labels, read_manifest
from earshot.sources.sinks import read_runs, report_csv, write_manifest_pair, write_runs

CKPTS = ["wav-rf2", "wav-rf4", "wav-rf8", "wav-rf16"]


def jn3(spark, sf):
    langs = class_index(table(spark, sf, "documents"), "lang", "doc_id")
    return W.label_pairs(langs, "lang", "class_id")


def jn4(spark, sf):
    pairs = jn3(spark, sf).select("scenarios")
    return W.sweep_grid(pairs, CKPTS, exps=["base", "txt", "noexemb", "noexembtxt", "noexembnotxt"])


def _grid(spark, sf):
    labels = table(spark, sf, "embeddings").select("label").distinct()
    named = labels.select(F.col("label").alias("pos"), F.col("label").cast("string").alias("label"))
    pairs = W.label_pairs(named)
    return W.sweep_grid(pairs, CKPTS[:2], n_shots=[0, 1, 2], exps=["base", "txt"], seeds=[0, 1])


def _stored(spark, sf):
    """Stored runs made from the score table: each row belongs to one cell of the grid."""
    e = table(spark, sf, "embeddings")
    other = (F.col("vec_id") % 10).cast("int")
    first = F.col("embedding")[0].cast("double")
    cells = e.select(
        F.concat_ws("_", F.least("label", other), F.greatest("label", other)).alias("scenarios"),
        F.when(F.col("vec_id") % 3 == 0, CKPTS[0]).otherwise(CKPTS[1]).alias("model_tag"),
        (F.col("vec_id") % 7 % 3).cast("int").alias("n_shot"),
        F.when(F.col("vec_id") % 5 < 3, "base").otherwise("txt").alias("exp"),
        (F.col("vec_id") % 2).cast("int").alias("seed"),
        (first > 0).cast("double").alias("ok"),
        (first > 0.1).cast("double").alias("ok_cf"),
    )
    return cells.groupBy(*W.CELL).agg(
        F.avg("ok").alias("acc"), F.avg("ok_cf").alias("acc_cf"), F.count(F.lit(1)).alias("n_chop")
    )


def jn5(spark, sf):
    return W.pending_cells(_grid(spark, sf), _stored(spark, sf)).select(*W.CELL)


def jn5_checkpoints(spark, sf):
    return W.pending_checkpoints(_grid(spark, sf), _stored(spark, sf))


def fl7(spark, sf):
    """Users as runs: their rarest event type decides whether they count."""
    return W.min_support(chop_size(table(spark, sf, "events"), "event_type", ["user_id"]))


def _sweep_runs(spark, sf):
    """UD-3 runs as a sweep: first label of the pair = shots, second = checkpoint."""
    r = runs(spark, sf)
    ends = F.split("scenarios", "_")
    return r.select(
        F.lit("base").alias("exp"), F.get(ends, F.lit(1)).alias("model_tag"),
        F.get(ends, F.lit(0)).cast("int").alias("n_shot"), "seed", "acc", "acc_cf", "n_chop",
    )


def _sweep_cells(spark, sf):
    labels = table(spark, sf, "embeddings").select("label").distinct()
    tags = F.explode(F.array(*[F.lit(str(i)) for i in range(1, 10)]))
    return labels.filter("label < 9").select(
        F.lit("base").alias("exp"), tags.alias("model_tag"), F.col("label").alias("n_shot")
    )


def ag8(spark, sf):
    m = W.seed_average(_sweep_runs(spark, sf), _sweep_cells(spark, sf))
    return m.withColumns({"acc": F.round("acc", 6), "acc_cf": F.round("acc_cf", 6)})


def ag9(spark, sf):
    m = W.seed_average(_sweep_runs(spark, sf), _sweep_cells(spark, sf))
    return W.report_pivot(m, [str(i) for i in range(1, 10)])


def _written_pair(spark, sf):
    """Documents written as a manifest pair, many files per side, and its folder."""
    d = table(spark, sf, "documents").select(
        F.lit("docs").alias("split"), F.col("doc_id").alias("line_no"),
        F.col("lang").alias("target"), F.lit("What is the scenario?").alias("prompt"),
        F.translate("text", "\t\n\r", "#*").alias("hyp"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"),
        F.col("n_chars").alias("n_frames"),
    )
    out = shared_dir(spark, "pair")
    write_manifest_pair(d, out, root="/corpus", lines_per_file=97)
    return out


def src1(spark, sf):
    """Written (SNK-1) and read back (SRC-1)."""
    return read_manifest(spark, _written_pair(spark, sf) + "/tsv")


def src2(spark, sf):
    """Written (SNK-1) and read back (SRC-2); three columns, so no hypothesis."""
    lines = read_labels(spark, _written_pair(spark, sf) + "/ltr")
    return lines.select(
        "split", "line_no", "answer", "question", F.md5("text").alias("text_md5"),
        F.md5(unescape_hyp("text")).alias("plain_md5"), "hyp",
    )


def src3(spark, sf):
    """The header of a WAV file as long as each document, built from its size."""

    def little(n, size):
        return [
            F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(size)
        ]

    def tag(s):
        return F.encode(F.lit(s), "UTF-8")

    n = F.col("n_chars").cast("bigint")
    lit = lambda v: F.lit(v).cast("bigint")
    content = F.concat(
        tag("RIFF"), *little(n * 2 + 36, 4), tag("WAVE"), tag("fmt "), *little(lit(16), 4),
        *little(lit(1), 2), *little(lit(1), 2), *little(lit(SAMPLE_RATE), 4),
        *little(lit(SAMPLE_RATE * 2), 4), *little(lit(2), 2), *little(lit(16), 2),
        tag("data"), *little(n * 2, 4),
    )
    d = table(spark, sf, "documents").select("doc_id", content.alias("content"))
    w = d.withColumn("w", parse_wav("content"))
    return w.select("doc_id", "w.sample_rate", "w.n_frames", "w.error")


def snk2(spark, sf):
    """Runs written by cell and read back."""
    out = shared_dir(spark, "runs")
    write_runs(_stored(spark, sf), out)
    r = read_runs(spark, out)
    return r.select(
        *W.CELL, F.round("acc", 6).alias("acc"), F.round("acc_cf", 6).alias("acc_cf"), "n_chop"
    )


def _report(spark, sf):
    means = (
        _stored(spark, sf).groupBy("model_tag", "n_shot")
        .agg(F.avg("acc").alias("acc"), F.avg("acc_cf").alias("acc_cf"), F.sum("n_chop").alias("n_chop"))
    )
    return W.report_pivot(means, CKPTS[:2])


def snk3(spark, sf):
    """A report written as CSV and read back as text."""
    out = shared_dir(spark, "report")
    report_csv(_report(spark, sf), out)
    return spark.read.option("header", True).csv(out)


QUERIES = {
    "jn3_label_pairs": jn3,
    "jn4_sweep_grid": jn4,
    "jn5_pending_cells": jn5,
    "jn5_pending_checkpoints": jn5_checkpoints,
    "fl7_min_support": fl7,
    "ag8_seed_average": ag8,
    "ag9_report_pivot": ag9,
    "src1_snk1_read_manifest": src1,
    "src2_snk1_read_labels": src2,
    "src3_wav_headers": src3,
    "snk2_runs_round_trip": snk2,
    "snk3_report_csv": snk3,
}

SQL_PAIRS = """
  langs AS (SELECT lang, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS pos FROM documents GROUP BY lang),
  pairs AS (SELECT a.lang || '_' || b.lang AS scenarios, a.pos AS pos_a, b.pos AS pos_b, a.lang AS label_a, b.lang AS label_b
            FROM langs a JOIN langs b ON a.pos < b.pos)"""

SQL_STORED = """
  done AS (
    SELECT least(label, vec_id % 10) || '_' || greatest(label, vec_id % 10) AS scenarios,
           CASE WHEN vec_id % 3 = 0 THEN 'wav-rf2' ELSE 'wav-rf4' END AS model_tag,
           CAST(vec_id % 7 % 3 AS INTEGER) AS n_shot, CASE WHEN vec_id % 5 < 3 THEN 'base' ELSE 'txt' END AS exp,
           CAST(vec_id % 2 AS INTEGER) AS seed,
           avg(CAST(embedding[1] > 0 AS INTEGER)::DOUBLE) AS acc,
           avg(CAST(embedding[1]::DOUBLE > 0.1 AS INTEGER)::DOUBLE) AS acc_cf, count(*) AS n_chop
    FROM embeddings GROUP BY 1, 2, 3, 4, 5)"""

SQL_PENDING = f"""
  WITH {SQL_STORED},
  l AS (SELECT DISTINCT label FROM embeddings),
  grid AS (SELECT a.label || '_' || b.label AS scenarios, m AS model_tag, CAST(n AS INTEGER) AS n_shot, x AS exp, CAST(s AS INTEGER) AS seed
           FROM l a JOIN l b ON a.label < b.label, (VALUES ('wav-rf2'), ('wav-rf4')) c(m), range(3) d(n), (VALUES ('base'), ('txt')) e(x), range(2) f(s)
           WHERE NOT (x = 'txt' AND m = 'wav-rf4')),
  pending AS (SELECT * FROM grid ANTI JOIN done USING (scenarios, model_tag, n_shot, exp, seed))"""

SQL_MEANS = f"""
  WITH {SQL_RUNS},
  means AS (SELECT CAST(split_part(scenarios, '_', 1) AS INTEGER) AS n_shot, split_part(scenarios, '_', 2) AS model_tag,
                   avg(acc) AS acc, avg(acc_cf) AS acc_cf, avg(n_chop) AS n_chop, count(*) AS n_runs
            FROM runs WHERE n_chop >= 10 GROUP BY 1, 2),
  cells AS (SELECT CAST(l AS INTEGER) AS n_shot, CAST(t AS VARCHAR) AS model_tag FROM labels, range(1, 10) r(t) WHERE l < 9)"""

SQL_CELL = "printf('%.2f%% (%.2f) (Nr:%.1f)', acc_cf * 100, acc * 100, n_chop)"

ORACLES = {
    "jn3_label_pairs": f"WITH {SQL_PAIRS} SELECT * FROM pairs",
    "jn4_sweep_grid": f"""
      WITH {SQL_PAIRS}
      SELECT scenarios, ckpt_pos, model_tag, n_shot, exp, CAST(s AS INTEGER) AS seed,
             NOT (exp IN ('txt', 'noexembtxt', 'noexembnotxt') AND ckpt_pos > 0) AS planned
      FROM pairs, (VALUES (0, 'wav-rf2'), (1, 'wav-rf4'), (2, 'wav-rf8'), (3, 'wav-rf16')) c(ckpt_pos, model_tag),
           (VALUES (0), (1), (2), (3), (4), (6), (8), (10)) d(n_shot),
           (VALUES ('base'), ('txt'), ('noexemb'), ('noexembtxt'), ('noexembnotxt')) e(exp), range(5) f(s)""",
    "jn5_pending_cells": f"{SQL_PENDING} SELECT * FROM pending",
    "jn5_pending_checkpoints": f"{SQL_PENDING} SELECT DISTINCT scenarios, model_tag FROM pending",
    "fl7_min_support": """
      SELECT user_id, min(n) AS n_chop, count(*) AS n_classes
      FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id HAVING min(n) >= 10""",
    "ag8_seed_average": f"""
      {SQL_MEANS} SELECT 'base' AS exp, model_tag, n_shot, round(acc, 6) AS acc, round(acc_cf, 6) AS acc_cf, n_chop, n_runs
      FROM cells LEFT JOIN means USING (n_shot, model_tag)""",
    "ag9_report_pivot": f"""
      {SQL_MEANS}
      SELECT n_shot, {', '.join(f"max(CASE WHEN model_tag = '{i}' AND acc IS NOT NULL THEN {SQL_CELL} END) AS \"{i}\"" for i in range(1, 10))}
      FROM cells LEFT JOIN means USING (n_shot, model_tag) GROUP BY n_shot""",
    "src1_snk1_read_manifest": """
      SELECT 'docs' AS split, doc_id AS line_no, '/corpus' AS root, source || '/' || doc_id || '.wav' AS path, n_chars AS n_frames, lang AS label
      FROM documents""",
    "src2_snk1_read_labels": """
      WITH d AS (SELECT doc_id, lang, replace(replace(replace(text, chr(9), '#'), chr(10), '*'), chr(13), '') AS t FROM documents)
      SELECT 'docs' AS split, doc_id AS line_no, lang AS answer, 'What is the scenario?' AS question, md5(t) AS text_md5,
             md5(replace(replace(trim(t, '.'), '#', chr(9)), '*', chr(10))) AS plain_md5, CAST(NULL AS VARCHAR) AS hyp FROM d""",
    "src3_wav_headers": """
      SELECT doc_id, CAST(16000 AS BIGINT) AS sample_rate, n_chars AS n_frames, CAST(NULL AS VARCHAR) AS error FROM documents""",
    "snk2_runs_round_trip": f"""
      WITH {SQL_STORED}
      SELECT scenarios, model_tag, n_shot, exp, seed, round(acc, 6) AS acc, round(acc_cf, 6) AS acc_cf, n_chop FROM done""",
    "snk3_report_csv": f"""
      WITH {SQL_STORED},
      m AS (SELECT model_tag, n_shot, avg(acc) AS acc, avg(acc_cf) AS acc_cf, sum(n_chop)::DOUBLE AS n_chop FROM done GROUP BY ALL)
      SELECT CAST(n_shot AS VARCHAR) AS n_shot, max(CASE WHEN model_tag = 'wav-rf2' THEN {SQL_CELL} END) AS "wav-rf2",
             max(CASE WHEN model_tag = 'wav-rf4' THEN {SQL_CELL} END) AS "wav-rf4"
      FROM m GROUP BY n_shot""",
}

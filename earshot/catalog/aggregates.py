"""Aggregates over labels, batches and the training log (AG)."""

from pyspark.sql import functions as F

from earshot.catalog.roles import SQL_LOG, doc_words, scores, sql_words, table, training_log, turns
from earshot.functions.vectors import label_probs, vocab_probs
from earshot.operators import metrics as X
from earshot.operators.calibration import accuracy, content_free_prior
from earshot.operators.sampling import chop_size, class_index

TEN = list(range(10))


def ag1(spark, sf):
    return class_index(table(spark, sf, "documents"), "lang", "doc_id")


def ag2(spark, sf):
    """Rarest event type per user: a cell per user."""
    e = table(spark, sf, "events").select("user_id", "event_type")
    return chop_size(e, "event_type", ["user_id"])


def ag3(spark, sf):
    p = scores(spark, sf).withColumn("probs", label_probs("scores", TEN))
    r = accuracy(p.withColumn("label", F.col("truth")), ["label"])
    return r.withColumn("acc", F.round("acc", 6))


def ag4(spark, sf):
    """Prior over ten labels, the score rows of each label as its content-free inputs."""
    p = scores(spark, sf).select("truth", vocab_probs("scores", TEN).alias("probs"))
    prior = content_free_prior(p, cell=["truth"])
    long = prior.select("truth", F.posexplode("p_cf").alias("class_id", "p"))
    return long.withColumn("p", F.round("p", 6))


def ag6(spark, sf):
    return X.reduce_metrics(training_log(spark, sf), ["event_type"])


def ag6_total(spark, sf):
    """Without accuracy counts and with equal sizes: perplexity from the loss."""
    log = training_log(spark, sf).drop("n_correct", "total").withColumn("sample_size", F.col("ntokens"))
    return X.reduce_metrics(log)


def ag7(spark, sf):
    return X.rollup_log(training_log(spark, sf))


def ag10(spark, sf):
    return X.batch_token_stats(turns(spark, sf), "conv_id", "words")


def ag10_sentences(spark, sf):
    d = doc_words(spark, sf, "source")
    return X.batch_token_stats(d, "source", "words", count_eos_twice=False, sentence_avg=True)


def ag11(spark, sf):
    log = training_log(spark, sf).select("worker", "update", "loss", "ntokens")
    return X.best_run(log, ["worker"])


QUERIES = {
    "ag1_class_index": ag1,
    "ag2_chop_size": ag2,
    "ag3_accuracy": ag3,
    "ag4_content_free_prior": ag4,
    "ag6_reduce_metrics": ag6,
    "ag6_reduce_metrics_total": ag6_total,
    "ag7_rollup_log": ag7,
    "ag10_batch_token_stats": ag10,
    "ag10_batch_token_stats_sentences": ag10_sentences,
    "ag11_best_run": ag11,
}


def _metrics_sql(by, log, size="sample_size", counted=True):
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    if counted:
        acc = """CAST(CASE WHEN t > 0 THEN c END AS BIGINT) AS n_correct, CAST(CASE WHEN t > 0 THEN t END AS BIGINT) AS total,
             round(CASE WHEN t > 0 THEN c * 100.0::DOUBLE / t END, 3) AS accuracy"""
    else:
        acc = "CAST(NULL AS BIGINT) AS n_correct, CAST(NULL AS BIGINT) AS total, CAST(NULL AS DOUBLE) AS accuracy"
    return f"""
      WITH s AS (SELECT {keys} sum(loss) AS l, sum({size})::DOUBLE AS n, sum(ntokens)::DOUBLE AS k,
                        sum(n_correct) AS c, sum(total) AS t FROM ({log}) {group})
      SELECT {keys} round(l / n / ln(2), 3) AS loss, 0.0::DOUBLE AS diff_loss, round(l / n / ln(2), 3) AS total_loss,
             round(CASE WHEN n <> k THEN l / k / ln(2) END, 3) AS nll_loss,
             round(pow(2, CASE WHEN n <> k THEN l / k / ln(2) ELSE l / n / ln(2) END), 2) AS ppl, {acc}
      FROM s"""


SQL_SOFTMAX = """
  s AS (SELECT vec_id AS id, label AS truth, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  x AS (SELECT id, truth, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM s),
  p AS (SELECT id, truth, list_transform(e, lambda x: x / list_sum(e)) AS p FROM x)
"""

ORACLES = {
    "ag1_class_index": """
      SELECT lang, first_line, n, CAST(row_number() OVER (ORDER BY first_line) - 1 AS INTEGER) AS class_id
      FROM (SELECT lang, min(doc_id) AS first_line, count(*) AS n FROM documents GROUP BY lang)""",
    "ag2_chop_size": """
      SELECT user_id, min(n) AS n_chop, count(*) AS n_classes
      FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""",
    "ag3_accuracy": f"""
      WITH {SQL_SOFTMAX}
      SELECT truth AS label, round(avg(CASE WHEN list_position(p[1:10], list_max(p[1:10])) - 1 = truth THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc,
             count(*) AS n FROM p GROUP BY truth""",
    "ag4_content_free_prior": f"""
      WITH {SQL_SOFTMAX},
      l AS (SELECT truth, unnest(p[1:10]) AS q, generate_subscripts(p[1:10], 1) - 1 AS class_id FROM p),
      m AS (SELECT truth, class_id, avg(q) AS a FROM l GROUP BY ALL)
      SELECT truth, CAST(class_id AS INTEGER) AS class_id, round(a / sum(a) OVER (PARTITION BY truth), 6) AS p FROM m""",
    "ag6_reduce_metrics": _metrics_sql("event_type", SQL_LOG),
    "ag6_reduce_metrics_total": _metrics_sql("", SQL_LOG, size="ntokens", counted=False),
    "ag7_rollup_log": _metrics_sql(
        "interval", f"SELECT *, CAST(update // 200 AS BIGINT) AS interval FROM ({SQL_LOG})"
    ),
    "ag10_batch_token_stats": f"""
      SELECT conv_id, count(*) AS nsentences, max(n) AS max_target_length,
             CAST(sum(n) + count(*) AS BIGINT) AS ntokens, CAST(sum(n) + count(*) AS BIGINT) AS sample_size
      FROM (SELECT conv_id, CAST(len({sql_words('text')}) AS BIGINT) AS n FROM conversations) GROUP BY conv_id""",
    "ag10_batch_token_stats_sentences": f"""
      SELECT source, count(*) AS nsentences, max(n) AS max_target_length,
             CAST(sum(n) AS BIGINT) AS ntokens, count(*) AS sample_size
      FROM (SELECT source, CAST(len({sql_words('text')}) AS BIGINT) AS n FROM documents) GROUP BY source""",
    "ag11_best_run": """
      SELECT user_id AS worker, event_id AS update, value AS loss,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS ntokens
      FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1""",
}

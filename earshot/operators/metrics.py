"""Training-log reduction (AG-6, AG-7, AG-10, AG-11)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMED = ["loss", "diff_loss", "total_loss", "ntokens", "sample_size", "n_correct", "total"]


def _sum(log: DataFrame, name: str) -> Column:
    if name not in log.columns:
        return F.lit(0.0)
    return F.coalesce(F.sum(name), F.lit(0).cast(dict(log.dtypes)[name]))


def reduce_metrics(log: DataFrame, by: list[str] = []) -> DataFrame:
    """AG-6: one metrics row per group of log records.

    Losses are sums over the sample size in bits, rounded to 3. When tokens and samples
    differ, ``nll_loss`` is the loss per token and the perplexity comes from it, else
    from the loss; it is computed from the unrounded value and rounded to 2. Accuracy
    is NULL unless something was counted. Missing log columns count as 0.
    """
    ln2 = F.lit(math.log(2))
    sums = log.groupBy(*by).agg(*[_sum(log, c).alias(f"_{c}") for c in SUMMED])
    size = F.col("_sample_size").cast("double")
    tokens = F.col("_ntokens").cast("double")
    per_sample = {c: F.col(f"_{c}") / size / ln2 for c in ("loss", "diff_loss", "total_loss")}
    nll = F.when(size != tokens, F.col("_loss") / tokens / ln2)
    counted = F.col("_total") > 0
    return sums.select(
        *by,
        *[F.round(v, 3).alias(k) for k, v in per_sample.items()],
        F.round(nll, 3).alias("nll_loss"),
        F.round(F.pow(F.lit(2.0), F.coalesce(nll, per_sample["loss"])), 2).alias("ppl"),
        F.when(counted, F.col("_n_correct")).cast("bigint").alias("n_correct"),
        F.when(counted, F.col("_total")).cast("bigint").alias("total"),
        F.round(
            F.when(counted, F.try_divide(F.col("_n_correct") * F.lit(100.0), F.col("_total"))), 3
        ).alias("accuracy"),
    )


def rollup_log(
    log: DataFrame, update: str = "update", interval: int = 200, by: list[str] = []
) -> DataFrame:
    """AG-7: the same reduction per logging interval, workers merged by their sums.

    Works on a streaming log as it stands (see ``streaming.metrics``).
    """
    step = F.floor(F.col(update) / F.lit(interval)).cast("bigint")
    return reduce_metrics(log.withColumn("interval", step), [*by, "interval"])


def batch_token_stats(
    df: DataFrame,
    batch: str,
    tokens: str,
    count_eos_twice: bool = True,
    sentence_avg: bool = False,
) -> DataFrame:
    """AG-10: sentences, tokens and sample size per batch.

    ``count_eos_twice`` adds one token per row although targets already end with an
    eos, as the original does. ``sentence_avg`` takes the rows as the sample size.
    """
    n = F.size(tokens).cast("bigint")
    per = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("nsentences"),
        F.sum(n).alias("target_tokens"),
        F.max(n).alias("max_target_length"),
    )
    extra = F.col("nsentences") if count_eos_twice else F.lit(0)
    per = per.withColumn("ntokens", (F.col("target_tokens") + extra).cast("bigint"))
    return per.withColumn(
        "sample_size", F.col("nsentences") if sentence_avg else F.col("ntokens")
    ).drop("target_tokens")


def best_run(
    runs: DataFrame, by: list[str], metric: str = "loss", tie: str = "update"
) -> DataFrame:
    """AG-11: the row with the lowest metric per model, the earlier update on ties.

    A run without a metric, NULL or NaN, is never the best; a model with none else has no row.
    """
    rest = [c for c in runs.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(F.col(metric), F.col(tie)))
    known = runs.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    return known.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")

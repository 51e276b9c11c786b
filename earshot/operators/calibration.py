"""Priors and accuracy (AG-3, AG-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.vectors import argmax, calibrate, normalize


def mean_vector(df: DataFrame, vec: str, cell: list[str] = []) -> DataFrame:
    """Element-wise mean of an array column in long form: (cell, class_id, p).

    Partial sums per element are made map-side; the shuffle carries one row per cell
    and element from each task.
    """
    return (
        df.select(*cell, F.posexplode(vec).alias("class_id", "_p"))
        .groupBy(*cell, "class_id")
        .agg(F.avg("_p").alias("p"))
    )


def content_free_prior(df: DataFrame, probs: str = "probs", cell: list[str] = []) -> DataFrame:
    """AG-4: mean label probabilities over the content-free inputs, divided by their sum."""
    long = mean_vector(df, probs, cell)
    ordered = F.array_sort(F.collect_list(F.struct("class_id", "p")))
    return long.groupBy(*cell).agg(
        normalize(F.transform(ordered, lambda x: x["p"])).alias("p_cf")
    )


def correctness(probs: str, truth: str, prior: str | None = None, mode: str | None = None):
    """1.0 when the (calibrated) best label is the true one, else 0.0."""
    p = normalize(probs)
    scores = calibrate(p, F.col(prior) if prior else None, mode)
    return (argmax(scores) == F.col(truth)).cast("double")


def accuracy(
    df: DataFrame,
    by: list[str],
    probs: str = "probs",
    truth: str = "truth",
    prior: str | None = None,
    mode: str | None = None,
    out: str = "acc",
) -> DataFrame:
    """AG-3: share of rows whose best label is the true one."""
    return df.groupBy(*by).agg(
        F.avg(correctness(probs, truth, prior, mode)).alias(out), F.count(F.lit(1)).alias("n")
    )

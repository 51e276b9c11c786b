"""Few-shot evaluation of all runs in one job (UD-3), the flagship.

The reference procedure loops over runs; here the run's key is a grouping column and
every step handles all runs at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.keys import order_key
from earshot.functions.vectors import label_probs
from earshot.operators.calibration import correctness
from earshot.operators.ranking import attach, balanced_cut, keep_head
from earshot.session import settle


def predictions(
    scores: DataFrame, label_tokens, cell: list[str], truth: str = "truth", vec: str = "scores"
) -> DataFrame:
    """Label probabilities per row (SC-3, SC-4), narrow from here on."""
    return scores.select(*cell, "id", truth, label_probs(vec, label_tokens).alias("probs"))


def _per_seed(rows: DataFrame, seeds: list[int] | None) -> DataFrame:
    """Every row with its place in its seed's shuffled order: once per seed, or once where
    the rows have a seed of their own."""
    runs = rows
    if seeds is not None:
        runs = rows.select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    return runs.withColumn("order_key", order_key(F.col("seed"), "id"))


def evaluate(
    preds: DataFrame,
    prior: DataFrame,
    cell: list[str],
    seeds: list[int] | None = None,
) -> DataFrame:
    """UD-3 from predictions on: balance, calibrate, argmax, accuracy per cell and seed.

    ``preds``: cell, id, truth, probs. ``prior``: cell, p_cf. With ``seeds`` the same scores
    serve every seed. Without, ``seed`` is a column of the predictions: scores differ by
    seed, and so may the prior, if it has that column too.

    Which rows a run keeps depends on their keys alone, so the cut is found on key columns,
    without touching probabilities. Whether a row is right does not depend on the seed's
    order, so both verdicts are made once per row, and only narrow columns fan out.
    """
    own = "seed" in preds.columns
    if own != (seeds is None):
        raise ValueError("give seeds, or predictions with a column seed, not both")
    if seeds is not None and "seed" in prior.columns:
        raise ValueError("a prior per seed needs predictions per seed")
    base = [c for c in cell if c != "seed"]
    run, kept = [*base, "seed"], [*base, "seed"] if own else base
    order, group = ["order_key", "id"], [*run, "truth"]
    keys = _per_seed(preds.select(*kept, "id", "truth"), seeds)
    cut = balanced_cut(keys, "truth", order, None, run)
    by = [c for c in kept if c in prior.columns]
    judged = attach(preds, settle(prior, "prior"), by).select(
        *kept,
        "id",
        "truth",
        correctness("probs", "truth").alias("right"),
        correctness("probs", "truth", "p_cf", "diagonal_W").alias("right_cf"),
    )
    head = keep_head(_per_seed(judged, seeds), cut, group, order)
    return head.groupBy(*run).agg(
        F.avg("right").alias("acc"),
        F.avg("right_cf").alias("acc_cf"),
        F.count(F.lit(1)).alias("n"),
        F.max("n_chop").alias("n_chop"),
        F.max("n_classes").alias("n_classes"),
    )


def few_shot_eval(
    scores: DataFrame,
    prior: DataFrame,
    label_tokens,
    cell: list[str],
    seeds: list[int] | None = None,
) -> DataFrame:
    """UD-3: stored or freshly computed score vectors to acc, acc_cf, n_chop per run.

    ``seeds`` lists seeds that share the scores; leave it out when ``seed`` is a column.
    """
    kept = [*cell, *(["seed"] if "seed" in scores.columns and "seed" not in cell else [])]
    return evaluate(predictions(scores, label_tokens, kept), prior, cell, seeds)

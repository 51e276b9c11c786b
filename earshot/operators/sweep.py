"""Sweep planning and reporting (JN-3 .. JN-5, AG-8, AG-9, FL-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sweep axes and the experiments that do not depend on the checkpoint.
N_SHOTS = [0, 1, 2, 3, 4, 6, 8, 10]
SEEDS = [0, 1, 2, 3, 4]
TEXT_ONLY = ["txt", "noexembtxt", "noexembnotxt"]
CELL = ["scenarios", "model_tag", "n_shot", "exp", "seed"]
MIN_SUPPORT = 10


# Labels in a block of the pair join, on average.
LABELS_PER_BLOCK = 512


def label_pairs(labels: DataFrame, label: str = "label", pos: str = "pos") -> DataFrame:
    """JN-3: every unordered pair of labels in list order, named ``a_b``.

    Labels are dealt over blocks of about 512. A block meets itself and the blocks of higher number, as
    one row per pair of blocks that holds their two short lists, so a task's memory does not grow with
    the labels and their pairs are made side by side. A label listed twice counts at its first place.
    """
    once = labels.groupBy(F.col(label).alias("label")).agg(F.min(pos).alias("pos"))
    n = once.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(LABELS_PER_BLOCK)), F.lit(1)).cast("int").alias("n")).scalar()
    dealt = once.select(F.pmod(F.xxhash64("label"), n).cast("int").alias("_x"), F.struct("pos", "label").alias("l"))
    blocks = dealt.groupBy("_x").agg(F.array_sort(F.collect_list("l")).alias("la"))
    left = blocks.select("*", F.explode(F.sequence("_x", n - 1)).alias("_y"))
    right = blocks.select(F.col("_x").alias("_y"), F.col("la").alias("lb"))
    one = left.join(right, "_y").select("_x", "_y", "lb", F.explode("la").alias("p"))
    mates = F.filter("lb", lambda q: (F.col("_x") < F.col("_y")) | (F.col("p") < q))
    both = one.select("p", F.explode(mates).alias("q"))
    pairs = both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return pairs.select(
        F.concat_ws("_", "a.label", "b.label").alias("scenarios"),
        F.col("a.pos").alias("pos_a"),
        F.col("b.pos").alias("pos_b"),
        F.col("a.label").alias("label_a"),
        F.col("b.label").alias("label_b"),
    )


def _axis(values: list):
    return F.explode(F.array(*[F.lit(v) for v in values]))


def sweep_grid(
    pairs: DataFrame,
    checkpoints: list[str],
    n_shots: list[int] = N_SHOTS,
    exps: list[str] = ["base", "txt"],
    seeds: list[int] = SEEDS,
) -> DataFrame:
    """JN-4: every run of the sweep, with ``planned``.

    The axes are parameters, so each pair row fans out in place; there is no join.
    Text-only experiments do not depend on the checkpoint: they are planned for the
    first one and recorded as empty for the rest.
    """
    ck = F.posexplode(F.array(*[F.lit(c) for c in checkpoints]))
    grid = (
        pairs.select("scenarios", ck.alias("ckpt_pos", "model_tag"))
        .select("*", _axis(n_shots).alias("n_shot"))
        .select("*", _axis(exps).alias("exp"))
        .select("*", _axis(seeds).alias("seed"))
    )
    return grid.withColumn("planned", ~(F.col("exp").isin(TEXT_ONLY) & (F.col("ckpt_pos") > 0)))


def pending_cells(grid: DataFrame, done: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """JN-5: planned runs without a stored result."""
    return grid.filter("planned").join(done.select(*cell), cell, "left_anti")


def pending_checkpoints(
    grid: DataFrame, done: DataFrame, cell: list[str] = CELL
) -> DataFrame:
    """JN-5: (scenarios, checkpoint) pairs with at least one pending run; the others are skipped."""
    return pending_cells(grid, done, cell).select("scenarios", "model_tag").distinct()


def min_support(runs: DataFrame, least: int = MIN_SUPPORT) -> DataFrame:
    """FL-7: runs whose balanced class size is at least ``least``."""
    return runs.filter(F.col("n_chop") >= least)


def seed_average(
    runs: DataFrame, grid: DataFrame, by: list[str] = ["exp", "model_tag", "n_shot"]
) -> DataFrame:
    """AG-8: means over seeds of the supported runs; a cell of the grid without any is NULL."""
    means = min_support(runs).groupBy(*by).agg(
        F.avg("acc").alias("acc"),
        F.avg("acc_cf").alias("acc_cf"),
        F.avg("n_chop").alias("n_chop"),
        F.count(F.lit(1)).alias("n_runs"),
    )
    return grid.select(*by).distinct().join(means, by, "left")


def report_cell(acc: str = "acc", acc_cf: str = "acc_cf", n: str = "n_chop"):
    """AG-9: one report cell, ``"53.67% (53.42) (Nr:196.0)"``, NULL when there is no run.

    ``format_number`` rounds the exact value half to even, as Python's ``.2f`` does;
    ``format_string`` would round half up.
    """
    return F.concat(
        F.format_number(F.col(acc_cf) * 100, 2),
        F.lit("% ("),
        F.format_number(F.col(acc) * 100, 2),
        F.lit(") (Nr:"),
        F.col(n).cast("double").cast("string"),
        F.lit(")"),
    )


def report_pivot(
    means: DataFrame, columns: list, rows: str | list[str] = "n_shot", column: str = "model_tag"
) -> DataFrame:
    """AG-9: a row per shot count (or per key of ``rows``), a column per checkpoint.

    The column values are given, so the pivot needs no pass to find them.
    """
    cells = means.withColumn("_cell", report_cell())
    return cells.groupBy(rows).pivot(column, columns).agg(F.first("_cell"))

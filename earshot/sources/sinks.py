"""Writers for manifest pairs, runs and reports (SNK-1 .. SNK-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.sweep import CELL
from earshot.session import settle

LINES_PER_FILE = 1_000_000


def write_manifest_pair(
    df: DataFrame,
    out: str,
    root: str = "",
    lines_per_file: int = LINES_PER_FILE,
    mode: str = "overwrite",
    other_splits: str = "drop",
) -> None:
    """SNK-1: ``out/ltr`` (target, prompt, hyp) and ``out/tsv`` (root line; path, frames, target).

    ``df`` holds ``split, line_no, target, prompt, hyp, path, n_frames`` with dense line
    numbers. Each file takes one block of line numbers, in order, the same blocks on
    both sides, so the files stay row-aligned and a split of any size is written by
    many tasks. ``df`` is computed once: both lines of a row are made together and written to the
    shared folder, and the two sides are written from there, so they agree even where ``df`` would
    give other rows when asked again, or a task fails on the way. Tabs and newlines inside a field
    would break the format: they fail the job before anything is written (write a hypothesis escaped,
    ``#`` for tab and ``*`` for newline). ``other_splits="keep"`` replaces only files of the splits in ``df``.
    """
    if other_splits not in ("drop", "keep"):
        raise ValueError("other_splits: 'drop' or 'keep'")
    part = F.floor(F.col("line_no") / F.lit(lines_per_file)).cast("bigint")

    def field(c):
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        bad = F.raise_error(F.concat(F.lit("tab or newline in "), F.lit(c)))
        return F.when(s.rlike(r"[\t\r\n]"), bad).otherwise(s)

    def line(*names):
        return F.concat_ws("\t", *[field(c) for c in names])

    both = df.select(
        "split", part.alias("part"), "line_no",
        line("target", "prompt", "hyp").alias("ltr"), line("path", "n_frames", "target").alias("tsv"),
    )
    rows = settle(both, "pair")

    def save(lines: DataFrame, where: str) -> None:
        (
            lines.repartition("split", "part")
            .sortWithinPartitions("split", "part", "line_no")
            .select("split", "part", "value")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic" if other_splits == "keep" else "static")
            .partitionBy("split", "part")
            .text(where)
        )

    save(rows.select("split", "part", "line_no", F.col("ltr").alias("value")), f"{out}/ltr")
    tsv = rows.select("split", "part", "line_no", F.col("tsv").alias("value"))
    heads = rows.select("split", "part").distinct().select(
        "split", "part", F.lit(-1).cast("bigint").alias("line_no"), F.lit(root).alias("value")
    )
    save(tsv.unionByName(heads), f"{out}/tsv")


def write_runs(
    runs: DataFrame, path: str, cell: list[str] = CELL, files_per_cell: int = 1
) -> None:
    """SNK-2: runs as Parquet, one directory per grid cell; only the cells written are replaced.

    A cell recorded as empty (NULL accuracies) counts as done. The same layout takes the
    predictions of a run; give those several files per cell, so that a cell with very
    many rows is written by several tasks.
    """
    rest = [c for c in runs.columns if c not in cell]
    salt = F.pmod(F.xxhash64(*rest), F.lit(files_per_cell))
    (
        runs.repartition(*cell, *([salt] if files_per_cell > 1 else []))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*cell)
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """SNK-2: stored runs; filters on the cell prune directories."""
    types = {"n_shot": "integer", "seed": "integer"}
    cell = {c: types.get(c, "string") for c in CELL}
    # the cell's types are told, not read off the directory names: model tag 08 stays 08
    found = spark.read.parquet(path).drop(*CELL).schema
    for c, t in cell.items():
        found = found.add(c, t)
    return spark.read.schema(found).parquet(path)


def report_csv(df: DataFrame, path: str, order: str = "n_shot") -> None:
    """SNK-3: a report table as one CSV file; it has a row per shot count."""
    df.orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)

"""Readers for manifests and label files (SRC-1, SRC-2).

A row's identity is its line number, and text files have none once they are split.
It is rebuilt exactly: within one input split Spark reads lines in order, so a line's
place in its split is known; counting lines per split and adding up the splits of a
file in order of their start gives the line number. Files are read in splits like any
other, so one huge file is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions.text import strip
from earshot.operators.ranking import join_on
from earshot.session import settle


def _split_name(path):
    """``split=NAME`` directory if the writer made one, else the file name without suffix."""
    made = F.regexp_extract(path, r"/split=([^/]+)/", 1)
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(made != "", F.url_decode(made)).otherwise(F.url_decode(name))


def numbered_lines(spark: SparkSession, path, header: bool) -> DataFrame:
    """Lines of text files as (split, line_no, line), and ``root`` = a file's first line.

    With ``header`` the first line of every file is its root and is not numbered. Part
    files of one written split (``part=N`` directories) continue each other's numbers.

    How Spark cuts files into splits may change between two jobs (it depends on the
    cores at hand), so the lines are written once with their places and both counting
    and numbering read that table. Manifests name audio; they are small beside it.
    """
    place = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(
        place.alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    lines = settle(lines, "lines")
    part = F.regexp_extract("_file", r"/part=(\d+)/", 1)
    head = 1 if header else 0
    blocks = (
        lines.groupBy("_file", "_start")
        .agg(
            F.min("_id").alias("_first"),
            F.count(F.lit(1)).alias("_n"),
            F.min_by("line", "_id").alias("_line0"),
        )
        .withColumns(
            {
                "split": _split_name(F.col("_file")),
                "_part": F.when(part != "", part.cast("bigint")).otherwise(F.lit(0)),
                "_head": F.when(F.col("_start") == 0, F.lit(head)).otherwise(F.lit(0)),
            }
        )
    )
    in_split = Window.partitionBy("split").orderBy("_part", "_file", "_start")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.select(
        "_file",
        "_start",
        "split",
        "_first",
        "_head",
        F.coalesce(F.sum(F.col("_n") - F.col("_head")).over(before), F.lit(0)).alias("_before"),
        F.first(F.when(F.col("_start") == 0, F.col("_line0")), ignorenulls=True)
        .over(Window.partitionBy("split", "_file"))
        .alias("_root"),
    )
    rows = join_on(lines, settle(numbered, "blocks"), ["_file", "_start"])
    at = F.col("_id") - F.col("_first") - F.col("_head")
    return rows.select(
        "split",
        F.when(at >= 0, F.col("_before") + at).cast("bigint").alias("line_no"),
        (strip("_root") if header else F.lit(None).cast("string")).alias("root"),
        "line",
    ).filter("line_no IS NOT NULL")


def _require(good, what: str):
    """Filter condition that fails the job on a bad line and names it.

    Header lines have no number; the optimizer may test them here first.
    """
    where = F.concat(F.col("split"), F.lit(" line "), F.col("line_no").cast("string"))
    fail = F.raise_error(F.concat(where, F.lit(f": {what}")))
    return F.when(F.col("line_no").isNull(), F.lit(False)).when(good, F.lit(True)).otherwise(fail)


def read_manifest(
    spark: SparkSession, path, labelled: bool = True, on_bad: str = "error"
) -> DataFrame:
    """SRC-1: ``split, line_no, root, path, n_frames, label`` from manifest files.

    A file starts with its root directory; other lines are ``path TAB n_frames``, with
    a label behind when ``labelled``. A line with another number of fields fails the
    job and is named, or with ``on_bad="keep"`` comes back with its text in ``bad``.
    """
    fields = 3 if labelled else 2
    rows = numbered_lines(spark, path, header=True).withColumn(
        "_f", F.split(strip("line"), "\t")
    )
    frames = F.get("_f", F.lit(1))
    good = (F.size("_f") == fields) & frames.rlike(r"^\s*[+-]?[0-9]+\s*$")
    if on_bad == "error":
        rows = rows.filter(_require(good, "malformed manifest line"))
    elif on_bad != "keep":
        raise ValueError("on_bad: 'error' or 'keep'")
    label = F.get("_f", F.lit(2)) if labelled else F.lit(None).cast("string")
    out = rows.select(
        "split",
        "line_no",
        "root",
        F.when(good, F.get("_f", F.lit(0))).alias("path"),
        F.when(good, frames.cast("bigint")).alias("n_frames"),
        F.when(good, label).alias("label"),
        F.when(~good, F.col("line")).alias("bad"),
    )
    return out if on_bad == "keep" else out.drop("bad")


def read_labels(spark: SparkSession, path, kind: str = "evaluation") -> DataFrame:
    """SRC-2: ``split, line_no, answer, question, text, hyp`` from label files.

    ``"evaluation"``: 3 columns, or 4 with a hypothesis; any other count is an error.
    ``"transcript"``: the whole line is the text.
    """
    rows = numbered_lines(spark, path, header=False)
    none = F.lit(None).cast("string")
    if kind == "transcript":
        return rows.select(
            "split",
            "line_no",
            none.alias("answer"),
            none.alias("question"),
            F.col("line").alias("text"),
            none.alias("hyp"),
        )
    if kind != "evaluation":
        raise ValueError("kind: 'evaluation' or 'transcript'")
    rows = rows.withColumn("_f", F.split("line", "\t"))
    rows = rows.filter(_require(F.size("_f").isin(3, 4), "a label line has 3 or 4 columns"))
    names = ["answer", "question", "text", "hyp"]
    return rows.select(
        "split", "line_no", *[F.get("_f", F.lit(i)).alias(c) for i, c in enumerate(names)]
    )

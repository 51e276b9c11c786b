"""Manifest filters, guards and positional joins (FL, JN-1, JN-6, JN-10, WN-3, TX-9, AG-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.ranking import attach, bucketed_rank, line_bucket


def skip_reason(
    n_frames: str, label: str, min_size: int | None, labels: list[str] | None
) -> Column:
    """FL-1: why a row is skipped, NULL when it is kept; size is tested before the label."""
    reason = F.lit(None).cast("string")
    if labels is not None:
        keep = F.coalesce(F.col(label).isin(labels), F.lit(False))
        reason = F.when(~keep, F.lit("label"))
    if min_size is not None:
        long_enough = F.coalesce(F.col(n_frames) >= min_size, F.lit(False))
        reason = F.when(~long_enough, F.lit("size")).otherwise(reason)
    return reason


def filter_manifest(
    df: DataFrame,
    min_size: int | None = 0,
    labels: list[str] | None = None,
    n_frames: str = "n_frames",
    label: str = "label",
) -> DataFrame:
    """FL-1: rows long enough and, if given, with a listed label.

    Plain predicates, so they reach the Parquet scan; ``skip_reason`` and
    ``skip_report`` say what was left out.
    """
    out = df
    if min_size is not None:
        out = out.filter(F.col(n_frames) >= min_size)
    if labels is not None:
        out = out.filter(F.col(label).isin(labels))
    return out


def skip_report(
    df: DataFrame,
    min_size: int | None = 0,
    labels: list[str] | None = None,
    n_frames: str = "n_frames",
    label: str = "label",
) -> DataFrame:
    """FL-2: rows loaded and rows skipped by reason."""
    reason = F.coalesce(skip_reason(n_frames, label, min_size, labels), F.lit("loaded"))
    return df.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# Input limits of evaluation, generation and training.
MAX_EVAL_POSITIONS = 900
MAX_GENERATION_POSITIONS = 799
MAX_TRAINING_POSITIONS = 1023


def length_guard(df: DataFrame, length: str, limit: int, on_exceed: str, outputs: list[str] = []):
    """FL-3: rows longer than ``limit``, by named policy.

    ``"drop"``: the row does not count (evaluation). ``"null"``: the row stays and its
    outputs become NULL, so it adds nothing to sums (generation). ``"zero"``: the row
    stays and its outputs become 0 (training: no loss, but the sample counts).
    """
    over = F.col(length) > limit
    if on_exceed == "drop":
        return df.filter(F.col(length) <= limit)
    if on_exceed not in ("null", "zero"):
        raise ValueError("on_exceed: 'drop', 'null' or 'zero'")
    types = dict(df.dtypes)
    put = {
        c: F.when(over, F.lit(None if on_exceed == "null" else 0).cast(types[c])).otherwise(F.col(c))
        for c in outputs
    }
    return df.withColumns(put)


def crop_size(n_frames, max_sample_size: int | None = 320000) -> Column:
    """FL-5: effective size of an item; the default is 20 s at 16 kHz."""
    c = F.col(n_frames) if isinstance(n_frames, str) else n_frames
    return c if max_sample_size is None else F.least(c, F.lit(max_sample_size).cast("bigint"))


def duration_s(n_frames, sample_rate: int = 16000) -> Column:
    c = F.col(n_frames) if isinstance(n_frames, str) else n_frames
    return c.cast("double") / F.lit(float(sample_rate))


def match_lines(
    manifest: DataFrame, labels: DataFrame, keys: list[str] = ["split", "line_no"]
) -> DataFrame:
    """Both files side by side, one row per line of either, with a ``match`` column."""
    left = manifest.withColumn("_in_manifest", F.lit(True))
    right = labels.withColumn("_in_labels", F.lit(True))
    match = (
        F.when(F.col("_in_labels").isNull(), F.lit("manifest only"))
        .when(F.col("_in_manifest").isNull(), F.lit("labels only"))
        .otherwise(F.lit("both"))
    )
    joined = left.join(right, keys, "full_outer")
    return joined.withColumn("match", match).drop("_in_manifest", "_in_labels")


def alignment_report(
    manifest: DataFrame, labels: DataFrame, keys: list[str] = ["split", "line_no"], by: list[str] = []
) -> DataFrame:
    """JN-1: lines per match outcome, and lines whose label and answer disagree."""
    m = match_lines(manifest, labels, keys)
    differs = (
        (F.col("label") != F.col("answer")).cast("bigint")
        if {"label", "answer"} <= set(m.columns)
        else F.lit(0).cast("bigint")
    )
    return m.groupBy(*by, "match").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(differs), F.lit(0)).alias("n_differ")
    )


def attach_labels(
    manifest: DataFrame,
    labels: DataFrame,
    keys: list[str] = ["split", "line_no"],
    on_mismatch: str = "error",
) -> DataFrame:
    """JN-1: label line i beside manifest line i.

    A line on one side only fails the job and names the line (``"error"``), or is left
    out (``"inner"``). Take from the labels only the lines whose manifest line was skipped
    (``labels.join(skipped, keys, "left_anti")``), so that a surplus label line still fails.
    """
    if on_mismatch == "inner":
        return manifest.join(labels, keys)
    where = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    fail = F.raise_error(F.concat(F.lit("unaligned line "), where, F.lit(": "), F.col("match")))
    ok = F.when(F.col("match") == "both", F.lit(True)).otherwise(fail)
    return match_lines(manifest, labels, keys).filter(ok).drop("match")


def keep_collated(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """JN-10: rows whose id survived collation."""
    return rows.join(ids.select(key), key, "left_semi")


def dense_reindex(
    df: DataFrame, split: list[str] = [], line_no: str = "line_no", out: str = "index"
) -> DataFrame:
    """WN-3: kept rows numbered 0..n-1 per split, by line number.

    Exact for one split of any size: rows are ranked inside blocks of 65,536 line
    numbers and shifted by the count of the blocks before.
    """
    ranked = bucketed_rank(df, split, [line_no], line_bucket(F.col(line_no)), "_rn")
    return ranked.withColumn(out, F.col("_rn") - 1).drop("_rn")


def incomplete_outputs(
    plan: DataFrame, outputs: DataFrame, n: int, split: str = "split", rows: str = "n_rows"
) -> DataFrame:
    """JN-6: splits that hold fewer output lines than ``min(rows, n)``, with the shortfall."""
    have = outputs.groupBy(split).agg(F.count(F.lit(1)).alias("n_done"))
    wanted = F.least(F.col(rows), F.lit(n).cast("bigint"))
    return (
        plan.join(have, split, "left")
        .withColumn("n_done", F.coalesce(F.col("n_done"), F.lit(0).cast("bigint")))
        .withColumn("n_wanted", wanted)
        .filter(F.col("n_done") < F.col("n_wanted"))
    )


def split_segments(df: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """TX-9: one row per segment of an ``a;b`` path: ``segment_no`` and ``segment_path``."""
    return df.select(
        "*", F.posexplode(F.split(F.col(path), ";")).alias("segment_no", "_segment")
    ).withColumn("segment_path", F.concat_ws("/", F.col(root), F.col("_segment"))).drop("_segment")


def sum_segments(segments: DataFrame, keys: list[str], n_frames: str = "n_frames") -> DataFrame:
    """TX-9: total size and segment count per item."""
    return segments.groupBy(*keys).agg(
        F.sum(n_frames).alias("n_frames"), F.count(F.lit(1)).alias("n_segments")
    )


def duration_report(
    df: DataFrame, by: list[str], n_frames: str = "n_frames", sample_rate: int = 16000
) -> DataFrame:
    """AG-12: rows, frames and seconds per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(n_frames).alias("n_frames"),
        (F.sum(n_frames) / F.lit(float(sample_rate))).alias("seconds"),
        F.min(n_frames).alias("min_frames"),
        F.max(n_frames).alias("max_frames"),
    )

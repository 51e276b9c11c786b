"""Model scoring and what follows it row by row (UD-1, JN-7, JN-8, SC-6, SC-7, SM-4, SC-8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType

from earshot.functions.vectors import argmax
from earshot.session import settle

# Vocabulary of the frozen language model and its shared special id.
VOCAB_SIZE = 50257
SPECIAL_ID = 50256
# Inputs that carry no content.
CONTENT_FREE_INPUTS = ["N/A", "", "[MASK]"]


def score(
    df: DataFrame,
    make_scorer: Callable,
    in_cols: list[str],
    out: str = "scores",
    shapes: list[list[int] | None] | None = None,
    batch_size: int = 64,
    return_type: DataType | None = None,
) -> DataFrame:
    """UD-1: a frozen model over every row.

    ``make_scorer()`` runs once per Python worker and returns ``f(*arrays) -> array``
    of one score vector per row. For wide vocabularies let the scorer return the label
    columns (and the log-sum-exp) only, so that no 50,000-wide row leaves the worker.
    """
    udf = predict_batch_udf(
        make_scorer,
        return_type=return_type or ArrayType(FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=shapes,
    )
    return df.withColumn(out, udf(*[F.col(c) for c in in_cols]))


def label_tokens(classes: DataFrame, tokens: DataFrame, label: str = "label") -> DataFrame:
    """First-token table of the labels; a label that is not exactly one token fails the job.

    ``tokens`` holds (label, token_ids).
    """
    one = F.when(F.size("token_ids") == 1, F.get("token_ids", F.lit(0))).otherwise(
        F.raise_error(F.concat(F.lit("label is not a single token: "), F.col(label)))
    )
    return classes.join(tokens, label).withColumn("token_id", one).drop("token_ids")


def map_label_tokens(df: DataFrame, classes: DataFrame, token: str, out: str = "truth") -> DataFrame:
    """JN-7: first target token -> class index; a token that is no label gives NULL.

    ``classes`` holds (token_id, class_id), one row per label, at most the vocabulary.
    """
    table = settle(
        classes.select(F.col("token_id").alias("_token"), F.col("class_id").alias(out)), "classes"
    )
    return df.join(table, df[token] == F.col("_token"), "left").drop("_token")


def content_free_grid(
    inputs: DataFrame, labels: DataFrame, text: str, prompt: str, label: str = "label"
) -> DataFrame:
    """JN-8: one probe row ``input + prompt + label`` per content-free input and label.

    The few labels arrive as one ordered array (a scalar subquery), so each input row
    fans out in place and nothing is shuffled.
    """
    few = labels.select(label).distinct().agg(F.array_sort(F.collect_set(label)).alias("labels"))
    checked = few.select(
        F.when(F.size("labels") <= VOCAB_SIZE, F.col("labels")).otherwise(
            F.raise_error(F.lit("more labels than the vocabulary has tokens"))
        )
    )
    probes = inputs.withColumn("probe_label", F.explode(checked.scalar()))
    return probes.withColumn(
        "probe", F.concat(F.col(text), F.lit(prompt), F.lit(" "), F.col("probe_label"))
    )


def found_type(df: DataFrame, scores: str) -> str:
    """Element type of a score column."""
    return df.schema[scores].dataType.elementType.simpleString()


def masked_nll(
    df: DataFrame,
    pad: int,
    seq: str,
    pos: str,
    target: str,
    lprobs: str,
    pad_is_eos: bool = True,
    ignore_prefix: int = 0,
) -> DataFrame:
    """SC-6: summed loss per sequence over real tokens plus the first pad (the eos).

    With a dedicated pad id (``pad_is_eos=False``) only real tokens count. Without a pad
    all positions count. The first ``ignore_prefix`` positions (from 0) of every sequence are left
    out, targets and scores. A target outside the scores fails. One pass with partial sums; no window and no second join, so a
    very long sequence is no hot spot.
    """
    found = F.get(F.col(lprobs), F.col(target))
    outside = (F.col(target) < 0) | (F.col(target) >= F.size(lprobs))
    fail = F.raise_error(F.concat(F.lit("target outside the scores: "), F.col(target).cast("string")))
    nll = -F.when(outside, fail.cast(found_type(df, lprobs))).otherwise(found).cast("double")
    is_pad = F.col(target) == pad
    return (
        _behind(df, pos, ignore_prefix).select(seq, F.col(pos).alias("_pos"), nll.alias("_nll"), is_pad.alias("_pad"))
        .groupBy(seq)
        .agg(
            F.coalesce(F.sum(F.when(~F.col("_pad"), F.col("_nll"))), F.lit(0.0)).alias("_real"),
            F.coalesce(
                F.min_by(
                    F.when(F.col("_pad"), F.col("_nll")), F.when(F.col("_pad"), F.col("_pos"))
                ),
                F.lit(0.0),
            ).alias("_eos"),
            F.count(F.when(~F.col("_pad"), 1)).alias("n_real"),
        )
        .select(
            seq,
            (F.col("_real") + (F.col("_eos") if pad_is_eos else F.lit(0.0))).alias("loss"),
            "n_real",
        )
    )


def _behind(df: DataFrame, pos: str | None, prefix: int) -> DataFrame:
    """Positions from ``prefix`` on."""
    if not prefix:
        return df
    if pos is None:
        raise ValueError("a prefix needs the name of the position column")
    return df.filter(F.col(pos) >= prefix)


def token_accuracy(
    df: DataFrame,
    pad: int,
    by: list[str],
    target: str,
    scores: str,
    pos: str | None = None,
    ignore_prefix: int = 0,
) -> DataFrame:
    """SC-7: right and counted positions, pads (and so the eos) left out, and the first
    ``ignore_prefix`` positions of every sequence with them."""
    df = _behind(df, pos, ignore_prefix)
    real = F.col(target) != pad
    right = real & (argmax(scores) == F.col(target))
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(right.cast("bigint")), F.lit(0)).alias("n_correct"),
        F.coalesce(F.sum(real.cast("bigint")), F.lit(0)).alias("total"),
    )


def greedy_decode(
    df: DataFrame, seq: str, step: str, scores: str, eos: int, max_len: int = 200
) -> DataFrame:
    """SM-4: the best token per step; after the first eos every token is the pad (= eos).

    The argmax is taken before the shuffle, so only (sequence, step, token) moves; a
    sequence has at most ``max_len`` steps.
    """
    best = df.filter(F.col(step) < max_len).select(
        seq, F.struct(F.col(step).alias("step"), argmax(scores).alias("token")).alias("_t")
    )
    steps = best.groupBy(seq).agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    tokens = F.transform("_t", lambda t: t["token"])
    first = F.array_position(tokens, F.lit(eos))
    padded = F.transform(
        tokens,
        lambda t, i: F.when((first > 0) & (i >= first), F.lit(eos)).otherwise(t),
    )
    return steps.select(seq, padded.alias("tokens"))


def shift_scores(
    df: DataFrame, seq: str, pos: str, scores: str, target: str, k: int = 1
) -> DataFrame:
    """SC-8: the scores at position t-k beside the target at t, as rows.

    An equi-join on (sequence, position): positions are unique, so a long sequence is
    spread over tasks, unlike a window partitioned by the sequence.
    """
    past = df.select(seq, (F.col(pos) + k).alias(pos), F.col(scores).alias("prev_scores"))
    return df.select(seq, pos, target).join(past, [seq, pos])

"""Row-local array functions (FL-4, WN-4, SC-8, AR-2 .. AR-5, AR-7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def truncate_tokens(tokens, max_positions: int) -> Column:
    """FL-4: the first ``max_positions - 1`` tokens."""
    return F.slice(_c(tokens), 1, max_positions - 1)


def wrap_tokens(tokens, bos, eos) -> Column:
    """FL-4, evaluation form: bos in front, eos behind."""
    return F.concat(F.array(F.lit(bos)), _c(tokens), F.array(F.lit(eos)))


def ones_mask(tokens) -> Column:
    """Attention mask of an unpadded sequence: 1 for every token."""
    return F.array_repeat(F.lit(1).cast("tinyint"), F.size(_c(tokens)))


def strip_pad(tokens, pad) -> Column:
    """AR-2: the sequence without its pad ids."""
    return F.filter(_c(tokens), lambda x: x != F.lit(pad))


def compact(arr, mask) -> Column:
    """AR-3: the positions whose mask is 1."""
    m = _c(mask)
    return F.filter(_c(arr), lambda x, i: F.get(m, i) == 1)


def downsample(arr, factor: int, kernel: list[float] | None = None) -> Column:
    """AR-4: one value per ``factor`` frames, kernel and stride ``factor``, tail dropped.

    The kernel defaults to the mean; a caller's weights replace it.
    """
    a = _c(arr)
    if factor == 1 and kernel is None:
        return F.transform(a, lambda x: x.cast("double"))
    weights = [1.0 / factor] * factor if kernel is None else [float(w) for w in kernel]
    if len(weights) != factor:
        raise ValueError("the kernel needs one weight per frame of its window")
    steps = (F.size(a) / F.lit(factor)).cast("int")

    def window(k):
        if kernel is None:
            part = F.slice(a, k * F.lit(factor) + 1, factor)
            return F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.lit(factor)
        out = F.lit(0.0)
        for j, w in enumerate(weights):
            out = out + F.get(a, k * F.lit(factor) + F.lit(j)).cast("double") * F.lit(w)
        return out

    empty = F.array().cast("array<double>")
    return F.when(steps < 1, empty).otherwise(
        F.transform(F.sequence(F.lit(0), steps - 1), window)
    )


def downsample_mask(mask, out_len, factor: int) -> Column:
    """AR-4: every ``factor``-th mask bit; output positions beyond the mask are padding.

    Masks here are attention masks (1 = keep), so padding is 0.
    """
    m, n = _c(mask), _c(out_len)
    empty = F.array().cast("array<int>")
    return F.when(n < 1, empty).otherwise(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.coalesce(F.get(m, k * F.lit(factor)).cast("int"), F.lit(0)),
        )
    )


def chop(arr, n_token: int) -> Column:
    """AR-5: the first ``n_token`` positions, or all of them when ``n_token`` < 1."""
    return F.slice(_c(arr), 1, n_token) if n_token >= 1 else _c(arr)


def last_scores(scores, back: int = 0) -> Column:
    """SC-8: the last score entry (0), or the one ``back`` places before it."""
    s = _c(scores)
    return F.get(s, F.size(s) - F.lit(1 + back))


def shift_pairs(scores, targets) -> Column:
    """SC-8: the score entry at t-1 beside the target at t, as an array of structs."""
    s, t = _c(scores), _c(targets)
    n = F.least(F.size(s), F.size(t)) - 1
    return F.arrays_zip(
        F.slice(s, F.lit(1), F.greatest(n, F.lit(0))).alias("score"),
        F.slice(t, F.lit(2), F.greatest(n, F.lit(0))).alias("target"),
    )


@F.arrow_udf(ArrayType(IntegerType()))
def _position_ids(mask: pa.Array) -> pa.Array:
    if isinstance(mask, pa.ChunkedArray):
        mask = mask.combine_chunks()
    lengths = np.asarray(mask.value_lengths().fill_null(0))
    flat = np.asarray(mask.flatten()).astype(np.int64)
    starts = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    running = np.concatenate(([0], np.cumsum(flat)))
    ids = running[1:] - np.repeat(running[starts[:-1]], lengths) - 1
    ids = np.where(flat == 0, 1, ids).astype(np.int32)
    nulls = pa.array(np.asarray(mask.is_null()), type=pa.bool_()) if mask.null_count else None
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids), mask=nulls)


def position_ids(mask) -> Column:
    """WN-4 on arrays: running count of kept slots minus 1, masked slots get 1.

    A prefix sum inside an array has no linear built-in form, so a whole Arrow batch
    is summed at once. For one row per position use ``operators.sequences.position_ids_long``.
    """
    return _position_ids(_c(mask).cast("array<int>"))

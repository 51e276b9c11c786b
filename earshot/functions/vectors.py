"""Score vectors (SC-3 .. SC-5, SM-3): softmax, label probabilities, calibration, argmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(tokens) -> Column:
    if isinstance(tokens, (list, tuple)):
        return F.array(*[F.lit(int(t)) for t in tokens])
    return _c(tokens)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def log_sum_exp(scores) -> Column:
    """ln(sum(exp(x))) of a score array, shifted by its maximum: one pass, no copy."""
    s = _c(scores)

    def shifted(m):
        acc = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - m))
        return m + F.log(acc)

    return bind(F.array_max(s).cast("double"), shifted)


def softmax(scores) -> Column:
    """SC-3: probabilities over the whole array."""
    s = _c(scores)
    return bind(log_sum_exp(s), lambda z: F.transform(s, lambda x: F.exp(x.cast("double") - z)))


def log_softmax(scores) -> Column:
    """SC-3: log probabilities over the whole array."""
    s = _c(scores)
    return bind(log_sum_exp(s), lambda z: F.transform(s, lambda x: x.cast("double") - z))


def vocab_probs(scores, tokens) -> Column:
    """Probabilities of the given tokens under the full softmax, not renormalised."""
    s = _c(scores)
    return bind(
        log_sum_exp(s),
        lambda z: F.transform(_tokens(tokens), lambda t: F.exp(F.get(s, t).cast("double") - z)),
    )


def label_probs(scores, tokens) -> Column:
    """SC-4: probabilities of the label tokens, renormalised over the labels.

    Renormalising cancels the sum over the vocabulary, so the softmax runs over the
    label scores alone: the same numbers without an exponential per vocabulary entry.
    """
    s = _c(scores)
    return bind(F.transform(_tokens(tokens), lambda t: F.get(s, t).cast("double")), softmax)


def normalize(arr) -> Column:
    """An array divided by its sum."""
    return bind(_c(arr), lambda a: bind(total(a), lambda t: F.transform(a, lambda x: x / t)))


def calibrate(probs, prior=None, mode: str | None = None, on_zero: str = "error") -> Column:
    """SC-5: corrected label scores.

    ``None`` keeps the probabilities, ``diagonal_W`` divides by the prior,
    ``identity_W`` subtracts it. A zero in the prior is an error, as a singular
    matrix would be; ``on_zero="null"`` gives NULL scores instead.
    """
    p = _c(probs)
    if mode is None or prior is None:
        return p
    q = _c(prior)
    if mode == "diagonal_W":
        if on_zero == "null":
            return F.zip_with(p, q, lambda a, b: F.try_divide(a, b))
        zero = F.exists(q, lambda x: x == 0)
        safe = F.when(zero, F.raise_error(F.lit("content-free prior holds a zero"))).otherwise(q)
        return bind(safe, lambda w: F.zip_with(p, w, lambda a, b: a / b))
    if mode == "identity_W":
        return F.zip_with(p, q, lambda a, b: a - b)
    raise ValueError(f"calibration mode {mode!r}: use None, 'diagonal_W' or 'identity_W'")


def argmax(arr) -> Column:
    """SM-3: 0-based position of the largest value, the first one on ties."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")

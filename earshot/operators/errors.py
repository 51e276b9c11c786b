"""Character and word error rates (AG-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.edits import char_edits, text_edits, word_edits
from earshot.functions.text import split_words


def edit_counts(
    df: DataFrame,
    ref: str,
    hyp: str,
    long_texts: bool = True,
    spread: int | None = None,
    spread_by: list[str] = [],
) -> DataFrame:
    """Edits and reference lengths per row.

    A NULL hypothesis (nothing was generated) adds 0 to every count. Edit distance is
    CPU work out of proportion to the bytes read, so ``spread`` deals the rows by key
    over that many tasks; without it one input split is one task.
    """
    rows = df.repartition(spread, *spread_by) if spread else df
    chars, words = text_edits(ref, hyp) if long_texts else (char_edits(ref, hyp, False), word_edits(ref, hyp))
    given = F.col(hyp).isNotNull() & F.col(ref).isNotNull()

    def count(c):
        return F.when(given, c.cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    return rows.withColumns(
        {
            "num_char_errors": count(F.coalesce(chars, F.lit(0))),
            "num_chars": count(F.length(ref)),
            "num_word_errors": count(F.coalesce(words, F.lit(0))),
            "num_words": count(F.size(split_words(ref))),
        }
    )


def _rate(errors: str, size: str):
    return F.when(F.col(size) > 0, F.col(errors) * F.lit(100.0) / F.col(size)).otherwise(
        F.lit(float("nan"))
    )


def reduce_errors(counts: DataFrame, by: list[str] = []) -> DataFrame:
    """UER and WER from summable counts: sums first, then one division.

    Counts from several workers, files or days merge by calling it on their union.
    """
    names = ["num_char_errors", "num_chars", "num_word_errors", "num_words"]
    sums = counts.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    )
    return sums.withColumns(
        {
            "uer": _rate("num_char_errors", "num_chars"),
            "wer": _rate("num_word_errors", "num_words"),
        }
    )


def error_rates(
    df: DataFrame,
    ref: str,
    hyp: str,
    by: list[str] = [],
    long_texts: bool = True,
    spread: int | None = None,
    spread_by: list[str] = [],
) -> DataFrame:
    """AG-5: corpus-level character and word error rates in percent, by any grouping."""
    return reduce_errors(edit_counts(df, ref, hyp, long_texts, spread, spread_by), by)

"""Transcript generation (UD-2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from earshot.functions.keys import order_key
from earshot.functions.text import clean_target, first_line
from earshot.operators.manifest import incomplete_outputs
from earshot.operators.ranking import bucketed_rank, key_bucket
from earshot.operators.sampling import cap_rows
from earshot.operators.sequences import GENERATION_PROMPT
from earshot.session import settle
from earshot.sources.manifests import read_labels
from earshot.sources.sinks import write_manifest_pair


def _bisected(generate: Callable, columns: list[list]) -> tuple[list, list]:
    """Texts and errors of a batch in one call; a batch that raises is halved until the bad rows are alone."""
    n = len(columns[0])
    try:
        texts = list(generate(*columns))
        if len(texts) != n:
            raise ValueError(f"{len(texts)} texts for {n} rows")
        return texts, [None] * n
    except Exception as e:  # recorded per row, see generate_hypotheses
        if n == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = n // 2
    first = _bisected(generate, [c[:half] for c in columns])
    second = _bisected(generate, [c[half:] for c in columns])
    return first[0] + second[0], first[1] + second[1]


# Characters of input whose texts are held at a time, in the task's Python and on the way back.
PART = 1 << 20


def _parts(columns: list[list], n: int, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, whole multiples of ``step`` but the last, of about PART characters."""
    lo = size = 0
    for hi in range(step, n + step, step):
        size += sum(len(v) if isinstance(v, (str, bytes)) else 64 for c in columns for v in c[hi - step : hi])
        if size >= PART or hi >= n:
            yield lo, min(hi, n)
            lo, size = hi, 0


def _runner(make_generator: Callable, inputs: list[str], batch_size: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = make_generator()
        generate = made if batch_size else lambda *columns: [made(*values) for values in zip(*columns)]
        step = batch_size or 1
        for rows in batches:
            columns = [rows[c].tolist() for c in inputs]
            for start, end in _parts(columns, len(rows), step):
                texts, errors = [], []
                for lo in range(start, end, step):
                    t, e = _bisected(generate, [c[lo : min(lo + step, end)] for c in columns])
                    texts += t
                    errors += e
                yield rows.iloc[start:end].assign(raw_hyp=texts, error=errors)

    return run


def generate_hypotheses(
    df: DataFrame, make_generator: Callable, inputs: list[str], target: str, batch_size: int | None = None
) -> DataFrame:
    """UD-2: a generator over every row, hypothesis and target cleaned.

    ``make_generator()`` runs once per task and returns ``f(*inputs) -> text``, or with
    ``batch_size`` a function of lists, ``f(*columns) -> texts``, called once per batch. A batch
    that raises is halved until the bad rows are alone. A row whose generator raises keeps its place with the reason in ``error`` and a NULL
    hypothesis; ``written_rows`` leaves such rows out, as the original does.
    """
    extra = [StructField("raw_hyp", StringType()), StructField("error", StringType())]
    schema = StructType(df.schema.fields + extra)
    out = df.mapInPandas(_runner(make_generator, inputs, batch_size), schema)
    return out.withColumns(
        {
            "hyp": first_line("raw_hyp"),
            "target": clean_target(target),
            "prompt": F.lit(GENERATION_PROMPT),
        }
    ).drop("raw_hyp")


def written_rows(generated: DataFrame) -> DataFrame:
    """Rows to write to the manifest pair: those without an error."""
    return generated.filter(F.col("error").isNull()).drop("error")


def transcribe(
    rows: DataFrame,
    make_generator: Callable,
    inputs: list[str],
    out: str,
    n: int,
    seed: int = 0,
    batch_size: int | None = None,
    root: str = "",
) -> int:
    """The generation stage as one plan: JN-6, SM-1 with FL-6, UD-2, then SNK-1. Gives the splits written.

    ``rows``: split, id (unique in a split), path, n_frames, target and the inputs. Splits that hold
    ``min(rows, n)`` lines already are left as they are; of the others the first n rows in the seed's
    order are generated, each once. Failed rows are dropped and the rest numbered without holes, in
    that order. Tabs and line breaks inside a field are written as ``#`` and ``*``.
    """
    spark = rows.sparkSession
    try:
        have = read_labels(spark, f"{out}/ltr").select("split")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        have = rows.select("split").limit(0)
    sizes = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    open_splits = settle(incomplete_outputs(sizes, have, n).select("split"), "splits")
    todo = open_splits.count()
    if not todo:
        return 0
    chosen = cap_rows(rows.join(open_splits, "split", "left_semi"), seed, n, "id", cell=["split"])
    made = generate_hypotheses(chosen, make_generator, inputs, "target", batch_size)
    kept = written_rows(made).select("split", "id", "path", "n_frames", "target", "prompt", "hyp")
    # generation is dear: its rows are written once, and everything after reads them
    kept = settle(kept.withColumn("_key", order_key(seed, "id")), "generated")
    ranked = bucketed_rank(kept, ["split"], ["_key", "id"], key_bucket(F.col("_key"), 3), "_rn")
    lines = ranked.withColumns(
        {"line_no": F.col("_rn") - 1, **{c: F.translate(c, "\t\n\r", "#*") for c in ("target", "hyp", "path")}}
    )
    write_manifest_pair(lines, out, root, other_splits="keep")
    return todo

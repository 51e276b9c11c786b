"""The sweep as one resumable plan: from samples to stored runs, every run of the grid in the same jobs.

A run is a cell (label pair, checkpoint, shots, experiment, seed). The original loops over runs; here the
cell is a set of grouping columns, and each step handles all pending runs at once:

1. the grid (JN-3, JN-4) without the runs that are stored already (JN-5): their folders are listed, and when
   nothing is pending no sample is read;
2. examples of every pair and seed (SM-2), collapsed into one block per pair, seed and shot count;
3. rows of a run: too long ones left out, then the first ``max_rows`` in the seed's order (FL-6 per cell).
   Lengths are sums of the parts' lengths, so this happens on key columns; prompts are made afterwards;
4. prompts (AR-6), and content-free probes (JN-8) behind the run's own examples;
5. the scorer (UD-1) over both, label probabilities (SC-4) and each run's prior (AG-4);
6. balanced, calibrated accuracy per run (UD-3), stored by cell (SNK-2).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from earshot.functions.text import render_answer, render_label
from earshot.functions.vectors import label_probs, vocab_probs
from earshot.operators.calibration import content_free_prior
from earshot.operators.sampling import cap_rows, draw_examples
from earshot.operators.scoring import CONTENT_FREE_INPUTS, score
from earshot.operators.sequences import EXPERIMENTS, example_blocks
from earshot.operators.sweep import (
    CELL,
    N_SHOTS,
    SEEDS,
    label_pairs,
    pending_cells,
    report_pivot,
    seed_average,
    sweep_grid,
)
from earshot.plans.few_shot import evaluate
from earshot.session import settle
from earshot.sources.sinks import read_runs, write_runs

# Fixed value: longest model input of an evaluation.
MAX_LENGTH = 900
BLOCK_KEY = ["scenarios", "seed", "n_shot"]
RUN_COLUMNS = {"acc": "double", "acc_cf": "double", "n": "bigint", "n_chop": "bigint", "n_classes": "bigint"}


@dataclass(frozen=True)
class Sweep:
    """Axes of a sweep and what its runs have in common.

    ``max_rows`` caps every run, one row later than asked where ``one_more`` is set, as the
    original does. ``max_length`` counts characters of text, or tokens of token arrays.
    ``files_per_run`` tasks write the predictions of a run; raise it for uncapped runs.
    """

    checkpoints: list[str]
    prompt: Column
    n_shots: list[int] = field(default_factory=lambda: list(N_SHOTS))
    exps: list[str] = field(default_factory=lambda: ["base", "txt"])
    seeds: list[int] = field(default_factory=lambda: list(SEEDS))
    inputs: list = field(default_factory=lambda: list(CONTENT_FREE_INPUTS))
    max_rows: int | None = None
    one_more: bool = True
    max_length: int = MAX_LENGTH
    files_per_run: int = 4


def done_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of stored runs, from the names of their folders: no column of any file is read."""
    try:
        return read_runs(spark, path).select(*CELL).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "scenarios string, model_tag string, n_shot int, exp string, seed int")


def plan_runs(pairs: DataFrame, sweep: Sweep, path: str) -> tuple[DataFrame, DataFrame]:
    """Pending runs, and runs that are only to be recorded as empty (text-only, later checkpoints)."""
    grid = sweep_grid(pairs.select("scenarios"), sweep.checkpoints, sweep.n_shots, sweep.exps, sweep.seeds)
    done = settle(done_cells(pairs.sparkSession, path), "done")
    pending = settle(pending_cells(grid, done).select(*CELL), "pending")
    empty = grid.filter("not planned").join(done, CELL, "left_anti").select(*CELL)
    return pending, empty


def _length(c: Column, is_text: bool) -> Column:
    return F.length(c) if is_text else F.size(c)


def _by_experiment(exps: list[str], make: Callable[[dict, bool], Column]) -> Column:
    """``make(parts, zero_shot)`` of the row's experiment and shot count."""
    out = F.lit(None)
    for e in exps:
        parts = EXPERIMENTS[e]
        both = F.when(F.col("n_shot") == 0, make(parts, True)).otherwise(make(parts, False))
        out = F.when(F.col("exp") == e, both).otherwise(out)
    return out


def _prompt(sweep: Sweep, audio: str, text: str) -> Column:
    """The model input from a row's parts and its run's block."""
    column = {"audio": audio, "text": text}

    def make(parts, zero):
        kind = parts["zero_shot" if zero else "sample"]
        lead = [] if zero else [F.col(f"block_{parts['example'] or 'bare'}")]
        return F.concat(*lead, *([F.col(column[kind])] if kind else []), sweep.prompt)

    return _by_experiment(sweep.exps, make)


def run_blocks(members: DataFrame, pending: DataFrame, sweep: Sweep) -> DataFrame:
    """One row per pair, seed and shot count with its examples (SM-2, JN-2); none for zero shots.

    Draws of a seed are the same for every shot count, so the longest list is drawn once
    and each count takes its head.
    """
    wanted = settle(pending.filter("n_shot > 0").select(*BLOCK_KEY).distinct(), "wanted")
    most = wanted.agg(F.max("n_shot")).first()[0]
    if not most:
        empty = members.limit(0).select("scenarios", F.lit(0).alias("seed"), F.lit(0).alias("n_shot"), "audio", "text")
        return empty.select(*BLOCK_KEY, *[F.col(c).alias(f"block_{k}") for k, c in (("audio", "audio"), ("text", "text"), ("bare", "text"))])
    drawn = draw_examples(members, "label", "id", int(most), sweep.seeds, ["scenarios"])
    is_text = dict(members.dtypes)["text"] == "string"
    answer = render_answer("label") if is_text else F.col("answer")
    rows = drawn.withColumn("answer", answer).join(wanted, ["scenarios", "seed"]).filter("draw < n_shot")
    blocks = example_blocks(rows, BLOCK_KEY, sweep.exps, "audio", "text", sweep.prompt, "answer")
    missing = [k for k in ("audio", "text", "bare") if f"block_{k}" not in blocks.columns]
    return blocks.withColumns({f"block_{k}": F.lit(None).cast(dict(members.dtypes)["text"]) for k in missing}) if missing else blocks


def run_rows(members: DataFrame, pending: DataFrame, blocks: DataFrame, sweep: Sweep) -> DataFrame:
    """Rows of every pending run with their model input: cell, id, truth, sequence.

    Length guard and cap work on key columns; without a cap there is nothing to look up again.
    """
    is_text = dict(members.dtypes)["text"] == "string"
    kinds = ("audio", "text", "bare")
    lengths = blocks.select(*BLOCK_KEY, *[_length(F.col(f"block_{k}"), is_text).alias(f"_block_{k}") for k in kinds])

    def size(parts, zero):
        kind = parts["zero_shot" if zero else "sample"]
        lead = F.lit(0) if zero else F.col(f"_block_{parts['example'] or 'bare'}")
        return lead + (F.col(f"_{kind}") if kind else F.lit(0)) + _length(sweep.prompt, is_text)

    wide = ["audio", "text"]
    measured = members.withColumns({f"_{c}": _length(F.col(c), is_text) for c in wide})
    if sweep.max_rows is not None:
        measured = measured.drop(*wide)
    runs = measured.join(pending, "scenarios").join(settle(lengths, "lengths"), BLOCK_KEY, "left")
    fit = runs.filter(_by_experiment(sweep.exps, size) <= sweep.max_length)
    fit = fit.select(*CELL, "id", "truth", *(wide if sweep.max_rows is None else []))
    if sweep.max_rows is not None:
        chosen = cap_rows(fit, "seed", sweep.max_rows, "id", sweep.one_more, cell=CELL)
        fit = settle(chosen, "chosen").join(members.select("scenarios", "id", *wide), ["scenarios", "id"])
    rows = fit.join(blocks, BLOCK_KEY, "left")
    return rows.select(*CELL, "id", "truth", _prompt(sweep, "audio", "text").alias("sequence"))


def run_probes(labels: DataFrame, pending: DataFrame, blocks: DataFrame, sweep: Sweep) -> DataFrame:
    """Content-free probes of every pending run (JN-8): cell, input_no, class_id, token_id, sequence, echo.

    The input stands where the sample would, behind the run's examples. ``echo`` is the label that
    follows the prompt; a scorer gives the scores of the place before it.
    """
    inputs = F.posexplode(F.array(*[F.lit(i) for i in sweep.inputs])).alias("input_no", "content")
    probes = pending.select("*", inputs).join(labels, "scenarios").join(blocks, BLOCK_KEY, "left")
    return probes.select(
        *CELL, "input_no", "class_id", "token_id",
        _prompt(sweep, "content", "content").alias("sequence"), render_label("label").alias("echo"),
    )


def run_priors(probes: DataFrame) -> DataFrame:
    """AG-4 per run: probabilities of the labels in their own probes, averaged over the inputs."""
    own = probes.withColumn("p", F.get(vocab_probs("scores", F.array("token_id")), F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct("class_id", "p")))
    per_input = own.groupBy(*CELL, "input_no").agg(F.transform(listed, lambda x: x["p"]).alias("probs"))
    return content_free_prior(per_input, "probs", CELL)


def run_sweep(
    samples: DataFrame, labels: DataFrame, make_scorer: Callable, sweep: Sweep, out: str, batch_size: int = 64
) -> DataFrame:
    """All pending runs of a sweep, stored under ``out``; returns the stored runs of the sweep's folder.

    ``samples``: id (unique), label, audio, text (strings, or token arrays with an ``answer`` column).
    ``labels``: label, pos (their order), token_id. ``make_scorer()`` runs once per Python worker and
    returns ``f(sequence, echo, model_tag) -> scores`` of a batch, one row of scores each.

    A run whose rows are all too long is stored with NULL accuracies and counts as done. Rows
    without label or with a label outside the list belong to no pair. Running again after a failure computes what
    is missing; when nothing is, samples are not read.
    """
    spark = samples.sparkSession
    pairs = settle(label_pairs(labels), "pairs")
    pending, empty = plan_runs(pairs, sweep, f"{out}/runs")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in RUN_COLUMNS.items()]
    skipped = settle(empty.select("*", *nothing), "empty")
    if not skipped.isEmpty():
        write_runs(skipped, f"{out}/runs")
    if pending.isEmpty():
        return read_runs(spark, f"{out}/runs")

    ends = F.posexplode(F.array(*[F.struct(F.col(f"label_{k}").alias("label"), F.col(f"pos_{k}").alias("pos")) for k in "ab"]))
    classes = pairs.join(pending.select("scenarios").distinct(), "scenarios", "left_semi")
    classes = classes.select("scenarios", ends.alias("class_id", "_l")).select("scenarios", "class_id", "_l.label")
    classes = settle(classes.join(labels.select("label", "token_id"), "label"), "classes")
    members = samples.join(classes.drop("token_id").withColumnRenamed("class_id", "truth"), "label")
    blocks = settle(run_blocks(members, pending, sweep), "blocks")

    inputs = ["sequence", "echo", "model_tag"]
    scores = ArrayType(DoubleType())
    probes = run_probes(classes, pending, blocks, sweep)
    priors = run_priors(score(probes, make_scorer, inputs, batch_size=batch_size, return_type=scores))
    rows = run_rows(members, pending, blocks, sweep).withColumn("echo", F.lit(""))
    tokens = classes.groupBy("scenarios").agg(F.array_sort(F.collect_list(F.struct("class_id", "token_id"))).alias("_t"))
    tokens = settle(tokens.select("scenarios", F.transform("_t", lambda t: t["token_id"]).alias("label_tokens")), "tokens")
    scored = score(rows, make_scorer, inputs, batch_size=batch_size, return_type=scores).join(tokens, "scenarios")
    preds = scored.select(*CELL, "id", "truth", label_probs("scores", "label_tokens").alias("probs"))
    write_runs(preds, f"{out}/predictions", files_per_cell=sweep.files_per_run)

    stored = read_runs(spark, f"{out}/predictions").join(pending, CELL, "left_semi")
    found = evaluate(stored, priors, CELL)
    runs = pending.join(found, CELL, "left").select(*CELL, *RUN_COLUMNS)
    write_runs(settle(runs, "runs"), f"{out}/runs")
    return read_runs(spark, f"{out}/runs")


def sweep_report(runs: DataFrame, sweep: Sweep) -> DataFrame:
    """AG-8 and AG-9 over stored runs: a row per experiment and shot count, a column per checkpoint."""
    by = ["exp", "model_tag", "n_shot"]
    return report_pivot(seed_average(runs, runs.select(*by), by), sweep.checkpoints, rows=["exp", "n_shot"])



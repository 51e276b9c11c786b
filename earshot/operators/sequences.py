"""Token sequences: padding, prompts, vocabulary, batching (AR, WN-4 .. WN-6, JN-2, JN-9, JN-11)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from earshot.functions.keys import order_key
from earshot.functions.sequences import ones_mask
from earshot.functions.text import split_words
from earshot.operators.ranking import LINES_PER_BUCKET, bucketed_rank, dense_ids, join_on, key_bucket, rows_before
from earshot.session import settle

# Prompt of training items, and of generation.
TRAINING_PROMPT = "what did the speaker say? "
GENERATION_PROMPT = "What is the scenario?"


def collate(df: DataFrame, batch: list[str], tokens: str, pad) -> DataFrame:
    """AR-1: every sequence right-padded to the longest of its batch.

    Adds ``padded``, ``mask`` (1 = real) and ``target_length``. The batch maximum is a
    partial aggregate joined back, so a hot batch key is split by AQE's skew join
    instead of sitting in one window.
    """
    longest = df.groupBy(*batch).agg(F.max(F.size(tokens)).alias("_m"))
    n = F.size(tokens)
    fill = F.col("_m") - n
    rows = join_on(df, longest, batch)
    one, zero = F.lit(1).cast("tinyint"), F.lit(0).cast("tinyint")
    return rows.select(
        *df.columns,
        F.concat(F.col(tokens), F.array_repeat(F.lit(pad), fill)).alias("padded"),
        F.concat(F.array_repeat(one, n), F.array_repeat(zero, fill)).alias("mask"),
        n.alias("target_length"),
    )


POSITIONS_PER_TASK = 1 << 20


def position_ids_long(df: DataFrame, seq: list[str], pos: str, mask: str, out: str = "position_id"):
    """WN-4, one row per position: running count of kept slots minus 1, masked slots get 1.

    ``pos`` is a unique whole number per sequence. Sums per block of 65,536 positions
    are shifted by the blocks before, so one endless sequence is no single task. What was kept
    before a block stands in front of its rows as a row of its own, so rows are sorted once and joined with
    nothing; they are dealt over tasks of about POSITIONS_PER_TASK rows, counted first.
    """
    spark = df.sparkSession
    kept = F.col(mask).cast("bigint")
    rows = df.withColumn("_block", F.floor(F.col(pos) / F.lit(LINES_PER_BUCKET)).cast("bigint"))
    sums = rows.groupBy(*seq, "_block").agg(F.sum(kept).alias("_s"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*seq).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        sums.select(*seq, "_block", "_n", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_kept")), "starts"
    )
    total = starts.agg(F.sum("_n")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // POSITIONS_PER_TASK))
    both = rows.withColumns({"_kept": kept, "_row": F.lit(True)}).unionByName(
        starts.drop("_n").withColumn("_row", F.lit(False)), allowMissingColumns=True
    )
    running = Window.partitionBy(*seq, "_block").orderBy("_row", pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.repartition(n, *seq, "_block")
        .withColumn("_run", F.sum("_kept").over(running) - 1)
        .filter("_row")
        .withColumn(out, F.when(F.col(mask) == 1, F.col("_run")).otherwise(F.lit(1)).cast("bigint"))
        .drop("_block", "_kept", "_row", "_run")
    )


def size_cuts(df: DataFrame, size: str, k: int) -> list[float]:
    """Exact quantiles i/k (i = 1 .. k) of the sizes, linear between neighbours; none without rows.

    Rows are counted per distinct size and the counts added up over sorted tasks; the two sizes
    around each cut are the ones whose ranks hold its place. No buffer holds the sizes.
    """
    ranked = rows_before(df.select(F.col(size).alias("size")).filter("size is not null"), "size")
    ranked = settle(ranked, "sizes")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    places = [i / k * (total - 1) for i in range(1, k + 1)]
    wanted = sorted({math.floor(p) for p in places} | {math.ceil(p) for p in places})
    inside = F.filter(
        F.array(*[F.lit(r).cast("bigint") for r in wanted]),
        lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")),
    )
    found = ranked.select("size", F.explode(inside).alias("rank")).collect()  # two rows a cut
    at = {r["rank"]: float(r["size"]) for r in found}
    cuts = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        cuts.append(at[low] if low == high else (high - p) * at[low] + (p - low) * at[high])
    return cuts


def with_size_buckets(df: DataFrame, size: str, k: int) -> DataFrame:
    """WN-5: ``bucket`` (0-based) and ``bucketed_size`` = upper bound of the row's bucket.

    Cut points are the exact quantiles i/k, found first (``size_cuts``); then every row compares
    itself with k numbers. A row without a size has no bucket.
    """
    if k < 1:
        return df.withColumns({"bucket": F.lit(0), "bucketed_size": F.col(size).cast("double")})
    cuts = F.array(*[F.lit(c) for c in size_cuts(df, size, k)]).cast("array<double>")
    fits = F.filter(cuts, lambda c: c >= F.col(size))
    known = F.col(size).isNotNull()
    return df.withColumns(
        {"bucket": F.when(known, F.lit(k) - F.size(fits)), "bucketed_size": F.when(known, F.get(fits, F.lit(0)))}
    )


# Sizes that one task batches at a time.
SIZES_PER_BLOCK = 2048
ANY = 1 << 31  # rows of size 0 that fit a batch


def identity():
    """How a run over sizes changes the open batch, before any size: (starts, slopes, values, opened).

    The state is how many rows the open batch holds. From ``starts[i]`` to the next start, a state h becomes
    ``values[i] + slopes[i] * (h - starts[i])`` (slope 0 or 1), and ``opened[i]`` batches are opened.
    """
    return np.array([0]), np.array([1]), np.array([0]), np.array([0])


def _split(f, level: int):
    """Pieces cut where the resulting state reaches ``level``."""
    starts, slopes, values, opened = f
    size = np.append(starts[1:], 1 << 40) - starts
    at = np.flatnonzero((slopes == 1) & (values < level) & (level < values + size))
    put = at + 1
    return (
        np.insert(starts, put, starts[at] + level - values[at]),
        np.insert(slopes, put, 1),
        np.insert(values, put, level),
        np.insert(opened, put, opened[at]),
    )


def then(f, cap: int, n: int):
    """``f`` followed by ``n`` rows of a size of which ``cap`` fit a batch; caps fall from call to call.

    From a state h, min(h, cap) + n rows fill batches of cap: the last one holds
    (min(h, cap) + n - 1) mod cap + 1.
    """
    f = _split(f, cap)
    wrap = cap - (n - 1) % cap
    for level in (wrap, wrap - cap):
        if 0 < level < cap:
            f = _split(f, level)
    starts, slopes, values, opened = f
    full = values >= cap
    total = np.minimum(values, cap) + n - 1
    slopes = np.where(full, 0, slopes)
    values, opened = total % cap + 1, opened + total // cap
    # neighbours that go on in one line are one piece
    step = np.diff(starts)
    same = (np.diff(opened) == 0) & (slopes[1:] == slopes[:-1]) & (values[1:] == values[:-1] + slopes[:-1] * step)
    keep = np.append(True, ~same)
    return starts[keep], slopes[keep], values[keep], opened[keep]


def at_state(f, held: int) -> tuple[int, int]:
    """Batches opened and rows held at the end, from ``held`` rows at the start."""
    starts, slopes, values, opened = f
    i = int(np.searchsorted(starts, held, side="right")) - 1
    return int(opened[i]), int(values[i] + slopes[i] * (held - starts[i]))


def _fits(size: int, max_tokens: int, max_rows: int | None) -> int:
    cap = max(1, max_tokens // size) if size > 0 else ANY
    return cap if max_rows is None else min(cap, max_rows)


def _compose(max_tokens: int, max_rows: int | None):
    """The state function of a block of sizes."""

    def compose(key: tuple, sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("size")
        f = identity()
        for size, n in zip(sizes["size"].tolist(), sizes["n"].tolist()):
            f = then(f, _fits(size, max_tokens, max_rows), n)
        return pd.DataFrame({"block": key[0], "start": f[0], "slope": f[1], "value": f[2], "opened": f[3]})

    return compose


def _fill_batches(max_tokens: int, max_rows: int | None):
    """Greedy batching of a block of sizes, ascending, from the state before it; one plan row per size."""

    def fill(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("size")
        batch, held, plan = int(sizes["batch"].iloc[0]), int(sizes["held"].iloc[0]), []
        for size, n in zip(sizes["size"].tolist(), sizes["n"].tolist()):
            cap = _fits(size, max_tokens, max_rows)
            room = min(n, max(0, cap - held))
            plan.append((size, batch, room, cap))
            rest = n - room
            opened = -(-rest // cap)
            held = rest - (opened - 1) * cap if opened else held + room
            batch += opened
        return pd.DataFrame(plan, columns=["plan_size", "open_batch", "room", "cap"])

    return fill


def token_budget_batches(
    df: DataFrame, size: str, id_col: str, max_tokens: int = 1280000, max_rows: int | None = None
) -> DataFrame:
    """WN-6: ``batch`` per row so that rows x longest row stays within ``max_tokens``.

    Greedy over ascending size, ties in hashed id order, exactly as a single loop over
    all rows would do it. What a run of sizes does to the open batch is a function of the
    rows it holds, a few straight pieces; so blocks of sizes are worked out side by side, and only
    their functions are followed from block to block: at most two pieces per size and
    no more than a batch of the block's smallest size has rows. With the state before it, each
    block then plans its sizes, and a row finds its batch from its rank among the rows of equal
    size, which are ranked in buckets. A row longer than the budget is a batch of its own.
    """
    spark = df.sparkSession
    hist = df.groupBy(F.col(size).cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    hist = hist.withColumn("block", F.floor(F.col("size") / SIZES_PER_BLOCK))
    pieces = hist.groupBy("block").applyInPandas(
        _compose(max_tokens, max_rows), "block bigint, start bigint, slope bigint, value bigint, opened bigint"
    )
    batch, held, states = 0, 0, []
    functions = pieces.toArrow().sort_by([("block", "ascending"), ("start", "ascending")]).to_pandas()
    for block, f in functions.groupby("block", sort=True):
        states.append((int(block), batch, held))
        opened, held = at_state(tuple(f[c].to_numpy() for c in ("start", "slope", "value", "opened")), held)
        batch += opened
    before = spark.createDataFrame(states, "block bigint, batch bigint, held bigint")
    plan = hist.join(before, "block").groupBy("block").applyInPandas(
        _fill_batches(max_tokens, max_rows), "plan_size bigint, open_batch bigint, room bigint, cap bigint"
    )
    keyed = df.withColumns({"_key": order_key(0, id_col), "_size": F.col(size).cast("bigint")})
    ranked = bucketed_rank(keyed, ["_size"], ["_key", id_col], key_bucket(F.col("_key"), 3), "_rn")
    placed = ranked.join(settle(plan, "batches"), F.col("_size") == F.col("plan_size"))
    later = F.floor((F.col("_rn") - 1 - F.col("room")) / F.col("cap"))
    batch = F.when(F.col("_rn") <= F.col("room"), F.col("open_batch")).otherwise(
        F.col("open_batch") + 1 + later
    )
    return placed.select(*df.columns, batch.cast("bigint").alias("batch"))


# What the five experiments put into a prompt. "example" is the part in
# front of each example's prompt and answer, "sample" the part in front of the final
# prompt, "zero_shot" the same when there are no examples.
EXPERIMENTS = {
    "base": {"example": "audio", "sample": "audio", "zero_shot": "audio"},
    "txt": {"example": "text", "sample": "text", "zero_shot": "text"},
    "noexemb": {"example": None, "sample": "audio", "zero_shot": "audio"},
    "noexembtxt": {"example": None, "sample": "text", "zero_shot": "text"},
    "noexembnotxt": {"example": None, "sample": None, "zero_shot": "audio"},
}


def _parts(exp: str) -> dict:
    if exp not in EXPERIMENTS:
        raise ValueError(f"unknown experiment {exp!r}")
    return EXPERIMENTS[exp]


def _block_name(exp: str) -> str:
    return f"block_{_parts(exp)['example'] or 'bare'}"


def example_blocks(
    examples: DataFrame,
    by: list[str],
    exps: list[str],
    audio: str,
    text: str,
    prompt: Column,
    answer: str,
) -> DataFrame:
    """The examples of a run collapsed into one row per ``by`` key, in draw order.

    One block column per kind of example the experiments need. Works on strings and on
    token arrays. Collapsing before the join lets a sample meet one row per run instead
    of ``n_shot`` rows.
    """
    column = {"audio": audio, "text": text}
    kinds = {_block_name(e): _parts(e)["example"] for e in exps}
    pieces = {
        name: F.concat(*([F.col(column[k])] if k else []), prompt, F.col(answer))
        for name, k in kinds.items()
    }
    drawn = F.struct("repeat", "draw", *[p.alias(n) for n, p in pieces.items()])
    listed = examples.groupBy(*by).agg(F.array_sort(F.collect_list(drawn)).alias("_e"))
    is_text = dict(examples.dtypes)[answer] == "string"

    def join(name):
        parts = F.transform("_e", lambda e: e[name])
        return (F.array_join(parts, "") if is_text else F.flatten(parts)).alias(name)

    return listed.select(*by, *[join(n) for n in pieces])


def assemble_prompt(
    samples: DataFrame,
    blocks: DataFrame | None,
    on: list[str],
    exps: list[str],
    audio: str,
    text: str,
    prompt: Column,
    out: str = "sequence",
) -> DataFrame:
    """AR-6 over JN-2: the model input of every sample, run and experiment (``exp``).

    ``blocks`` (see ``example_blocks``) is joined by the run's key ``on``, an equi-join
    on which every sample of a run finds that run's one row; ``None`` is zero-shot. All
    experiments come from that one join.
    """
    column = {"audio": audio, "text": text}

    def sequence(exp):
        kind = _parts(exp)["zero_shot" if blocks is None else "sample"]
        lead = [] if blocks is None else [F.col(_block_name(exp))]
        return F.concat(*lead, *([F.col(column[kind])] if kind else []), prompt)

    rows = samples if blocks is None else samples.join(settle(blocks, "blocks"), on)
    each = F.array(*[F.struct(F.lit(e).alias("exp"), sequence(e).alias(out)) for e in exps])
    return rows.select(
        *[c for c in rows.columns if not c.startswith("block_")], F.explode(each).alias("_s")
    ).select("*", "_s.*").drop("_s")


def without_examples(rows: DataFrame, examples: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a run that do not serve as its own examples.

    The original evaluates on its examples too, so this is an extra step, not the
    default. ``keys`` are the run's key and the line number.
    """
    return rows.join(settle(examples.select(*keys).distinct(), "used"), keys, "left_anti")


def training_sequence(
    df: DataFrame, audio: str, audio_mask: str, prompt: Column, tokens: str
) -> DataFrame:
    """AR-7: audio, prompt and transcript as one sequence with its mask, in that order."""
    return df.withColumns(
        {
            "sequence": F.concat(F.col(audio), prompt, F.col(tokens)),
            "sequence_mask": F.concat(F.col(audio_mask), ones_mask(prompt), ones_mask(tokens)),
        }
    )


def item_sizes(df: DataFrame, n_frames: str, tokens: str) -> DataFrame:
    """AR-9: input and target length of each item."""
    return df.withColumns(
        {"input_size": F.col(n_frames), "target_size": F.size(tokens).cast("bigint")}
    )


def build_vocab(words: DataFrame, word: str, max_size: int | None = None) -> DataFrame:
    """AR-8: symbol table (token_id, symbol, n), ids by falling count, then by symbol.

    Every symbol gets an id: the table is sorted by one range shuffle and numbered from
    counts per task, so no task holds it whole. ``max_size`` is for a model whose vocabulary has
    that size: the top ``max_size - 1`` symbols, the last id being the shared special one.
    """
    counts = words.groupBy(F.col(word).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("symbol")]
    kept = counts if max_size is None else counts.orderBy(*order).limit(max_size - 1)
    vocab = dense_ids(kept, order, "token_id")
    return vocab.select(F.col("token_id").cast("int").alias("token_id"), "symbol", "n")


# What every task may hold of a vocabulary: the first ids, of symbols of bounded length.
HOT_SYMBOLS = 1_000_000
HOT_LENGTH = 64


def _swap(df: DataFrame, keys: list[str], values: str, words: bool, vocab: DataFrame, out: str, rest) -> DataFrame:
    """``values`` of every row looked up in a vocabulary, in whole Arrow batches.

    The frequent part of the vocabulary (at most HOT_SYMBOLS symbols of at most HOT_LENGTH characters) is
    held by every task as one Arrow array. Rows whose values are all there are done where they are
    read; if that is the whole vocabulary, all rows are. Values that are not there meet the rest of
    the vocabulary in a join by value, and only the rows that have some are brought together again.
    ``words``: texts to ids, else ids to symbols. ``rest`` stands for unknown values.
    """
    spark = df.sparkSession
    here = (F.col("token_id") < HOT_SYMBOLS) & (F.length("symbol") <= HOT_LENGTH)
    hot = vocab.filter(here).select("token_id", "symbol").toArrow()
    complete = vocab.filter(~here | here.isNull()).isEmpty()
    order = np.argsort(hot.column("token_id").to_numpy())
    symbols = hot.column("symbol").combine_chunks().take(order)
    held = spark.sparkContext.broadcast((hot.column("token_id").to_numpy()[order].astype(np.int32), symbols))
    fields = [StructField(k, df.schema[k].dataType) for k in keys]
    kind, other = (IntegerType(), StringType()) if words else (StringType(), IntegerType())

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, names = held.value
        for b in batches:
            column = b.column(len(keys))
            if words:  # the texts become words a few at a time; the symbols held are hashed once a batch
                sizes, parts = [], []
                for lo in range(0, len(b), 500):
                    lists = [t.split() if t else [] for t in column.slice(lo, 500).to_pylist()]
                    sizes += [len(x) for x in lists]
                    parts.append(pa.array([w for x in lists for w in x], pa.string()))
                n = np.array(sizes, np.int64)
                flat = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
                at = pc.index_in(flat, value_set=names)
            else:
                n = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
                flat = pc.list_flatten(column).cast(pa.int32())
                asked = pc.fill_null(flat, 0).to_numpy()
                at = np.searchsorted(ids, asked)  # ids are sorted
                known = np.append(ids, 0)[at] == asked
                known &= (at < len(ids)) & flat.is_valid().to_numpy(zero_copy_only=False)
                at = pa.array(at, mask=~known)
            ends = np.concatenate([[0], np.cumsum(n)])
            found = pc.take(pa.array(ids) if words else names, at)
            miss = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
            if complete and len(miss):
                found, miss = pc.fill_null(found, rest), miss[:0]
            owner = np.searchsorted(ends, miss, side="right") - 1
            stops = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(b)))])
            at_row = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array((miss - ends[owner]).astype(np.int32)))
            cold = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), flat.take(pa.array(miss)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], lists, at_row, cold], names=[*keys, out, "_places", "_cold"])

    def fill(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists, late = b.column(len(keys)), b.column(len(keys) + 1)
            flat, new = pc.list_flatten(lists), pc.list_flatten(late)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = pc.struct_field(new, "_at").to_numpy() + np.repeat(ends[:-1], pc.list_value_length(late).to_numpy(zero_copy_only=False))
            missing = np.zeros(len(flat), dtype=bool)
            missing[at] = True
            values = pc.struct_field(new, "_new").take(pa.array(np.argsort(at, kind="stable")))
            filled = pc.replace_with_mask(flat, pa.array(missing), values)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), filled)], names=[*keys, out])

    schema = StructType([*fields, StructField(out, ArrayType(kind)), StructField("_places", ArrayType(IntegerType())), StructField("_cold", ArrayType(other))])
    rows = df.select(*keys, values).mapInArrow(run, schema)
    if complete:
        return rows.select(*keys, out)
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()), "swapped")
    done = rows.filter(F.size("_places") == 0).select(*keys, out)
    open_rows = rows.filter(F.size("_places") > 0)
    asked = open_rows.select("_row", F.explode(F.arrays_zip("_places", "_cold")).alias("c"))
    asked = asked.select("_row", F.col("c._places").alias("_at"), F.col("c._cold").alias("_value"))
    table = vocab.select(
        F.col("symbol" if words else "token_id").alias("_value"), F.col("token_id" if words else "symbol").alias("_new")
    )
    answer = asked.join(table, "_value", "left").select("_row", "_at", F.coalesce("_new", F.lit(rest)).alias("_new"))
    per_row = answer.groupBy("_row").agg(F.collect_list(F.struct("_at", "_new")).alias("_late"))
    late = open_rows.join(per_row, "_row").select(*keys, out, "_late")
    return done.unionByName(late.mapInArrow(fill, StructType([*fields, StructField(out, ArrayType(kind))])))


def special_id(vocab: DataFrame) -> int:
    """The id behind the last one of a whole vocabulary, for what is not in it."""
    last = vocab.agg(F.max("token_id")).first()[0]
    return 0 if last is None else last + 1


def encode(df: DataFrame, vocab: DataFrame, keys: list[str], text: str, unk: int | None = None) -> DataFrame:
    """AR-8: text -> ``token_ids``, row by row where the texts are read.

    Words outside the vocabulary get ``unk``, by default the id behind the last one. A null or blank
    text has no ids; repeated keys stay rows of their own.
    """
    return _swap(df, keys, text, True, vocab, "token_ids", special_id(vocab) if unk is None else unk)


def decode(
    df: DataFrame, vocab: DataFrame, keys: list[str], tokens: str, special: str = "<|endoftext|>"
) -> DataFrame:
    """AR-8: token ids -> ``text``, symbols joined by blanks; ids outside the vocabulary give ``special``."""
    return _swap(df, keys, tokens, False, vocab, "_symbols", special).select(
        *keys, F.array_join("_symbols", " ").alias("text")
    )


def embed_tokens(
    df: DataFrame,
    table: DataFrame,
    keys: list[str],
    tokens: str,
    token_id: str = "token_id",
    vec: str = "vec",
    unknown: str = "error",
) -> DataFrame:
    """JN-9: every token id replaced by its vector, order kept (``vectors``).

    An id that is not in the table fails the job and is named; ``unknown="null"`` puts NULL in its
    place. Rows without tokens, and null token arrays, keep their place with an empty list.
    The table is dealt by token id. Ids so frequent that one task would get a large share of all
    tokens (counted first, at most 8 per task) are split: their tokens are dealt over several tasks, each
    of which gets their vector. Nothing is hinted; a small table is broadcast by its measured size.
    """
    if unknown not in ("error", "null"):
        raise ValueError("unknown: 'error' or 'null'")
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(df.select(*keys, F.col(tokens).alias("_ids")).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    longform = rows.select("_row", F.posexplode("_ids").alias("_pos", "_id"))
    counts = settle(longform.groupBy("_id").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // (8 * tasks))
    hot = settle(counts.filter(F.col("n") > share).select(F.col("_id").alias("_hot")), "hot")  # fewer than 8 a task
    salted = longform.join(hot, F.col("_id") == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_row", "_pos"), F.lit(tasks))).otherwise(F.lit(0))
    )
    side = table.select(F.col(token_id).alias("_token"), F.col(vec).alias("_vec"))
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
    side = side.join(hot, F.col("_token") == F.col("_hot"), "left").select("_token", "_vec", F.explode(copies).alias("_part"))
    side = settle(side, "vectors")
    joined = salted.join(side, (F.col("_id") == F.col("_token")) & (F.col("_salt") == F.col("_part")), "left")
    kind = table.schema[vec].dataType
    found = F.col("_vec")
    if unknown == "error":
        name = F.coalesce(F.col("_id").cast("string"), F.lit("NULL"))
        fail = F.raise_error(F.concat(F.lit("token without a vector: "), name)).cast(kind)
        found = F.when(F.col("_token").isNull(), fail).otherwise(F.col("_vec"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", found.alias("_vec"))))
    lists = joined.groupBy("_row").agg(F.transform(ordered, lambda t: t["_vec"]).alias("vectors"))
    none = F.array().cast(ArrayType(kind))
    return rows.join(lists, "_row", "left").select(*keys, F.coalesce("vectors", none).alias("vectors"))


def pair_adjacent(
    df: DataFrame, by: list[str], line_no: str, tokens: str, mask: str | None = None
) -> DataFrame:
    """JN-11: rows 2k and 2k+1 joined into one, sequences and masks appended.

    The last row of an odd group stays alone. A pair has two rows, so nothing grows.
    """
    pair = F.floor(F.col(line_no) / F.lit(2)).cast("bigint").alias("pair_no")
    first = F.col(line_no) % 2 == 0

    def halves(c):
        empty = F.array().cast(dict(df.dtypes)[c])
        return F.concat(
            F.coalesce(F.any_value(F.when(first, F.col(c)), F.lit(True)), empty),
            F.coalesce(F.any_value(F.when(~first, F.col(c)), F.lit(True)), empty),
        ).alias(c)

    cols = [tokens] + ([mask] if mask else [])
    return df.groupBy(*by, pair).agg(F.count(F.lit(1)).alias("n_rows"), *[halves(c) for c in cols])


def collect_batches(*parts: DataFrame) -> DataFrame:
    """ST-1: batches of predictions or targets as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

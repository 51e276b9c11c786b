"""Balanced heads, pools, few-shot draws and seeded samples (SM, WN-1, WN-2, FL-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.keys import gumbel, key_int, order_key, uniform
from earshot.functions.vectors import bind, total
from earshot.operators.ranking import (
    attach,
    balanced_cut,
    bucketed_rank,
    head_cut,
    join_on,
    keep_head,
    key_bucket,
    line_bucket,
    rows_at_ranks,
)
from earshot.session import settle

# Up to this rank Spark limits the rows of a group in every task (its default setting).
WINDOW_LIMIT = 1000


def seeded_order(df: DataFrame, seed, id_col: str, out: str = "order_key") -> DataFrame:
    """SM-1: a shuffle key per row; ``seed`` is a number or a column."""
    return df.withColumn(out, order_key(seed, id_col))


def cap_rows(
    df: DataFrame, seed, n: int, id_col: str, one_more: bool = False, cell: list[str] = [], digits: int = 3
) -> DataFrame:
    """FL-6: the first ``n`` rows in shuffled order, of the table or of every ``cell``.

    ``seed`` is a number, or the name of a column when the order differs by cell.
    ``one_more=True`` keeps ``n + 1``, as evaluation in the original does (its stop
    test runs one row late). Rows that repeat an id count each.

    No cell is sorted whole. A table's cap plans as TakeOrderedAndProject. Up to 1,000 rows per
    cell, Spark turns the rank filter into a limit per task (WindowGroupLimit). Beyond,
    the n-th key of each cell is found by counts per bucket, and rows are compared with it; only
    rows of that one key, where it repeats, are ranked.
    """
    keep = n + 1 if one_more else n
    key = order_key(F.col(seed) if isinstance(seed, str) else seed, id_col)
    if not cell:
        return df.orderBy(key, F.col(id_col)).limit(keep)
    rows, order = df.withColumn("_key", key), ["_key", id_col]
    if keep <= WINDOW_LIMIT:
        w = Window.partitionBy(*cell).orderBy(*order)
        ranked = rows.withColumn("_rn", F.row_number().over(w))
        return ranked.filter(F.col("_rn") <= keep).select(*df.columns)
    cut = head_cut(rows, cell, order, key_bucket(F.col("_key"), digits), keep)
    known = join_on(rows, cut, cell, "left")
    here = F.struct(*order)
    below = known.filter(F.col("last").isNull() | (here < F.col("last")))
    w = Window.partitionBy(*cell).orderBy(F.xxhash64(*df.columns))
    edge = known.filter(here == F.col("last")).withColumn("_rn", F.row_number().over(w))
    return below.select(*df.columns).unionByName(edge.filter(F.col("_rn") <= F.col("_quota")).select(*df.columns))


def class_counts(df: DataFrame, label: str, cell: list[str] = []) -> DataFrame:
    """Rows per class, summed map-side first."""
    return df.groupBy(*cell, label).agg(F.count(F.lit(1)).alias("n"))


def chop_size(df: DataFrame, label: str, cell: list[str] = []) -> DataFrame:
    """AG-2: rows of the rarest class present, and how many classes are present."""
    return (
        class_counts(df, label, cell)
        .groupBy(*cell)
        .agg(F.min("n").alias("n_chop"), F.count(F.lit(1)).alias("n_classes"))
    )


def balanced_head(
    df: DataFrame,
    label: str,
    order: list[str],
    cell: list[str] = [],
    method: str = "buckets",
    digits: int | None = None,
) -> DataFrame:
    """WN-1: the first ``n_chop`` rows of every class, so that classes are equal in size.

    ``order`` starts with a hexadecimal hash key (SM-1) and ends with a unique id.
    ``method="buckets"`` finds the cut without sorting a class (see ``ranking``), in buckets
    that follow the size of each class, or of ``digits`` digits of the key;
    ``"window"`` is the plain form, for classes that fit one task.
    """
    group = [*cell, label]
    if method == "window":
        chop = chop_size(df, label, cell).drop("n_classes")
        w = Window.partitionBy(*group).orderBy(*order)
        ranked = attach(df.withColumn("_rn", F.row_number().over(w)), chop, cell)
        return ranked.filter(F.col("_rn") <= F.col("n_chop")).drop("_rn", "n_chop")
    if method != "buckets":
        raise ValueError("method: 'buckets' or 'window'")
    bucket = None if digits is None else key_bucket(F.col(order[0]), digits)
    cut = balanced_cut(df, label, order, bucket, cell)
    return keep_head(df, cut.drop("n_chop", "n_classes"), group, order)


def class_index(df: DataFrame, label: str, line_no: str, split: list[str] = []) -> DataFrame:
    """AG-1: label, class_id by order of first appearance, rows.

    The window runs over one row per label; a label is one token of the model's
    vocabulary, so there are at most 50,257.
    """
    per_label = df.groupBy(*split, label).agg(
        F.min(line_no).alias("first_line"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy(*split).orderBy("first_line")
    return per_label.withColumn("class_id", (F.row_number().over(w) - 1).cast("int"))


def balanced_pool(df: DataFrame, label: str, line_no: str, split: list[str] = []) -> DataFrame:
    """WN-2: candidates for few-shot examples with their ``pool_pos`` and the ``pool_n``.

    The first ``n_chop`` rows of each class in file order, classes one after another
    by first appearance; positions are arithmetic, no window over the pool. Pass key
    columns only: the pool is sorted in blocks. ``draw_examples`` does not need it.
    """
    group, bucket = [*split, label], line_bucket(F.col(line_no))
    cut = balanced_cut(df, label, [line_no], bucket, split)
    head = keep_head(df, cut, group, [line_no])
    ranked = bucketed_rank(head, group, [line_no], bucket, "_rn")
    classes = settle(class_index(df, label, line_no, split).select(*group, "class_id"), "classes")
    pos = F.col("class_id") * F.col("n_chop") + F.col("_rn") - 1
    return (
        join_on(ranked, classes, group)
        .withColumns(
            {"pool_pos": pos.cast("bigint"), "pool_n": F.col("n_chop") * F.col("n_classes")}
        )
        .drop("_rn", "class_id", "n_chop", "n_classes")
    )


def draw_plan(seeds: list[int], n_shot: int, n_repeat: int = 1) -> Column:
    """Array of (seed, repeat, draw): the draws of one example set per seed."""
    return F.array(
        *[
            F.struct(F.lit(s).alias("seed"), F.lit(r).alias("repeat"), F.lit(d).alias("draw"))
            for s in seeds
            for r in range(n_repeat)
            for d in range(n_shot)
        ]
    )


def draw_examples(
    df: DataFrame,
    label: str,
    line_no: str,
    n_shot: int,
    seeds: list[int],
    split: list[str] = [],
    n_repeat: int = 1,
) -> DataFrame:
    """SM-2: ``n_shot`` uniform draws with replacement from the balanced pool, per seed.

    The same draws serve every sample of a run; ``n_repeat`` lists the set again. A pool
    position says which class and which of its first rows is meant (WN-2), so the few
    drawn rows are looked up by rank: nothing but key columns is shuffled, and the wide
    columns of ``df`` are read for the drawn lines only.
    """
    if n_shot < 1 or n_repeat < 1 or not seeds:
        raise ValueError("nothing to draw: zero-shot runs have no examples")
    classes = settle(class_index(df, label, line_no, split), "classes")
    sizes = classes.groupBy(*split).agg(
        F.min("n").alias("_chop"), F.count(F.lit(1)).alias("_classes")
    )
    draws = sizes.select(
        *split, "_chop", "_classes", F.explode(draw_plan(seeds, n_shot, n_repeat)).alias("_d")
    ).select(*split, "_chop", "_classes", "_d.*")
    key = F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("draw").cast("string")))
    draws = draws.withColumn("pool_pos", key_int(key) % (F.col("_chop") * F.col("_classes")))
    draws = draws.select(
        *split,
        "seed",
        "repeat",
        "draw",
        "pool_pos",
        F.floor(F.col("pool_pos") / F.col("_chop")).cast("int").alias("class_id"),
        (F.col("pool_pos") % F.col("_chop") + 1).alias("_rank"),
    )
    group = [*split, label]
    wanted = join_on(draws, classes.select(*group, "class_id"), [*split, "class_id"])
    bucket = line_bucket(F.col(line_no))
    found = rows_at_ranks(df, group, [line_no], bucket, wanted.drop("class_id"))
    return join_on(df, settle(found, "draws"), [*group, line_no])


def gumbel_topk(
    df: DataFrame,
    group: list[str],
    logit: str,
    id_col: str,
    k: int,
    seed: int = 0,
    temperature: float = 1.0,
) -> DataFrame:
    """SM-5: weighted sampling without replacement, top ``k`` by (logit + noise) / temperature.

    Spark turns the rank filter into a limit per map task (WindowGroupLimit), so a hot
    group sends at most ``k`` rows per task through the shuffle.
    """
    score = (F.col(logit).cast("double") + gumbel(uniform(seed, id_col))) / F.lit(float(temperature))
    w = Window.partitionBy(*group).orderBy(F.col("perturbed").desc(), F.col(id_col))
    return (
        df.withColumn("perturbed", score)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def gumbel_softmax(logits, seed, id_col, temperature: float) -> Column:
    """SM-5 on an array of logits: softmax((logit + noise) / temperature) of one row."""
    c = F.col(logits) if isinstance(logits, str) else logits
    key = id_col if isinstance(id_col, Column) else F.col(id_col)

    def noisy(x, i):
        u = uniform(seed, F.concat(key.cast("string"), F.lit(":"), i.cast("string")))
        return (x.cast("double") + gumbel(u)) / F.lit(float(temperature))

    def soft(a):
        exps = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
        return bind(exps, lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))

    return bind(F.transform(c, noisy), soft)


def temperature_at(update, start: float = 2.0, floor: float = 0.5, decay: float = 0.999995):
    """SM-5: sampling temperature after ``update`` updates; defaults are fixed values."""
    u = F.col(update) if isinstance(update, str) else update
    return F.greatest(F.lit(start) * F.pow(F.lit(decay), u), F.lit(floor))

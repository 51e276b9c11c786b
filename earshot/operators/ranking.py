"""Ranks within a group without sorting the group in one task.

``row_number()`` partitioned by a label sorts all rows of that label in one task;
with two labels that is two tasks, however large the cluster. Here the rows of a
group fall into many ordered buckets first. Counting rows per bucket (with partial
aggregation) and adding up the counts gives every bucket's first rank, so only rows
of one bucket are ever sorted together. The results are the exact ranks.

Buckets must follow the order: every row of a lower bucket precedes every row of a
higher one. Bucket counts and cuts are small tables that are written before rows are
joined with them (``session.settle``), so calls here run jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.session import settle

# Rows per bucket when the order is a dense line number.
LINES_PER_BUCKET = 1 << 16


def key_bucket(key: Column, digits: int = 4) -> Column:
    """Bucket of a hexadecimal hash key: 16 ** digits buckets of equal expected size."""
    return F.substring(key, 1, digits)


def line_bucket(line_no: Column) -> Column:
    """Bucket of a unique line number: never more than LINES_PER_BUCKET rows."""
    return F.floor(line_no / F.lit(LINES_PER_BUCKET)).cast("bigint")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys; ``right``'s key columns are dropped.

    No broadcast hint: the runtime sizes decide, and AQE splits a hot key of a
    sort-merge join.
    """
    right = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys], F.lit(True)
    )
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach(rows: DataFrame, per_group: DataFrame, group: list[str]) -> DataFrame:
    """One-row-per-group values beside every row; without a group, scalar subqueries."""
    if group:
        return join_on(rows, per_group, group)
    return rows.select("*", *[per_group.select(c).scalar().alias(c) for c in per_group.columns])


def _offsets(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per (group, _bucket): rows in it and rows of the group before it."""
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    before = (
        Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))


def bucketed_rank(
    df: DataFrame, group: list[str], order: list[str], bucket: Column, out: str
) -> DataFrame:
    """``row_number()`` (1-based, BIGINT) of every row within ``group`` by ``order``."""
    rows = df.withColumn("_bucket", bucket)
    offsets = settle(_offsets(rows.select(*group, "_bucket"), group).drop("_in"), "offsets")
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_place", F.row_number().over(inner))
    return (
        join_on(ranked, offsets, [*group, "_bucket"])
        .withColumn(out, (F.col("_before") + F.col("_place")).cast("bigint"))
        .drop("_bucket", "_before", "_place")
    )


def _rows_at(
    narrow: DataFrame, offsets: DataFrame, group: list[str], order: list[str], wanted: DataFrame
) -> DataFrame:
    """The key columns of the rows at the ranks ``wanted`` (group, _rank, ...) asks for.

    Only the buckets that hold a wanted rank are sorted.
    """
    hits = (
        join_on(wanted, offsets, group)
        .filter(F.col("_rank").between(F.col("_before") + 1, F.col("_before") + F.col("_in")))
        .withColumn("_place", F.col("_rank") - F.col("_before"))
        .drop("_before", "_in", "_rank")
    )
    hits = settle(hits, "hits")
    keys = [*group, "_bucket"]
    inside = join_on(narrow, hits.select(*keys), keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    found = join_on(inside.withColumn("_place", place), hits, [*keys, "_place"])
    return found.drop("_bucket", "_place")


def rows_at_ranks(
    df: DataFrame, group: list[str], order: list[str], bucket: Column, wanted: DataFrame
) -> DataFrame:
    """Rows at given ranks of their group, found without ranking the group.

    ``wanted`` holds the group's columns, ``_rank`` (1-based) and any columns to carry;
    the result has the group's and the order's columns and the carried ones.
    """
    narrow = df.select(*group, *order, bucket.alias("_bucket"))
    return _rows_at(narrow, settle(_offsets(narrow, group), "offsets"), group, order, wanted)


def _in_buckets(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Key columns with a ``_bucket`` of the hash key ``order[0]``, as deep as the group is large.

    Groups are counted first: one of at most LINES_PER_BUCKET rows is one bucket, so a thousand small
    groups have a thousand buckets; each further digit splits a group into sixteen.
    """
    narrow = df.select(*group, *order)
    sizes = narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    digits = F.ceil(F.log(16.0, F.col("_n") / F.lit(LINES_PER_BUCKET)))
    depth = settle(sizes.select(*group, F.greatest(digits, F.lit(0)).cast("int").alias("_depth")), "depth")
    return join_on(narrow, depth, group).withColumn("_bucket", F.substr(order[0], F.lit(1), "_depth")).drop("_depth")


def balanced_cut(
    df: DataFrame, label: str, order: list[str], bucket: Column | None, cell: list[str] = []
) -> DataFrame:
    """Where to cut every class so that all classes of a cell keep ``n_chop`` rows.

    One row per (cell, class): ``last`` = the order key of its last kept row, ``n_chop``
    = rows of the cell's rarest class, ``n_classes``. Only key columns are read; rows
    are counted per bucket with partial aggregation, and one bucket per class is sorted.
    Without a ``bucket``, ``order`` starts with a hash key and buckets follow the classes' sizes.
    """
    group = [*cell, label]
    if bucket is None:
        narrow = _in_buckets(df, group, order)
    else:
        narrow = df.select(*group, *order, bucket.alias("_bucket"))
    offsets = settle(_offsets(narrow, group), "offsets")
    sizes = offsets.groupBy(*group).agg(F.sum("_in").alias("_n"))
    chop = sizes.groupBy(*cell).agg(
        F.min("_n").alias("n_chop"), F.count(F.lit(1)).alias("n_classes")
    )
    wanted = attach(sizes.drop("_n"), chop, cell).withColumn("_rank", F.col("n_chop"))
    last = _rows_at(narrow, offsets, group, order, wanted)
    return settle(
        last.select(*group, F.struct(*order).alias("last"), "n_chop", "n_classes"), "cut"
    )


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows sorted over all tasks by one range shuffle, written with their task and place in it.

    ``order`` should be unique: rows that compare equal go to one task.
    """
    rows = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    return rows.withColumns({"_task": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})


def _starts(rows: DataFrame, n: Column) -> DataFrame:
    """Sum of ``n`` over the tasks before each task: one row per task."""
    sums = rows.groupBy("_task").agg(F.sum(n).alias("_in"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return settle(sums.select("_task", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start")), "starts")


def dense_ids(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Numbers 0, 1, 2 ... over the whole table by ``order`` (BIGINT), without a window over it."""
    rows = _sorted(df, order)
    numbered = rows.join(_starts(rows, F.lit(1)), "_task").withColumn(out, F.col("_start") + F.col("_at"))
    return numbered.drop("_at", "_task", "_start")


def rows_before(df: DataFrame, value: str, out: str = "before") -> DataFrame:
    """Distinct values with ``n`` rows each and how many rows of the table have a smaller one."""
    rows = _sorted(df.groupBy(value).agg(F.count(F.lit(1)).alias("n")), [F.col(value)])
    place = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_before", F.coalesce(F.sum("n").over(place), F.lit(0)))
    return (
        inside.join(_starts(rows, F.col("n")), "_task")
        .withColumn(out, (F.col("_start") + F.col("_before")).cast("bigint"))
        .drop("_at", "_task", "_start", "_before")
    )


def head_cut(df: DataFrame, group: list[str], order: list[str], bucket: Column, n: int) -> DataFrame:
    """Where to cut groups of more than ``n`` rows: the group's columns, ``last``, ``_quota``.

    ``last`` is the order key of the n-th row and ``_quota`` how many rows of that very key
    belong to the head (more than one where keys repeat). Groups of at most n rows are left out.
    """
    narrow = df.select(*group, *order, bucket.alias("_bucket"))
    offsets = settle(_offsets(narrow, group), "offsets")
    sizes = offsets.groupBy(*group).agg(F.sum("_in").alias("_n")).filter(F.col("_n") > n)
    last = _rows_at(narrow, offsets, group, order, sizes.select(*group, F.lit(n).alias("_rank")))
    last = settle(last.select(*group, F.struct(*order).alias("last")), "last")
    lower = join_on(narrow, last, group).filter(F.struct(*order) < F.col("last"))
    before = settle(lower.groupBy(*group).agg(F.count(F.lit(1)).alias("_lower")), "lower")
    return settle(
        join_on(last, before, group, "left").select(
            *group, "last", (F.lit(n) - F.coalesce("_lower", F.lit(0))).alias("_quota")
        ),
        "cut",
    )


def keep_head(df: DataFrame, cut: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows up to their group's cut, with the cut's other columns.

    The cut table has one row per class: when it is small enough to broadcast, the wide
    rows are neither shuffled nor sorted.
    """
    return join_on(df, cut, group).filter(F.struct(*order) <= F.col("last")).drop("last")

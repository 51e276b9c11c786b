"""Quality rules and robust multivariate outliers, with DataFrame functions only.

The minimum covariance determinant of every group is found by concentration steps: start from medians,
then again and again take the share of rows that lies nearest and estimate centre and covariance from
them. A step reads the statistics once: distances are counted on a fixed grid together with the sums a
covariance needs, so no group is sorted or gathered, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import SPACE, columns_free, settle

WINDOW = 8
GRID = 64  # cells of the distance grid per power of two
MEDIAN_GRID = 256  # cells per unit for medians
#: Spreads to start from; they order the rows of the first step, later ones use what is estimated.
START = {"log_words": 1.5, "word_length": 0.5, "symbols": 0.6, "dup_lines": 0.8, "repeats": 0.8}
#: Fixed values for five statistics: nearest share, factor that makes its covariance that of a normal
#: distribution, and the chi-square value that one normal row in 100,000 passes.
SHARE, FACTOR, CUTOFF = 0.75, 1.37, 30.86
#: Least spread of any statistic, a number for all of them: where a group is constant, the cutoff then lies 1.39
#: away (a fourth of the words, four times as many, or rates above 3 in 100 words where there are none).
LEAST = 0.25
NAMES = list(START)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more; windows are compared by 64-bit hash."""

    def windows(w: Column) -> Column:
        # single places are looked up: a slice would copy the whole array for every window
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(s: Column) -> Column:
        same = lambda k, o: F.coalesce(F.get(s, k + o)["h"] == F.get(s, k)["h"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (same(k, -1) | same(k, 1)).alias("r"))), lambda x: x["r"]), lambda x: x["i"]))
        add = lambda t, p: F.struct((t["n"] + F.least(F.lit(WINDOW), p - t["last"])).alias("n"), p.alias("last"))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, add, lambda t: t["n"])

    def counted(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(order, covered))

    return F.when(F.size(words) < WINDOW, 0).otherwise(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), counted))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); null texts have none of anything."""
    columns_free(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_w")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumn("_w", F.filter(F.split(t, SPACE, -1), lambda w: w != ""))
    long = lambda c: c.cast("long")
    return rows.withColumns(
        {
            "n_words": long(F.size("_w")),
            "word_chars": long(F.length(F.array_join("_w", ""))),
            "n_symbols": long(F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))),
            "n_dup_lines": long(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
            "n_repeat_words": long(_repeat_words(F.col("_w"))),
        }
    ).drop("_w")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c: F.log1p(100 * F.col(c) / n)
    return {
        "log_words": F.log(n),
        "word_length": F.col("word_chars") / n,
        "symbols": rate("n_symbols"),
        "dup_lines": rate("n_dup_lines"),
        "repeats": rate("n_repeat_words"),
    }


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``_d``, the squared Mahalanobis distance, by forward substitution with the group's factor."""
    total = F.lit(0.0)
    for i, a in enumerate(NAMES):
        z = F.col(a) - F.col(f"c{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return rows.withColumn("_d", total)


def _factor(moments: DataFrame) -> DataFrame:
    """Centre and Cholesky factor from n, sums s and sums of products q."""
    p, n = len(NAMES), F.col("n")
    rows = moments.withColumns({f"c{i}": F.col(f"s{i}") / n for i in range(p)})
    for i in range(p):
        for j in range(i + 1):
            v = FACTOR * (F.col(f"q{i}{j}") / n - F.col(f"c{i}") * F.col(f"c{j}"))
            if i == j:
                v = F.greatest(v, F.lit(LEAST**2))
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-6))) if i == j else v / F.col(f"l{j}{j}"))
    return rows.select("g", *[f"c{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _medians(rows: DataFrame) -> DataFrame:
    """Start: medians on a grid, and fixed spreads."""
    cells = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(a) * MEDIAN_GRID).cast("long").alias("v")) for i, a in enumerate(NAMES)])).alias("x"))
    cells = cells.groupBy("g", F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("g", "i")
    cells = cells.withColumn("upto", F.sum("n").over(by.orderBy("v"))).withColumn("all", F.sum("n").over(by))
    half = cells.filter(2 * F.col("upto") >= F.col("all")).groupBy("g", "i").agg((F.min("v") / MEDIAN_GRID).alias("m"))
    p = len(NAMES)
    centre = half.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"c{i}") for i in range(p)])
    return centre.withColumns({f"l{i}{j}": F.lit(START[NAMES[i]] if i == j else 0.0) for i in range(p) for j in range(i + 1)})


def estimates(rows: DataFrame, steps: int = 5) -> DataFrame:
    """Centre and factor of every group ``g`` of rows that hold the statistics; one row per group."""
    p = len(NAMES)
    sums = {f"s{i}": F.col(a) for i, a in enumerate(NAMES)} | {f"q{i}{j}": F.col(NAMES[i]) * F.col(NAMES[j]) for i in range(p) for j in range(i + 1)}
    now = settle(_medians(rows), "centres")
    for _ in range(steps):
        near = _distance(rows.join(now, "g")).withColumn("b", F.floor(F.log2(1 + F.col("_d")) * GRID))
        cells = near.groupBy("g", "b").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
        by = Window.partitionBy("g")
        cells = cells.withColumn("upto", F.sum("n").over(by.orderBy("b")) - F.col("n")).withColumn("all", F.sum("n").over(by))
        used = cells.filter(F.col("upto") < SHARE * F.col("all"))
        now = settle(_factor(used.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums])), "centres")
    return now


def quality(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), least: int = 50) -> DataFrame:
    """Adds the base statistics, ``base_failed``, ``distance`` (squared, null where there is none) and ``kept``.

    Rows that pass the base rules are measured against their group (null values form groups of their own;
    groups of fewer than ``least`` rows are put together). A row is kept when it passes the base rules and
    its distance is at most the cutoff; where even the small groups together have fewer than ``least``
    rows, passing rows are kept. Rows that repeat count as often as they stand there. The statistics are
    written, so texts are read once and carried along; other columns stay.
    """
    columns_free(docs, "base_failed", "distance", "kept", "g", "_g", *NAMES)
    base = statistics(docs, text).withColumn("base_failed", base_failed()).drop(text)
    key = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"k{i}") for i, c in enumerate(groups)]))
    base = settle(base.withColumn("_g", key).withColumns(_vector()), "statistics")
    passed = base.filter("not base_failed")
    size = passed.groupBy("_g").agg(F.count("*").alias("n"))
    size = settle(size.withColumn("g", F.when(F.col("n") < least, "rest").otherwise(F.col("_g"))).select("_g", "g"), "groups")
    rows = passed.join(size, "_g")
    found = estimates(rows)
    enough = settle(rows.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(found, "g").drop("n"), "estimates")
    far = _distance(base.join(size, "_g", "left").join(enough, "g", "left"))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUTOFF))
    extra = [c for c in docs.columns if c != text]
    return far.withColumn("distance", F.when(~F.col("base_failed"), F.col("_d"))).select(
        *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept")
    )

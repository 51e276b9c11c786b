"""Hard negatives by exact integer inner products of packed vectors.

Components are whole numbers. Several candidates' components are biased to be non-negative and put into
separated fields of one wide integer; multiplying it once by a component of the anchor multiplies them
all, and sums over the components stay inside their fields, so exact scores are read off. Words of 53 bits
are held in doubles, which represent them exactly, so that the products over all components are one matrix
product; where two fields do not fit into 53 bits, words are Python integers of any width.

Anchors meet candidates block by block: blocks of anchors are dealt out over a fixed number of splits of
the candidates, and a task holds one block of anchors with the best rows found so far while candidates
stream past. What leaves a task is a bounded list per anchor, so rows grow with the anchors.

Odd rows: rows without id, label or vector, and vectors with a null, NaN or infinite component, take no part.
A row never meets rows of its own id; rows that repeat an id take part each, and an anchor that is
repeated is mined each time. Ties go to the smaller id. Vectors of different lengths do not meet. Scores that
do not fit 64 bits stop the job. No anchors, no positives or an empty table give an empty table. Other
columns are left out, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import settle

BLOCK = 1024  # candidates in a block
ANCHORS = 1 << 16  # anchors that a task holds
SPLITS = 16  # parts of the candidates
STRIP = 256  # anchors scored at a time
EXACT = 53  # bits that a double holds exactly
NONE = -(1 << 63)

ROWS = "row long, vec_id long, label long, vector array<double>"
BLOCKS = "block long, dim int, n int, rows binary, ids binary, labels binary, vectors binary, kind string, bounds binary"


def packed_products(candidates, anchors):
    """Exact inner products (anchors x candidates) of integer-valued matrices of doubles; int64.

    Raises OverflowError where a score does not fit 64 bits.
    """
    (n, d), m = candidates.shape, len(anchors)
    if not n or not m or not d:
        return np.zeros((m, n), np.int64)
    low_c, low_a = int(candidates.min()), int(anchors.min())
    high_c, high_a = int(candidates.max()) - low_c, int(anchors.max()) - low_a
    field = max(1, (d * high_c * high_a).bit_length())
    sum_c = d * max(abs(low_c), abs(low_c + high_c)) * max(abs(low_a), abs(low_a + high_a))
    if 2 * field <= EXACT and sum_c < 1 << 62:
        fields = EXACT // field
        words = -(-n // fields)
        biased = np.zeros((words * fields, d))
        biased[:n] = candidates - low_c
        wide = np.zeros((words, d))
        for k in range(fields):
            wide += biased[k * words : (k + 1) * words] * float(1 << (field * k))
        product = ((anchors - low_a) @ wide.T).astype(np.int64)
        mask = (1 << field) - 1
        out = np.concatenate([(product >> (field * k)) & mask for k in range(fields)], axis=1)[:, :n]
        # undo both biases: sum (c - lc)(a - la) = sum ca - la sum c - lc sum a + d lc la
        sums_c, sums_a = (x.astype(np.int64).sum(axis=1) for x in (candidates, anchors))
        out += low_a * sums_c[None, :] + low_c * sums_a[:, None]
        return out - d * low_c * low_a
    fields = 8
    words = -(-n // fields)
    whole_c = [[int(x) for x in row] for row in candidates]
    whole_a = [[int(x) for x in row] for row in anchors]
    wide = [[sum((row[j] - low_c) << (field * k) for k, row in enumerate(whole_c[w::words])) for j in range(d)] for w in range(words)]
    mask = (1 << field) - 1
    out = np.zeros((m, n), np.int64)
    for i, a in enumerate(whole_a):
        ones = [x - low_a for x in a]
        shift = low_c * sum(a) - d * low_c * low_a
        for w, word in enumerate(wide):
            product = sum(x * y for x, y in zip(ones, word, strict=True))
            for k in range(w, n, words):
                out[i, k] = ((product >> (field * (k // words))) & mask) + low_a * sum(whole_c[k]) + shift
    return out


class Best:
    """The first ``size`` (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.scores = np.full((slots, size), NONE, np.int64)
        self.ids = np.zeros((slots, size), np.int64)

    def add(self, slots, scores, ids) -> None:
        """``scores`` (slots x candidates) where NONE stands for rows that do not count."""
        if scores.shape[1] > self.size:
            # what cannot be among the first of the block need not be sorted
            nth = np.partition(scores, -self.size, axis=1)[:, -self.size]
        else:
            nth = np.full(len(slots), NONE)
        least = np.maximum(nth, self.scores[slots, -1])
        at, k = np.nonzero((scores >= least[:, None]) & (scores > NONE))
        if not len(at):
            return
        old_at, old_k = np.nonzero(self.scores[slots] > NONE)
        touched = np.zeros(len(slots), bool)
        touched[at] = True
        keep = touched[old_at]
        old_at, old_k = old_at[keep], old_k[keep]
        where = np.concatenate([old_at, at])
        score = np.concatenate([self.scores[slots[old_at], old_k], scores[at, k]])
        name = np.concatenate([self.ids[slots[old_at], old_k], ids[k]])
        order = np.lexsort((name, -score, where))
        where, score, name = where[order], score[order], name[order]
        first = np.searchsorted(where, where)
        place = np.arange(len(where)) - first
        good = place < self.size
        rows = slots[np.flatnonzero(touched)]
        self.scores[rows] = NONE
        self.scores[slots[where[good]], place[good]] = score[good]
        self.ids[slots[where[good]], place[good]] = name[good]


def _blocks(rows: DataFrame, size: int, bounds: int) -> DataFrame:
    """Rows of numbers as blocks of packed arrays; ``bounds`` scores per row are carried along."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for b in batches:
            lists = b.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            dims, flat = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)
            whole = [b.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in range(3)]
            told = b.column(4).values.to_numpy(zero_copy_only=False).astype("<i8")[b.column(4).offsets[0].as_py() :].reshape(-1, bounds) if bounds else np.zeros((len(b), 0), "<i8")
            out = []
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                for lo in range(0, len(mine), size):
                    some = mine[lo : lo + size]
                    v = flat[(ends[some][:, None] + np.arange(dim)[None, :]).ravel()].reshape(len(some), dim)
                    top = np.abs(v).max() if v.size else 0
                    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
                    out.append((at, dim, len(some), *[w[some].tobytes() for w in whole], v.astype(kind).tobytes(), kind, told[some].tobytes()))
                    at += 1
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
                names = ["block", "dim", "n", "rows", "ids", "labels", "vectors", "kind", "bounds"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, BLOCKS)


def _meet(anchors: DataFrame, candidates: DataFrame, groups: int, size: int, slots: int, task, schema: str) -> DataFrame:
    """Blocks of anchors and of candidates brought together: a part per group of anchors and split of candidates.

    ``task(held)`` gives a function for the candidates' blocks and one that ends the part; candidates come
    after the anchors of their part and are not held.
    """
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    split = F.pmod(F.xxhash64("block"), F.lit(SPLITS)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.select("*", F.lit(0).alias("role"), group.alias("g")).select("*", every(SPLITS).alias("s"))
    c = candidates.select("*", F.lit(1).alias("role"), split.alias("s")).select("*", every(groups).alias("g"))
    both = a.unionByName(c).withColumn("part", F.col("g") * SPLITS + F.col("s")).drop("g", "s")
    columns = both.columns

    def run(batches):
        part, held, work = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part:
                    if work:
                        yield from work.end()
                    part, held, work = r["part"], [], None
                names = [np.frombuffer(r[c], "<i8") for c in ("rows", "ids", "labels")]
                vectors = np.frombuffer(r["vectors"], r["kind"]).reshape(r["n"], r["dim"]).astype(np.float64)
                if r["role"] == 0:
                    held.append((*names, vectors, np.frombuffer(r["bounds"], "<i8").reshape(r["n"], -1)))
                else:
                    if work is None and held:
                        work = task(held, size, slots)
                    if work:
                        work.add(*names[1:], vectors)
        if work:
            yield from work.end()

    dealt = both.select(*columns).repartition(groups * SPLITS, "part").sortWithinPartitions("part", "role")
    return dealt.mapInArrow(run, schema)


class _Work:
    """Anchors of a part, by vector length, and what they have found."""

    def __init__(self, held, size: int, slots: int):
        self.size, self.slots = size, slots
        self.sets = {}
        for dim in {h[3].shape[1] for h in held}:
            mine = [h for h in held if h[3].shape[1] == dim]
            joined = [np.concatenate([h[k] for h in mine]) for k in range(5)]
            self.sets[dim] = (*joined, Best(len(joined[0]) * slots, size))
        self.waiting: dict[int, list] = {}

    def add(self, ids, labels, vectors) -> None:
        dim = vectors.shape[1]
        if dim not in self.sets:
            return
        rest = self.waiting.setdefault(dim, [])
        rest.append((ids, labels, vectors))
        if sum(len(r[0]) for r in rest) >= BLOCK:
            self.flush(dim)

    def flush(self, dim: int) -> None:
        rest = self.waiting.pop(dim, None)
        if not rest:
            return
        ids, labels, vectors = (np.concatenate([r[k] for r in rest]) for k in range(3))
        _, own_ids, own_labels, own, bounds, best = self.sets[dim]
        for lo in range(0, len(own_ids), STRIP):
            hi = min(lo + STRIP, len(own_ids))
            scores = packed_products(vectors, own[lo:hi])
            other = own_ids[lo:hi, None] != ids[None, :]
            same = own_labels[lo:hi, None] == labels[None, :]
            self.score(best, np.arange(lo, hi), scores, same, other, bounds[lo:hi], ids)

    def lists(self):
        import pyarrow as pa

        for dim in list(self.waiting):
            self.flush(dim)
        for rows, ids, _, _, _, best in self.sets.values():
            at, place = np.nonzero(best.scores > NONE)
            for lo in range(0, len(at), 1 << 16):
                k, p = at[lo : lo + (1 << 16)], place[lo : lo + (1 << 16)]
                owner, slot = k // self.slots, k % self.slots
                yield [pa.array(x) for x in (rows[owner], ids[owner], slot.astype(np.int32), best.ids[k, p], best.scores[k, p])]


class Positives(_Work):
    def score(self, best, at, scores, same, other, bounds, ids) -> None:
        best.add(at, np.where(same & other, scores, NONE), ids)

    def end(self):
        import pyarrow as pa

        for cols in self.lists():
            yield pa.RecordBatch.from_arrays(cols, names=["row", "anchor_id", "slot", "id", "score"])


class Negatives(_Work):
    def score(self, best, at, scores, same, other, bounds, ids) -> None:
        for k in range(self.slots):
            low, high = bounds[:, 2 * k], bounds[:, 2 * k + 1]
            good = ~same & other & (scores >= low[:, None]) & (scores <= high[:, None])
            best.add(at * self.slots + k, np.where(good, scores, NONE), ids)

    end = Positives.end


FOUND = "row long, anchor_id long, slot int, id long, score long"


def _first(found: DataFrame, n: int) -> DataFrame:
    """The first n of each (row, slot) over all parts, with their place from 1."""
    w = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    scale: int = 256,
    low: int = 30,
    high: int = 90,
    anchors_held: int = ANCHORS,
) -> DataFrame:
    """``vec_id, embedding, label`` -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x). An anchor's positives are its first ``positives`` other rows
    of the same label; a positive's negatives are the first ``negatives`` rows of other labels whose score lies
    between ``low`` and ``high`` per cent of the positive's. Anchors against all rows, in blocks.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("double"))
    whole = F.transform("embedding", lambda v: v.cast("double") * scale)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    beyond = F.exists(whole, lambda v: F.abs(v) >= float(1 << 62))
    exact = F.when(beyond, F.raise_error(F.lit("a component does not fit 64 bits")).cast("array<double>")).otherwise(x)
    good = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(finite)
    rows = good.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"), exact.alias("vector"), is_anchor.alias("anchor"),
    )
    rows = settle(rows, "vectors")
    own = rows.filter("anchor").drop("anchor")
    groups = max(1, -(-own.count() // anchors_held))
    candidates = settle(_blocks(rows.drop("anchor"), BLOCK, 0), "candidates")
    none = F.array().cast("array<long>")

    firsts = _first(_meet(_blocks(own.withColumn("told", none), STRIP, 0), candidates, groups, positives, 1, Positives, FOUND), positives)
    firsts = settle(firsts.select("row", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # bounds of a missing positive let nothing through; whole numbers, so the limits are rounded inwards
    part = lambda p: F.col("positive_score").cast("decimal(20,0)") * p / 100
    bound = F.array(F.ceil(part(low)).cast("long"), F.floor(part(high)).cast("long"))
    listed = firsts.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", bound.alias("b")))).alias("b"))
    shut = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    told = F.flatten(F.array(*[F.coalesce(F.try_element_at("b", F.lit(k + 1)), shut) for k in range(positives)]))
    asked = own.join(listed, "row").select(*own.columns, told.alias("told"))
    found = _first(_meet(_blocks(asked, STRIP, 2 * positives), candidates, groups, negatives, positives, Negatives, FOUND), negatives)
    return (
        found.withColumn("slot", F.col("slot") + 1).withColumnRenamed("place", "rank")
        .join(firsts.withColumnRenamed("place", "slot"), ["row", "slot"])
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )

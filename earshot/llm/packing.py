"""Best-two-fit packing of documents into sequences, planned on the histogram of lengths.

Pieces of one length are alike, so the plan needs only how many there are of each: at most as many
numbers as a sequence has tokens, whatever the corpus. Every piece then finds its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import END_ID, settle
from earshot.llm.encoder import encoder, units

RANKS = 1 << 44  # room for the ranks of one length in a sorted key


def best_two_fit(counts, capacity: int):
    """Plan from ``counts[length]``: lists of (times, [lengths]) that use every piece once.

    A sequence is filled with the longest piece that fits, again and again. Where a gap is left, the
    smallest piece of the sequence is replaced by the two unpacked pieces that fill the widened gap
    best, if they fill more than it did. The pattern is repeated as long as its pieces last: the
    choices depend only on which lengths are left.
    """
    left = np.array(counts, dtype=np.int64)
    plan = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return plan
        upto = np.zeros(capacity + 1, dtype=np.int64)  # longest piece left of at most that length
        upto[have] = have
        upto = np.maximum.accumulate(upto)
        used: dict[int, int] = {}
        gap, at = capacity, capacity
        while gap and (x := int(upto[min(gap, at)])):
            n = min(gap // x, int(left[x]))
            used[x] = n
            gap -= n * x
            at = x - 1
        if gap and sum(used.values()) > 1:
            least = min(used)
            room = gap + least
            free = left.copy()
            for x, n in used.items():
                free[x] -= n
            have = np.flatnonzero(free)
            have = have[have < room]
            if len(have):
                upto = np.zeros(capacity + 1, dtype=np.int64)
                upto[have] = have
                upto = np.maximum.accumulate(upto)
                mate = upto[room - have]
                lone = (mate == have) & (free[have] < 2)
                mate = np.where(lone, upto[np.maximum(have - 1, 0)], mate)
                both = np.where(mate > 0, have + mate, 0)
                k = int(np.argmax(both))
                if both[k] > least:
                    used[least] -= 1
                    for x in (int(have[k]), int(mate[k])):
                        used[x] = used.get(x, 0) + 1
                    used = {x: n for x, n in used.items() if n}
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= times * n
        plan.append((times, [x for x in sorted(used, reverse=True) for _ in range(used[x])]))


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``doc_id, text``: doc_id, piece, start, length, ids, ids_crc32, chunk, rank.

    Null texts count as empty: one piece with the end id. Only documents of more than ``capacity``
    tokens are cut. ``chunk`` is the task, ``rank`` the piece's number among the task's pieces of its
    length; both hold once the pieces are written, which this does.
    """
    tail = end_id.to_bytes(4, "little")

    def cut(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        chunk, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                           ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("chunk", pa.int64()), ("rank", pa.int64())])
        enc, step = encoder(tokenizer), 4 * capacity
        for b in batches:
            for lo, hi in units(b.column(1)):
                out, some = [], b.slice(lo, hi - lo)
                for i, ids in zip(some.column(0).to_pylist(), enc.encode_column(some.column(1)), strict=True):
                    raw = ids.as_py() + tail
                    for k, p in enumerate(range(0, len(raw), step)):
                        part = raw[p : p + step]
                        n = len(part) // 4
                        out.append((i, k, p // 4, n, part, zlib.crc32(part), chunk, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, chunk long, rank long"
    )
    return settle(rows, "pieces")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``length, chunk, rank``.

    Sequences are gapless from offset 0 and hold at most ``capacity`` tokens. No rows: no sequences.
    Other columns are kept. Collects the histogram of lengths, at most ``capacity`` rows.
    """
    per_chunk = settle(pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = settle(
        per_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift")), "shifts"
    )
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    taken, keys, firsts, places, sequence = [0] * (capacity + 1), [], [], [], 0
    for times, lengths in best_two_fit(counts, capacity):
        offset = 0
        for x in lengths:
            keys.append(x * RANKS + taken[x])
            firsts.append(sequence)
            places.append(offset)
            taken[x] += times
            offset += x
        sequence += times
    order = np.argsort(keys, kind="stable")
    keys, firsts, places = (np.array(v, dtype=np.int64)[order] for v in (keys, firsts, places))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = length.to_numpy(np.int64) * RANKS + rank.to_numpy(np.int64)
        k = np.searchsorted(keys, key, side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[k] + key - keys[k], "offset": places[k]})

    placed = pieces.join(shifts, ["length", "chunk"]).withColumn("_at", place("length", F.col("rank") + F.col("_shift")))
    return placed.select(
        *[c for c in pieces.columns if c not in ("chunk", "rank")],
        F.col("_at.sequence_id").alias("sequence_id"),
        F.col("_at.offset").alias("offset"),
    )

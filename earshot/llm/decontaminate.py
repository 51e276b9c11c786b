"""Benchmark decontamination by greedy string tiling over word hashes.

The words of a text are hashed by Karp-Rabin sums of its bytes, and runs of words by sums of those.
Runs that a document shares with a test item are seeds; seeds in a row are matches, and tiling takes
the longest match that is free in both texts again and again. The share of an item that tiles cover
does not depend on their order, so reordered passages count in full.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import give_back

BASE = 0x9E3779B97F4A7C15 | 1
BLOCK_WORDS = 500_000  # words of the test set that a task holds at a time


def word_spans(text: str | None):
    """A text's bytes in lower case, and the first byte and size of every word.

    Words are runs of letters and digits; in ASCII, all else parts them.
    """
    import numpy as np

    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    alpha = np.zeros(256, dtype=bool)
    alpha[48:58] = alpha[97:123] = alpha[128:] = True
    inside = alpha[raw]
    # U+2010 to U+203A (dashes, quotes) and no-break blank, guillemets part words too
    for lead, second, third in ((0xE2, 0x80, True), (0xC2, 0xA0, False), (0xC2, 0xAB, False), (0xC2, 0xBB, False)):
        at = np.flatnonzero((raw[:-1] == lead) & (raw[1:] == second)) if len(raw) > 1 else []
        for k in range(3 if third else 2):
            inside[np.minimum(np.asarray(at, dtype=np.int64) + k, len(raw) - 1)] = False
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return raw, first, last - first


def span_hashes(raw, first, size):
    """Hashes of spans of bytes."""
    import numpy as np

    if not len(first):
        return np.array([], dtype=np.uint64)
    # Horner's rule for all spans at once, by place in the span
    h = np.full(len(first), 7, dtype=np.uint64)
    wide = raw.astype(np.uint64)
    open_ = np.arange(len(first))
    for k in range(int(size.max())):
        open_ = open_[size[open_] > k]
        h[open_] = (h[open_] ^ (h[open_] >> np.uint64(29))) * np.uint64(BASE) + wide[first[open_] + k] + np.uint64(1)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: str | None):
    """Hashes of a text's words in lower case."""
    return span_hashes(*word_spans(text))


def run_hashes(words, n: int):
    """Karp-Rabin hashes of all runs of n words."""
    import numpy as np

    if len(words) < n:
        return np.array([], dtype=np.uint64)
    m = len(words) - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h = h * np.uint64(BASE) + words[k : m + k]
    return h ^ (h >> np.uint64(31))


def tiles(seeds, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seed pairs (place in the item, place in the document).

    Every pair stands for a run of ``shortest`` equal words. Returns (item place, document place,
    length), longest first; ties go to the earlier place in the item, then in the document.
    """
    import numpy as np

    seeds = np.unique(np.asarray(seeds, dtype=np.int64).reshape(-1, 2), axis=0)
    diagonal = seeds[:, 1] - seeds[:, 0]
    order = np.lexsort((seeds[:, 0], diagonal))
    s, d = seeds[order], diagonal[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(s[:, 0]) != 1)])) if len(s) else []
    ends = np.append(new[1:], len(s)) if len(s) else []
    heap = [(-(int(b - a) + shortest - 1), int(s[a, 0]), int(s[a, 1])) for a, b in zip(new, ends, strict=True)]
    heapq.heapify(heap)
    item, doc, out = set(), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [i + k not in item and j + k not in doc for k in range(-n)]
        if all(free):
            item.update(range(i, i - n))
            doc.update(range(j, j - n))
            out.append((i, j, -n))
            continue
        start = None
        for k, f in enumerate([*free, False]):
            if f and start is None:
                start = k
            elif not f and start is not None:
                if k - start >= shortest:
                    heapq.heappush(heap, (start - k, i + start, j + start))
                start = None
    return out


def matched_items(docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.5) -> DataFrame:
    """Pairs of a document and a test item that it covers: doc_id, item_id, coverage, n_tiles, n_words.

    ``docs`` has ``doc_id, text``, ``benchmark`` has ``item_id, text``. A pair is returned when tiles of
    at least ``shortest`` words cover at least the share ``coverage`` of the item's words. Items with
    fewer than ``shortest`` words, null and empty texts match nothing. Rows that repeat give rows
    that repeat. The test set is read in blocks of words that fit a task, whatever its size; every block
    is held against all documents. Other columns are not used.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    sized = items.withColumn("_w", F.length("text") / 2 + 1)
    total = sized.agg(F.sum("_w")).first()[0] or 0
    blocks = max(1, int(total // BLOCK_WORDS) + 1)
    out = None
    for k in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("item_id", "text"), blocks) == k).select("item_id", "text")
        found = _against(docs, [(r["item_id"], r["text"]) for r in part.toLocalIterator()], shortest, coverage)
        out = found if out is None else out.unionAll(found)
    return out


def _against(docs: DataFrame, items: list, shortest: int, coverage: float) -> DataFrame:
    import numpy as np

    words = [word_hashes(t) for _, t in items]
    names, sizes = [i for i, _ in items], [len(w) for w in words]
    runs = [run_hashes(w, shortest) for w in words]
    hashes = np.concatenate([np.array([], dtype=np.uint64), *runs])
    owner = np.repeat(np.arange(len(items)), [len(r) for r in runs])
    place = np.concatenate([np.array([], dtype=np.int64), *(np.arange(len(r)) for r in runs)])
    order = np.argsort(hashes, kind="stable")
    hashes, owner, place = hashes[order], owner[order], place[order]
    words = None

    def match(batches):
        import pyarrow as pa

        kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("n_words", pa.int32())])
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not len(hashes):
                    break
                h = run_hashes(word_hashes(t.as_py()), shortest)
                lo = np.searchsorted(hashes, h)
                hit = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == h)
                if not len(hit):
                    continue
                hi = np.searchsorted(hashes, h[hit], side="right")
                pairs = defaultdict(list)
                for j, a, z in zip(hit.tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
                    for x in range(a, z):
                        pairs[owner[x]].append((place[x], j))
                for o, seeds in pairs.items():
                    found = tiles(seeds, shortest)
                    n = sum(f[2] for f in found)
                    if n >= coverage * sizes[o]:
                        out.append((i, names[o], n / sizes[o], len(found), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], schema=kinds)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(match, "doc_id long, item_id long, coverage double, n_tiles int, n_words int")

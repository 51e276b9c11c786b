"""Alignment of two tokenizers' tokens by their spans, and how often their ids meet in a corpus.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model. Both see a blank and the
text. Character offsets of A and spans of B are coarse cuts in the bytes; tokens that share a character
(parts of a multibyte character, byte-fallback pieces, pieces without surface) are told apart by the
bytes they decode to. Places where a token of A and a token of B both end cut the text into groups;
all A-B pairs of a group are links.

Both tokenizers cut before a blank that follows a character which is no white space, whatever stands
around it (A's pattern takes a blank only in front; no piece of B has a blank inside, which is checked), so
a text is the sum of such chunks, and chunks met before are looked up. Where that does not hold, or a chunk does not come back from its tokens, the text goes
through both tokenizers whole.

Odd rows: null and empty texts, and texts that do not come back from either tokenizer, have no tokens
(zeros and an empty group list). Repeated rows and repeated ids are documents of their own: rows are told
apart by a number of their own, ``row``. Very long texts are taken whole. Columns besides ``doc_id`` and
``text`` are left out. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from itertools import chain
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import kept, settle
from earshot.llm.encoder import slices

SPLIT = 15  # bits of a B id in a pair's key
HOT = 1_000_000  # pairs whose counts every task holds: at most 13 MB
_seam = re.compile(r"(?<=\S)(?= \s*\S)")
_CHUNKS = 600_000  # chunks met more than once that a task keeps
_ONCE = 1_500_000  # marks of chunks met once
BLANK = "▁"  # stands for a blank in pieces


def refined_ends(begin, end, lengths):
    """Byte ends of tokens from coarse byte spans and decoded lengths.

    A token closes a run where the next one begins at or after its end, and its end lies beyond the
    run before; so tokens that share a character form a run, and so do pieces without surface and the
    one that has it. Inside a run, ends follow from the lengths. None where the lengths do not fill a run.
    """
    n = len(end)
    if not n:
        return end
    free = np.flatnonzero(np.append(begin[1:] >= end[:-1], True))
    before = np.maximum.accumulate(np.concatenate([[0], end[free]]))[:-1]
    at = free[end[free] > before]
    total = np.cumsum(lengths)
    if not len(at) or at[-1] != n - 1 or not (total[at] == end[at]).all():
        return None
    run = np.searchsorted(at, np.arange(n))
    base = np.concatenate([[0], end[at[:-1]]])
    before = np.concatenate([[0], total[at[:-1]]])
    return base[run] + total - before[run]


#: What a chunk adds to a text: tokens of A, group list, keys of its linked pairs (32 bits, one for each
#: link), and (key, links) of groups with very many links. A plain tuple: the collector passes over it.
Chunk = tuple[int, str, bytes, tuple[tuple[int, int], ...]]
N_A, GROUPS, LINKS, MANY = map(itemgetter, range(4))


def chunks_of(a, b, cut_a, cut_b, stops) -> list[Chunk]:
    """Chunks from ids in order: ``cut_a``, ``cut_b`` say where each group ends, ``stops`` the last group of each chunk."""
    out = []
    i = j = g = 0
    name_a, name_b = list(map(str, a)), list(map(str, b))
    for stop in stops:
        first, parts, links, many = i, [], [], []
        for g in range(g, stop):
            p, q = cut_a[g], cut_b[g]
            if p == i + 1 and q == j + 1:
                links.append(a[i] << SPLIT | b[j])
                parts.append(name_a[i] + "|" + name_b[j])
            else:
                x, y = a[i:p], b[j:q]
                parts.append(",".join(name_a[i:p]) + "|" + ",".join(name_b[j:q]))
                if len(x) * len(y) <= 64:
                    links += [u << SPLIT | v for u in x for v in y]
                else:  # equal ids first: a long run of one token is one pair with a count
                    right = Counter(y).items()
                    many += [(u << SPLIT | v, m * w) for u, m in Counter(x).items() for v, w in right]
            i, j = p, q
        g = stop
        out.append((i - first, ";".join(parts), array("i", links).tobytes(), tuple(many)))
    return out


class Aligner:
    """Both tokenizers, the bytes of their tokens, and a bounded cache of chunks."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        self.bytes_a = [b""] * (max(self.a.get_vocab_size(), max(vocab.values()) + 1))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes([byte[c] for c in token])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(self.bytes_a) > 1 << 16 or len(pieces) > 1 << SPLIT:
            raise ValueError("vocabularies too large for a pair key")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # spans count bytes or characters, as the library has it
        self.in_bytes = max(self._spans("é é")[1]) == 5
        plain = all(BLANK not in p.lstrip(BLANK) for p in pieces)
        # A mark after a letter is a token of its own for A's pattern, and for B where no piece joins the two.
        joined = {p[i + 1] for p in pieces for i in range(len(p) - 1) if p[i].isalpha()}
        self.marks = {m: self._mark(m) for m in ",.;:!?" if m not in joined}
        kind = told.get("pre_tokenizer") or {}
        self.by_chunk = plain and told.get("normalizer") is None and kind.get("type") == "ByteLevel" and kind.get("use_regex")
        self.chunks: dict[str, Chunk] = {}
        self.once: set[int] = set()

    def _spans(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and ends of B's pieces; the immutable proto, or what newer releases put in its place."""
        try:
            found = self.b.encode(text, out_type="immutable_proto")
        except ValueError:
            found = self.b.encode(text, return_type="proto")
        pieces = found.pieces
        return [p.id for p in pieces], [p.end for p in pieces]

    def _tokens(self, whole: str):
        """Ids and byte ends of both tokenizers over ``whole``, which begins with a blank; None if bytes are lost."""
        raw = whole.encode()
        found = self.a.encode(whole, add_special_tokens=False)
        a = np.array(found.ids, np.int64)
        ids_b, end_b = self._spans(whole[1:])
        if b"".join([self.bytes_a[i] for i in found.ids]) != raw or b"".join([self.bytes_b[i] for i in ids_b]) != raw:
            return None
        place_a = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        b, end_b = np.array(ids_b, np.int64), np.array(end_b, np.int64)
        if len(raw) != len(whole):
            code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
            width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            start = np.concatenate([[0], np.cumsum(width)])
            place_a = start[place_a]
            if not self.in_bytes:
                end_b = start[end_b + 1] - 1
        ends_a = refined_ends(place_a[:, 0], place_a[:, 1], self.length_a[a])
        # B does not see the blank in front: its spans are one byte behind, its first piece has the blank.
        # Its pieces follow each other without gaps, those without surface begin and end at one place.
        begin_b = np.concatenate([[0], np.maximum.accumulate(end_b)[:-1]])
        ends_b = refined_ends(begin_b + 1, end_b + 1, self.length_b[b])
        if ends_a is None:
            ends_a = np.cumsum(self.length_a[a])
        if ends_b is None:
            ends_b = np.cumsum(self.length_b[b])
        return a, b, ends_a, ends_b

    def _mark(self, mark: str) -> Chunk:
        a = self.a.encode("a" + mark, add_special_tokens=False).ids[-1]
        b = self._spans("a" + mark)[0][-1]
        return chunks_of([a], [b], [1], [1], [1])[0]

    def _whole(self, text: str) -> Chunk | None:
        got = self._tokens(" " + text)
        if got is None:
            return None
        a, b, ends_a, ends_b = got
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        place = [np.searchsorted(e, cuts, side="right").tolist() for e in (ends_a, ends_b)]
        return chunks_of(a.tolist(), b.tolist(), *place, [len(cuts)])[0]

    def _learn(self, chunks: set[str]) -> dict[str, Chunk | None]:
        """Chunks not met before, through both tokenizers in one text; alone where that is not possible."""
        new: dict[str, Chunk | None] = {}
        rows, marked = set(), []
        for c in chunks:
            if c[-1].isspace() or len(c) > 1 << 16:
                new[c] = self._whole(c[1:])
            elif c[-1] in self.marks and c[-2].isalpha():
                marked.append(c)
                if c[:-1] not in self.chunks:
                    rows.add(c[:-1])
            else:
                rows.add(c)
        todo = sorted(rows)
        for lo in range(0, len(todo), 4000):
            some = todo[lo : lo + 4000]
            got = self._tokens("".join(some))
            if got is not None:
                a, b, ends_a, ends_b = got
                stop = np.cumsum([len(c.encode()) for c in some])
                cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
                stops = np.searchsorted(cuts, stop)
                if (cuts[stops] == stop).all():  # the last cut is the end of the text
                    place = [np.searchsorted(e, cuts, side="right").tolist() for e in (ends_a, ends_b)]
                    stops = (stops + 1).tolist()
                    new.update(zip(some, chunks_of(a.tolist(), b.tolist(), *place, stops), strict=True))
                    continue
            new.update((c, self._whole(c[1:])) for c in some)
        for c in marked:
            stem, mark = self.chunks.get(c[:-1]) or new[c[:-1]], self.marks[c[-1]]
            new[c] = stem and (stem[0] + mark[0], f"{stem[1]};{mark[1]}", stem[2] + mark[2], stem[3])
        if len(self.once) + len(new) > _ONCE:
            self.once.clear()
        marks = {hash(c): c for c, x in new.items() if x is not None and len(c) <= 64}
        again = marks.keys() & self.once
        if len(self.chunks) + len(again) > _CHUNKS:
            self.chunks.clear()
        self.chunks.update((marks[h], new[marks[h]]) for h in again)
        self.once.update(marks)
        return new

    def align(self, texts: list[str | None]) -> list[list[Chunk]]:
        """The chunks of each text; none for texts without tokens."""
        cut: list[list[str]] = []
        for t in texts:
            if not t or BLANK in t:
                cut.append([])
            else:
                cut.append(_seam.split(" " + t) if self.by_chunk else [" " + t])
        out = [list(map(self.chunks.get, cs)) for cs in cut]
        missing = {c for cs, found in zip(cut, out, strict=True) if None in found for c, x in zip(cs, found, strict=True) if x is None}
        if missing:
            new = self._learn(missing) if self.by_chunk else {c: self._whole(c[1:]) for c in missing}
            for k, found in enumerate(out):
                if None in found:
                    found = [new[c] if x is None else x for c, x in zip(cut[k], found, strict=True)]
                    out[k] = [] if None in found else found
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    return kept(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))


def linked(found: list[Chunk]):
    """Distinct linked pairs of a text's chunks, in order, and how often each is linked."""
    keys, times = np.unique(np.frombuffer(b"".join(map(LINKS, found)), np.int32), return_counts=True)
    rest = [m for c in found if c[3] for m in c[3]]
    if rest:
        more, weight = np.array(rest, np.int64).T
        both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, at, np.concatenate([times, weight]))
        return both.astype(np.int32), total
    return keys, times.astype(np.int64)


SPANS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<long>"


def align_spans(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, text`` -> row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``groups`` lists the groups as ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the document's distinct linked id
    pairs (A's id times 2**15 plus B's) and ``times`` how often each is linked. ``row`` counts
    the rows of a task: it holds once the table is written.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        both = aligner(path_a, path_b)
        for b in batches:
            names, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                counts, groups, pairs, times, ends = [], [], [], [], [0]
                for found in both.align(texts[lo:hi]):
                    listing = ";".join(map(GROUPS, found))
                    groups.append(listing)
                    keys, many = linked(found)
                    pairs.append(keys)
                    times.append(many)
                    ends.append(ends[-1] + len(keys))
                    # a group adds two ids and every comma one more
                    n_a, n_groups = sum(map(N_A, found)), listing.count(";") + 1 if found else 0
                    counts.append((n_a, listing.count(",") + 2 * n_groups - n_a, n_groups, int(many.sum())))
                stops = pa.array(ends, pa.int32())

                def listed(parts, kind, stops=stops):
                    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
                    return pa.ListArray.from_arrays(stops, pa.array(flat.astype(kind)))

                rows = np.arange(at, at + hi - lo)
                at += hi - lo
                cols = [pa.array(rows), names.slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in zip(*counts, strict=True)], pa.array(groups, pa.string()),
                        listed(pairs, np.int32), listed(times, np.int64)]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def pair_counts(spans: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is the highest of its A id)."""
    counts = settle(spans.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.shiftright("pair", SPLIT)
    highest = settle(counts.groupBy(a.alias("a")).agg(F.max("n").alias("most")), "highest")  # at most a row per A id
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def count_links(spans: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """Adds n_best and count_sum to written spans, and drops ``pairs, times``.

    Counts of the ``hot`` most frequent pairs (at most that many rows, whatever the corpus) are held
    by every task; the rest, pairs of few documents each, meet their counts in a join by pair.
    """
    spark = spans.sparkSession
    counts = settle(counts, "counts")
    levels = counts.groupBy("n").agg(F.count("*").alias("m"))
    # the least count of which all pairs and those above it are at most ``hot``
    size = counts.count()
    least = 0
    if size > hot:
        bucket = F.floor(F.log2("n") * 8).cast("int")  # few buckets; whole buckets are taken
        total = 0
        for r in levels.groupBy(bucket.alias("b")).agg(F.sum("m").alias("m"), F.min("n").alias("n")).orderBy(F.col("b").desc()).collect():
            if total + r["m"] > hot:
                break
            total, least = total + r["m"], r["n"]
        if not total:
            least = 1 << 62
    top = counts.filter(F.col("n") >= least).toArrow()
    pair = top.column("pair").to_numpy()
    order = np.argsort(pair)
    held = spark.sparkContext.broadcast(
        (pair[order], top.column("n").to_numpy()[order], top.column("best").to_numpy(zero_copy_only=False)[order])
    )

    def run(batches):
        import pyarrow as pa

        keys, n, best = held.value
        for b in batches:
            lists, times = b.column(1), b.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat, many = lists.values.to_numpy()[ends[0] : ends[-1]], times.values.to_numpy()[ends[0] : ends[-1]]
            owner = np.repeat(np.arange(len(lists)), np.diff(ends))
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            sums, bests = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
            np.add.at(sums, owner[hit], n[at[hit]] * many[hit])
            np.add.at(bests, owner[hit], many[hit] * best[at[hit]])
            miss = ~hit
            stops = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[miss], minlength=len(lists)))]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(stops, pa.array(x[miss])) for x in (flat, many)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums), pa.array(bests), *rest], names=["row", "_sum", "_best", "_pairs", "_times"])

    found = spans.select("row", "pairs", "times").mapInArrow(
        run, "row long, _sum long, _best long, _pairs array<int>, _times array<long>"
    )
    narrow = [c for c in spans.columns if c not in ("pairs", "times")]
    found = settle(found, "links")
    if size > hot:
        cold = found.select("row", F.explode(F.arrays_zip("_pairs", "_times")).alias("p")).select(
            "row", F.col("p._pairs").alias("pair"), F.col("p._times").alias("m")
        )
        late = cold.join(counts.filter(F.col("n") < least), "pair").select(
            "row", (F.col("n") * F.col("m")).alias("_sum"), F.when(F.col("best"), F.col("m")).otherwise(0).alias("_best")
        )
        found = found.select("row", "_sum", "_best").unionByName(late)
    sums = found.groupBy("row").agg(F.sum("_best").alias("n_best"), F.sum("_sum").alias("count_sum"))
    return spans.select(*narrow).join(sums, "row")

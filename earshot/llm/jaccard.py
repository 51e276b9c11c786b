"""N-gram Jaccard join with adaptive multi-match prefixes.

1. One pass over the texts: every document's set size and digest, and counts of shingles that occur
   twice or more in a block of a task. Equal sets form a class; classes are compared, not copies.
2. A prefix per class. Shingles are ordered by those counts, rare first. Two sets of the wanted
   similarity share m shingles of their prefixes when both are m - 1 longer than the plain prefix;
   each class takes the m whose estimated cost (postings to read, candidates to verify) is least, the
   largest where it has rare shingles enough, and a pair must share the smaller m of the two. So texts
   that share a rare shingle or two by chance do not hang together, however many texts there are.
3. Shingles that occur in two prefixes or more make candidates: pairs where the posting list is
   short, the whole list where it is long. What hangs together is a family. A large one is parted first: its
   sets are cut into so many parts that two which link must have an equal part, and only what hangs
   together by equal parts stays a family. One that is still large is parted into bands of set sizes, so wide that only neighbouring bands can link, and a band into tiles by the least
   prefix token, which near copies mostly share. Two tiles of bands that can link meet with their prefix
   tokens, as products of incidence matrices. A candidate must also pass the bound that the parity
   bitmaps of its two sets give: bits that differ are elements that only one set has. What hangs together
   by the rest is a cluster; only the sets of clusters are sent, each cluster a group of its own, and verified.
4. A cluster reports its components and each member's number of links, so no group of near copies is
   ever written out as pairs.

Shingles are compared by 64-bit hash, sets by 128-bit digest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import give_back, settle
from earshot.llm.components import components

HEAVY = 1 << 18  # shingles whose count is kept for the order; the order decides cost, never results
BLOCK = 1 << 21  # shingles of a task that are counted together
LONG_LIST = 64  # longer posting lists become families instead of pairs
TILE = 1024  # sets in a tile, on average; pairs of tiles are compared in strips
TILE_SHINGLES = 1 << 19  # and shingles
BANDS = 1 << 32  # tiles of a band, at most: a tile's number is the band's times this, and its place
CELLS = 1 << 20  # cells of the pair matrix that a task holds at a time
FEW = 16  # a shingle in at most m / FEW of m sets is added pair by pair, others in matrix products
MOST_MATCHES = 4
SMALL_SIDE = 1_000_000  # rows of ids that may be broadcast


def shingle_set(text: str | None, k: int):
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, none no shingle."""
    import numpy as np
    import xxhash

    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""  # bytes lower only A-Z, and part at the same blanks
    words = raw.split()
    n = len(words)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    x = h[: n - k + 1].copy()
    for j in range(1, k):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> np.uint64(32)))


def _digest(s) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(s) -> bytes:
    """Parity of the number of elements at each of 64 bits or more, a power of two not below the set's size."""
    import numpy as np

    bits = 64 << max(0, (len(s) - 1).bit_length() - 6)
    count = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


class Bounds:
    """Which pairs of sets can link, by their bitmaps and sizes; never rules out a pair that does.

    Every bit in which two bitmaps of one width differ stands for an element, or more, that only one
    of the sets has. The wider bitmap of a pair is folded to the width of the other.
    """

    def __init__(self, maps: list[bytes], n, percent: int):
        import numpy as np

        self.maps, self.n, self.percent = maps, n, percent
        self.width = np.array([len(m) for m in maps], dtype=np.int64)
        self.levels: dict[int, tuple] = {}

    def _folded(self, width: int) -> tuple:
        import numpy as np

        if width not in self.levels:
            at = np.flatnonzero(self.width >= width)
            rows = np.empty((len(at), width // 8), dtype=np.uint64)
            for k, i in enumerate(at):
                m = np.frombuffer(self.maps[i], dtype=np.uint64)
                rows[k] = np.bitwise_xor.reduce(m.reshape(-1, width // 8), axis=0)
            place = np.full(len(self.maps), -1, dtype=np.int64)
            place[at] = np.arange(len(at))
            self.levels[width] = rows, place
        return self.levels[width]

    def passed(self, a, b):
        """For pairs of places: whether they can link."""
        import numpy as np

        out, widths = np.zeros(len(a), dtype=bool), np.minimum(self.width[a], self.width[b])
        for width in np.unique(widths):
            rows, place = self._folded(int(width))
            pairs = np.flatnonzero(widths == width)
            step = max(1, 8 * CELLS // int(width))
            for lo in range(0, len(pairs), step):
                p = pairs[lo : lo + step]
                i, j = a[p], b[p]
                apart = np.bitwise_count(rows[place[i]] ^ rows[place[j]]).sum(axis=1, dtype=np.int64)
                both = self.n[i] + self.n[j]
                out[p] = 100 * (both - apart) >= self.percent * (both + apart)
        return out


def _surveyed(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: documents (id, n, x, y: digest, map) and shingle counts (n: count, x: shingle)."""

    def survey(batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("doc", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("map", pa.binary())])
        block, size = [], 0

        def counted():
            u, c = np.unique(np.concatenate(block), return_counts=True)
            u, c = u[c > 1].view(np.int64), c[c > 1]
            no = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), dtype=bool)), no, pa.array(c), pa.array(u), no, pa.nulls(len(u), pa.binary())], schema=kinds)

        for b in batches:
            ids, n, x, y, maps = b.column(0).to_pylist(), [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), k)
                d = _digest(s)
                n.append(len(s))
                x.append(d[0])
                y.append(d[1])
                maps.append(bitmap(s))
                block.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield counted()
                    block, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(ids)), pa.array(ids, pa.int64()), *(pa.array(v, pa.int64()) for v in (n, x, y)), pa.array(maps, pa.binary())], schema=kinds)
        if size:
            yield counted()
        block = []
        give_back()

    return settle(docs.mapInArrow(survey, "doc boolean, id long, n long, x long, y long, map binary"), "survey")


def _frequent(survey: DataFrame):
    """Hashes and counts of at most HEAVY shingles, the most frequent ones."""
    import numpy as np

    counts = settle(survey.filter("not doc").groupBy("x").agg(F.sum("n").alias("n")), "shingle-counts")
    level = F.floor(F.log2("n") * 16)
    rows, keep, total = counts.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect(), None, 0
    for r in sorted(rows, key=lambda r: -r["l"]):
        total += r["k"]
        if total > HEAVY:
            break
        keep = r["l"]
    if keep is None:
        return np.array([], dtype=np.uint64), np.array([], dtype=np.int64)
    found = counts.filter(level >= keep).toPandas()
    h, c = found["x"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _prefixes(docs: DataFrame, k: int, percent: int, heavy, counts) -> DataFrame:
    """Rows token, x (of the class), need, known: the prefix of every class a task meets.

    ``known`` tokens are among the frequent ones, so others have them too.
    """

    def prefix(batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("token", pa.int64()), ("x", pa.int64()), ("need", pa.int32()), ("known", pa.bool_())])
        seen = set()
        for b in batches:
            tokens, xs, known, needs, sizes, held = [], [], [], [], [], 0
            for t in b.column(1):
                s = shingle_set(t.as_py(), k)
                n = len(s)
                if not n or (d := _digest(s)) in seen:
                    continue
                seen.add(d)
                overlap = (percent * n + 99) // 100
                plain, most = n - overlap + 1, min(MOST_MATCHES, overlap)
                long = plain + most - 1
                f = np.zeros(n, dtype=np.int64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    hit = heavy[at] == s
                    f[hit] = counts[at[hit]]
                rare = s[f == 0]
                if len(rare) >= long:
                    # rare ones beyond the counts kept still meet by chance, more often in a larger corpus; the most matches cost a few postings
                    p, need = rare[:long], most
                    often = np.zeros(len(p), dtype=bool)
                else:
                    order = np.lexsort((s, f))[:long]
                    scan = np.cumsum(f[order])[plain - 1 :]
                    ways = np.arange(1, most + 1)
                    need = int(np.argmin(plain + ways + scan * (1 + n / (8 * ways)))) + 1
                    p = s[order[: plain + need - 1]]
                    often = f[order[: plain + need - 1]] > 0
                tokens.append(p)
                sizes.append(len(p))
                xs.append(d[0])
                known.append(often)
                needs.append(need)
                held += len(p)
                if held > 1 << 18:
                    yield _batch(tokens, xs, known, needs, sizes, kinds)
                    tokens, xs, known, needs, sizes, held = [], [], [], [], [], 0
            if tokens:
                yield _batch(tokens, xs, known, needs, sizes, kinds)
        give_back()

    def _batch(tokens, xs, known, needs, sizes, kinds):
        import numpy as np
        import pyarrow as pa

        rep = lambda v, t: pa.array(np.repeat(np.array(v, dtype=t), sizes))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), rep(xs, np.int64), rep(needs, np.int32), pa.array(np.concatenate(known))], schema=kinds)

    return docs.mapInArrow(prefix, "token long, x long, need int, known boolean")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """Sets of members: rows text, x, y and ``info``; the set where the digest is the text's own."""

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            names = b.schema.names
            at = [names.index(c) for c in ("text", "x", "y")]
            info = [i for i in range(len(names)) if i not in at]
            size = 0
            keep, found = [], []
            for r, (t, x, y) in enumerate(zip(*(b.column(i) for i in at), strict=True)):
                s = shingle_set(t.as_py(), k)
                if _digest(s) == (x.as_py(), y.as_py()):
                    keep.append(r)
                    found.append(s.tobytes())
                    size += 8 * len(s)
                if size > 1 << 23 or r == b.num_rows - 1:
                    rows = b.take(pa.array(keep, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in info), pa.array(found, pa.binary())], names=[*(names[i] for i in info), "shingles"])
                    size, keep, found = 0, [], []
        give_back()

    rest = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name not in ("text", "x", "y")]
    return texts.mapInArrow(sets, ", ".join([*rest, "shingles binary"]))


def _digested(texts: DataFrame, k: int) -> DataFrame:
    """Adds the digest x, y to rows of a text."""

    def digested(batches):
        import pyarrow as pa

        for b in batches:
            d = [_digest(shingle_set(t.as_py(), k)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64())], names=["text", "x", "y"])

    return texts.mapInArrow(digested, "text string, x long, y long")


def _band(n, percent: int):
    """Bands of sizes, numbers or a column: sets can link only if theirs are the same or neighbours."""
    # a little wider than the logarithm of the largest ratio of sizes, so that rounding parts no pair
    width = 1.000001 * math.log(100 / percent) if percent < 100 else 0
    if not isinstance(n, int):
        return F.floor(F.log(n) / width) if width else n
    return math.floor(math.log(n) / width) if width else n


def _most_in(band: int, percent: int) -> int:
    """A size that no set of the band exceeds."""
    return math.ceil(math.exp((band + 1) * 1.000001 * math.log(100 / percent))) + 1 if percent < 100 else band


def parts(s, percent: int):
    """Hashes of the parts of a set; two sets that link have one of them in common.

    Two sets that link differ in at most ``d`` elements, a bound by their sizes. Cut into d + 1 parts by the
    elements' hashes, they are equal in one part at least. The number of parts is that of a pair of
    neighbouring bands, so a set has parts for its own band with the next and for the one before with its own.
    """
    import numpy as np

    out, own = [], _band(len(s), percent)
    for band in (own - 1, own):
        differ = (100 - percent) * (_most_in(band, percent) + _most_in(band + 1, percent)) // (100 + percent)
        at = (s % np.uint64(differ + 1)).astype(np.int64)
        total = np.zeros(differ + 1, dtype=np.uint64)
        np.add.at(total, at, s)
        key = np.arange(differ + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((band + 2) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
        x = (total ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(29)))
    return np.unique(np.concatenate(out))


def _parts(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows part, rep of the sets of ``text, x, y, rep``."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("part", pa.int64()), ("rep", pa.int64())])
        for b in batches:
            found, reps, size = [], [], 0
            for r, (t, x, y, rep) in enumerate(zip(*(b.column(c) for c in ("text", "x", "y", "rep")), strict=True)):
                s = shingle_set(t.as_py(), k)
                if len(s) and _digest(s) == (x.as_py(), y.as_py()):
                    found.append(parts(s, percent))
                    reps.append(rep.as_py())
                    size += len(found[-1])
                if found and (size > 1 << 20 or r == b.num_rows - 1):
                    rows = np.repeat(np.array(reps, dtype=np.int64), [len(f) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(rows)], schema=kinds)
                    found, reps, size = [], [], 0

    return texts.select("text", "x", "y", "rep").mapInArrow(cut, "part long, rep long")


def _texts_of(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Texts of classes: ``members`` (with id, x, y, written) beside a text each, without id.

    Found by doc_id; classes without an id, or with one that other members have too, by digest.
    """
    several = settle(members.filter("id is not null").groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id"), "several")
    texts = docs.withColumnRenamed("doc_id", "id")
    lone = members.filter("id is null").unionByName(members.join(several, "id", "left_semi"))
    side = members.filter("id is not null").join(several, "id", "left_anti")
    found = texts.join(F.broadcast(side) if members.count() <= SMALL_SIDE else side, "id")
    if not lone.isEmpty():
        apart = texts.filter("id is null").unionByName(texts.join(several, "id", "left_semi")).select("text")
        found = found.unionByName(_digested(apart, k).join(lone, ["x", "y"]))
    return found.drop("id")


def _refined(families: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows rep, family: large families are parted into what hangs together by equal parts of sets."""
    large = settle(families.groupBy("family").agg(F.count("*").alias("m")).filter(F.col("m") > TILE).select("family"), "large-families")
    if large.isEmpty():
        return families
    held = settle(families.join(large, "family", "left_semi").select("rep").join(classes.select("rep", "id", "x", "y"), "rep"), "large-members")
    alike = Window.partitionBy("part")
    rows = _parts(_texts_of(docs, held, k), k, percent)
    equal = settle(rows.withColumn("first", F.min("rep").over(alike)).filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "equal-parts")
    joined = components(equal).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    return families.join(large, "family", "left_anti").select("rep", "family").unionByName(joined)


def overlaps(sets: list):
    """Strips of the matrix of intersection sizes of sorted hash arrays: first row, rows of the strip.

    No array has more than about ``CELLS`` cells, however many sets there are. The diagonal counts
    the elements that a set shares with any other.
    """
    import numpy as np

    m = len(sets)
    who = np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in sets])
    _, inv, c = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(c > 1) - 1
    keep = c[inv] > 1
    who, col, c = who[keep], shared[inv[keep]], c[c > 1]
    order = np.argsort(col, kind="stable")
    who, col, first = who[order], col[order], np.cumsum(c) - c
    many = c > max(2, m // FEW)
    wide = np.cumsum(many) - 1
    dense = many[col]
    dw, dc, sw, sc = who[dense], wide[col[dense]], who[~dense], col[~dense]
    width, step = max(1, min(4096, CELLS // m)), max(1, CELLS // m)
    for top in range(0, m, step):
        end = min(m, top + step)
        out = np.zeros((end - top, m), dtype=np.float64)
        # columns that the strip's own sets lack add nothing to it
        own = np.unique(dc[(dw >= top) & (dw < end)])
        at = np.minimum(np.searchsorted(own, dc), max(0, len(own) - 1))
        met = own[at] == dc if len(own) else np.zeros(len(dc), dtype=bool)
        w, a = dw[met], at[met]
        for lo in range(0, len(own), width):
            i, j = np.searchsorted(a, [lo, lo + width])
            x = np.zeros((m, min(width, len(own) - lo)), dtype=np.float32)
            x[w[i:j], a[i:j] - lo] = 1
            out += x[top:end] @ x.T
        mine = (sw >= top) & (sw < end)
        row, of = sw[mine] - top, sc[mine]
        ends = np.cumsum(c[of])
        lo = 0
        while lo < len(of):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right")))
            k = c[of[lo:hi]]
            place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            cell = np.repeat(row[lo:hi].astype(np.int64) * m, k) + who[np.repeat(first[of[lo:hi]], k) + place]
            out += np.bincount(cell, minlength=out.size).reshape(out.shape)
            lo = hi
        yield top, out


class _Roots:
    """Smallest member that each reaches by links, from strips of links."""

    def __init__(self, rep):
        self.root = rep.copy()

    def add(self, top: int, link) -> None:
        import numpy as np

        for r, row in enumerate(link, top):
            met = self.root[row]
            if len(met) and ((met != self.root[r]).any()):
                names = np.unique(np.append(met, self.root[r]))
                self.root[np.isin(self.root, names)] = names[0]


def _dealt(members: DataFrame, percent: int) -> DataFrame:
    """Rows family, rep, tile, ``meets``: tiles that can hold links of a member of ``family, rep, n, least``.

    Small families are one tile. In others two sets can link only if their bands are the same or neighbours.
    Copies of one least token beyond a quarter of a tile are spread over several.
    """
    size = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    large = settle(size.filter((F.col("m") > TILE) | (F.col("s") > TILE_SHINGLES)).select("family", F.lit(True).alias("large")), "large")
    band = _band(F.col("n"), percent)
    members = members.join(large, "family", "left").withColumn("band", F.when(F.col("large"), band).otherwise(0).cast("long"))
    members = settle(members.drop("large"), "banded")
    load = F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)
    bands = settle(members.groupBy("family", "band").agg(F.ceil(load).alias("t")), "bands")
    beside = lambda by, name: bands.select("family", (F.col("band") + by).alias("band"), F.col("t").alias(name))
    bands = settle(bands.join(beside(1, "below"), ["family", "band"], "left").join(beside(-1, "above"), ["family", "band"], "left"), "beside")
    hot = members.join(bands.filter("t > 1").select("family", "band"), ["family", "band"]).groupBy("family", "band", "least")
    hot = settle(hot.agg(F.ceil(4 * load).alias("parts")).filter("parts > 1"), "hot-tokens")
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))
    tiles = lambda by, t: F.when(
        F.col(t) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(t) - 1), lambda x: (F.col("band") + by) * BANDS + x)
    ).otherwise(F.array().cast("array<long>"))
    return settle(
        members.join(bands, ["family", "band"]).join(hot, ["family", "band", "least"], "left").select(
            "family", "rep",
            (F.col("band") * BANDS + F.pmod(F.xxhash64("least", part), F.col("t"))).alias("tile"),
            F.concat(tiles(-1, "below"), tiles(0, "t"), tiles(1, "above")).alias("meets"),
        ), "tiled",
    )


def _placed(members: DataFrame, *columns: str) -> DataFrame:
    """A row for every pair of tiles that a member of ``family, rep, tile, meets`` takes part in."""
    each = members.withColumn("o", F.explode("meets"))
    return each.select("family", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "rep", "n", *columns)


def _candidates(placed: DataFrame, percent: int) -> DataFrame:
    """Rows rep, i, j, cluster: who has a candidate in which pair of tiles, from shared prefix tokens and bitmaps."""
    import numpy as np
    import pandas as pd

    def match(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        rep, n, need, tile = (g[c].to_numpy(np.int64) for c in ("rep", "n", "need", "tile"))
        some, clusters, bounds = np.zeros(len(rep), dtype=bool), _Roots(rep), Bounds(list(g["map"]), n, percent)
        if len(rep) > 1 and (i == j or (tile != tile[0]).any()):
            for top, both in overlaps([np.asarray(t, dtype=np.int64) for t in g["tokens"]]):
                r = np.arange(top, top + len(both))
                link = both >= np.minimum(need[r, None], need)
                link &= 100 * np.minimum(n[r, None], n) >= percent * np.maximum(n[r, None], n)
                link &= np.arange(len(rep)) > r[:, None]
                if i != j:
                    link &= tile[r, None] != tile
                a, b = np.nonzero(link)
                ok = bounds.passed(a + top, b)
                link[a[~ok], b[~ok]] = False
                some[a[ok] + top] = some[b[ok]] = True
                clusters.add(top, link)
        k = int(some.sum())
        return pd.DataFrame({"rep": rep[some], "i": np.full(k, i), "j": np.full(k, j), "cluster": clusters.root[some]})

    return placed.groupBy("family", "i", "j").applyInPandas(match, "rep long, i long, j long, cluster long")


def _verified(members: DataFrame, percent: int) -> DataFrame:
    """Rows rep, root, links from ``i, j, cluster, tile, rep, n, copies, shingles``."""
    import numpy as np
    import pandas as pd

    def verify(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("rep")
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        rep, tile = g["rep"].to_numpy(np.int64), g["tile"].to_numpy(np.int64)
        n, w = g["n"].to_numpy(np.float64), g["copies"].to_numpy(np.int64)
        roots, links = _Roots(rep), np.zeros(len(rep), dtype=np.int64)
        for top, both in overlaps([np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]]):
            r = np.arange(top, top + len(both))
            link = 100 * both >= percent * (n[r, None] + n - both)
            link[r - top, r] = False
            if i != j:  # pairs within a tile belong to the tile's own group
                link &= tile[r, None] != tile
            roots.add(top, link)
            links[r] = link @ w
        return pd.DataFrame({"rep": rep, "root": roots.root, "links": links})

    return members.groupBy("i", "j", "cluster").applyInPandas(verify, "rep long, root long, links long")


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``doc_id, text``: doc_id, n_shingles, component_id, n_links.

    Texts link when ``100 * intersection >= percent * union`` of their k-word shingle sets (A-Z in lower
    case; a text of fewer words is one shingle; texts without words, null texts too, link with nothing).
    ``component_id`` is the smallest doc_id reachable by links, ``n_links`` the number of other rows
    linked. Copies share a class, so their links are counted and never listed. Rows with one doc_id are
    one node. Rows without doc_id link, but name no component: theirs is the smallest doc_id they reach,
    null if none. Other columns are not used. Runs several jobs; each writes to the shared folder.
    """
    if not 0 < percent <= 100 or k < 1:
        raise ValueError("percent lies in 1 to 100, k is 1 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = _surveyed(docs, k)
    nodes = survey.filter("doc").select(F.col("id").alias("doc_id"), "n", "x", "y", "map")
    # a class is known by a number of its own: its least doc_id may stand on other texts too
    classes = nodes.filter("n > 0").groupBy("x", "y").agg(F.max("n").alias("n"), F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("map").alias("map"))
    mapped = settle(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    nodes, classes = nodes.drop("map"), mapped.drop("map")
    heavy, counts = _frequent(survey)
    rows = _prefixes(docs, k, percent, heavy, counts)
    # frequent tokens are shared for certain and may be hot; of the others, those of one class alone go
    rows = settle(rows, "prefixes")
    alike = Window.partitionBy("token")
    once = rows.filter("not known").withColumn("lo", F.min("x").over(alike)).withColumn("hi", F.max("x").over(alike)).filter("lo <> hi")
    live = rows.filter("known").select("token", "x", "need").union(once.select("token", "x", "need"))
    live = live.groupBy("token", "x").agg(F.max("need").alias("need"))
    live = settle(live.join(classes.select("x", "rep", "n"), "x").select("token", "rep", "n", "need"), "postings")
    lists = settle(live.groupBy("token").agg(F.count("*").alias("m"), F.min("rep").alias("first")), "lists")
    live = live.join(lists, "token")
    short = live.filter(F.col("m") <= LONG_LIST).select("token", "rep", "n", "need")
    a, b = short.toDF("token", "a", "na", "ma"), short.toDF("token", "b", "nb", "mb")
    close = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = (
        a.join(b, "token").filter(close).groupBy("a", "b").agg(F.count("*").alias("k"), F.min(F.least("ma", "mb")).alias("m"))
        .filter("k >= m").select("a", "b")
    )
    stars = live.filter((F.col("m") > LONG_LIST) & (F.col("rep") != F.col("first"))).select(F.col("first").alias("a"), F.col("rep").alias("b"))
    families = components(settle(pairs.union(stars), "candidates")).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    families = _refined(settle(families, "families"), classes, docs, k, percent)
    own = live.groupBy("rep").agg(F.max("n").alias("n"), F.max("need").alias("need"), F.min("token").alias("least"), F.collect_list("token").alias("tokens"))
    own = settle(families.join(own, "rep").join(mapped.select("rep", "map"), "rep"), "own")
    dealt = _dealt(own.select("family", "rep", "n", "least"), percent)
    placed = _placed(own.drop("family").join(dealt, "rep"), "need", "tokens", "map")
    met = _candidates(placed, percent).groupBy("rep").agg(F.collect_list(F.struct("i", "j", "cluster")).alias("met"))
    members = settle(dealt.select("rep", "tile").join(met, "rep").join(classes, "rep"), "members")
    sent = _sets(_texts_of(docs, members, k), k).withColumn("met", F.explode("met")).select("met.i", "met.j", "met.cluster", "tile", "rep", "n", "copies", "shingles")
    found = settle(_verified(sent, percent), "verified")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # rows that share a doc_id are one node, so its classes belong together
    same = nodes.filter("n > 0 and doc_id is not null").join(classes.select("x", "y", "rep"), ["x", "y"]).select("doc_id", "rep")
    first = settle(same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b"), "same")
    same = same.join(first, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    joined = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).union(same))
    # the least id of a component, where it has one
    least = joined.join(classes.select(F.col("rep").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    ids = joined.join(least, "component").select(F.col("node").alias("rep"), "component_id")
    known = settle(
        classes.join(linked, "rep", "left").join(ids.withColumn("in_component", F.lit(True)), "rep", "left")
        .select("x", "y", "copies", "links", "component_id", "in_component", "id"), "known"
    )
    own = F.when(F.col("in_component"), F.col("component_id")).otherwise(F.col("id"))
    return nodes.join(known, ["x", "y"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(own).alias("component_id"),
        F.when(F.col("n") == 0, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )

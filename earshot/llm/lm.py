"""Language-model scores: word counts of the corpus, and a causal self-attention model in numpy.

The model reads subword ids. It gives every next id the probability of its class, from one head of
causal self-attention over a window of ids and the class that tends to follow the last id, times the
id's share of its class. Counts and shares come from all training texts; the attention's weights are
trained by tasks side by side on all training texts and averaged, round by round, so what is learnt from
grows with the corpus. Long texts are scored in overlapping windows that give
each id once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import give_back, settle
from earshot.llm.encoder import encoder, slices, units

LENGTH, STRIDE = 32, 24  # ids a window reads, and ids that all but a text's first window score
DIM, HIDDEN, CLASSES = 16, 16, 48
ROWS = 1024  # embeddings: the most frequent ids have their own, the others share by remainder
LAST = 256  # last ids that have their own table of following classes
HOT_WORDS = 150_000  # words whose counts every task holds; the others are joined
LEARNERS = 4  # learners of a task, on average
WINDOWS = 512  # windows scored at a time; other numbers round otherwise
END = b""  # no word is empty


def _words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes are parted at the same blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _kind(tokenizer: str) -> str:
    """The type that ids are stored in: two bytes where they fit."""
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _as(ids: bytes, was: str, kind: str) -> bytes:
    return ids if was == kind else np.frombuffer(ids, dtype=was).astype(kind).tobytes()


class Attention:
    """Weights of the network; ``rows`` and ``last`` map ids to embeddings and to followers' tables."""

    SHAPES = {
        "e": (ROWS, DIM), "p": (LENGTH, DIM), "qkv": (DIM, 3 * DIM), "u": (DIM, HIDDEN), "w": (DIM, HIDDEN), "o": (HIDDEN, CLASSES),
    }

    def __init__(self, rows, last, follow, classes, share, start: int, end: int, weights=None):
        self.rows, self.last, self.follow, self.classes, self.share = rows, last, follow, classes, share
        self.start, self.end = start, end
        if weights is None:
            rng = np.random.default_rng(5)
            weights = np.concatenate([rng.normal(0, 0.3 if k in ("e", "p") else s[0] ** -0.5 * (0.3 if k == "o" else 1), s).ravel() for k, s in self.SHAPES.items()])
        self.weights = weights.astype(np.float32)
        self.mask = np.triu(np.full((LENGTH, LENGTH), -1e9, dtype=np.float32), 1)

    def parts(self) -> dict:
        out, at = {}, 0
        for k, s in self.SHAPES.items():
            n = s[0] * s[1]
            out[k] = self.weights[at : at + n].reshape(s)
            at += n
        return out

    def logits(self, ids, first: int = 0):
        """Class logits for positions from ``first`` on, and what the gradient needs; ids: windows of LENGTH."""
        w = self.parts()
        b = len(ids)
        x = w["e"][self.rows[ids]] + w["p"]
        qkv = (x.reshape(-1, DIM) @ w["qkv"]).reshape(b, LENGTH, 3 * DIM)
        q, k, v = qkv[:, first:, :DIM], qkv[:, :, DIM : 2 * DIM], qkv[:, :, 2 * DIM :]
        s = q @ k.transpose(0, 2, 1)
        s *= DIM**-0.5
        s += self.mask[first:]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        z = s @ v
        xq = x[:, first:]
        h = np.tanh(xq.reshape(-1, DIM) @ w["u"] + z.reshape(-1, DIM) @ w["w"])
        y = h @ w["o"] + self.follow[self.last[ids[:, first:]]].reshape(-1, CLASSES)
        return y, (x, q, k, v, s, z, h)

    def log_probs(self, ids, targets, first: int):
        """Natural logarithms for the targets of positions from ``first`` on."""
        y, _ = self.logits(ids, first)
        y -= y.max(axis=1, keepdims=True)
        t = targets.ravel()
        picked = y[np.arange(len(t)), self.classes[t]]
        return (picked - np.log(np.exp(y, out=y).sum(axis=1))).reshape(targets.shape) + self.share[targets]

    def learn(self, stream, batches_of: int = 64, rate: float = 0.05, seed: int = 0) -> None:
        """One pass of Adagrad over windows of a row of ids (start id before every text)."""
        n = -(-(len(stream) - 1) // LENGTH)
        stream = np.append(stream, np.full(n * LENGTH + 1 - len(stream), self.start))  # starts are not predicted
        ids, targets = stream[: n * LENGTH].reshape(n, LENGTH), stream[1 : n * LENGTH + 1].reshape(n, LENGTH)
        order = np.random.default_rng(seed).permutation(n)
        seen = np.full(len(self.weights), 1e-6, dtype=np.float32)
        for lo in range(0, n, batches_of):
            pick = order[lo : lo + batches_of]
            g = self._gradient(ids[pick], targets[pick])
            seen += g * g
            self.weights -= rate * g / np.sqrt(seen)

    def _gradient(self, ids, targets):
        w, b = self.parts(), len(ids)
        y, (x, q, k, v, a, z, h) = self.logits(ids)
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        t = targets.ravel()
        y[np.arange(len(t)), self.classes[t]] -= 1
        y[t == self.start] = 0  # the start of a text is not predicted
        y /= len(t)
        g = {"o": h.T @ y}
        dpre = (y @ w["o"].T) * (1 - h * h)
        xf, zf = x.reshape(-1, DIM), z.reshape(-1, DIM)
        g["u"], g["w"] = xf.T @ dpre, zf.T @ dpre
        dz = (dpre @ w["w"].T).reshape(b, LENGTH, DIM)
        da = dz @ v.transpose(0, 2, 1)
        ds = a * (da - (da * a).sum(axis=2, keepdims=True)) * DIM**-0.5
        dqkv = np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dz], axis=2).reshape(-1, 3 * DIM)
        g["qkv"] = xf.T @ dqkv
        dx = (dpre @ w["u"].T + dqkv @ w["qkv"].T).reshape(b, LENGTH, DIM)
        g["p"] = dx.sum(axis=0)
        g["e"] = np.zeros(ROWS * DIM, dtype=np.float32)
        np.add.at(g["e"], (self.rows[ids].reshape(-1, 1) * DIM + np.arange(DIM)).ravel(), dx.ravel())  # numbers go much faster than rows
        return np.concatenate([g[k].ravel() for k in self.SHAPES])

    def score(self, texts: list):
        """Log10 probability of each row of ids, the end id included."""
        sizes = np.array([len(t) + 1 for t in texts])
        begin = np.cumsum(sizes) - sizes
        start, end = np.array([self.start]), np.array([self.end])
        x = np.concatenate([p for t in texts for p in (start, t)] + [np.zeros(LENGTH, dtype=np.int64)])
        y = np.concatenate([p for t in texts for p in (t, end)] + [np.zeros(LENGTH, dtype=np.int64)])
        total = np.zeros(len(texts))
        more = np.maximum(0, -(-(sizes - LENGTH) // STRIDE))
        doc = np.repeat(np.arange(len(texts)), more)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(more) - more, more)
        for docs, at, first in ((np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64), 0), (doc, STRIDE * (nth + 1), LENGTH - STRIDE)):
            for lo in range(0, len(docs), WINDOWS):
                d, a = docs[lo : lo + WINDOWS], at[lo : lo + WINDOWS]
                place = (begin[d] + a)[:, None] + np.arange(LENGTH)
                inside = (a[:, None] + np.arange(first, LENGTH)) < sizes[d][:, None]
                place = np.minimum(place, len(x) - 1)
                lp = self.log_probs(x[place], y[place[:, first:]], first)
                total += np.bincount(d, weights=np.where(inside, lp, 0).sum(axis=1), minlength=len(texts))
        return total / np.log(10)


def corpus_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One pass over training texts: rows word, n of every word of a task, and rows with the ids of a text, n its number in its task.

    ``deal`` is a hash of a text's ids and number, by which learners get their texts.
    """
    kind = _kind(tokenizer)

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        kinds = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("ids", pa.binary()), ("deal", pa.int64())])

        def flush(words):
            m = len(words)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words.keys()), pa.binary()), pa.array(list(words.values()), pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], schema=kinds
            )

        words: Counter = Counter()
        nth = 0
        for b in batches:
            for lo, hi in units(b.column(0)):
                texts = b.column(0).slice(lo, hi - lo)
                for t in texts:
                    words.update(_words(t.as_py()))
                    if len(words) > 300_000:
                        yield flush(words)
                        words = Counter()
                words[END] += len(texts)
                ids = encoder(tokenizer).encode_column(pc.ascii_lower(texts)).to_pylist()
                m, stored = len(ids), pa.array([_as(i, "<u4", kind) for i in ids], pa.binary())
                deal = [xxhash.xxh64_intdigest(k.to_bytes(8, "little"), xxhash.xxh64_intdigest(i, 42)) for k, i in enumerate(ids, nth)]
                deal = np.array(deal, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), pa.array(range(nth, nth + m), pa.int64()), stored, pa.array(deal)], schema=kinds)
                nth += m
        if words:
            yield flush(words)
        words = Counter()
        give_back()

    return settle(docs.select("text").mapInArrow(count, "word binary, n long, ids binary, deal long"), "corpus-counts", compression="zstd")


def _id_counts(words: DataFrame, tokenizer: str, end: int, vocabulary: int):
    """How often every subword id is met in the training texts, from their distinct words."""

    def ids(batches):
        import pyarrow as pa

        counts = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            n = b.column(1).to_numpy()
            texts = [w.decode("utf-8", "surrogatepass") for w in b.column(0).to_pylist()]
            for lo, hi in slices(texts):
                found = encoder(tokenizer).encode(texts[lo:hi])
                counts += np.bincount(
                    np.frombuffer(b"".join(found), dtype="<u4"), weights=np.repeat(n[lo:hi], [len(f) // 4 for f in found]), minlength=vocabulary
                ).astype(np.int64)
            counts[end] += n[[i for i, t in enumerate(texts) if not t]].sum()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    rows = words.mapInArrow(ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocabulary, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def _streamed(blobs: list, start: int, end: int, kind: str = "<u4"):
    """Ids of texts in a row, the start id before each and the end id behind."""
    return np.concatenate([np.array([start])] + [p for i in blobs for p in (np.frombuffer(i, dtype=kind).astype(np.int64), np.array([end, start]))])


def _followers(ids, last, place, frequent: int, start: int, end: int, kind: str = "<u4"):
    """How often which id stands behind which in an Arrow column of texts' ids; a bounded number of texts at a time."""
    found = np.zeros(LAST * (frequent + 1), dtype=np.int64)
    for lo, hi in units(ids, 1 << 21):
        s = _streamed(ids.slice(lo, hi - lo).to_pylist(), start, end, kind)
        s, t = s[:-1], s[1:]
        keep = t != start
        found += np.bincount(last[s[keep]] * (frequent + 1) + np.minimum(place[t[keep]], frequent), minlength=len(found))
    return found


def _classes(pairs, frequent, rounds: int = 12):
    """Classes of the frequent ids by what stands before them: k-means on square roots of shares."""
    x = np.sqrt(pairs / np.maximum(pairs.sum(axis=0, keepdims=True), 1)).T  # rows: ids
    k = min(CLASSES - 4, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    weight = pairs.sum(axis=0)
    for _ in range(rounds):
        near = (x @ centres.T * 2 - (centres * centres).sum(axis=1)).argmax(axis=1)
        for c in range(k):
            own = near == c
            if own.any():
                centres[c] = np.average(x[own], axis=0, weights=weight[own] + 1)
    return near


def train(counts: DataFrame, words: DataFrame, tokenizer: str, rounds: int = 2, task_ids: int = 500_000) -> Attention:
    """Fits the model to ``corpus_counts`` rows and the words summed up."""
    tok = encoder(tokenizer).tokenizer
    vocabulary = tok.get_vocab_size(with_added_tokens=True)
    start, end = vocabulary - 2, vocabulary - 1
    known = _id_counts(words, tokenizer, end, vocabulary)
    rank = np.argsort(-known, kind="stable")
    place = np.empty(vocabulary, dtype=np.int64)
    place[rank] = np.arange(vocabulary)
    rows = np.where(place < ROWS - 32, place, ROWS - 32 + place % 32)
    last = np.where(place < LAST - 1, place, LAST - 1)
    frequent = 2048
    texts, kind = counts.filter("ids is not null").select("ids", "deal"), _kind(tokenizer)
    total = texts.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // np.dtype(kind).itemsize

    def pairs(batches):
        import pyarrow as pa

        found = np.zeros(LAST * (frequent + 1), dtype=np.int64)
        for b in batches:
            found += _followers(b.column(0), last, place, frequent, start, end, kind)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["pair", "n"])

    seen = texts.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most LAST * 2049 rows
    table = np.zeros(LAST * (frequent + 1))
    table[seen["pair"].to_numpy(np.int64)] = seen["n"].to_numpy(np.float64)
    table = table.reshape(LAST, frequent + 1)
    near = _classes(table[:, :frequent], frequent)
    classes = np.empty(vocabulary, dtype=np.int64)
    classes[rank[:frequent]] = near
    classes[rank[frequent:]] = CLASSES - 4 + np.arange(vocabulary - frequent) * 4 // max(1, vocabulary - frequent)
    of_class = np.bincount(classes, weights=known + 0.5, minlength=CLASSES)
    share = np.log((known + 0.5) / of_class[classes]).astype(np.float32)
    follow = np.full((LAST, CLASSES), 0.0)
    np.add.at(follow.T, near, table[:, :frequent].T)
    follow[:, CLASSES - 4 :] += table[:, frequent:] / 4
    prior = (of_class + 1) / (of_class + 1).sum()
    follow = np.log((follow + 20 * prior) / (follow.sum(axis=1, keepdims=True) + 20)).astype(np.float32)
    model = Attention(rows, last, follow, classes, share, start, end)
    if not total:  # nothing to train on: the counts alone decide
        model.parts()["o"][:] = 0
    # texts go to learners once, by ids and number, so that copies go to many; a learner's texts lie together in a file
    n = max(1, int(total // task_ids))
    dealt = texts.select("ids", F.pmod(F.hash("deal"), F.lit(n)).alias("learner"))
    dealt = settle(dealt.repartition(-(-n // LEARNERS), "learner").sortWithinPartitions("learner"), "dealt", compression="zstd") if total else None
    for r in range(rounds if total else 0):
        weights = model.weights

        def learn(batches, weights=weights, r=r):
            import pyarrow as pa

            size, sums = 0, np.zeros(len(weights))

            def learnt(blobs):
                """Number of ids, and the weights after them times this number."""
                own = Attention(rows, last, follow, classes, share, start, end, weights.copy())
                own.learn(_streamed(sorted(blobs, key=lambda i: _as(i, kind, "<u4")), start, end, kind), seed=r)
                ids = sum(len(i) for i in blobs) // np.dtype(kind).itemsize
                return ids, own.weights.astype(np.float64) * ids

            def learners():
                whose, blobs = None, []
                for b in batches:
                    for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        if k != whose and blobs:
                            yield blobs
                            blobs = []
                        whose = k
                        blobs.append(i)
                if blobs:
                    yield blobs

            for blobs in learners():
                ids, w = learnt(blobs)
                size += ids
                sums += w
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["size", "w"])

        found = dealt.mapInArrow(learn, "size long, w array<double>").filter("size > 0")
        mean = found.select("size", F.posexplode("w").alias("i", "v")).groupBy("i").agg((F.sum("v") / F.sum("size")).alias("v"))
        for x in mean.collect():
            model.weights[x["i"]] = x["v"]
    return model


def score(docs: DataFrame, held_out: str = "held_out", tokenizer: str = "") -> DataFrame:
    """Per row of ``doc_id, text`` and a flag: doc_id, the flag, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose flag is not true. Tokens are words (A-Z in lower case) and one end. ``base_score``
    sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over them, ``score`` is the model's log10 probability of the
    text's subword ids and its end. Null texts count as empty: the end alone. Rows that repeat count and
    score each for itself; other columns are not used. Runs several jobs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), "text")
    counts = corpus_counts(rows.filter("not held_out"), tokenizer)
    words = settle(counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = train(counts, words, tokenizer)
    level = F.floor(F.log2("c") * 16)
    keep, total = None, 0
    for r in sorted(words.groupBy(level.alias("l")).count().collect(), key=lambda r: -r["l"]):
        total += r["count"]
        if total > HOT_WORDS:
            break
        keep = r["l"]
    keep = 1 << 30 if keep is None else keep
    hot = {bytes(r["word"]): r["c"] for r in words.filter(level >= keep).toLocalIterator()}
    bottom = np.log10(n + 0.5 * (v + 1))
    logs = {w: float(np.log10(c + 0.5) - bottom) for w, c in hot.items()}

    def scored(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                           ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("k", pa.int64())])
        at, enc = TaskContext.get().partitionId() << 33, encoder(tokenizer)
        none = lambda m, t: pa.nulls(m, t)
        for b in batches:
            for lo, hi in units(b.column(2), 1 << 21):
                m = hi - lo
                ids, flags, texts = (c.slice(lo, m) for c in b.columns)
                names, tokens, known, base, who, rare, times = list(range(at, at + m)), [], [], [], [], [], []
                at += m
                for name, t in zip(names, texts, strict=True):
                    w = _words(t.as_py())
                    w.append(END)
                    found = list(map(logs.get, w))
                    tokens.append(len(w))
                    if None in found:
                        few = Counter(x for x, f in zip(w, found, strict=True) if f is None)
                        who += [name] * len(few)
                        rare += few.keys()
                        times += few.values()
                        found = [f for f in found if f is not None]
                    known.append(len(found))
                    base.append(sum(found))
                lp = model.score([np.frombuffer(i, dtype="<u4").astype(np.int64) for i in enc.encode_column(pc.ascii_lower(texts)).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), ids, flags, pa.array(tokens, pa.int64()),
                     pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(lp), none(m, pa.binary()), none(m, pa.int64())], schema=kinds
                )
                r = len(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who, pa.int64()), none(r, pa.int64()), none(r, pa.bool_()), none(r, pa.int64()), none(r, pa.int64()), none(r, pa.float64()),
                     none(r, pa.float64()), pa.array(rare, pa.binary()), pa.array(times, pa.int64())], schema=kinds
                )

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word binary, k long"
    found = settle(rows.mapInArrow(scored, kinds), "scores")
    rare = found.filter("word is not null").select("row", "word", "k").join(words.filter(level < keep), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5) - F.lit(float(bottom))
    rest = rare.groupBy("row").agg(F.sum(F.col("k") * log).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"))
    return found.filter("word is null").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )

"""Toxicity by non-negative positive-unlabelled learning on hashed words, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import columns_free
from earshot.llm.decontaminate import span_hashes, word_spans

POSITIVES = 4_000  # about as many confirmed examples are drawn at most
UNLABELLED = 12_000  # and as many unlabelled texts
BEGINNINGS = (4, 6)  # bytes of a longer word that are a feature of their own
TIMES = 4
SIZES = np.arange(4, 20, dtype=np.uint64)
SUPPORT = 5  # different positives that use a feature, at least


def _features(text: str | None):
    """Distinct hashes of a whole text's words, and of the beginnings of longer ones: rare forms of a word share them.

    The second to ``TIMES``-th use of each has a hash of its own, so a word that a long text holds once says less.
    """
    raw, first, size = word_spans(text)
    found = [span_hashes(raw, first, size)]
    for n in BEGINNINGS:
        more = first[size > n]
        found.append(span_hashes(raw, more, np.full(len(more), n)) ^ np.uint64(n))
    each, n = np.unique(np.concatenate(found), return_counts=True)
    again = [each[n >= k] * np.uint64(2 * k + 1) for k in range(2, TIMES + 1)]
    # a size class of the text: k where it has 2 ** k words or more
    return np.unique(np.concatenate([SIZES[np.uint64(len(first)) >> SIZES > 0], each, *again]))


class ToxicityModel:
    """Weights of sorted word hashes and a bias."""

    def __init__(self, words, weights, bias):
        self.words, self.weights, self.bias = words, weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias
        if len(self.words):
            f = _features(text)
            at = np.minimum(np.searchsorted(self.words, f), len(self.words) - 1)
            z += float(self.weights[at[self.words[at] == f]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class Rows:
    """0/1 rows by the places of their ones: a sample takes memory for those alone, not for rows times features."""

    def __init__(self, rows: list, width: int):
        self.width, self.sizes = width, np.array([len(r) for r in rows], dtype=np.int64)
        self.at = np.concatenate([np.array([], dtype=np.int32), *rows]).astype(np.int32)

    @classmethod
    def of(cls, x):
        return x if isinstance(x, cls) else cls([np.flatnonzero(r) for r in x], x.shape[1])

    def __len__(self):
        return len(self.sizes)

    def dot(self, w):
        """Sum of the weights of every row's ones."""
        sums = np.append(0.0, np.cumsum(w[self.at]))
        ends = np.cumsum(self.sizes)
        return sums[ends] - sums[ends - self.sizes]

    def weighted(self, g):
        """Sum of the numbers of the rows that have a one, per feature."""
        return np.bincount(self.at, weights=np.repeat(g, self.sizes), minlength=self.width)


def nnpu(positive, unlabelled, prior: float, steps: int = 600, ridge: float = 1e-3, beta: float = 0.0):
    """Weights and bias of a linear classifier from 0/1 rows of positives and of unlabelled texts.

    Minimises ``prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])`` with the logistic loss l. Where
    the estimate of the negatives' risk falls below ``-beta`` the step goes up that part's slope instead,
    which keeps the model from learning the positives by heart. Every step sees the whole sample, as the
    risk of small batches would fall below zero by chance.
    """
    xp, xu = Rows.of(positive), Rows.of(unlabelled)
    w = np.zeros(xp.width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    with_bias = lambda x, g: np.append(x.weighted(g), g.sum())
    for t in range(1, steps + 1):
        zp, zu = xp.dot(w) + w[-1], xu.dot(w) + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sp, su = sig(zp), sig(zu)
        g_plus = prior * with_bias(xp, sp - 1) / len(xp)
        g_minus = with_bias(xu, su) / len(xu) - prior * with_bias(xp, sp) / len(xp)
        g = g_plus + g_minus if negative >= -beta else -g_minus
        g[:-1] += ridge * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(texts: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 3) -> ToxicityModel:
    """Fits on ``texts`` (doc_id, text) and confirmed labels (doc_id, toxic); both hold training rows only.

    Positives are the texts labelled 1, all other texts are unlabelled: labels of 0 are not used to learn.
    ``prior``, the share of toxic texts among all, is by default the share of 1 among the labels. The
    sample is bounded (about ``positives`` and ``unlabelled`` rows, drawn by a hash of the id); feature hashes
    of the positives come to the driver, and of the unlabelled those that ``SUPPORT`` positives use. Features are the words and beginnings of words that positives use clearly more often (see ``associated``). Rows without
    label, text or doc_id are unlabelled or left out; without any positive the score is the prior.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    if prior is None:
        prior = seen["k"] / seen["n"] if seen["n"] else 0.0
    prior = min(max(float(prior), 1e-4), 0.9)
    if not seen["k"]:
        return ToxicityModel(np.array([], dtype=np.uint64), np.array([]), float(np.log(prior / (1 - prior))))
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null and doc_id is not null")
    total = rows.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), 1_000_000) / 1e6
    share_p, share_u = min(1.0, positives / seen["k"]), min(1.0, unlabelled / max(1, total))
    toxic = marks.filter("toxic = 1").filter(draw < share_p).select("doc_id", F.lit(1).alias("p"))
    # at most ``positives`` ids, so the join sends no text anywhere
    drawn = rows.join(F.broadcast(toxic), "doc_id", "left").filter((F.col("p") == 1) | (draw < share_u))

    def drawn_bags(part, known=None):
        def hashed(batches):
            import pyarrow as pa

            for b in batches:
                bags = [_features(t.as_py()) for t in b.column(1)]
                if known is not None:
                    bags = [known[_places(known, f)] for f in bags]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tobytes() for f in bags], pa.binary())], names=["doc_id", "f"])

        found = part.select("doc_id", "text").mapInArrow(hashed, "doc_id long, f binary").toArrow()
        return found.column("doc_id").to_numpy(), [np.frombuffer(f.as_buffer(), dtype=np.uint64) for f in found.column("f")]

    ids, bags = drawn_bags(drawn.filter("p = 1"))
    is_p = np.ones(len(ids), dtype=bool)
    if len(ids):
        # of the unlabelled texts only features that enough positives use are of interest
        found, n = np.unique(np.concatenate(bags), return_counts=True)
        other_ids, other = drawn_bags(drawn.filter("p is null"), np.unique(np.concatenate([SIZES, found[n >= SUPPORT]])))
        ids, bags = np.concatenate([ids, other_ids]), bags + other
        is_p = np.arange(len(ids)) < len(is_p)
    times = dict(zip(*np.unique(ids, return_counts=True), strict=True))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], bags[i].tobytes() if times[ids[i]] > 1 else b""))
    bags, is_p = [bags[i] for i in order], is_p[order]
    return fit(bags, is_p, draws_u(is_p, seed, share_u), prior)


def _places(words, bag):
    """Where the features of a bag are among sorted ones; those that are not there are left out."""
    at = np.minimum(np.searchsorted(words, bag), len(words) - 1)
    return at[words[at] == bag]


def fit(bags: list, is_p, in_u, prior: float) -> ToxicityModel:
    """The model of drawn bags of features; flags tell the positives and the unlabelled sample."""
    if not is_p.any():
        return ToxicityModel(np.array([], dtype=np.uint64), np.array([]), float(np.log(prior / (1 - prior))))
    words = associated([b for b, p in zip(bags, is_p, strict=True) if p], [b for b, u in zip(bags, in_u, strict=True) if u])
    if not len(words):
        return ToxicityModel(words, np.array([]), float(np.log(prior / (1 - prior))))
    found = [_places(words, b) for b in bags]
    in_u = in_u if in_u.any() else np.ones(len(bags), dtype=bool)
    positive, unlabelled = (Rows([found[i] for i in np.flatnonzero(x)], len(words)) for x in (is_p, in_u))
    weights, bias = nnpu(positive, unlabelled, prior)
    a, b = calibrated(positive.dot(weights) + bias, unlabelled.dot(weights) + bias, prior)
    return ToxicityModel(words, a * weights, a * bias + b)


def calibrated(positive, unlabelled, prior: float, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset that turn logits into probabilities, from the same risk.

    The non-negative estimate keeps logits small. With two numbers to learn the plain estimate cannot
    overfit, and for the logistic loss it is convex: ``mean(softplus(u)) - prior * mean(p)``.
    """
    theta, h0 = np.array([1.0, 0.0]), np.diag([1e-3, 1e-6])
    fp = np.array([positive.mean(), 1.0])
    fu = np.column_stack([unlabelled, np.ones(len(unlabelled))])
    risk = lambda t: np.logaddexp(0, fu @ t).mean() - prior * (fp @ t) + t @ h0 @ t / 2
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(fu @ theta, -40, 40)))
        g = (fu * s[:, None]).mean(axis=0) - prior * fp + h0 @ theta
        step = np.linalg.solve((fu * (s * (1 - s))[:, None]).T @ fu / len(fu) + h0, g)
        size = 1.0
        while size > 1e-4 and risk(theta - size * step) > risk(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def associated(positive: list, unlabelled: list):
    """Features that positives use clearly more often than unlabelled texts: twice as often, by six standard
    errors (many are tried), and in ``SUPPORT`` different positives.

    The support is a count, not a share, so that a language with few of the positives has features too. Near
    copies would lift every rare word of theirs over it: positives that agree in two smallest hashes count once.
    The size classes of texts are features in any case.
    """
    empty = [np.array([], dtype=np.uint64)]
    mixed = [tuple(int((b * np.uint64(m)).min()) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)) if len(b) else () for b in positive]
    positive = list({m: b for m, b in zip(reversed(mixed), reversed(positive), strict=True)}.values())
    words, n = np.unique(np.concatenate(empty + positive), return_counts=True)
    seen = np.zeros(len(words))
    for b in unlabelled if len(words) else []:  # a bag at a time: their union is many times larger
        seen[_places(words, b)] += 1
    rate = (seen + 1) / (len(unlabelled) + 1)
    share = n / max(1, len(positive))
    sure = (share - rate) / np.sqrt(rate * (1 - np.minimum(rate, 0.999)) / max(1, len(positive)))
    return np.unique(np.concatenate([SIZES, words[(n >= SUPPORT) & (share >= 2 * rate) & (sure >= 6)]]))


def draws_u(is_p, seed: int, share: float):
    """Which drawn rows belong to the unlabelled sample: all that are no positives, and their part of those."""
    rng = np.random.default_rng(seed)
    return ~is_p | (rng.random(len(is_p)) < share)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); other columns stay.

    Whole texts are scored; null and empty texts get the score of no words.
    """
    columns_free(docs, "score", "predicted")

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", scored(text)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

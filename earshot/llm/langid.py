"""Language identification: averaged hashed subword embeddings under a linear softmax, in numpy."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import columns_free, give_back
from earshot.llm.encoder import slices

UNKNOWN = "und"
BUCKETS = 1 << 16
DIM = 16
_letter = re.compile(r"[^\W\d_]")


def grams(texts: list[str | None]):
    """Subword buckets of several texts in a row, and where each text's buckets begin.

    Subwords are runs of 3 and 4 UTF-8 bytes inside a word in lower case with one blank at either
    side; everything ASCII that is no letter counts as a blank.
    """
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    parts = [b" " + (t or "").lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    b = table[np.frombuffer(b"".join(parts) + b" " * 3, dtype=np.uint8)]
    n = len(b) - 3
    word = b != 32
    h3 = (b[:n] * np.uint32(65599) + b[1 : n + 1]) * np.uint32(65599) + b[2 : n + 2]
    h4 = h3 * np.uint32(65599) + b[3:]
    inside = word[1 : n + 1] & (word[:n] | word[2 : n + 2])
    both = np.empty(2 * n, dtype=np.uint32)
    both[0::2] = h3 * np.uint32(2654435761)
    both[1::2] = (h4 + np.uint32(1)) * np.uint32(2246822519)
    keep = np.empty(2 * n, dtype=bool)
    keep[0::2] = inside
    keep[1::2] = word[1 : n + 1] & word[2 : n + 2]
    at = np.concatenate([[0], np.cumsum(keep)])
    return (both[keep] >> np.uint32(16)).astype(np.int32), at[2 * starts], int(at[-1])


class LanguageModel:
    """Logits of the subwords of every bucket, temperature and rejection level."""

    def __init__(self, labels, logits, temperature, reject_below):
        self.labels, self.logits, self.temperature, self.reject_below = labels, logits, temperature, reject_below

    def scores(self, texts: list[str | None]):
        """Class probabilities, rows of texts; texts without subwords are even."""
        none = np.zeros((0, len(self.labels)))
        return np.concatenate([none, *(self._scores(texts[lo:hi]) for lo, hi in slices(texts, 1 << 19))])

    def _scores(self, texts: list[str | None]):
        ids, starts, total = grams(texts)
        sums = np.zeros((len(texts), len(self.labels)))
        ends = np.append(starts[1:], total)
        full = np.flatnonzero(ends > starts)
        if len(full):
            sums[full] = np.add.reduceat(self.logits[ids], starts[full], axis=0)
        mean = sums / np.maximum(ends - starts, 1)[:, None] / self.temperature
        e = np.exp(mean - mean.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _fit(bags: list, y, n_labels: int, epochs: int, seed: int):
    """Bucket logits by stochastic gradient descent; bags: (buckets, shares) per text."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w = np.zeros((DIM, n_labels), dtype=np.float32)
    g2e, g2w = np.full(BUCKETS, 1e-8, dtype=np.float32), np.full(w.shape, 1e-8, dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 16):
            pick = order[lo : lo + 16]
            ids = np.concatenate([bags[i][0] for i in pick])
            share = np.concatenate([bags[i][1] for i in pick])[:, None]
            sizes = np.array([len(bags[i][0]) for i in pick])
            first = np.cumsum(sizes) - sizes
            v = np.add.reduceat(e[ids] * share, first, axis=0)
            z = v @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            gw, gv = v.T @ p, p @ w.T
            g2w += gw * gw
            w -= 0.3 * gw / np.sqrt(g2w)
            rows, inv = np.unique(ids, return_inverse=True)
            ge = np.zeros((len(rows), DIM), dtype=np.float32)
            np.add.at(ge, inv, np.repeat(gv, sizes, axis=0) * share)
            g2e[rows] += (ge * ge).mean(axis=1)
            e[rows] -= 0.3 * ge / np.sqrt(g2e[rows])[:, None]
    return e @ w


def train(examples: DataFrame, label: str = "lang", per_label: int = 800, keep: float = 0.999, epochs: int = 4, seed: int = 7) -> LanguageModel:
    """Fits on ``text`` and a label, on a bounded sample of about ``per_label`` different texts of every label.

    The sample is drawn by a hash of the text, and copies count once; its bags of subwords come to the driver. A fifth of it
    is held back: it sets the temperature (least log loss) and the rejection level, the highest score,
    at most 0.5, that ``keep`` of the held-back texts reach. Rows without label or letters are left out.
    At most 1,000 labels.
    """
    rows = examples.select(F.col(label).alias("label"), "text").filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    different = F.approx_count_distinct(F.xxhash64("text")).alias("n")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(different).limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError("more than 1,000 labels")
    if not counts:
        return LanguageModel([UNKNOWN], np.zeros((BUCKETS, 1)), 1.0, 0.0)
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("label") == k, min(1.0, per_label / n)).otherwise(share)

    def bag(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t in b.column(1):
                ids, _, _ = grams([t.as_py()])
                u, c = np.unique(ids, return_counts=True)
                out.append((u.astype("<i4").tobytes(), c.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["label", "ids", "n"])

    drawn = rows.filter(F.pmod(F.xxhash64("text", F.lit(seed)), 1_000_000) < share * 1_000_000).dropDuplicates(["label", "text"])
    found = sorted(drawn.mapInArrow(bag, "label string, ids binary, n binary").collect(), key=lambda r: (r["label"], bytes(r["ids"])))
    labels = sorted(counts)
    bags, y = [], []
    for r in found:
        ids, n = np.frombuffer(r["ids"], dtype="<i4"), np.frombuffer(r["n"], dtype="<i4")
        if len(ids):
            bags.append((ids, (n / n.sum()).astype(np.float32)))
            y.append(labels.index(r["label"]))
    if not bags:
        return LanguageModel(labels, np.zeros((BUCKETS, len(labels))), 1.0, 0.0)
    y = np.array(y)
    order = np.random.default_rng(seed).permutation(len(bags))
    held, used = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 10 else (order, order)
    logits = _fit([bags[i] for i in used], y[used], len(labels), epochs, seed)
    z = np.array([(logits[bags[i][0]] * bags[i][1][:, None]).sum(axis=0) for i in held])

    def probs(t):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(probs(t)[np.arange(len(held)), y[held]], 1e-12)).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    level = min(0.5, float(np.quantile(probs(temperature).max(axis=1), 1 - keep)))
    return LanguageModel(labels, logits, temperature, level)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected`` to the rows; their own columns stay.

    ``score`` is the calibrated probability of the prediction. Null texts and those without a letter are
    ``und`` with score 0. Rejected: ``und``, or a score below the model's level.
    """
    columns_free(docs, "lang_pred", "score", "rejected", "_found")
    labels = model.labels

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        values, names, scores = texts.tolist(), [], []
        for lo, hi in slices(values):
            part = values[lo:hi]
            p = model.scores(part)
            best = p.argmax(axis=1)
            ok = np.array([bool(t) and _letter.search(t) is not None for t in part])
            names += [labels[k] if o else UNKNOWN for k, o in zip(best, ok, strict=True)]
            scores += np.where(ok, p.max(axis=1), 0.0).tolist()
        give_back()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    found: Column = F.col("_found")
    return docs.withColumn("_found", predict(text)).withColumns(
        {
            "lang_pred": found["lang_pred"],
            "score": found["score"],
            "rejected": (found["lang_pred"] == UNKNOWN) | (found["score"] < model.reject_below),
        }
    ).drop("_found")

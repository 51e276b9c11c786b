"""The sweep plan, caps per cell and evaluation by seed, against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import sampling as P
from earshot.operators import sweep as W
from earshot.plans.few_shot import evaluate, few_shot_eval
from earshot.plans.sweep import Sweep, done_cells, run_sweep, sweep_report


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


LABELS = ["cat", "dog", "eel"]


def _stand_in():
    """Made inside, so that workers get it by value."""

    def make():
        import hashlib

        import numpy as np

        def scores(sequence, echo, model_tag):
            out = np.zeros((len(sequence), 4))
            for k, (s, e, m) in enumerate(zip(sequence, echo, model_tag)):
                for t in range(4):
                    out[k, t] = int(hashlib.md5(f"{m}|{t}|{s}{e}".encode()).hexdigest()[:8], 16) / 2**32 * 4
            return out

        return scores

    return make


stand_in = _stand_in()


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(LABELS + ["dog"] * 4), "x" * rng.randrange(1, 60) + str(i), f"<{i}>") for i in range(90)]
    rows += [(100, None, "no label", "<100>"), (101, "fox", "other label", "<101>")]
    return spark.createDataFrame(rows, "id bigint, label string, text string, audio string").repartition(3), rows


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(x, i, i) for i, x in enumerate(LABELS)], "label string, pos int, token_id int")


def counted(df, seen):
    def tell(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(tell, df.schema)


def by_hand(rows, plan, cap):
    """Every run one after the other."""
    model = stand_in()
    out = {}
    for a in range(3):
        for b in range(a + 1, 3):
            pair = [LABELS[a], LABELS[b]]
            own = [r for r in rows if r[1] in pair]
            first = sorted(pair, key=lambda x: min(r[0] for r in own if r[1] == x))
            chop = min(Counter(r[1] for r in own).values())
            pool = [r for x in first for r in sorted(r for r in own if r[1] == x)[:chop]]
            for tag in plan.checkpoints:
                for shots in plan.n_shots:
                    for exp in plan.exps:
                        for seed in plan.seeds:
                            key = ("_".join(pair), tag, shots, exp, seed)
                            if exp in W.TEXT_ONLY and tag != plan.checkpoints[0]:
                                out[key] = None
                                continue
                            drawn = [pool[int(md5(f"{seed}:{d}")[:15], 16) % len(pool)] for d in range(shots)]
                            part = {"base": 3, "txt": 2, "noexembnotxt": None}[exp]
                            block = "".join((r[part] if part else "") + "Q? " + r[1] + "\n" for r in drawn)
                            own_part = part if part or shots else 3
                            seen = []
                            for r in sorted(own, key=lambda r: (md5(f"{seed}:{r[0]}"), r[0])):
                                s = block + (r[own_part] if own_part else "") + "Q?"
                                if len(s) <= plan.max_length and (cap is None or len(seen) <= cap):
                                    seen.append((s, pair.index(r[1])))
                            if not seen:
                                out[key] = None
                                continue
                            prior = np.zeros(2)
                            for content in plan.inputs:
                                for k, x in enumerate(pair):
                                    s = block + (content if own_part else "") + "Q?"
                                    v = np.exp(model([s], [" " + x], [tag])[0])
                                    prior[k] += v[[a, b][k]] / v.sum()
                            prior /= prior.sum()
                            n_chop = min(Counter(t for _, t in seen).values())
                            right, right_cf, used = [], [], Counter()
                            for s, t in seen:
                                used[t] += 1
                                if used[t] <= n_chop:
                                    p = np.exp(model([s], [""], [tag])[0][[a, b]])
                                    right.append(int(np.argmax(p)) == t)
                                    right_cf.append(int(np.argmax(p / prior)) == t)
                            out[key] = (np.mean(right), np.mean(right_cf), n_chop)
    return out


@pytest.mark.parametrize("cap", [None, 11])
def test_sweep_equals_the_loop(spark, samples, labels, tmp_path, cap):
    df, rows = samples
    plan = Sweep(
        ["m1", "m2"], F.lit("Q?"), n_shots=[0, 1, 3], exps=["base", "txt", "noexembnotxt"], seeds=[0, 5], max_rows=cap, max_length=120
    )
    runs = run_sweep(df, labels, stand_in, plan, str(tmp_path))
    got = {tuple(r[c] for c in W.CELL): (r.acc, r.acc_cf, r.n_chop) if r.acc is not None else None for r in runs.collect()}
    want = by_hand([r for r in rows if r[1] in LABELS], plan, cap)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k] is None) == (w is None), k
        if w:
            assert got[k] == pytest.approx(w), k
    report = sweep_report(runs, plan)
    assert report.count() == 9 and set(report.columns) == {"exp", "n_shot", "m1", "m2"}


def test_sweep_goes_on_where_it_stopped(spark, samples, labels, tmp_path):
    df, _ = samples
    plan = Sweep(["m1", "m2"], F.lit("Q?"), n_shots=[0, 1], exps=["base", "txt"], seeds=[0], max_rows=5)
    out = str(tmp_path)
    assert done_cells(spark, out + "/runs").count() == 0
    read = spark.sparkContext.accumulator(0)
    first = run_sweep(counted(df, read), labels, stand_in, plan, out)
    before = {tuple(r) for r in first.collect()}
    assert read.value > 0 and len(before) == 24
    at = read.value
    again = run_sweep(counted(df, read), labels, stand_in, plan, out)
    assert {tuple(r) for r in again.collect()} == before
    assert read.value == at  # nothing is pending: samples are not read
    more = run_sweep(df, labels, stand_in, Sweep(**{**plan.__dict__, "seeds": [0, 7]}), out)
    kept = {tuple(r) for r in more.filter("seed = 0").collect()}
    assert kept == before and more.count() == 48


def test_scores_may_differ_by_seed(spark):
    rng = random.Random(0)
    rows = [(s, i, i % 2, [rng.random(), rng.random()]) for s in (0, 3) for i in range(40)]
    df = spark.createDataFrame(rows, "seed int, id bigint, truth int, scores array<double>").withColumn("c", F.lit("x"))
    prior = spark.createDataFrame([("x", 0, [0.5, 0.5]), ("x", 3, [0.2, 0.8])], "c string, seed int, p_cf array<double>")
    for cell in (["c"], ["c", "seed"]):
        both = {r.seed: r for r in few_shot_eval(df, prior, [0, 1], cell).collect()}
        for s, p in ((0, [0.5, 0.5]), (3, [0.2, 0.8])):
            own = [r for r in rows if r[0] == s]
            assert both[s].acc == pytest.approx(np.mean([int(np.argmax(r[3])) == r[2] for r in own]))
            assert both[s].acc_cf == pytest.approx(np.mean([int(np.argmax(np.exp(r[3]) / np.array(p))) == r[2] for r in own]))
    one = few_shot_eval(df.filter("seed = 0").drop("seed"), prior.filter("seed = 0").drop("seed"), [0, 1], ["c"], [0]).first()
    assert one.acc == both[0].acc
    with pytest.raises(ValueError):
        evaluate(df, prior, ["c"], [0])
    with pytest.raises(ValueError):
        evaluate(df.drop("seed"), prior, ["c"])


@pytest.mark.parametrize("limit", [1000, 3])
def test_cap_per_cell(spark, monkeypatch, limit):
    """By window and by counts per bucket, with a hot cell, null cells, repeated keys and small cells."""
    monkeypatch.setattr(P, "WINDOW_LIMIT", limit)
    rng = random.Random(9)
    rows = [(i % 150, rng.choice(["hot"] * 6 + ["b", None]), i) for i in range(600)] + [(1, "tiny", 1000)]
    df = spark.createDataFrame(rows, "id bigint, cell string, x int").repartition(4)
    for n, more in ((7, False), (40, True)):
        got = Counter((r.cell, r.id) for r in P.cap_rows(df, 2, n, "id", more, cell=["cell"]).collect())
        want = Counter()
        for c in {r[1] for r in rows}:
            own = sorted((md5(f"2:{r[0]}"), r[0]) for r in rows if r[1] == c)
            want.update((c, i) for _, i in own[: n + more])
        assert got == want
    assert P.cap_rows(df.limit(0), 2, 5, "id", cell=["cell"]).count() == 0

"""Operators against golden rows and brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions.keys import order_key
from earshot.functions.text import split_words
from earshot.operators import calibration as C
from earshot.operators import errors as R
from earshot.operators import manifest as M
from earshot.operators import metrics as X
from earshot.operators import sampling as P
from earshot.operators import scoring as G
from earshot.operators import sequences as Q
from earshot.operators import sweep as W
from earshot.operators.ranking import bucketed_rank, dense_ids, line_bucket
from earshot.plans.corpus import training_items
from earshot.plans.few_shot import evaluate
from earshot.plans.generation import generate_hypotheses, written_rows


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows of one class, 60 and 40 of two others, in three cells."""
    labels = ["a"] * 900 + ["b"] * 60 + ["c"] * 40
    random.Random(0).shuffle(labels)
    rows = [(i, lab, i % 3) for i, lab in enumerate(labels)]
    return spark.createDataFrame(rows, "id bigint, label string, cell int"), rows


def head_by_hand(rows, seed, cell):
    groups, counts = {}, {}
    for i, lab, c in sorted(rows, key=lambda r: (md5(f"{seed}:{r[0]}"), r[0])):
        groups.setdefault((c if cell else 0, lab), []).append(i)
    for (c, _), ids in groups.items():
        counts[c] = min(counts.get(c, 10**9), len(ids))
    return {i for (c, _), ids in groups.items() for i in ids[: counts[c]]}


@pytest.mark.parametrize("cell", [[], ["cell"]])
@pytest.mark.parametrize("digits", [1, 2, 4])
def test_balanced_head_is_exact(skewed, cell, digits):
    df, rows = skewed
    keyed = df.withColumn("k", order_key(7, "id"))
    got = P.balanced_head(keyed, "label", ["k", "id"], cell, digits=digits)
    plain = P.balanced_head(keyed, "label", ["k", "id"], cell, method="window")
    ids = {r.id for r in got.collect()}
    assert ids == head_by_hand(rows, 7, bool(cell)) == {r.id for r in plain.collect()}
    sizes = got.groupBy(*cell, "label").count().groupBy(*cell).agg(F.countDistinct("count").alias("d"))
    assert all(r.d == 1 for r in sizes.collect())


def test_balanced_head_keeps_missing_labels(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(10)], "id bigint, label string")
    got = P.balanced_head(df.withColumn("k", order_key(0, "id")), "label", ["k", "id"])
    assert got.count() == 10


@pytest.mark.parametrize("partitions", ["1", "32"])
def test_results_do_not_depend_on_shuffle_partitions(spark, skewed, partitions):
    df, rows = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = P.balanced_head(df.withColumn("k", order_key(1, "id")), "label", ["k", "id"])
        assert {r.id for r in got.collect()} == head_by_hand(rows, 1, False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bucketed_rank_and_reindex_over_block_borders(spark):
    lines = [0, 5, 65535, 65536, 65537, 131071, 131072, 500000]
    df = spark.createDataFrame([("s", x) for x in lines] + [("t", 65536)], "split string, line_no bigint")
    got = bucketed_rank(df, ["split"], ["line_no"], line_bucket(F.col("line_no")), "rn").collect()
    assert {(r.split, r.line_no): r.rn for r in got} == {
        **{("s", x): i + 1 for i, x in enumerate(lines)}, ("t", 65536): 1,
    }
    dense = {r.line_no: r["index"] for r in M.dense_reindex(df, ["split"]).filter("split = 's'").collect()}
    assert dense == {x: i for i, x in enumerate(lines)}


def test_pool_and_draws(spark):
    labels = ["x", "y", "x", "x", "z", "y", "x", "z", "y", "x"]
    df = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "line_no bigint, label string")
    pool = {r.pool_pos: r.line_no for r in P.balanced_pool(df, "label", "line_no").collect()}
    assert pool == {0: 0, 1: 2, 2: 1, 3: 5, 4: 4, 5: 7}
    drawn = P.draw_examples(df, "label", "line_no", 5, [0, 1], n_repeat=2).collect()
    assert len(drawn) == 20
    for r in drawn:
        pos = int(md5(f"{r.seed}:{r.draw}")[:15], 16) % 6
        assert r.pool_pos == pos and r.line_no == pool[pos] and r.label == labels[r.line_no]
    with pytest.raises(ValueError):
        P.draw_examples(df, "label", "line_no", 0, [0])


def test_class_index_and_chop(spark):
    df = spark.createDataFrame([(5, "b"), (2, "a"), (9, "b"), (7, "c"), (8, "c")], "line_no bigint, label string")
    got = {r.label: (r.class_id, r.n) for r in P.class_index(df, "label", "line_no").collect()}
    assert got == {"a": (0, 1), "b": (1, 2), "c": (2, 2)}
    assert tuple(P.chop_size(df, "label").first()) == (1, 3)


def test_cap_rows(spark):
    ids = sorted(range(50), key=lambda i: md5(f"3:{i}"))
    assert [r.id for r in P.cap_rows(spark.range(50), 3, 7, "id").collect()] == ids[:7]
    assert P.cap_rows(spark.range(50), 3, 7, "id", one_more=True).count() == 8


def test_filters(spark):
    rows = [(0, 5, "en"), (1, 50, "xx"), (2, 5, "xx"), (3, 60, "en"), (4, 70, "fr")]
    df = spark.createDataFrame(rows, "line_no bigint, n_frames bigint, label string")
    assert {r.line_no for r in M.filter_manifest(df, 10, ["en", "fr"]).collect()} == {3, 4}
    report = {r.outcome: r.n for r in M.skip_report(df, 10, ["en", "fr"]).collect()}
    assert report == {"loaded": 2, "size": 2, "label": 1}
    assert M.filter_manifest(df, None, None).count() == 5
    out = df.withColumn("loss", F.lit(2.0))
    assert M.length_guard(out, "n_frames", 55, "drop").count() == 3
    for policy, value in (("null", None), ("zero", 0.0)):
        got = {r.line_no: r.loss for r in M.length_guard(out, "n_frames", 55, policy, ["loss"]).collect()}
        assert got == {0: 2.0, 1: 2.0, 2: 2.0, 3: value, 4: value}


def test_attach_labels_names_the_unaligned_line(spark):
    m = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "split string, line_no bigint, label string")
    good = spark.createDataFrame([("s", 0, "a"), ("s", 1, "x")], "split string, line_no bigint, answer string")
    assert M.attach_labels(m, good).count() == 2
    report = {r.match: (r.n, r.n_differ) for r in M.alignment_report(m, good).collect()}
    assert report == {"both": (2, 1)}
    with pytest.raises(Exception, match="unaligned line s/1"):
        M.attach_labels(m, good.filter("line_no = 0")).collect()
    more = good.union(spark.createDataFrame([("s", 2, "z")], good.schema))
    with pytest.raises(Exception, match="unaligned line s/2: labels only"):
        M.attach_labels(m, more).count()
    assert M.attach_labels(m, more, on_mismatch="inner").count() == 2


def test_training_items(spark):
    m = spark.createDataFrame(
        [("s", 0, 900000, "flickr8k"), ("s", 1, 10, "flickr8k"), ("s", 2, 500, "libri")],
        "split string, line_no bigint, n_frames bigint, dataset string",
    )
    lab = spark.createDataFrame(
        [("s", 0, "A dog"), ("s", 1, "skipped"), ("s", 2, "H I")], "split string, line_no bigint, text string"
    )
    got = {r.line_no: (r.transcript, r.size) for r in training_items(m, lab, "dataset", 100).collect()}
    assert got == {0: ("A dog.", 320000), 2: ("hi.", 500)}
    with pytest.raises(Exception, match="unaligned"):
        training_items(m, lab.filter("line_no < 2"), "dataset", 100).collect()


def test_segments(spark):
    df = spark.createDataFrame([(1, "/r", "a.wav;b.wav"), (2, "/r", "c.wav")], "id int, root string, path string")
    seg = M.split_segments(df).orderBy("id", "segment_no").collect()
    assert [(r.id, r.segment_no, r.segment_path) for r in seg] == [
        (1, 0, "/r/a.wav"), (1, 1, "/r/b.wav"), (2, 0, "/r/c.wav"),
    ]


def test_error_rates_are_micro_averages(spark):
    df = spark.createDataFrame([("ab", "ax"), ("abcdefgh", "abcdefgh"), ("lost", None)], "r string, h string")
    row = R.error_rates(df, "r", "h").first()
    assert (row.num_char_errors, row.num_chars, row.uer) == (1, 10, 10.0)
    assert (row.num_word_errors, row.num_words, row.wer) == (1, 2, 50.0)
    empty = R.error_rates(df.filter("r = 'lost'"), "r", "h").first()
    assert empty.num_chars == 0 and math.isnan(empty.uer) and math.isnan(empty.wer)


def test_merged_counts_equal_one_pass(spark):
    df = spark.createDataFrame([(i % 4, f"w{i} a b c d", f"w{i % 5} a c d") for i in range(40)], "p int, r string, h string")
    counts = R.edit_counts(df, "r", "h")
    parts = [counts.filter(F.col("p") == i) for i in range(4)]
    merged = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    assert tuple(R.reduce_errors(merged).first()) == tuple(R.error_rates(df, "r", "h", spread=8, spread_by=["r"]).first())


def test_metrics(spark):
    log = spark.createDataFrame(
        [(0, 4.0, 8, 2, 3, 4), (150, 2.0, 4, 1, 1, 4), (250, 3.0, 3, 3, 0, 0)],
        "update bigint, loss double, ntokens bigint, sample_size bigint, n_correct bigint, total bigint",
    )
    a, b = X.rollup_log(log).orderBy("interval").collect()
    assert (a.interval, a.loss, a.nll_loss) == (0, round(6 / 3 / math.log(2), 3), round(6 / 12 / math.log(2), 3))
    assert a.ppl == round(2 ** (6 / 12 / math.log(2)), 2)
    assert (a.n_correct, a.total, a.accuracy) == (4, 8, 50.0)
    assert b.nll_loss is None and b.ppl == round(2 ** (1 / math.log(2)), 2) and b.accuracy is None
    assert a.diff_loss == 0.0


def test_batch_stats_and_best_run(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [1]), (1, [1, 2])], "b int, t array<int>")
    got = {r.b: (r.nsentences, r.ntokens, r.sample_size) for r in X.batch_token_stats(df, "b", "t").collect()}
    assert got == {0: (2, 6, 6), 1: (1, 3, 3)}
    once = X.batch_token_stats(df, "b", "t", count_eos_twice=False, sentence_avg=True)
    assert {r.b: (r.ntokens, r.sample_size) for r in once.collect()} == {0: (4, 2), 1: (2, 1)}
    runs = spark.createDataFrame([("m", 3, 0.5), ("m", 1, 0.4), ("m", 2, 0.4)], "model string, update int, loss double")
    assert tuple(X.best_run(runs, ["model"]).first()) == ("m", 1, 0.4)


def test_prior_and_accuracy(spark):
    cf = spark.createDataFrame([("c", [0.2, 0.2]), ("c", [0.4, 0.0])], "cell string, probs array<double>")
    np.testing.assert_allclose(C.content_free_prior(cf, cell=["cell"]).first().p_cf, [0.75, 0.25])
    rows = [(0, [0.6, 0.4], [0.75, 0.25]), (1, [0.6, 0.4], [0.75, 0.25])]
    df = spark.createDataFrame(rows, "truth int, probs array<double>, p array<double>")
    assert C.accuracy(df, []).first().acc == 0.5
    only_one = df.filter("truth = 1")
    assert C.accuracy(only_one, [], prior="p", mode="diagonal_W").first().acc == 1.0


def test_few_shot_by_hand(spark):
    rng = np.random.default_rng(1)
    rows, prior = [], {"x": [0.7, 0.3], "y": [0.4, 0.6]}
    for i in range(120):
        p = float(rng.random())
        rows.append(("x" if i % 3 else "y", i, int(rng.random() < 0.3), [p, 1 - p]))
    preds = spark.createDataFrame(rows, "cell string, id bigint, truth int, probs array<double>")
    pf = spark.createDataFrame(list(prior.items()), "cell string, p_cf array<double>")
    got = {(r.cell, r.seed): r for r in evaluate(preds, pf, ["cell"], [0, 4]).collect()}
    for cell in prior:
        for seed in (0, 4):
            mine = sorted((r for r in rows if r[0] == cell), key=lambda r: md5(f"{seed}:{r[1]}"))
            classes = [[r for r in mine if r[2] == t] for t in (0, 1)]
            n = min(len(c) for c in classes)
            kept = classes[0][:n] + classes[1][:n]
            acc = np.mean([int(np.argmax(r[3])) == r[2] for r in kept])
            cf = np.mean([int(np.argmax(np.array(r[3]) / prior[cell])) == r[2] for r in kept])
            r = got[(cell, seed)]
            assert (r.n_chop, r.n, r.n_classes) == (n, 2 * n, 2)
            assert abs(r.acc - acc) < 1e-12 and abs(r.acc_cf - cf) < 1e-12


def test_label_tokens(spark):
    classes = spark.createDataFrame([("a", 0), ("b", 1)], "label string, class_id int")
    toks = spark.createDataFrame([("a", [7]), ("b", [9])], "label string, token_ids array<int>")
    table = G.label_tokens(classes, toks)
    df = spark.createDataFrame([(0, 9), (1, 7), (2, 8)], "id int, token int")
    got = {r.id: r.truth for r in G.map_label_tokens(df, table, "token").collect()}
    assert got == {0: 1, 1: 0, 2: None}
    two = spark.createDataFrame([("a", [7, 8])], "label string, token_ids array<int>")
    with pytest.raises(Exception, match="single token"):
        G.label_tokens(classes, two).collect()


def test_losses_and_decoding(spark):
    lp = [math.log(0.5), math.log(0.3), math.log(0.2)]
    rows = [(0, 0, 0, lp), (0, 1, 1, lp), (0, 2, 2, lp), (0, 3, 2, lp), (1, 0, 1, lp)]
    df = spark.createDataFrame(rows, "seq int, pos int, target int, lp array<double>")
    got = {r.seq: (r.loss, r.n_real) for r in G.masked_nll(df, 2, "seq", "pos", "target", "lp").collect()}
    assert abs(got[0][0] + math.log(0.5 * 0.3 * 0.2)) < 1e-12 and got[0][1] == 2
    assert abs(got[1][0] + math.log(0.3)) < 1e-12
    acc = {r.seq: (r.n_correct, r.total) for r in G.token_accuracy(df, 2, ["seq"], "target", "lp").collect()}
    assert acc == {0: (1, 2), 1: (0, 1)}
    steps = [(0, 0, [0.0, 1.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (1, 0, [0.0, 1.0]), (1, 1, [0.0, 2.0])]
    sdf = spark.createDataFrame(steps, "seq int, step int, s array<double>")
    dec = {r.seq: r.tokens for r in G.greedy_decode(sdf, "seq", "step", "s", eos=0, max_len=3).collect()}
    assert dec == {0: [1, 0, 0], 1: [1, 1]}
    sh = {r.step: r.prev_scores for r in G.shift_scores(sdf.withColumn("t", F.lit(1)), "seq", "step", "s", "t").filter("seq = 0").collect()}
    assert sh == {1: [0.0, 1.0], 2: [1.0, 0.0]}


def test_score_runs_a_user_model(spark):
    def make():
        w = np.array([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]], dtype=np.float32)

        def predict(x):
            return x @ w

        return predict

    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(10)], "i int, x array<float>")
    got = G.score(df, make, ["x"], shapes=[[3]], batch_size=3).collect()
    assert all(r.scores == [r.i + 2.0, 4.0] for r in got)


def test_generation_records_failures(spark):
    def make():
        def generate(text):
            if text == "bad":
                raise ValueError("no")
            return f".{text}. \nrest"

        return generate

    df = spark.createDataFrame([(0, "hi there", " .news. "), (1, "bad", "x")], "id int, t string, answer string")
    out = generate_hypotheses(df, make, ["t"], "answer")
    got = {r.id: (r.hyp, r.target, r.error) for r in out.collect()}
    assert got == {0: ("hi there.", "news", None), 1: (None, "x", "ValueError: no")}
    assert written_rows(out).count() == 1


def test_content_free_grid(spark):
    inputs = spark.createDataFrame([(t,) for t in G.CONTENT_FREE_INPUTS], "text string")
    labels = spark.createDataFrame([("b",), ("a",)], "label string")
    got = [r.probe for r in G.content_free_grid(inputs, labels, "text", " q?").collect()]
    assert sorted(got) == sorted(f"{t} q? {lab}" for t in G.CONTENT_FREE_INPUTS for lab in "ab")


def test_collate_round_trip(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, []), (1, [5])], "b int, t array<int>")
    rows = Q.collate(df, ["b"], "t", 0).collect()
    for r in rows:
        width = 3 if r.b == 0 else 1
        assert r.padded == r.t + [0] * (width - len(r.t))
        assert r.mask == [1] * len(r.t) + [0] * (width - len(r.t)) and r.target_length == len(r.t)


def test_position_ids_long(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for s in range(3):
        n = 0
        for p in sorted(rng.sample(range(200000), 40)):
            m = rng.randint(0, 1)
            n += m
            rows.append((s, p, m))
            want[(s, p)] = n - 1 if m else 1
    df = spark.createDataFrame(rows, "s int, p bigint, m int")
    got = {(r.s, r.p): r.position_id for r in Q.position_ids_long(df, ["s"], "p", "m").collect()}
    assert got == want


def test_words_outside_what_tasks_hold_in_many_batches(spark, monkeypatch):
    """Cold words at many places of many rows, null and unknown ids, batches of a few rows."""
    monkeypatch.setattr(Q, "HOT_SYMBOLS", 6)
    rng = random.Random(9)
    names = [f"n{i}" for i in range(40)]
    texts = [" ".join(rng.choice(names[: rng.randint(1, 40)]) for _ in range(rng.randint(0, 30))) for _ in range(100)] + [None, " "]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        vocab = Q.build_vocab(docs.select(F.explode(F.split(F.trim("text"), " ")).alias("w")).filter("w <> ''"), "w")
        ids = {r.symbol: r.token_id for r in vocab.collect()}
        enc = {r.id: r.token_ids for r in Q.encode(docs, vocab, ["id"], "text").collect()}
        assert enc == {i: [ids[w] for w in (t or "").split()] for i, t in enumerate(texts)}
        rows = [(i, [None if x % 11 == 3 else x + 500 * (x % 13 == 1) for x in e]) for i, e in enc.items()] + [(1000, None)]
        symbols = {i: s for s, i in ids.items()}
        got = Q.decode(spark.createDataFrame(rows, "id int, t array<int>"), vocab, ["id"], "t", special="?").collect()
        assert {r.id: r.text for r in got} == {i: " ".join(symbols.get(x, "?") for x in t or []) for i, t in rows}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_position_ids_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(Q, "POSITIONS_PER_TASK", 100)
    rows = [(i % 3 or None, i * 1000, i % 2 if i % 5 else None, str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "s int, p bigint, m int, t string")
    out = Q.position_ids_long(df, ["s"], "p", "m")
    assert out.columns == ["s", "p", "m", "t", "position_id"]
    assert out.rdd.getNumPartitions() == 30
    n, want = {}, {}
    for s, p, m, t in rows:
        n[s] = n.get(s, 0) + (m or 0)
        want[(s, p, m, t)] = n[s] - 1 if m == 1 else 1
    assert {tuple(r)[:4]: r.position_id for r in out.collect()} == want


@pytest.mark.parametrize("max_tokens, max_rows", [(100, None), (60, 3), (7, 2), (1, None)])
def test_batches_match_one_loop(spark, max_tokens, max_rows):
    rng = random.Random(max_tokens)
    sizes = [rng.choice([0, 1, 3, 3, 3, 7, 20, 40]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint")
    got = {r.id: r.batch for r in Q.token_budget_batches(df, "size", "id", max_tokens, max_rows).collect()}
    assert sorted(got) == list(range(300))
    batch, held = 0, 0
    for i in sorted(range(300), key=lambda i: (sizes[i], md5(f"0:{i}"))):
        fits = held == 0 or ((held + 1) * sizes[i] <= max_tokens and (max_rows is None or held < max_rows))
        batch, held = (batch, held + 1) if fits else (batch + 1, 1)
        assert got[i] == batch


@pytest.mark.parametrize("seed", range(6))
def test_batches_are_composed_from_blocks(spark, monkeypatch, seed):
    """Blocks of few sizes, composed, give the same batches as the loop over all rows."""
    monkeypatch.setattr(Q, "SIZES_PER_BLOCK", 5)
    rng = random.Random(seed)
    most, tokens, cap = rng.choice([(60, 200, None), (200, 150, 7), (40, 1000, 50), (9, 30, None)])
    sizes = [rng.choice([rng.randrange(0, most), most]) for _ in range(400)] + [0] * rng.randrange(3)
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint").repartition(4)
    got = {r.id: r.batch for r in Q.token_budget_batches(df, "size", "id", tokens, cap).collect()}
    batch, held, want = 0, 0, {}
    for i, size in sorted(enumerate(sizes), key=lambda r: (r[1], md5(f"0:{r[0]}"), r[0])):
        if held and ((held + 1) * size > tokens or (cap and held + 1 > cap)):
            batch, held = batch + 1, 0
        held += 1
        want[i] = batch
    assert got == want


def test_state_functions_compose():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [(rng.randrange(1, 40), rng.randrange(1, 60)) for _ in range(rng.randrange(1, 12))]
        sizes.sort(reverse=True)  # caps fall as sizes rise
        f = Q.identity()
        for cap, n in sizes:
            f = Q.then(f, cap, n)
        for h in range(0, 90):
            held, opened = h, 0
            for cap, n in sizes:
                for _ in range(n):
                    if held >= cap:
                        opened, held = opened + 1, 0
                    held += 1
            assert Q.at_state(f, h) == (opened, held)


@pytest.mark.parametrize("k", [1, 3, 7])
def test_size_cuts_are_exact_quantiles(spark, k):
    rng = random.Random(k)
    for n in (1, 2, 11, 500):
        values = [rng.choice([5, 5, 5, rng.randrange(1000)]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "size bigint").repartition(3)
        assert np.allclose(Q.size_cuts(df, "size", k), np.quantile(values, [i / k for i in range(1, k + 1)]))
    assert Q.size_cuts(df.limit(0), "size", k) == []


def test_size_buckets(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 2, 3, 9]], "size bigint")
    got = {r.size: (r.bucket, r.bucketed_size) for r in Q.with_size_buckets(df, "size", 2).collect()}
    assert got == {1: (0, 2.0), 2: (0, 2.0), 3: (1, 9.0), 9: (1, 9.0)}
    assert {r.bucket for r in Q.with_size_buckets(df, "size", 0).collect()} == {0}


EXPECTED_PROMPTS = {
    "base": "<e0>? x\n<e1>? y\n<s>?",
    "txt": "e0? x\ne1? y\ns?",
    "noexemb": "? x\n? y\n<s>?",
    "noexembtxt": "? x\n? y\ns?",
    "noexembnotxt": "? x\n? y\n?",
}
ZERO_SHOT = {"base": "<s>?", "txt": "s?", "noexemb": "<s>?", "noexembtxt": "s?", "noexembnotxt": "<s>?"}


def test_prompts_as_text_and_tokens(spark):
    ex = spark.createDataFrame(
        [("r", 0, 1, "<e1>", "e1", " y\n"), ("r", 0, 0, "<e0>", "e0", " x\n")],
        "run string, repeat int, draw int, audio string, text string, answer string",
    )
    s = spark.createDataFrame([("r", "<s>", "s")], "run string, audio string, text string")
    exps = list(EXPECTED_PROMPTS)
    blocks = Q.example_blocks(ex, ["run"], exps, "audio", "text", F.lit("?"), "answer")
    got = Q.assemble_prompt(s, blocks, ["run"], exps, "audio", "text", F.lit("?")).collect()
    assert {r.exp: r.sequence for r in got} == EXPECTED_PROMPTS
    zero = Q.assemble_prompt(s, None, [], exps, "audio", "text", F.lit("?")).collect()
    assert {r.exp: r.sequence for r in zero} == ZERO_SHOT
    with pytest.raises(ValueError):
        Q.assemble_prompt(s, None, [], ["other"], "audio", "text", F.lit("?"))

    def ids(df):
        return df.select(*[F.split(c, "").alias(c) if c in ("audio", "text", "answer") else c for c in df.columns])

    prompt = F.array(F.lit("?"))
    tblocks = Q.example_blocks(ids(ex), ["run"], exps, "audio", "text", prompt, "answer")
    toks = Q.assemble_prompt(ids(s), tblocks, ["run"], exps, "audio", "text", prompt).collect()
    assert {r.exp: "".join(r.sequence) for r in toks} == EXPECTED_PROMPTS


def test_vocabulary_round_trip(spark):
    docs = spark.createDataFrame([(0, "b a b"), (1, "c  a b"), (2, ""), (3, None)], "id int, text string")
    words = docs.select(F.explode(F.split("text", r"\s+")).alias("w")).filter("w <> ''")
    vocab = Q.build_vocab(words, "w")
    assert [(r.token_id, r.symbol, r.n) for r in vocab.orderBy("token_id").collect()] == [(0, "b", 3), (1, "a", 2), (2, "c", 1)]
    small = Q.build_vocab(words, "w", max_size=3)
    enc = Q.encode(docs, small, ["id"], "text", unk=99)
    got = {r.id: r.token_ids for r in enc.collect()}
    assert got == {0: [0, 1, 0], 1: [99, 1, 0], 2: [], 3: []}
    dec = {r.id: r.text for r in Q.decode(enc, small, ["id"], "token_ids", special="?").collect()}
    assert dec == {0: "b a b", 1: "? a b", 2: "", 3: ""}


@pytest.mark.parametrize("most, length", [(300_000, 64), (2, 64), (0, 64), (300_000, 2)])
def test_vocabulary_is_whole_and_split(spark, monkeypatch, most, length):
    """Every symbol has a dense id; texts come back however much of the vocabulary the tasks hold."""
    monkeypatch.setattr(Q, "HOT_SYMBOLS", most)
    monkeypatch.setattr(Q, "HOT_LENGTH", length)
    rng = random.Random(2)
    texts = [" ".join("w" * rng.randrange(1, 5) + str(rng.randrange(40)) for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (90, None), (91, " \n")]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(4)
    vocab = Q.build_vocab(docs.select(F.explode(split_words("text")).alias("w")), "w")
    counts = {}
    for _, t in rows:
        for w in (t or "").split():
            counts[w] = counts.get(w, 0) + 1
    want = sorted(counts, key=lambda w: (-counts[w], w))
    assert [(r.token_id, r.symbol, r.n) for r in vocab.orderBy("token_id").collect()] == [(i, w, counts[w]) for i, w in enumerate(want)]
    enc = Q.encode(docs, vocab, ["id"], "text")
    ids = {w: i for i, w in enumerate(want)}
    assert sorted((r.id, r.token_ids) for r in enc.collect()) == sorted((i, [ids[w] for w in (t or "").split()]) for i, t in rows)
    dec = Q.decode(enc, vocab, ["id"], "token_ids")
    assert sorted(tuple(r) for r in dec.collect()) == sorted((i, " ".join((t or "").split())) for i, t in rows)
    other = spark.createDataFrame([(0, "never seen w1")], "id int, text string")
    assert Q.encode(other, vocab, ["id"], "text").first().token_ids[:2] == [len(want), len(want)]


def test_encoding_needs_no_exchange(spark):
    docs = spark.createDataFrame([(0, "a b")], "id int, text string")
    vocab = Q.build_vocab(docs.select(F.explode(F.split("text", " ")).alias("w")), "w")
    plan = Q.encode(docs, vocab, ["id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = sorted(tuple(r) for r in dense_ids(df, [F.col("x").desc()], "i").collect())
    assert got == [(x, 999 - x) for x in range(1000)]
    assert dense_ids(df.limit(0), [F.col("x")], "i").count() == 0


def test_embedding_keeps_every_row(spark):
    rows = [(0, [2, 0, 2]), (1, [1]), (2, []), (3, None), (4, [1] * 500), (0, [0])]
    df = spark.createDataFrame(rows, "id int, t array<int>").repartition(3)
    table = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(3)], "token_id int, vec array<float>")
    got = sorted((r.id, r.vectors) for r in Q.embed_tokens(df, table, ["id"], "t").collect())
    assert got == sorted((i, [[float(x), -float(x)] for x in t or []]) for i, t in rows)


def test_embedding_of_unknown_ids(spark):
    df = spark.createDataFrame([(0, [0, 7, 1]), (1, [9]), (2, []), (3, [None])], "id int, t array<int>")
    table = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "token_id int, vec array<float>")
    got = {r.id: r.vectors for r in Q.embed_tokens(df, table, ["id"], "t", unknown="null").collect()}
    assert got == {0: [[0.0], None, [1.0]], 1: [None], 2: [], 3: [None]}
    with pytest.raises(Exception, match="token without a vector"):
        Q.embed_tokens(df, table, ["id"], "t").collect()


def test_pairs_of_rows(spark):
    df = spark.createDataFrame([(0, [1], [1]), (1, [2, 3], [1, 0]), (2, [4], [1])], "line_no bigint, t array<int>, m array<int>")
    got = {r.pair_no: (r.t, r.m, r.n_rows) for r in Q.pair_adjacent(df, [], "line_no", "t", "m").collect()}
    assert got == {0: ([1, 2, 3], [1, 1, 0], 2), 1: ([4], [1], 1)}


def test_sweep(spark):
    labels = spark.createDataFrame([(1, "b"), (0, "a"), (2, "c")], "pos int, label string")
    pairs = W.label_pairs(labels)
    assert [r.scenarios for r in pairs.collect()] == ["a_b", "a_c", "b_c"]
    grid = W.sweep_grid(pairs, ["m1", "m2"], [0, 2], ["base", "txt"], [0, 1])
    assert grid.count() == 3 * 2 * 2 * 2 * 2 and grid.filter("planned").count() == 3 * 2 * 2 * 3
    done = grid.filter("scenarios = 'a_b' and model_tag = 'm2'")
    pending = W.pending_cells(grid, done)
    assert pending.count() == 36 - 4
    assert W.pending_checkpoints(grid, done).count() == 5
    big = W.sweep_grid(pairs.limit(1), ["m"])
    assert big.count() == 80


def test_reports(spark):
    runs = spark.createDataFrame(
        [("base", "m1", 0, 0, 0.5, 0.6, 20), ("base", "m1", 0, 1, 0.4625, 0.6, 21), ("base", "m1", 2, 0, 0.9, 0.9, 9)],
        "exp string, model_tag string, n_shot int, seed int, acc double, acc_cf double, n_chop bigint",
    )
    assert W.min_support(runs).count() == 2
    grid = spark.createDataFrame([("base", m, n) for m in ("m1", "m2") for n in (0, 2)], "exp string, model_tag string, n_shot int")
    means = W.seed_average(runs, grid)
    got = {(r.model_tag, r.n_shot): r.n_runs for r in means.collect()}
    assert got == {("m1", 0): 2, ("m1", 2): None, ("m2", 0): None, ("m2", 2): None}
    table = {r.n_shot: (r.m1, r.m2) for r in W.report_pivot(means, ["m1", "m2"]).collect()}
    assert table == {0: (f"{60:.2f}% ({48.125:.2f}) (Nr:20.5)", None), 2: (None, None)}


def test_rows_that_must_not_be_lost_or_won(spark):
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "label string, pos int")
    assert [r["scenarios"] for r in W.label_pairs(labels).collect()] == ["a_b"]
    many = spark.range(60_000).select(F.lit("a").alias("label")).union(spark.range(3).select(F.lit("b").alias("label")))
    inputs = spark.createDataFrame([("x",)], "text string")
    assert G.content_free_grid(inputs, many, "text", "p").count() == 2
    runs = spark.createDataFrame([("m", 0, None), ("m", 1, 0.4), ("m", 2, float("nan"))], "model string, update int, loss double")
    assert tuple(X.best_run(runs, ["model"]).first()) == ("m", 1, 0.4)
    sizes = spark.createDataFrame([(None,), (5,)], "n_frames long")
    assert {r["outcome"]: r["n"] for r in M.skip_report(sizes).collect()} == {"size": 1, "loaded": 1}
    scores = spark.createDataFrame([(0, 0, 7, [0.0, -1.0])], "seq long, pos int, target int, lprobs array<double>")
    with pytest.raises(Exception, match="outside"):
        G.masked_nll(scores, -1, "seq", "pos", "target", "lprobs").collect()

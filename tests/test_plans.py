"""Pairs over blocks, batched generation and its plan, the one-pass pair writer, buckets by size, ignored prefixes."""

import random
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from earshot.functions.keys import order_key
from earshot.operators import ranking as K
from earshot.operators import sampling as P
from earshot.operators import scoring as G
from earshot.operators import sweep as W
from earshot.plans import generation
from earshot.plans.generation import generate_hypotheses, transcribe
from earshot.sources.manifests import read_labels, read_manifest
from earshot.sources.sinks import write_manifest_pair


@pytest.mark.parametrize("size", [512, 3, 1])
def test_label_pairs_over_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(W, "LABELS_PER_BLOCK", size)
    names = [f"l{i % 23}" for i in range(40)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "label string, pos int").repartition(3)
    once = list(dict.fromkeys(names))
    want = sorted((f"{a}_{b}", names.index(a), names.index(b), a, b) for a, b in combinations(once, 2))
    assert sorted(tuple(r) for r in W.label_pairs(df).collect()) == want
    assert W.label_pairs(df.limit(0)).count() == 0
    assert W.label_pairs(df.filter("pos = 1")).count() == 0


def test_batches_are_halved_until_bad_rows_are_alone(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def generate(texts, numbers):
            calls.add(1)
            if "bad" in texts:
                raise ValueError("no")
            if "short" in texts:
                return texts[1:]
            return [f"{t}{n}\nrest" for t, n in zip(texts, numbers)]

        return generate

    texts = ["a"] * 64
    df = spark.createDataFrame([(i, t, 7, " x.") for i, t in enumerate(texts)], "id int, t string, n int, answer string").coalesce(1)
    got = generate_hypotheses(df, make, ["t", "n"], "answer", batch_size=16).select("id", "hyp", "error").collect()
    assert calls.value == 4 and all(r.hyp == "a7" and r.error is None for r in got)
    calls.value = 0
    odd = df.withColumn("t", F.when(F.col("id") == 5, "bad").when(F.col("id") == 40, "short").otherwise(F.col("t")))
    got = {r.id: (r.hyp, r.error) for r in generate_hypotheses(odd, make, ["t", "n"], "answer", batch_size=16).select("id", "hyp", "error").collect()}
    assert got.pop(5) == (None, "ValueError: no") and got.pop(40) == (None, "ValueError: 0 texts for 1 rows")
    assert set(got.values()) == {("a7", None)}
    assert calls.value == 2 + 2 * 9  # two whole batches; two halved four times


def test_generated_texts_are_handed_back_in_parts(monkeypatch):
    monkeypatch.setattr(generation, "PART", 1000)
    rows = pd.DataFrame({"id": range(100), "t": ["x" * 90] * 99 + ["y" * 5000], "n": 1})
    calls = []

    def generate(texts):
        calls.append(len(texts))
        return [t[:3] for t in texts]

    out = list(generation._runner(lambda: generate, ["t"], 4)(iter([rows])))
    assert max(len(x) for x in out) == 12 and calls == [4] * 25
    assert pd.concat(out)["id"].tolist() == list(range(100)) and pd.concat(out)["raw_hyp"].tolist() == ["xxx"] * 99 + ["yyy"]
    out = list(generation._runner(lambda: lambda t: t[:3], ["t"], None)(iter([rows, rows[:0]])))
    assert max(len(x) for x in out) == 12 and len(pd.concat(out)) == 100


def test_generation_plan(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def make():
        def generate(texts):
            made.add(len(texts))
            if any("#" in t for t in texts):
                raise ValueError("mark")
            return [t + "\nrest" for t in texts]

        return generate

    rows = [(s, i, f"{s}{i}.wav", 10 + i, "t\tq", ("#" if i % 9 == 4 else "say") + str(i)) for s, n in (("u", 30), ("v", 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "split string, id bigint, path string, n_frames bigint, target string, text string").repartition(3)
    out = str(tmp_path / "pair")
    assert transcribe(df, make, ["text"], out, 20, seed=1, batch_size=8, root="/r") == 2
    lines, files = read_labels(spark, out + "/ltr"), read_manifest(spark, out + "/tsv")
    both = lines.join(files, ["split", "line_no"]).collect()
    key = order_key(1, "id")
    order = [(r.split, r.id) for r in df.select("split", "id", key.alias("k")).orderBy("split", "k").collect()]
    chosen = [o for s, n in (("u", 20), ("v", 6)) for o in [o for o in order if o[0] == s][:n]]
    good = [o for o in chosen if o[1] % 9 != 4]
    want = {(s, sum(1 for x in good[: good.index((s, i))] if x[0] == s), f"say{i}", f"{s}{i}.wav", "t#q") for s, i in good}
    assert {(r.split, r.line_no, r.text, r.path, r.answer) for r in both} == want
    # splits that are complete stay as they are; 'v' and 'u' lost rows, so they are made again and come out alike
    complete = df.filter("text not like '#%'")
    other = str(tmp_path / "other")
    assert transcribe(complete, make, ["text"], other, 20, seed=1, batch_size=8) == 2
    before = made.value
    assert transcribe(complete, make, ["text"], other, 20, seed=1, batch_size=8) == 0
    assert made.value == before


def test_pair_is_written_from_one_read(spark, tmp_path):
    rows_read = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            rows_read.add(len(b))
            b["hyp"] = [f"h{random.random()}" for _ in range(len(b))]  # another value at each call
            yield b

    rows = [("s", i, f"t{i}", "q", "", f"{i}.wav", i) for i in range(50)]
    df = spark.createDataFrame(rows, "split string, line_no bigint, target string, prompt string, hyp string, path string, n_frames bigint")
    out = str(tmp_path / "pair")
    write_manifest_pair(df.repartition(3).mapInPandas(tell, df.schema), out, lines_per_file=7)
    assert rows_read.value == 50
    left = {r.line_no: r.answer for r in read_labels(spark, out + "/ltr").collect()}
    right = {r.line_no: r.label for r in read_manifest(spark, out + "/tsv").collect()}
    assert left == right == {i: f"t{i}" for i in range(50)}
    write_manifest_pair(df.filter("line_no < 3").withColumn("split", F.lit("w")), out, other_splits="keep")
    assert read_labels(spark, out + "/ltr").groupBy("split").count().count() == 2


@pytest.mark.parametrize("most", [1 << 16, 40, 3])
def test_buckets_follow_the_size_of_a_class(spark, monkeypatch, most):
    monkeypatch.setattr(K, "LINES_PER_BUCKET", most)
    rows = [(i, "big" if i % 10 else "small", i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, label string, cell int").withColumn("k", order_key(7, "id"))
    got = {r.id for r in P.balanced_head(df, "label", ["k", "id"], ["cell"]).collect()}
    assert got == {r.id for r in P.balanced_head(df, "label", ["k", "id"], ["cell"], method="window").collect()}
    buckets = K._in_buckets(df, ["cell", "label"], ["k", "id"]).groupBy("cell", "label").agg(F.countDistinct("_bucket").alias("n")).collect()
    sizes = {(r.cell, r.label): r.n for r in buckets}
    if most == 1 << 16:
        assert set(sizes.values()) == {1}
    if most == 40:
        assert {n for (c, x), n in sizes.items() if x == "small"} == {1} and all(n > 4 for (c, x), n in sizes.items() if x == "big")


def test_prefix_is_left_out(spark):
    rows = [(0, p, t, [-1.0 - p, -2.0, -3.0]) for p, t in enumerate([0, 1, 0, 2, 2])] + [(1, 0, 1, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame(rows, "seq int, pos int, target int, lp array<double>")
    loss = {r.seq: (r.loss, r.n_real) for r in G.masked_nll(df, 2, "seq", "pos", "target", "lp", ignore_prefix=2).collect()}
    assert loss == {0: (6.0, 1)}
    hits = {r.seq: (r.n_correct, r.total) for r in G.token_accuracy(df, 2, ["seq"], "target", "lp", "pos", 1).collect()}
    assert hits == {0: (0, 2)}
    with pytest.raises(ValueError):
        G.token_accuracy(df, 2, ["seq"], "target", "lp", ignore_prefix=1)

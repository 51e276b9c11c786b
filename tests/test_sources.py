"""Readers and writers on files made in the test."""

import struct
import wave

import pytest
from pyspark.sql import functions as F

from earshot.operators.manifest import duration_report
from earshot.sources.audio import scan_audio
from earshot.sources.manifests import numbered_lines, read_labels, read_manifest
from earshot.sources.sinks import read_runs, report_csv, write_manifest_pair, write_runs
from earshot.streaming.metrics import follow_log, latest, read_log
from earshot.operators.metrics import rollup_log


def test_manifest_files(spark, tmp_path):
    for name, n in (("test_a_b", 5), ("test_c_d", 3)):
        lines = ["/root/dir "] + [f"{name}{i}.wav\t{100 + i}\t{'xy'[i % 2]}" for i in range(n)]
        (tmp_path / f"{name}.tsv").write_text("\n".join(lines) + "\n")
    m = read_manifest(spark, str(tmp_path))
    got = sorted((r.split, r.line_no, r.root, r.path, r.n_frames, r.label) for r in m.collect())
    assert got[0] == ("test_a_b", 0, "/root/dir", "test_a_b0.wav", 100, "x")
    assert len(got) == 8 and got[-1] == ("test_c_d", 2, "/root/dir", "test_c_d2.wav", 102, "x")
    report = {r.label: (r.n, r.n_frames) for r in duration_report(m.filter("split = 'test_a_b'"), ["label"]).collect()}
    assert report == {"x": (3, 306), "y": (2, 204)}


def test_unlabelled_and_malformed_manifests(spark, tmp_path):
    p = tmp_path / "train.tsv"
    p.write_text("/r\na.wav\t5\nb.wav\t6\n")
    got = read_manifest(spark, str(p), labelled=False).orderBy("line_no").collect()
    assert [(r.line_no, r.path, r.n_frames, r.label) for r in got] == [(0, "a.wav", 5, None), (1, "b.wav", 6, None)]
    with pytest.raises(Exception, match=r"train line \d: malformed"):
        read_manifest(spark, str(p)).collect()
    kept = read_manifest(spark, str(p), on_bad="keep").orderBy("line_no").collect()
    assert [r.bad for r in kept] == ["a.wav\t5", "b.wav\t6"]


def test_line_numbers_survive_file_splits(spark, tmp_path):
    p = tmp_path / "big.txt"
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    p.write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = numbered_lines(spark, str(p), header=False)
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 5
        got = {r.line_no: r.line for r in df.collect()}
        assert got == dict(enumerate(lines))
        first = numbered_lines(spark, str(p), header=True).collect()
        assert {r.line_no: r.line for r in first} == dict(enumerate(lines[1:]))
        assert {r.root for r in first} == {lines[0].strip()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_label_files(spark, tmp_path):
    (tmp_path / "dev.ltr").write_text("a\tq?\tsome text.\nb\tq?\tother\th#y*p.\n")
    got = read_labels(spark, str(tmp_path / "dev.ltr")).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [
        ("dev", 0, "a", "q?", "some text.", None), ("dev", 1, "b", "q?", "other", "h#y*p."),
    ]
    (tmp_path / "one.ltr").write_text("Just a transcript.\n")
    assert read_labels(spark, str(tmp_path / "one.ltr"), "transcript").first().text == "Just a transcript."
    with pytest.raises(Exception, match="one line 0"):
        read_labels(spark, str(tmp_path / "one.ltr")).collect()
    (tmp_path / "five.ltr").write_text("a\tb\tc\td\te\n")
    with pytest.raises(Exception, match="3 or 4 columns"):
        read_labels(spark, str(tmp_path / "five.ltr")).collect()


def test_manifest_pair_round_trip(spark, tmp_path):
    rows = [(s, i, f"t{i % 2}", "q?", f"hyp {s} {i}", f"{s}{i}.wav", 10 + i) for s in ("u v", "w") for i in range(25)]
    df = spark.createDataFrame(rows, "split string, line_no bigint, target string, prompt string, hyp string, path string, n_frames bigint")
    out = str(tmp_path / "pair")
    write_manifest_pair(df.repartition(4), out, root="/data", lines_per_file=10)
    m = read_manifest(spark, out + "/tsv").withColumnRenamed("label", "target")
    lab = read_labels(spark, out + "/ltr").withColumnRenamed("text", "hyp2")
    both = m.join(lab, ["split", "line_no"]).filter("target = answer")
    got = {(r.split, r.line_no, r.target, r.hyp2, r.path, r.n_frames, r.root) for r in both.collect()}
    assert got == {(s, i, t, h, p, n, "/data") for s, i, t, _, h, p, n in rows}
    bad = df.withColumn("hyp", F.lit("a\tb"))
    with pytest.raises(Exception, match="tab or newline"):
        write_manifest_pair(bad, str(tmp_path / "bad"))


def test_runs_replace_only_their_cells(spark, tmp_path):
    schema = "scenarios string, model_tag string, n_shot int, exp string, seed int, acc double, acc_cf double, n_chop bigint"
    a = spark.createDataFrame([("1_2", "m", 0, "base", 0, 0.5, 0.6, 20), ("1_2", "m", 2, "base", 1, None, None, None)], schema)
    b = spark.createDataFrame([("1_2", "m", 0, "base", 0, 0.7, 0.8, 30)], schema)
    out = str(tmp_path / "runs")
    write_runs(a, out)
    write_runs(b, out)
    got = {(r.scenarios, r.n_shot, r.seed): (r.acc, r.n_chop) for r in read_runs(spark, out).collect()}
    assert got == {("1_2", 0, 0): (0.7, 30), ("1_2", 2, 1): (None, None)}


def test_predictions_of_one_cell_take_several_files(spark, tmp_path):
    cell = ("1_2", "m", 0, "base", 0)
    df = spark.createDataFrame(
        [(*cell, i, i % 2, [0.5, 0.5]) for i in range(200)],
        "scenarios string, model_tag string, n_shot int, exp string, seed int, id bigint, truth int, probs array<double>",
    )
    out = tmp_path / "preds"
    write_runs(df.repartition(3), str(out), files_per_cell=4)
    assert read_runs(spark, str(out)).count() == 200
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_runs(df, str(out), files_per_cell=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert read_runs(spark, str(out)).count() == 200 and len(list(out.rglob("*.parquet"))) > 1


def test_report_csv(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (0, "60.00% (50.00) (Nr:20.0)")], "n_shot int, m1 string")
    report_csv(df, str(tmp_path / "r"))
    files = list((tmp_path / "r").glob("*.csv"))
    assert len(files) == 1
    assert files[0].read_text().splitlines() == ["n_shot,m1", "0,60.00% (50.00) (Nr:20.0)", "2,"]


def test_scan_audio(spark, tmp_path):
    for i, rate in enumerate((16000, 8000)):
        with wave.open(str(tmp_path / f"{i}.wav"), "wb") as w:
            w.setnchannels(1 + i)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\0" * 2 * (1 + i) * 800)
    plain = (tmp_path / "0.wav").read_bytes()
    extra = b"LIST" + struct.pack("<I", 9000) + b"\0" * 9000
    late = plain[:36] + extra + plain[36:]
    (tmp_path / "late.wav").write_bytes(b"RIFF" + struct.pack("<I", len(late) - 8) + late[8:])
    (tmp_path / "broken.wav").write_bytes(b"not audio")
    got = {r.path.rsplit("/", 1)[1]: r for r in scan_audio(spark, str(tmp_path)).collect()}
    assert (got["0.wav"].sample_rate, got["0.wav"].n_frames, got["0.wav"].duration_s) == (16000, 800, 0.05)
    assert (got["1.wav"].sample_rate, got["1.wav"].n_frames, got["1.wav"].duration_s) == (8000, 800, 0.1)
    assert got["late.wav"].n_frames == 800 and got["late.wav"].error is None
    assert got["broken.wav"].n_frames is None and got["broken.wav"].error


def test_streaming_rollup_equals_batch(spark, tmp_path):
    log = spark.range(1000).select(
        F.col("id").alias("update"), (F.col("id") % 7).cast("double").alias("loss"),
        (F.col("id") % 5 + 1).alias("ntokens"), F.lit(1).cast("bigint").alias("sample_size"),
    )
    src, out, ck = (str(tmp_path / n) for n in ("log", "out", "ck"))
    log.filter("id < 500").coalesce(1).write.parquet(src)
    follow_log(read_log(spark, src, log.schema), out, ck, once=True).awaitTermination(60)
    log.filter("id >= 500").coalesce(1).write.mode("append").parquet(src)
    follow_log(read_log(spark, src, log.schema), out, ck, once=True).awaitTermination(60)
    want = sorted(tuple(r) for r in rollup_log(log).collect())
    got = sorted(tuple(r) for r in latest(spark, out).select(*rollup_log(log).columns).collect())
    assert got == want

"""Golden values and brute force for the column functions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.functions import edits as E
from earshot.functions import keys as K
from earshot.functions import sequences as S
from earshot.functions import text as T
from earshot.functions import vectors as V
from earshot.operators.sampling import gumbel_softmax, temperature_at


def one(spark, expr, **cols):
    names, values = list(cols), tuple(cols.values())
    df = spark.createDataFrame([values], names) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "fn, given_text, expected",
    [
        (T.normalize_letters, "H E | L O", "he lo"),
        (T.normalize_letters, " A\tB |\n| C ", "ab  c"),
        (T.ensure_period, " a b ", "a b."),
        (T.ensure_period, "a.", "a."),
        (T.ensure_period, "", "."),
        (T.strip_dots, "..a.b..", "a.b"),
        (T.unescape_hyp, "..a#b*c.", "a\tb\nc"),
        (T.first_sentence, "hello there . more", "hello there."),
        (T.first_sentence, "no stop ", "no stop."),
        (T.first_line, ". hi there. \nsecond", "hi there."),
        (T.clean_target, " .news. ", "news"),
        (T.render_answer, "news", " news\n"),
        (T.render_label, "news", " news"),
        (T.split_words, "  a  b\n\x1cc\xa0d ", ["a", "b", "c", "d"]),
        (T.split_words, " \n ", []),
        (T.split_words, "", []),
    ],
)
def test_text(spark, fn, given_text, expected):
    assert one(spark, fn("c"), c=given_text) == expected


def test_every_python_space_splits_and_strips(spark):
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    assert sorted(spaces) == sorted(T.PY_SPACE)
    rows = [(f"{s}a{s}{s}b{s}",) for s in spaces] + [("a​b",), ("a\x00b",)]
    df = spark.createDataFrame(rows, ["c"]).select("c", T.split_words("c"), T.strip("c"), T.rstrip("c"))
    for c, words, stripped, right in df.collect():
        assert words == c.split() and stripped == c.strip() and right == c.rstrip()


def test_normalizer_by_corpus(spark):
    rows = [("libri100", "H I | Y O U"), ("flickr8k", " A dog "), ("voxceleb", "a cat.")]
    df = spark.createDataFrame(rows, ["d", "t"]).select(T.normalizer_for("d", "t").alias("x"))
    assert [r.x for r in df.collect()] == ["hi you.", "A dog.", "a cat."]
    bad = spark.createDataFrame([("other", "x")], ["d", "t"]).select(T.normalizer_for("d", "t"))
    with pytest.raises(Exception, match="not implemented"):
        bad.collect()


def test_model_key(spark):
    path = T.checkpoint_path(F.lit("outputs/wav{v}/best.pt"), F.lit(8))
    assert one(spark, path) == "outputs/wav8/best.pt"
    assert one(spark, T.model_tag(path)) == "wav8"


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_bit_edits(a, b):
    assert E.bit_edits(a, b) == brute(a, b)
    assert E.bit_edits(a, b, reach=1, chunk=3) == brute(a, b)
    assert E.bit_edits(a, b, reach=1, chunk=1) == brute(a, b)


def test_bit_edits_of_long_texts_that_stray_from_the_diagonal():
    r = random.Random(5)
    a = [r.choice("abcdef") for _ in range(700)]
    for b in (a[300:] + a[:300], a[:100] + a[400:], a[::-1], ["z"] * 650, a[200:] + ["q"] * 90):
        assert E.bit_edits(a, b) == E.bit_edits(a, b, reach=1, chunk=7) == brute(a, b)


_words = st.lists(st.sampled_from(["a", "b", "ab", "ba", "é", "", "c\td", "ccc"]), max_size=30).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(_words, _words)
def test_text_distances(a, b):
    assert E.char_distance(a, b) == brute(a, b)
    assert E.word_distance(a, b) == brute(a.split(), b.split())
    assert E.both_distances(a, b) == (brute(a, b), brute(a.split(), b.split()))


def test_text_distances_of_damaged_copies(monkeypatch):
    """Copies with lost and overwritten words: only the stretches that differ meet the dynamic program."""
    r = random.Random(11)
    whole = E._band_edits
    widths = []

    def seen(b, m, *rest):
        widths.append(m)
        return whole(b, m, *rest)

    for n_words, size in ((5000, 200), (20, 600)):
        names = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(n_words)]
        a = [r.choice(names) for _ in range(size)]
        b = ["#" * len(w) if r.random() < 0.1 else w for w in a if r.random() > 0.15]
        want = brute(" ".join(a), " ".join(b)), brute(a, b)
        assert E.both_distances(" ".join(a), " ".join(b)) == want
        assert E.both_distances(" ".join(b), " ".join(a)) == want
        a, b = a + ["x"] * 5 + a[::-1], b[::-1]
        assert E.both_distances(" ".join(a), " ".join(b)) == (E.bit_edits(" ".join(a), " ".join(b)), E.bit_edits(a, b))
    monkeypatch.setattr(E, "_band_edits", seen)
    a = [f"w{i}" for i in range(20000)]
    b = ["#" * len(w) if i % 11 == 0 else w for i, w in enumerate(a) if i % 7]
    chars, words = E.both_distances(" ".join(a), " ".join(b))
    lost = [w for i, w in enumerate(a) if i % 7 == 0]
    over = [w for i, w in enumerate(a) if i % 7 and i % 11 == 0]
    assert (chars, words) == (sum(map(len, lost)) + len(lost) + sum(map(len, over)), len(lost) + len(over))
    assert max(widths, default=0) < 100


def test_edit_columns_on_short_and_long_texts(spark):
    r = random.Random(3)
    words = ["ab", "é", "cde", "f", "gh", "漢", "i"]
    pairs = [("a b c b", "a c b d"), ("é", "e"), ("", "abc"), ("same", "same"), (None, "x"), ("x", None)]
    for n in (5, 60, 300):
        for _ in range(4):
            a = [r.choice(words) for _ in range(n)]
            b = [w if r.random() > 0.2 else r.choice(words) for w in a if r.random() > 0.1]
            pairs.append((" ".join(a), "  ".join(b)))
    df = spark.createDataFrame(pairs, ["r", "h"])
    out = df.select("r", "h", E.char_edits("r", "h"), E.char_edits("r", "h", False), E.word_edits("r", "h"))
    for ref, hyp, chars, native, word in out.collect():
        if ref is None or hyp is None:
            assert chars is None and native is None and word is None
            continue
        assert chars == native == brute(ref, hyp)
        assert word == brute(ref.split(), hyp.split())


def test_text_edits_are_both_columns(spark):
    text = " ".join(f"w{i % 37}" for i in range(400))
    pairs = [("a b", "a c"), ("", ""), (None, "x"), ("x", None), (text, text.replace(" w5", "")), (text, text[::-1]), (text, "")]
    df = spark.createDataFrame(pairs, ["r", "h"])
    got = df.select(E.char_edits("r", "h"), E.word_edits("r", "h"), *E.text_edits("r", "h")).collect()
    assert all(x[:2] == x[2:] for x in map(tuple, got))
    assert tuple(got[2][2:]) == tuple(got[3][2:]) == (None, None)


def test_vectors_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 16)) * 8
    x[0, 3] = x[0, 9] = 99.0
    x[1] += 2000.0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], ["i", "s"])
    tokens = [2, 5, 11]
    got = df.select(
        "i", V.softmax("s").alias("soft"), V.log_softmax("s").alias("log"), V.vocab_probs("s", tokens).alias("voc"),
        V.label_probs("s", tokens).alias("lab"), V.argmax("s").alias("best"),
    ).orderBy("i").collect()
    e = np.exp(x - x.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    lab = p[:, tokens] / p[:, tokens].sum(1, keepdims=True)
    for g, pi, li, xi in zip(got, p, lab, x):
        np.testing.assert_allclose(g.soft, pi, rtol=1e-9, atol=1e-300)
        np.testing.assert_allclose(np.exp(g.log), pi, rtol=1e-9, atol=1e-300)
        np.testing.assert_allclose(g.voc, pi[tokens], rtol=1e-9, atol=1e-300)
        np.testing.assert_allclose(g.lab, li, rtol=1e-9)
        assert abs(sum(g.lab) - 1) < 1e-12
        assert g.best == int(np.argmax(xi))


def test_calibration_modes(spark):
    cols = {"p": [0.6, 0.4], "q": [0.8, 0.2]}
    np.testing.assert_allclose(one(spark, V.calibrate("p", "q", "diagonal_W"), **cols), [0.75, 2.0])
    np.testing.assert_allclose(one(spark, V.calibrate("p", "q", "identity_W"), **cols), [-0.2, 0.2])
    assert one(spark, V.calibrate("p"), **cols) == [0.6, 0.4]
    assert one(spark, V.argmax(V.calibrate("p", "q", "diagonal_W")), **cols) == 1
    with pytest.raises(ValueError):
        V.calibrate("p", "q", "other")
    zero = {"p": [0.6, 0.4], "q": [1.0, 0.0]}
    with pytest.raises(Exception, match="zero"):
        one(spark, V.calibrate("p", "q", "diagonal_W"), **zero)
    assert one(spark, V.calibrate("p", "q", "diagonal_W", "null"), **zero) == [0.6, None]


def test_argmax_takes_the_first_of_a_tie(spark):
    assert one(spark, V.argmax("a"), a=[1.0, 3.0, 3.0]) == 1


@pytest.mark.parametrize(
    "expr, cols, expected",
    [
        (lambda: S.position_ids("m"), {"m": [1, 0, 1, 1, 0]}, [0, 1, 1, 2, 1]),
        (lambda: S.downsample("a", 2), {"a": [1.0, 3.0, 5.0, 7.0, 9.0, 11.0, 99.0]}, [2.0, 6.0, 10.0]),
        (lambda: S.downsample("a", 4), {"a": [1.0]}, []),
        (lambda: S.downsample("a", 2, [1.0, -1.0]), {"a": [5.0, 3.0, 1.0, 4.0]}, [2.0, -3.0]),
        (lambda: S.downsample_mask("m", F.lit(3), 2), {"m": [1, 0, 1, 1]}, [1, 1, 0]),
        (lambda: S.chop("a", 2), {"a": [1, 2, 3]}, [1, 2]),
        (lambda: S.chop("a", 0), {"a": [1, 2, 3]}, [1, 2, 3]),
        (lambda: S.compact("a", "m"), {"a": [7, 8, 9], "m": [1, 0, 1]}, [7, 9]),
        (lambda: S.strip_pad("a", 0), {"a": [7, 0, 9, 0]}, [7, 9]),
        (lambda: S.truncate_tokens("a", 3), {"a": [1, 2, 3, 4]}, [1, 2]),
        (lambda: S.wrap_tokens("a", 9, 9), {"a": [1, 2]}, [9, 1, 2, 9]),
        (lambda: S.last_scores("a", 1), {"a": [1, 2, 3]}, 2),
        (lambda: S.shift_pairs("a", "b"), {"a": [1, 2, 3], "b": [4, 5, 6]}, [(1, 5), (2, 6)]),
    ],
)
def test_sequences(spark, expr, cols, expected):
    got = one(spark, expr(), **cols)
    assert [tuple(x) if isinstance(x, tuple) else x for x in got] == expected if isinstance(expected, list) else got == expected


def test_position_ids_of_empty_and_missing_masks(spark):
    df = spark.createDataFrame([(0, [1, 1]), (1, []), (2, None), (3, [0, 1])], "i int, m array<int>")
    got = {r.i: r.x for r in df.select("i", S.position_ids("m").alias("x")).collect()}
    assert got == {0: [0, 1], 1: [], 2: None, 3: [1, 0]}


def test_keys_do_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    a = {r.id: (r.k, r.u) for r in df.repartition(3).select("id", K.order_key(5, "id").alias("k"), K.uniform(5, "id").alias("u")).collect()}
    b = {r.id: (r.k, r.u) for r in df.repartition(17).select("id", K.order_key(5, "id").alias("k"), K.uniform(5, "id").alias("u")).collect()}
    assert a == b and all(0 < u < 1 for _, u in a.values())
    assert abs(np.mean([u for _, u in a.values()]) - 0.5) < 0.05


def test_gumbel_softmax_and_temperature(spark):
    df = spark.range(3000).select("id", F.array(F.lit(0.0), F.lit(np.log(3.0))).alias("l"))
    soft = df.select(gumbel_softmax("l", 0, "id", 1.0).alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in soft)
    assert abs(np.mean([r.p[1] > r.p[0] for r in soft]) - 0.75) < 0.03
    assert one(spark, temperature_at(F.lit(0))) == 2.0
    assert one(spark, temperature_at(F.lit(10_000_000))) == 0.5

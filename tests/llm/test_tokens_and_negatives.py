"""Encoding, alignment and hard negatives against the libraries and brute force, with odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import align, bpe, negatives
from earshot.llm.common import settle, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def odd_texts():
    rng = random.Random(3)
    texts = [
        None, "", " ", "\n", "one", "one one", "one one", "Don't stop, we'LL see. it's 12,000", "a<|endoftext|>b <|startoftext|>",
        "İstanbul ΣΑΣ σς ﬁ ½ ²x", "x\x1cy\x85z　q", "é ́x", "\U0001f600 世界 龘 don't", "  lead", "trail  ",
        "\n\n x\t y  z\n", "a▁b", "<s> </s> <unk> <0x41>", "a\x00b", "ab" * 5000, "the cat sat, " * 3000, "zq" * 300 + " " + "é" * 300,
    ]
    for _ in range(300):
        kinds = [(32, 127), (32, 127), (32, 0x250), (0x20, 0xD800), (0x10000, 0x1FFFF)]
        texts.append("".join(" " if rng.random() < 0.2 else chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(1, 50))))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, "clash", 1) for i, t in enumerate(odd_texts())] + [(5, "one one", "clash", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- encoding -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", A])
def test_ids_and_texts_equal_the_library(spark, docs, empty, name):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path(name))
    got = bpe.decode_texts(bpe.encode_texts(docs, tokenizer_path(name)), tokenizer_path(name)).collect()
    want = []
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got), key=key) == sorted(want, key=key)
    assert bpe.decode_texts(bpe.encode_texts(empty, tokenizer_path(name)), tokenizer_path(name)).count() == 0


def merged(word, merges):
    """Merging in rank order, leftmost first."""
    while True:
        found = [(merges[p], i) for i, p in enumerate(zip(word, word[1:])) if p in merges]
        if not found:
            return word
        i = min(found)[1]
        word = [*word[:i], word[i] + word[i + 1], *word[i + 2 :]]


def test_prefix_encoding_of_random_vocabularies():
    rng = random.Random(5)
    for _ in range(40):
        symbols = ["a", "b", "c"]
        names, merges = list(symbols), {}
        for _ in range(rng.randrange(3, 25)):
            x, y = rng.choice(names), rng.choice(names)
            if x + y not in names and (x, y) not in merges:
                merges[x, y] = len(merges)
                names.append(x + y)
        vocab = {n: i for i, n in enumerate(names)}
        table = bpe.PairTable(vocab, list(merges))
        auto = bpe.SuffixAutomaton({t: s for t, s in table.symbols.items() if table.whole[t]})
        model = object.__new__(bpe.Bpe)
        model.ignore_merges, model.pair, model.automaton = {}, table, auto
        model.inner = model.final = {ord(c): vocab[c] for c in symbols}
        for _ in range(60):
            word = "".join(rng.choice(symbols) for _ in range(rng.randrange(1, 30)))
            assert model.encode_piece(word.encode()) == [vocab[t] for t in merged(list(word), merges)], (word, merges)


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError, match="order"):
        bpe.PairTable({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])


def test_suffixes_are_the_tokens_that_end_a_prefix():
    words = {0: (1,), 1: (2,), 2: (1, 2), 3: (2, 1, 2), 4: (1, 1), 5: (2, 2, 1)}
    auto = bpe.SuffixAutomaton(words)
    text = [random.Random(1).choice([1, 2]) for _ in range(200)]
    state = held = 0
    for i, s in enumerate(text):
        while s not in auto.step[state]:
            state = auto.link[state]
            held = auto.length[state]
        state, held = auto.step[state][s], held + 1
        got = {t for m, t in auto.suffixes[state] if m <= held}
        assert got == {t for t, w in words.items() if tuple(text[max(0, i + 1 - len(w)) : i + 1]) == w}


# --- alignment ------------------------------------------------------------------------------


def aligned(both, text):
    """Groups and links of one text from whole encodings and decoded bytes."""
    if not text:
        return "", [], 0, 0, 0
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = [[t[i] for i in ids] for t, ids in ((both.bytes_a, a), (both.bytes_b, b))]
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return "", [], 0, 0, 0
    ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        links += [(x, y) for x in a[i:p] for y in b[j:q]]
        i, j = p, q
    return ";".join(groups), links, len(a), len(b), len(groups)


@pytest.mark.parametrize("hot", [1_000_000, 40, 0])
def test_alignment_equals_brute_force(spark, docs, hot):
    short = docs.filter("text is null or length(text) < 3000")
    paths = tokenizer_path(A), tokenizer_path(B)
    both = align.Aligner(*paths)
    spans = settle(align.align_spans(short, *paths), "spans")
    got = align.count_links(spans, align.pair_counts(spans), hot=hot).collect()
    plain = [(r["doc_id"], *aligned(both, r["text"])) for r in short.collect()]
    count = {}
    for p in plain:
        for pair in set(p[2]):
            count[pair] = count.get(pair, 0) + 1
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    want = [
        (i, n_a, n_b, n, len(links), groups, sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links))
        for i, groups, links, n_a, n_b, n in plain
    ]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=key) == sorted(want, key=key)


def test_long_runs_are_counted_not_listed(spark, empty):
    paths = tokenizer_path(A), tokenizer_path(B)
    both = align.aligner(*paths)
    for text in ("龘" * 400, "\n" * 5000, " " * 3000 + "x", "ab" * 4000):
        found = both.align([text])[0]
        keys, times = align.linked(found)
        groups, links, *_ = aligned(both, text)
        assert ";".join(map(align.GROUPS, found)) == groups
        want = {}
        for a, b in links:
            want[a << align.SPLIT | b] = want.get(a << align.SPLIT | b, 0) + 1
        assert dict(zip(keys.tolist(), times.tolist())) == want
    spans = settle(align.align_spans(empty, *paths), "spans")
    assert align.count_links(spans, align.pair_counts(spans)).count() == 0


def test_spans_are_refined_by_bytes():
    # two tokens share a character of three bytes, then a plain one, then three byte pieces with one surface
    begin, end = np.array([0, 0, 3, 4, 4, 4]), np.array([3, 3, 4, 4, 4, 7])
    assert align.refined_ends(begin, end, np.array([1, 2, 1, 1, 1, 1])).tolist() == [1, 3, 4, 5, 6, 7]
    assert align.refined_ends(begin, end, np.array([1, 1, 1, 1, 1, 1])) is None


# --- hard negatives -------------------------------------------------------------------------


def mined(rows, n_pos=5, n_neg=10):
    """Plain loop over rows (vec_id, embedding, label)."""
    good = [
        (i, [int(np.floor(256 * float(x))) for x in v], y)
        for i, v, y in rows
        if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, v, y in good:
        if i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in good if j != i and len(w) == len(v)]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for p, j, _ in [r for r in scored if r[2] == y][:n_pos]:
            near = [r for r in scored if r[2] != y and 30 * p <= 100 * r[0] <= 90 * p][:n_neg]
            out += [(i, j, k + 1, n, p, s) for k, (s, n, _) in enumerate(near)]
    return sorted(out)


def vectors(n=700, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (n, 6)).astype(np.float32)
    base[50:300] = base[40]  # ties
    rows = [(i, [float(x) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(base)]
    rows += [(9001, None, 1), (9002, [None] * 6, 1), (9003, [float("nan")] * 6, 0), (9100, [float("inf")] * 6, 0), (9200, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(9300, [0.0] * 6, 1), (9400, [-1.0] * 6, 2), (9500, [1.0, 2.0], 0), (9501, [1.0, 1.0], 0), (9502, [0.5, 0.5], 1), (9600, [], 0), (9601, [], 0), (9602, [], 1)]
    return rows + [rows[3], rows[100], rows[100]]


@pytest.mark.parametrize("held", [1 << 16, 3])
def test_mining_equals_brute_force(spark, held):
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, rank string").repartition(5)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, anchors_held=held)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)


def test_nothing_to_mine(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(one, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("top", [3, 200, 40_000, 1 << 27])
def test_packed_products_are_exact(top):
    rng = np.random.default_rng(top)
    c, a = rng.integers(-top, top + 1, (37, 9)).astype(float), rng.integers(-top, top + 1, (11, 9)).astype(float)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in c] for r in a]
    assert negatives.packed_products(c, a).tolist() == want
    far = [[sum((int(x) + 2**30) * int(y) for x, y in zip(s, r)) for s in c] for r in a]
    assert negatives.packed_products(c + 2.0**30, a).tolist() == far


def test_scores_beyond_64_bits_fail():
    with pytest.raises(OverflowError):
        negatives.packed_products(np.full((3, 4), 2.0**61), np.full((2, 4), 2.0**10))


def test_encoder_keeps_letters_once_whatever_marks_follow():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from earshot.llm.encoder import Encoder

    lib, enc = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    marks = ["", ",", ".", "...", "%%%", ",$$$", "(7", "'s", "?!'s", "-a-b", "«", "×,", "é.ß", "º."]
    texts = [f" {w}{m}\t{m}{w} {w.upper()}{m}{w}\n" for w in ("thing", "élève", "zxqvw", "ñandú", "o") for m in marks]
    odd = [None, "", " \n\t ", "İx, y", "<|endoftext|> a,", "x\x1cy", "ab\x85cd", "日本, 語", "a\x00b.", ",", "Ǆ.ɏ,", "".join(map(chr, range(0xA1, 0x250)))]
    mixed = [t for pair in itertools.zip_longest(texts, odd) for t in pair]
    want = [np.array(lib.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in mixed]
    column = pa.array([*odd, *mixed], pa.string()).slice(len(odd))
    assert enc.encode(mixed) == enc.encode_column(column).to_pylist() == want
    assert enc.encode([]) == enc.encode_column(pa.array([], pa.string())).to_pylist() == []
    enc = Encoder(tokenizer_path())
    enc.encode([" ".join(f"{w}{a}{b}" for w in ("thing", "élève") for a in "!#$%&()*" for b in ",.:;?")])
    assert len(enc.young) <= 42  # 80 words: two of letters, 40 runs of marks


def test_units_hold_a_bounded_number_of_bytes_and_every_row():
    import pyarrow as pa

    from earshot.llm.encoder import units

    column = pa.array(["x" * 9, None, "é" * 40, "", "ab", "cd", None], pa.string()).slice(1)
    assert list(units(column, 8)) == [(0, 2), (2, 6)]
    assert list(units(column, 2)) == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert list(units(column.slice(6), 8)) == []


def test_followers_are_counted_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from earshot.llm import lm

    rng, size = np.random.default_rng(2), 3000
    texts = [rng.integers(0, size - 2, n).astype("<u4") for n in (0, 1, 2, *[4000] * 1500)]
    place = np.arange(size)
    last = np.minimum(place, lm.LAST - 1)
    column = pa.array([t.tobytes() for t in texts], pa.binary())
    tracemalloc.start()
    got = lm._followers(column, last, place, 2048, size - 2, size - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 24 MB of ids; all at once took more than 200 MB
    want = np.zeros_like(got)
    for t in texts:
        row = np.array([size - 2, *t, size - 1])
        np.add.at(want, last[row[:-1]] * 2049 + np.minimum(place[row[1:]], 2048), 1)
    assert (got == want).all()


def test_sets_that_link_have_a_part_in_common():
    from earshot.llm import jaccard

    rng = np.random.default_rng(4)
    for percent in (50, 80, 90, 100):
        for n in (1, 2, 9, 10, 11, 19, 20, 37, 100, 333, 900):
            for _ in range(12):
                s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                away, more = rng.integers(0, n // 2 + 1), rng.integers(0, n // 2 + 1)
                t = np.unique(np.concatenate([s[away:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
                both = len(np.intersect1d(s, t))
                if len(t) and 100 * both >= percent * (len(s) + len(t) - both):
                    assert len(np.intersect1d(jaccard.parts(s, percent), jaccard.parts(t, percent)))
    a, b = (rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(2))
    b[:200] = a[:200]  # half in common: a prefix token meets, no part does
    assert not len(np.intersect1d(jaccard.parts(np.sort(a), 90), jaccard.parts(np.sort(b), 90)))


def test_components_name_every_node_of_long_chains(spark):
    from earshot.llm.components import components

    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(100, 400)] + [(k + 1000, 1000) for k in range(1, 60)] + [(7, 7), (None, 3), (2, 1), (1, 2), (5, 1)]
    rng.shuffle(chain)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 401)}, **{k: 1000 for k in range(1000, 1060)}, 1: 1, 2: 1, 5: 1}
    empty = components(spark.createDataFrame([], "a long, b long"))
    assert empty.columns == ["node", "component"] and not empty.collect()


def test_language_scores_take_bounded_memory():
    import tracemalloc

    from earshot.llm import langid

    rng = np.random.default_rng(6)
    model = langid.LanguageModel(list("abcde"), rng.normal(size=(langid.BUCKETS, 5)).astype(np.float32), 0.7, 0.0)
    texts = [None, "", " 12 ", *[" ".join(f"wört{k}{j % 97}e" for j in range(3000)) for k in "abc"]] * 30
    tracemalloc.start()
    got = model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 2.4 million characters; all at once took more than 150 MB
    assert np.array_equal(got, np.concatenate([model._scores([t]) for t in texts])) and model.scores([]).shape == (0, 5)


def test_encoder_holds_little_between_units():
    """In a process of its own, whose memory nothing else changes."""
    import subprocess
    import sys

    code = """
import re, sys
import pyarrow as pa
from earshot.llm.common import tokenizer_path
from earshot.llm.encoder import Encoder, units
def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
own = Encoder(tokenizer_path())
own.encode(["warm up"])
before = held()
for part in range(8):  # 320,000 words, all different
    words = [f"{x:08x}".translate(str.maketrans("0123456789", "ghijklmnop")) for x in range(40_000 * part, 40_000 * part + 40_000)]
    texts = pa.array([" ".join(words[i : i + 400]) * 10 for i in range(0, 40_000, 400)])
    for lo, hi in units(texts):
        own.encode_column(texts.slice(lo, hi - lo))
    del words, texts
print(held() - before)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert float(got.stdout) < 60


def test_language_model_deals_texts_to_learners_once(spark, monkeypatch):
    from earshot.llm import lm
    from earshot.llm.encoder import Encoder

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("red", "Blue", "naïve", "stone,", "x7")) for _ in range(rng.randrange(30)))) for i in range(60)] + [(70, None)]
    counts = lm.corpus_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_path())
    words = counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c"))
    texts = counts.filter("ids is not null").select("ids", "n", "deal").collect()
    whole = [np.frombuffer(t["ids"], dtype="<u2").astype("<u4").tobytes() for t in texts]  # two bytes an id
    own = Encoder(tokenizer_path())
    assert sorted(whole) == sorted(own.encode([t and t.lower() for _, t in rows]))
    n = sum(len(w) for w in whole) // 4 // 100
    dealt = spark.createDataFrame([(i, bytearray(w), t["n"]) for i, (w, t) in enumerate(zip(whole, texts, strict=True))], "i long, ids binary, n long")
    found = dealt.select("i", F.xxhash64("ids", "n").alias("deal")).select("i", "deal", F.pmod(F.hash("deal"), F.lit(n)).alias("k")).collect()
    assert n > 4 and {r["i"]: r["deal"] for r in found} == {i: t["deal"] for i, t in enumerate(texts)}
    written = []
    monkeypatch.setattr(lm, "settle", lambda df, name="part", **o: written.append(name) or settle(df, name, **o))
    got = lm.train(counts, words, tokenizer_path(), task_ids=100).weights
    assert written == ["dealt"]  # not again each round
    want = lm.train(counts, words, tokenizer_path(), rounds=0, task_ids=100)
    for r in range(2):
        sums, size = 0, 0
        for k in range(n):
            mine = sorted(whole[x["i"]] for x in found if x["k"] == k)
            one = lm.Attention(*[getattr(want, a) for a in ("rows", "last", "follow", "classes", "share", "start", "end")], want.weights.copy())
            if ids := sum(len(i) for i in mine):
                one.learn(lm._streamed(mine, want.start, want.end), seed=r)
                sums, size = sums + one.weights.astype(np.float64) * ids, size + ids
        want.weights = (sums / size).astype(np.float32)
    assert np.abs(got - want.weights).max() < 1e-6

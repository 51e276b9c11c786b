"""Score vectors, decoding, losses and the few-shot evaluation (SC, SM-3, SM-4, UD, ST)."""

from pyspark.sql import functions as F

from earshot.catalog.aggregates import SQL_SOFTMAX
from earshot.catalog.roles import scores, table, token_scores
from earshot.functions import vectors as V
from earshot.functions.sequences import last_scores
from earshot.operators import scoring as R
from earshot.operators.calibration import mean_vector
from earshot.operators.sequences import collect_batches
from earshot.operators.sweep import SEEDS, label_pairs
from earshot.plans.few_shot import few_shot_eval
from earshot.plans.generation import generate_hypotheses, transcribe
from earshot.session import settle, shared_dir
from earshot.sources.manifests import read_labels, read_manifest

PAD = 9


def _long(df, vec, *keys):
    out = df.select(*keys, F.posexplode(vec).alias("i", "p"))
    return out.withColumn("p", F.round("p", 6))


def sc3(spark, sf):
    return _long(scores(spark, sf).withColumn("v", V.softmax("scores")), "v", "id")


def sc3_log(spark, sf):
    return _long(scores(spark, sf).withColumn("v", V.log_softmax("scores")), "v", "id")


def sc4(spark, sf):
    p = scores(spark, sf).withColumn("v", V.label_probs("scores", [0, 3, 5, 7]))
    return _long(p, "v", "id", "truth")


def _with_prior(spark, sf, tokens):
    """Every score row beside the prior of the whole table."""
    s = scores(spark, sf)
    probs = s.select("id", "truth", V.label_probs("scores", tokens).alias("probs"))
    mean = mean_vector(s.select(V.vocab_probs("scores", tokens).alias("v")), "v")
    ordered = F.array_sort(F.collect_list(F.struct("class_id", "p")))
    prior = mean.agg(V.normalize(F.transform(ordered, lambda x: x["p"])))
    return probs.withColumn("prior", prior.scalar())


def sc5(spark, sf):
    d = _with_prior(spark, sf, [0, 1, 2, 3])
    both = d.select(
        "id",
        F.arrays_zip(
            V.calibrate("probs", "prior", "diagonal_W").alias("diagonal_w"),
            V.calibrate("probs", "prior", "identity_W").alias("identity_w"),
            F.col("probs").alias("plain"),
        ).alias("z"),
    )
    x = both.select("id", F.posexplode("z").alias("i", "z")).select("id", "i", "z.*")
    return x.select("id", "i", *[F.round(c, 6).alias(c) for c in ("diagonal_w", "identity_w", "plain")])


def sm3(spark, sf):
    s = scores(spark, sf)
    return s.select("id", V.argmax("scores").alias("best"))


def sc6(spark, sf):
    t = token_scores(spark, sf).withColumn("lprobs", V.log_softmax("scores"))
    return R.masked_nll(t, PAD, "seq", "pos", "target", "lprobs").withColumn("loss", F.round("loss", 6))


def sc6_dedicated(spark, sf):
    t = token_scores(spark, sf).withColumn("lprobs", V.log_softmax("scores"))
    n = R.masked_nll(t, PAD, "seq", "pos", "target", "lprobs", pad_is_eos=False)
    return n.withColumn("loss", F.round("loss", 6))


def sc7(spark, sf):
    return R.token_accuracy(token_scores(spark, sf), PAD, ["seq"], "target", "scores")


def sc6_prefix(spark, sf):
    """The first three positions of every sequence are a prompt."""
    t = token_scores(spark, sf).withColumn("lprobs", V.log_softmax("scores"))
    n = R.masked_nll(t, PAD, "seq", "pos", "target", "lprobs", ignore_prefix=3)
    return n.withColumn("loss", F.round("loss", 6))


def sc7_prefix(spark, sf):
    return R.token_accuracy(token_scores(spark, sf), PAD, ["seq"], "target", "scores", "pos", 3)


def sc8(spark, sf):
    s = R.shift_scores(token_scores(spark, sf), "seq", "pos", "scores", "target")
    return s.select(
        "seq", "pos", "target", V.argmax("prev_scores").alias("predicted"),
        F.round(last_scores("prev_scores").cast("double"), 6).alias("last"),
        F.round(last_scores("prev_scores", 1).cast("double"), 6).alias("before_last"),
    )


def sm4(spark, sf):
    """Sequences decoded over all 64 scores, eos = 3."""
    d = R.greedy_decode(token_scores(spark, sf), "seq", "pos", "scores", eos=3)
    return d.select("seq", F.array_join("tokens", ",").alias("tokens"))


def st1(spark, sf):
    """Predictions of two batches, even and odd rows, as one table."""
    s = scores(spark, sf).select("id", "truth", V.argmax("scores").alias("best"))
    return collect_batches(s.filter("id % 2 = 0"), s.filter("id % 2 = 1"))


def _pairs(spark, sf):
    """Label pairs of the score table with their tokens, classes in label order."""
    e = table(spark, sf, "embeddings")
    labels = e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("label").alias("pos"), F.col("label").cast("string").alias("label")
    )
    return label_pairs(labels).select(
        "scenarios", F.array("pos_a", "pos_b").alias("label_tokens")
    )


def runs(spark, sf):
    """UD-3 on every label pair: rows of the pair's two labels, all rows as its content-free inputs."""
    s = scores(spark, sf).withColumnRenamed("truth", "token")
    pairs = settle(_pairs(spark, sf), "pairs")
    members = pairs.select("*", F.posexplode("label_tokens").alias("truth", "token"))
    samples = s.join(members, "token")
    mean = mean_vector(s.select(V.softmax("scores").alias("v")), "v").withColumnRenamed("class_id", "token")
    per_pair = members.join(mean, "token").groupBy("scenarios")
    ordered = F.array_sort(F.collect_list(F.struct("truth", "p")))
    prior = per_pair.agg(V.normalize(F.transform(ordered, lambda x: x["p"])).alias("p_cf"))
    return few_shot_eval(samples, prior, "label_tokens", ["scenarios"], SEEDS)


def ud3(spark, sf):
    r = runs(spark, sf)
    return r.select(
        "scenarios", "seed", F.round("acc", 6).alias("acc"), F.round("acc_cf", 6).alias("acc_cf"),
        "n_chop", "n_classes", "n",
    )


def _doubled():
    """A stand-in for a frozen model: scores in, scaled scores out."""

    def predict(x):
        return (x * 2.0).astype("float32")

    return predict


def ud1(spark, sf):
    """The stand-in model over every row; its best token is that of the scores."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = R.score(e, _doubled, ["embedding"], shapes=[[64]])
    return out.select(
        "vec_id", V.argmax("scores").alias("best"),
        F.round(F.array_max("scores").cast("double"), 5).alias("top"),
    )


def _echo():
    def generate(text):
        if "#" in text:
            raise ValueError("mark in text")
        return text + "\nsecond line"

    return generate


def ud2(spark, sf):
    """A stand-in generator over every document; texts with a mark fail and say so."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    g = generate_hypotheses(d, _echo, ["text"], "lang")
    return g.select("doc_id", "target", "prompt", "hyp", "error")


def _echo_batches():
    def generate(texts):
        if any("#" in t for t in texts):
            raise ValueError("mark in text")
        return [t + "\nsecond line" for t in texts]

    return generate


def ud2_batches(spark, sf):
    """The stand-in called with 32 documents at a time; a batch with a marked text is halved."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    g = generate_hypotheses(d, _echo_batches, ["text"], "lang", batch_size=32)
    return g.select("doc_id", "target", "prompt", "hyp", "error")


def ud2_plan(spark, sf):
    """Up to 200 documents of every language through the generation stage, and read back."""
    d = table(spark, sf, "documents").select(
        F.col("lang").alias("split"), F.col("doc_id").alias("id"), F.col("source").alias("target"), "text",
        F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"), F.col("n_chars").alias("n_frames"),
    )
    out = shared_dir(spark, "transcripts")
    transcribe(d, _echo_batches, ["text"], out, 200, seed=3, batch_size=32, root="/corpus")
    lines = read_labels(spark, f"{out}/ltr")
    files = read_manifest(spark, f"{out}/tsv").select("split", "line_no", "root", "path", "n_frames", "label")
    both = lines.join(files, ["split", "line_no"])
    return both.select(
        "split", "line_no", "root", "path", "n_frames", "label", "answer", "question", F.md5("text").alias("text_md5")
    )


QUERIES = {
    "sc3_softmax": sc3,
    "sc3_log_softmax": sc3_log,
    "sc4_label_probs": sc4,
    "sc5_calibrate": sc5,
    "sm3_argmax_label": sm3,
    "sc6_masked_nll": sc6,
    "sc6_masked_nll_dedicated_pad": sc6_dedicated,
    "sc7_token_accuracy": sc7,
    "sc6_masked_nll_prefix": sc6_prefix,
    "sc7_token_accuracy_prefix": sc7_prefix,
    "sc8_shift_scores": sc8,
    "sm4_greedy_decode": sm4,
    "st1_collect_batches": st1,
    "ud1_score": ud1,
    "ud2_generate_hypotheses": ud2,
    "ud2_generate_batches": ud2_batches,
    "ud2_generation_plan": ud2_plan,
    "ud3_few_shot_eval": ud3,
}

SQL_SEQ = "SELECT vec_id // 10 AS seq, vec_id % 10 AS pos, label AS target, embedding AS v FROM embeddings"
SQL_BEST = "CAST(list_position(v, list_max(v)) - 1 AS INTEGER)"

# Few-shot runs of every label pair; also the base of the sweep reports.
SQL_RUNS = f"""
  {SQL_SOFTMAX},
  mean AS (SELECT i, avg(q) AS p FROM (SELECT unnest(p) AS q, generate_subscripts(p, 1) - 1 AS i FROM p) GROUP BY i),
  labels AS (SELECT DISTINCT truth AS l FROM p),
  pairs AS (SELECT a.l AS a, b.l AS b, a.l || '_' || b.l AS scenarios,
                   ma.p / (ma.p + mb.p) AS cf_a, mb.p / (ma.p + mb.p) AS cf_b
            FROM labels a JOIN labels b ON a.l < b.l JOIN mean ma ON ma.i = a.l JOIN mean mb ON mb.i = b.l),
  j AS (SELECT scenarios, id, truth,
               CAST((CASE WHEN p.p[b + 1] > p.p[a + 1] THEN b ELSE a END) = truth AS INTEGER)::DOUBLE AS ok,
               CAST((CASE WHEN p.p[b + 1] / cf_b > p.p[a + 1] / cf_a THEN b ELSE a END) = truth AS INTEGER)::DOUBLE AS ok_cf
        FROM p JOIN pairs ON truth IN (a, b)),
  chop AS (SELECT scenarios, min(n) AS n_chop, count(*) AS n_classes
           FROM (SELECT scenarios, truth, count(*) AS n FROM j GROUP BY ALL) GROUP BY scenarios),
  o AS (SELECT j.*, CAST(s.seed AS INTEGER) AS seed,
               row_number() OVER (PARTITION BY scenarios, truth, s.seed ORDER BY md5(s.seed || ':' || id), id) AS rn
        FROM j, range(5) s(seed)),
  runs AS (SELECT scenarios, seed, avg(ok) AS acc, avg(ok_cf) AS acc_cf, any_value(n_chop) AS n_chop,
                  any_value(n_classes) AS n_classes, count(*) AS n
           FROM o JOIN chop USING (scenarios) WHERE rn <= n_chop GROUP BY scenarios, seed)
"""

ORACLES = {
    "sc3_softmax": f"""
      WITH {SQL_SOFTMAX}
      SELECT id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS i, round(unnest(p), 6) AS p FROM p""",
    "sc3_log_softmax": f"""
      WITH {SQL_SOFTMAX}
      SELECT id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS i, round(ln(unnest(p)), 6) AS p FROM p""",
    "sc4_label_probs": f"""
      WITH {SQL_SOFTMAX}, q AS (SELECT id, truth, [p[1], p[4], p[6], p[8]] AS q FROM p)
      SELECT id, truth, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS i, round(unnest(q) / list_sum(q), 6) AS p FROM q""",
    "sc5_calibrate": f"""
      WITH {SQL_SOFTMAX},
      m AS (SELECT i, avg(q) AS m FROM (SELECT unnest(p[1:4]) AS q, generate_subscripts(p[1:4], 1) AS i FROM p) GROUP BY i),
      w AS (SELECT i, m / sum(m) OVER () AS w FROM m),
      l AS (SELECT id, generate_subscripts(p[1:4], 1) AS i, unnest(p[1:4]) / list_sum(p[1:4]) AS q FROM p)
      SELECT id, CAST(i - 1 AS INTEGER) AS i, round(q / w, 6) AS diagonal_w, round(q - w, 6) AS identity_w, round(q, 6) AS plain
      FROM l JOIN w USING (i)""",
    "sm3_argmax_label": "SELECT vec_id AS id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings",
    "sc6_masked_nll": f"""
      WITH {SQL_SOFTMAX},
      t AS (SELECT id // 10 AS seq, id % 10 AS pos, truth AS target, -ln(p[truth + 1]) AS nll FROM p),
      f AS (SELECT *, min(CASE WHEN target = 9 THEN pos END) OVER (PARTITION BY seq) AS first_pad FROM t)
      SELECT seq, round(sum(CASE WHEN target <> 9 OR pos = first_pad THEN nll END), 6) AS loss,
             count(CASE WHEN target <> 9 THEN 1 END) AS n_real
      FROM f GROUP BY seq""",
    "sc6_masked_nll_dedicated_pad": f"""
      WITH {SQL_SOFTMAX}
      SELECT id // 10 AS seq, round(coalesce(sum(CASE WHEN truth <> 9 THEN -ln(p[truth + 1]) END), 0), 6) AS loss,
             count(CASE WHEN truth <> 9 THEN 1 END) AS n_real
      FROM p GROUP BY id // 10""",
    "sc7_token_accuracy": f"""
      SELECT seq, count(CASE WHEN target <> 9 AND {SQL_BEST} = target THEN 1 END) AS n_correct,
             count(CASE WHEN target <> 9 THEN 1 END) AS total
      FROM ({SQL_SEQ}) GROUP BY seq""",
    "sc8_shift_scores": f"""
      WITH l AS (SELECT seq, pos, target, lag(v) OVER (PARTITION BY seq ORDER BY pos) AS v FROM ({SQL_SEQ}))
      SELECT seq, pos, target, {SQL_BEST} AS predicted, round(v[64]::DOUBLE, 6) AS last, round(v[63]::DOUBLE, 6) AS before_last
      FROM l WHERE v IS NOT NULL""",
    "sm4_greedy_decode": """
      WITH t AS (SELECT vec_id // 10 AS seq, vec_id % 10 AS pos,
                        list_position(embedding, list_max(embedding)) - 1 AS tok FROM embeddings),
      e AS (SELECT *, min(CASE WHEN tok = 3 THEN pos END) OVER (PARTITION BY seq) AS eos FROM t)
      SELECT seq, string_agg(CASE WHEN pos > eos THEN 3 ELSE tok END, ',' ORDER BY pos) AS tokens FROM e GROUP BY seq""",
    "st1_collect_batches": """
      SELECT vec_id AS id, label AS truth, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings WHERE vec_id % 2 = 0
      UNION ALL
      SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) FROM embeddings WHERE vec_id % 2 = 1""",
    "ud1_score": """
      SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best,
             round(list_max(embedding)::DOUBLE * 2, 5) AS top FROM embeddings""",
    "ud2_generate_hypotheses": """
      SELECT doc_id, lang AS target, 'What is the scenario?' AS prompt,
             CASE WHEN contains(text, '#') THEN NULL ELSE trim(trim(split_part(text, chr(10), 1), '.')) END AS hyp,
             CASE WHEN contains(text, '#') THEN 'ValueError: mark in text' END AS error
      FROM documents""",
    "ud2_generation_plan": """
      WITH c AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) <= 200)
      SELECT lang AS split, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) - 1 AS line_no, '/corpus' AS root,
             doc_id || '.wav' AS path, n_chars AS n_frames, source AS label, source AS answer, 'What is the scenario?' AS question,
             md5(replace(replace(trim(trim(split_part(text, chr(10), 1), '.')), chr(9), '#'), chr(13), '')) AS text_md5
      FROM c WHERE NOT contains(text, '#')""",
    "sc6_masked_nll_prefix": f"""
      WITH {SQL_SOFTMAX},
      t AS (SELECT id // 10 AS seq, id % 10 AS pos, truth AS target, -ln(p[truth + 1]) AS nll FROM p WHERE id % 10 >= 3),
      f AS (SELECT *, min(CASE WHEN target = 9 THEN pos END) OVER (PARTITION BY seq) AS first_pad FROM t)
      SELECT seq, round(coalesce(sum(CASE WHEN target <> 9 OR pos = first_pad THEN nll END), 0), 6) AS loss,
             count(CASE WHEN target <> 9 THEN 1 END) AS n_real
      FROM f GROUP BY seq""",
    "sc7_token_accuracy_prefix": f"""
      SELECT seq, count(CASE WHEN target <> 9 AND {SQL_BEST} = target THEN 1 END) AS n_correct,
             count(CASE WHEN target <> 9 THEN 1 END) AS total
      FROM ({SQL_SEQ}) WHERE pos >= 3 GROUP BY seq""",
    "ud3_few_shot_eval": f"""
      WITH {SQL_RUNS}
      SELECT scenarios, seed, round(acc, 6) AS acc, round(acc_cf, 6) AS acc_cf, n_chop, n_classes, n FROM runs""",
}
ORACLES["ud2_generate_batches"] = ORACLES["ud2_generate_hypotheses"]

"""Padding, prompts, vocabulary and frames (AR, JN-2)."""

from pyspark.sql import functions as F

from earshot.catalog.roles import PROMPT, doc_words, sql_md5_int, sql_words, table, turns
from earshot.functions import sequences as S
from earshot.functions.text import render_answer, split_words
from earshot.operators import sequences as Q
from earshot.operators.sampling import class_index, draw_examples
from earshot.operators.sweep import label_pairs
from earshot.session import settle

EXPS = ["base", "txt", "noexemb", "noexembtxt", "noexembnotxt"]
PAD = "<pad>"


def _joined(c):
    return F.md5(F.array_join(c, " "))


def ar1(spark, sf):
    c = Q.collate(turns(spark, sf), ["conv_id"], "words", PAD)
    return c.select(
        "conv_id", "turn", _joined("padded").alias("padded_md5"),
        F.array_join("mask", "").alias("mask"), "target_length",
    )


def ar2(spark, sf):
    c = Q.collate(turns(spark, sf), ["conv_id"], "words", PAD)
    return c.select("conv_id", "turn", F.array_join(S.strip_pad("padded", PAD), " ").alias("words"))


def ar3(spark, sf):
    mask = F.transform("words", lambda w: (F.length(w) > 3).cast("int"))
    d = doc_words(spark, sf).withColumn("mask", mask)
    kept = S.compact("words", "mask")
    return d.select("doc_id", F.size(kept).cast("bigint").alias("n"), F.array_join(kept, " ").alias("words"))


def ar4(spark, sf):
    """Means over eight frames; the mask marks positive frames and covers one step less."""
    e = table(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("mask")
    )
    short = F.slice("mask", 1, 56)
    z = F.arrays_zip(
        S.downsample("embedding", 8).alias("value"),
        S.downsample_mask(short, F.lit(8), 8).alias("keep"),
    )
    x = e.select("vec_id", F.posexplode(z).alias("t", "z")).select("vec_id", "t", "z.*")
    return x.withColumn("value", F.round("value", 6))


def ar4_kernel(spark, sf):
    """A caller's kernel of five; the last four of 64 frames are dropped."""
    v = S.downsample("embedding", 5, [0.1, 0.2, 0.4, 0.2, 0.1])
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(v).alias("t", "value"))
    return e.withColumn("value", F.round("value", 6))


def ar5(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id", F.posexplode(S.chop("embedding", 10)).alias("t", "value"),
        F.size(S.chop("embedding", 0)).alias("n_all"),
    ).withColumn("value", F.round(F.col("value").cast("double"), 6))


def _samples(spark, sf):
    """Every document in each language pair it belongs to."""
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", "text",
        F.concat(F.lit("<"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(">")).alias("audio"),
    )
    langs = class_index(d, "lang", "doc_id")
    pairs = settle(label_pairs(langs, "lang", "class_id"), "pairs")
    members = pairs.select("scenarios", F.explode(F.array("label_a", "label_b")).alias("lang"))
    return d.join(members, "lang")


def _examples(samples, n_shot, seeds):
    drawn = draw_examples(samples, "lang", "doc_id", n_shot, seeds, ["scenarios"])
    return drawn.withColumn("answer", render_answer("lang"))


def jn2(spark, sf):
    """Two examples per run beside every sample of the run's pair."""
    samples = _samples(spark, sf)
    blocks = Q.example_blocks(
        _examples(samples, 2, [0, 1]), ["scenarios", "seed"], ["base"], "audio", "text",
        F.lit(PROMPT), "answer",
    )
    joined = samples.select("doc_id", "scenarios").join(settle(blocks, "blocks"), "scenarios")
    return joined.withColumnRenamed("block_audio", "block")


def ar6(spark, sf):
    samples = _samples(spark, sf)
    blocks = Q.example_blocks(
        _examples(samples, 2, [0, 1]), ["scenarios", "seed"], EXPS, "audio", "text",
        F.lit(PROMPT), "answer",
    )
    p = Q.assemble_prompt(
        samples, blocks, ["scenarios"], EXPS, "audio", "text", F.lit(PROMPT)
    )
    return p.select(
        "doc_id", "scenarios", "seed", "exp", F.length("sequence").alias("n"), F.md5("sequence").alias("sequence_md5")
    )


def ar6_zero(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "text", F.concat(F.lit("<"), "source", F.lit(">")).alias("audio")
    )
    p = Q.assemble_prompt(d, None, [], EXPS, "audio", "text", F.lit(PROMPT))
    return p.select("doc_id", "exp", F.md5("sequence").alias("sequence_md5"))


def ar6_without(spark, sf):
    """Samples of each pair that are not among its examples of any seed."""
    samples = _samples(spark, sf)
    rest = Q.without_examples(samples, _examples(samples, 4, [0, 1]), ["scenarios", "doc_id"])
    return rest.select("scenarios", "doc_id", "lang")


def ar7(spark, sf):
    t = turns(spark, sf).select(
        "conv_id", "turn", "words",
        F.transform("words", lambda w: F.length(w).cast("string")).alias("audio"),
        F.transform("words", lambda w: (F.length(w) > 3).cast("tinyint")).alias("audio_mask"),
    )
    s = Q.training_sequence(t, "audio", "audio_mask", split_words(F.lit(Q.TRAINING_PROMPT)), "words")
    return s.select(
        "conv_id", "turn", _joined("sequence").alias("sequence_md5"),
        F.array_join("sequence_mask", "").alias("mask"),
    )


def _dealt(spark, sf):
    """Texts dealt by id: the driver's table is one file that one task would read and split."""
    return table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")


def _words(docs):
    return docs.select(F.explode(split_words("text")).alias("word"))


def ar8(spark, sf):
    return Q.build_vocab(_words(_dealt(spark, sf)), "word")


def _encoded(spark, sf):
    docs = _dealt(spark, sf)
    vocab = Q.build_vocab(_words(docs), "word")
    return Q.encode(docs, vocab, ["doc_id"], "text"), vocab


def ar8_encode(spark, sf):
    e, _ = _encoded(spark, sf)
    return e.select("doc_id", F.array_join("token_ids", " ").alias("token_ids"))


def ar8_decode(spark, sf):
    e, vocab = _encoded(spark, sf)
    return Q.decode(e, vocab, ["doc_id"], "token_ids")


def ar9(spark, sf):
    d = doc_words(spark, sf, "n_chars")
    return Q.item_sizes(d, "n_chars", "words").select("doc_id", "input_size", "target_size")


QUERIES = {
    "ar1_collate": ar1,
    "ar2_strip_pad": ar2,
    "ar3_compact": ar3,
    "ar4_downsample": ar4,
    "ar4_downsample_kernel": ar4_kernel,
    "ar5_chop": ar5,
    "jn2_cross_examples": jn2,
    "ar6_assemble_prompt": ar6,
    "ar6_zero_shot": ar6_zero,
    "ar6_without_examples": ar6_without,
    "ar7_training_sequence": ar7,
    "ar8_build_vocab": ar8,
    "ar8_encode": ar8_encode,
    "ar8_decode": ar8_decode,
    "ar9_item_sizes": ar9,
}

SQL_TURNS = f"SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations"
SQL_DOC_WORDS = f"SELECT doc_id, n_chars, {sql_words('text')} AS w FROM documents"

def _sql_examples(n_shot):
    return SQL_EXAMPLES.replace("range(2) b(i)", f"range({n_shot}) b(i)")


SQL_EXAMPLES = f"""
  langs AS (SELECT lang, row_number() OVER (ORDER BY min(doc_id)) - 1 AS pos FROM documents GROUP BY lang),
  pairs AS (SELECT a.lang || '_' || b.lang AS scenarios, a.lang AS a, b.lang AS b FROM langs a JOIN langs b ON a.pos < b.pos),
  samples AS (SELECT doc_id, lang, text, '<' || source || '/' || doc_id || '>' AS audio, scenarios
              FROM documents JOIN pairs ON lang IN (a, b)),
  c AS (SELECT scenarios, lang, n, row_number() OVER (PARTITION BY scenarios ORDER BY first) - 1 AS class_id
        FROM (SELECT scenarios, lang, count(*) AS n, min(doc_id) AS first FROM samples GROUP BY ALL)),
  k AS (SELECT scenarios, min(n) AS chop, min(n) * count(*) AS pool_n FROM c GROUP BY scenarios),
  r AS (SELECT *, row_number() OVER (PARTITION BY scenarios, lang ORDER BY doc_id) AS rn FROM samples),
  pool AS (SELECT r.*, c.class_id * k.chop + rn - 1 AS pool_pos FROM r JOIN c USING (scenarios, lang) JOIN k USING (scenarios) WHERE rn <= k.chop),
  draws AS (SELECT scenarios, CAST(s AS INTEGER) AS seed, i AS draw,
                   CAST({sql_md5_int("s || ':' || i", 15)} % pool_n AS BIGINT) AS pool_pos
            FROM k, range(2) a(s), range(2) b(i)),
  ex AS (SELECT d.scenarios, d.seed, d.draw, p.audio, p.text, '{PROMPT} ' || p.lang || chr(10) AS tail
         FROM draws d JOIN pool p USING (scenarios, pool_pos)),
  blocks AS (SELECT scenarios, seed, string_agg(audio || tail, '' ORDER BY draw) AS block_audio,
                    string_agg(text || tail, '' ORDER BY draw) AS block_text,
                    string_agg(tail, '' ORDER BY draw) AS block_bare
             FROM ex GROUP BY scenarios, seed)
"""

SQL_VOCAB = f"""
  l AS (SELECT unnest(w) AS symbol FROM ({SQL_DOC_WORDS})),
  v AS (SELECT symbol, count(*) AS n FROM l GROUP BY symbol),
  vocab AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, symbol) - 1 AS INTEGER) AS token_id, symbol, n FROM v)
"""

ORACLES = {
    "ar1_collate": f"""
      WITH t AS ({SQL_TURNS}), m AS (SELECT conv_id, max(len(w)) AS m FROM t GROUP BY conv_id)
      SELECT conv_id, turn,
             md5(array_to_string(list_concat(w, list_transform(range(m - len(w)), lambda x: '{PAD}')), ' ')) AS padded_md5,
             repeat('1', CAST(len(w) AS INTEGER)) || repeat('0', CAST(m - len(w) AS INTEGER)) AS mask,
             CAST(len(w) AS INTEGER) AS target_length
      FROM t JOIN m USING (conv_id)""",
    "ar2_strip_pad": f"SELECT conv_id, turn, array_to_string(w, ' ') AS words FROM ({SQL_TURNS})",
    "ar3_compact": f"""
      SELECT doc_id, CAST(len(k) AS BIGINT) AS n, array_to_string(k, ' ') AS words
      FROM (SELECT doc_id, list_filter(w, lambda x: length(x) > 3) AS k FROM ({SQL_DOC_WORDS}))""",
    "ar4_downsample": """
      WITH f AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
      SELECT vec_id, CAST(i // 8 AS INTEGER) AS t, round(avg(x), 6) AS value,
             CAST(CASE WHEN i // 8 = 7 THEN 0 ELSE max(CASE WHEN i % 8 = 0 AND x > 0 THEN 1 ELSE 0 END) END AS INTEGER) AS keep
      FROM f GROUP BY vec_id, i // 8""",
    "ar4_downsample_kernel": """
      WITH f AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
      SELECT vec_id, CAST(i // 5 AS INTEGER) AS t, round(sum(x * [0.1, 0.2, 0.4, 0.2, 0.1][i % 5 + 1]::DOUBLE), 6) AS value
      FROM f WHERE i < 60 GROUP BY vec_id, i // 5""",
    "ar5_chop": """
      SELECT vec_id, CAST(generate_subscripts(embedding[1:10], 1) - 1 AS INTEGER) AS t,
             round(CAST(unnest(embedding[1:10]) AS DOUBLE), 6) AS value, CAST(len(embedding) AS INTEGER) AS n_all FROM embeddings""",
    "jn2_cross_examples": f"""
      WITH {SQL_EXAMPLES} SELECT doc_id, scenarios, seed, block_audio AS block FROM samples JOIN blocks USING (scenarios)""",
    "ar6_assemble_prompt": f"""
      WITH {SQL_EXAMPLES},
      x AS (SELECT doc_id, scenarios, seed, unnest([
              {{'exp': 'base', 's': block_audio || s.audio}}, {{'exp': 'txt', 's': block_text || s.text}},
              {{'exp': 'noexemb', 's': block_bare || s.audio}}, {{'exp': 'noexembtxt', 's': block_bare || s.text}},
              {{'exp': 'noexembnotxt', 's': block_bare}}]) AS e
            FROM samples s JOIN blocks USING (scenarios))
      SELECT doc_id, scenarios, seed, e.exp AS exp, CAST(length(e.s || '{PROMPT}') AS INTEGER) AS n, md5(e.s || '{PROMPT}') AS sequence_md5 FROM x""",
    "ar6_zero_shot": f"""
      WITH x AS (SELECT doc_id, text, '<' || source || '>' AS audio FROM documents)
      SELECT doc_id, exp, md5(CASE WHEN exp IN ('txt', 'noexembtxt') THEN text ELSE audio END || '{PROMPT}') AS sequence_md5
      FROM x, (VALUES ('base'), ('txt'), ('noexemb'), ('noexembtxt'), ('noexembnotxt')) v(exp)""",
    "ar6_without_examples": f"""
      WITH {_sql_examples(4)},
      used AS (SELECT DISTINCT scenarios, doc_id FROM draws JOIN pool USING (scenarios, pool_pos))
      SELECT scenarios, doc_id, lang FROM samples ANTI JOIN used USING (scenarios, doc_id)""",
    "ar7_training_sequence": f"""
      SELECT conv_id, turn,
             md5(array_to_string(list_concat(list_concat(list_transform(w, lambda x: CAST(length(x) AS VARCHAR)),
                 ['what', 'did', 'the', 'speaker', 'say?']), w), ' ')) AS sequence_md5,
             array_to_string(list_transform(w, lambda x: CASE WHEN length(x) > 3 THEN '1' ELSE '0' END), '')
               || '11111' || repeat('1', CAST(len(w) AS INTEGER)) AS mask
      FROM ({SQL_TURNS})""",
    "ar8_build_vocab": f"WITH {SQL_VOCAB} SELECT token_id, symbol, n FROM vocab",
    "ar8_encode": f"""
      WITH {SQL_VOCAB},
      w AS (SELECT doc_id, unnest(w) AS symbol, generate_subscripts(w, 1) AS i FROM ({SQL_DOC_WORDS}))
      SELECT d.doc_id, coalesce(string_agg(token_id, ' ' ORDER BY i) FILTER (i IS NOT NULL), '') AS token_ids
      FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN vocab USING (symbol) GROUP BY d.doc_id""",
    "ar8_decode": f"""
      WITH {SQL_VOCAB},
      w AS (SELECT doc_id, unnest(w) AS symbol, generate_subscripts(w, 1) AS i FROM ({SQL_DOC_WORDS})),
      j AS (SELECT doc_id, i, vocab.symbol AS s FROM w JOIN vocab USING (symbol))
      SELECT d.doc_id, coalesce(string_agg(s, ' ' ORDER BY i), '') AS text FROM documents d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id""",
    "ar9_item_sizes": f"SELECT doc_id, n_chars AS input_size, CAST(len(w) AS BIGINT) AS target_size FROM ({SQL_DOC_WORDS})",
}

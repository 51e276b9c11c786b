"""Ranks, balanced heads, draws, prefix sums and batches (WN, SM)."""

from pyspark.sql import functions as F

from earshot.catalog.roles import sql_md5_int, sql_words, table, turns
from earshot.functions.sequences import position_ids
from earshot.operators import sampling as P
from earshot.operators import sequences as Q
from earshot.operators.manifest import crop_size


def sm1(spark, sf):
    return P.seeded_order(table(spark, sf, "documents").select("doc_id"), 3, "doc_id")


def _keyed_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return P.seeded_order(e, 0, "event_id")


def wn1(spark, sf):
    head = P.balanced_head(_keyed_events(spark, sf), "event_type", ["order_key", "event_id"])
    return head.select("event_id", "event_type")


def wn1_window(spark, sf):
    head = P.balanced_head(
        _keyed_events(spark, sf), "event_type", ["order_key", "event_id"], method="window"
    )
    return head.select("event_id", "event_type")


def wn1_cells(spark, sf):
    """Balanced languages within each source, one cell per source."""
    d = P.seeded_order(table(spark, sf, "documents").select("doc_id", "lang", "source"), 7, "doc_id")
    head = P.balanced_head(d, "lang", ["order_key", "doc_id"], ["source"])
    return head.select("doc_id", "lang", "source")


def wn2(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return P.balanced_pool(d, "lang", "doc_id")


def sm2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    d = P.draw_examples(docs, "lang", "doc_id", 4, [0, 1, 2, 3, 4], n_repeat=2)
    return d.select("seed", "repeat", "draw", "pool_pos", "doc_id", "lang")


def sm5(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", F.log(F.col("n_chars").cast("double")).alias("logit")
    )
    top = P.gumbel_topk(d, ["lang"], "logit", "doc_id", 10, seed=1, temperature=2.0)
    return top.select("lang", "doc_id", F.col("rank").cast("int"), F.round("perturbed", 6).alias("score"))


def sm5_softmax(spark, sf):
    """Every score row perturbed and softmaxed at the temperature of its row number."""
    e = table(spark, sf, "embeddings")
    soft = P.gumbel_softmax("embedding", 0, "vec_id", 0.5)
    return e.select(
        "vec_id",
        F.round(F.array_max(soft), 6).alias("top"),
        (F.array_position(soft, F.array_max(soft)) - 1).cast("bigint").alias("best"),
        F.round(P.temperature_at("vec_id", decay=0.99), 6).alias("temperature"),
    )


def wn4(spark, sf):
    """Running position per user; purchases and views are kept slots."""
    e = table(spark, sf, "events").select(
        "user_id",
        "event_id",
        F.col("event_type").isin("purchase", "view").cast("int").alias("mask"),
    )
    return Q.position_ids_long(e, ["user_id"], "event_id", "mask")


def wn4_arrays(spark, sf):
    """Words of a turn, short words masked."""
    mask = F.transform("words", lambda w: (F.length(w) > 3).cast("int"))
    t = turns(spark, sf).select("conv_id", "turn", position_ids(mask).alias("ids"))
    return t.select("conv_id", "turn", F.array_join("ids", ",").alias("ids"))


def wn5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", crop_size("n_chars").alias("size"))
    b = Q.with_size_buckets(d, "size", 4)
    return b.withColumn("bucketed_size", F.round("bucketed_size", 6))


def wn6(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", crop_size("n_chars").alias("size"))
    return Q.token_budget_batches(d, "size", "doc_id", max_tokens=40000, max_rows=16)


QUERIES = {
    "sm1_seeded_order": sm1,
    "wn1_balanced_head": wn1,
    "wn1_balanced_head_window": wn1_window,
    "wn1_balanced_head_cells": wn1_cells,
    "wn2_balanced_pool": wn2,
    "sm2_draw_examples": sm2,
    "sm5_gumbel_topk": sm5,
    "sm5_gumbel_softmax": sm5_softmax,
    "wn4_position_ids": wn4,
    "wn4_position_ids_arrays": wn4_arrays,
    "wn5_size_buckets": wn5,
    "wn6_token_budget_batches": wn6,
}

SQL_HEAD = """
  WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type),
  r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || event_id), event_id) AS rn FROM events)
  SELECT event_id, event_type FROM r WHERE rn <= (SELECT min(n) FROM c)"""

SQL_POOL = """
  c AS (SELECT lang, n, row_number() OVER (ORDER BY first) - 1 AS class_id
        FROM (SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY lang)),
  k AS (SELECT min(n) AS chop, min(n) * count(*) AS pool_n FROM c),
  r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
  pool AS (SELECT r.doc_id, r.lang, k.pool_n, c.class_id * k.chop + r.rn - 1 AS pool_pos
           FROM r JOIN c USING (lang), k WHERE r.rn <= k.chop)"""


def _u(key):
    return f"(({sql_md5_int(key, 8)})::DOUBLE + 0.5) / 4294967296.0"


def _gumbel(key):
    return f"(-ln(-ln({_u(key)} + 1e-10) + 1e-10))"


ORACLES = {
    "sm1_seeded_order": "SELECT doc_id, md5('3:' || doc_id) AS order_key FROM documents",
    "wn1_balanced_head": SQL_HEAD,
    "wn1_balanced_head_window": SQL_HEAD,
    "wn1_balanced_head_cells": """
      WITH c AS (SELECT source, min(n) AS chop FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source),
      r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source, lang ORDER BY md5('7:' || doc_id), doc_id) AS rn FROM documents)
      SELECT doc_id, lang, source FROM r JOIN c USING (source) WHERE rn <= chop""",
    "wn2_balanced_pool": f"WITH {SQL_POOL} SELECT doc_id, lang, pool_n, CAST(pool_pos AS BIGINT) AS pool_pos FROM pool",
    "sm2_draw_examples": f"""
      WITH {SQL_POOL},
      d AS (SELECT CAST(s AS INTEGER) AS seed, CAST(t AS INTEGER) AS repeat, CAST(i AS INTEGER) AS draw
            FROM range(5) a(s), range(2) b(t), range(4) g(i)),
      p AS (SELECT d.*, CAST({sql_md5_int("seed || ':' || draw", 15)} % (SELECT pool_n FROM k) AS BIGINT) AS pos FROM d)
      SELECT seed, repeat, draw, CAST(pool_pos AS BIGINT) AS pool_pos, doc_id, lang FROM p JOIN pool ON pool_pos = pos""",
    "sm5_gumbel_topk": f"""
      WITH s AS (SELECT doc_id, lang, (ln(n_chars::DOUBLE) + {_gumbel("'1:' || doc_id")}) / 2.0 AS score FROM documents)
      SELECT lang, doc_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(score, 6) AS score FROM s
      WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""",
    "sm5_gumbel_softmax": f"""
      WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
      n AS (SELECT vec_id, i, (x + {_gumbel("'0:' || vec_id || ':' || i")}) / 0.5 AS y FROM l),
      m AS (SELECT vec_id, max(y) AS m, arg_max(i, y) AS best FROM n GROUP BY vec_id)
      SELECT vec_id, round(1 / sum(exp(y - m)), 6) AS top, CAST(any_value(best) AS BIGINT) AS best,
             round(greatest(2.0 * pow(0.99, vec_id), 0.5), 6) AS temperature
      FROM n JOIN m USING (vec_id) GROUP BY vec_id""",
    "wn4_position_ids": """
      SELECT user_id, event_id, mask,
             CAST(CASE WHEN mask = 1 THEN sum(mask) OVER (PARTITION BY user_id ORDER BY event_id) - 1 ELSE 1 END AS BIGINT) AS position_id
      FROM (SELECT user_id, event_id, CAST(event_type IN ('purchase', 'view') AS INTEGER) AS mask FROM events)""",
    "wn4_position_ids_arrays": f"""
      WITH t AS (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations),
      l AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
      p AS (SELECT *, CASE WHEN length(word) > 3
                           THEN count(CASE WHEN length(word) > 3 THEN 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1
                           ELSE 1 END AS id FROM l)
      SELECT conv_id, turn, string_agg(id, ',' ORDER BY i) AS ids FROM p GROUP BY conv_id, turn""",
    "wn5_size_buckets": """
      WITH q AS (SELECT quantile_cont(least(n_chars, 320000)::DOUBLE, [0.25, 0.5, 0.75, 1.0]) AS c FROM documents),
      b AS (SELECT doc_id, least(n_chars, 320000) AS size, c, len(list_filter(c, lambda x: x < least(n_chars, 320000))) AS b FROM documents, q)
      SELECT doc_id, size, CAST(b AS INTEGER) AS bucket, round(c[b + 1], 6) AS bucketed_size FROM b""",
    "wn6_token_budget_batches": """
      WITH RECURSIVE o AS (
        SELECT doc_id, least(n_chars, 320000) AS size,
               row_number() OVER (ORDER BY least(n_chars, 320000), md5('0:' || doc_id), doc_id) AS i FROM documents),
      g AS (
        SELECT i, doc_id, size, 0::BIGINT AS batch, 1 AS held FROM o WHERE i = 1
        UNION ALL
        SELECT o.i, o.doc_id, o.size,
               CASE WHEN (g.held + 1) * o.size <= 40000 AND g.held + 1 <= 16 THEN g.batch ELSE g.batch + 1 END,
               CASE WHEN (g.held + 1) * o.size <= 40000 AND g.held + 1 <= 16 THEN g.held + 1 ELSE 1 END
        FROM g JOIN o ON o.i = g.i + 1)
      SELECT doc_id, size, batch FROM g""",
}

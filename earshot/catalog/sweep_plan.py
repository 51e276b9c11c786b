"""The sweep from documents to its report (UD-3, JN-4, JN-5, FL-6, SM-2, AR-6, JN-8, UD-1, SNK-2, AG-8, AG-9)."""

from dataclasses import replace

from pyspark.sql import functions as F

from earshot.catalog.roles import PROMPT, sql_md5_int, table
from earshot.catalog.sequences import SQL_EXAMPLES
from earshot.operators.sampling import class_index
from earshot.plans.sweep import Sweep, run_sweep, sweep_report
from earshot.session import shared_dir

VOCAB = 6
CAP = 60
LONGEST = 9000


def _plan():
    return Sweep(
        checkpoints=["wav-rf2", "wav-rf4"], prompt=F.lit(PROMPT), n_shots=[0, 1, 2],
        exps=["base", "txt", "noexemb"], seeds=[0, 1], max_rows=CAP, max_length=LONGEST,
    )


def _stand_in():
    """A frozen model's stand-in: scores of a small vocabulary from a hash of everything it sees."""
    import hashlib

    import numpy as np

    def scores(sequence, echo, model_tag):
        out = np.zeros((len(sequence), VOCAB))
        for k, (s, e, m) in enumerate(zip(sequence, echo, model_tag)):
            for t in range(VOCAB):
                seen = hashlib.md5(f"{m}|{t}|{s}{e}".encode()).hexdigest()
                out[k, t] = int(seen[:8], 16) / 4294967296.0 * 4
        return out

    return scores


def _sweep(spark, sf):
    """The sweep in two calls: the first with one seed only, the second adds what is missing."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text",
        F.concat(F.lit("<"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(">")).alias("audio"),
    )
    langs = class_index(d, "label", "id").select("label", F.col("class_id").alias("pos"), F.col("class_id").alias("token_id"))
    plan = _plan()
    out = shared_dir(spark, "sweep")
    run_sweep(d, langs, _stand_in, replace(plan, seeds=[1]), out)
    return run_sweep(d, langs, _stand_in, plan, out), plan


def sweep_runs(spark, sf):
    runs, _ = _sweep(spark, sf)
    return runs.select(
        "scenarios", "model_tag", "n_shot", "exp", "seed", F.round("acc", 6).alias("acc"),
        F.round("acc_cf", 6).alias("acc_cf"), "n", "n_chop", "n_classes",
    )


def report(spark, sf):
    runs, plan = _sweep(spark, sf)
    return sweep_report(runs, plan)


QUERIES = {"ud3_sweep_runs": sweep_runs, "ud3_sweep_report": report}


def _score(token: str, seen: str) -> str:
    return f"({sql_md5_int(f"model_tag || '|' || {token} || '|' || {seen}", 8)} / 4294967296.0 * 4)"


SQL_SWEEP = f"""
  WITH {SQL_EXAMPLES},
  shots AS (SELECT scenarios, seed, CAST(n AS INTEGER) AS n_shot, string_agg(audio || tail, '' ORDER BY draw) AS block_audio,
                   string_agg(text || tail, '' ORDER BY draw) AS block_text, string_agg(tail, '' ORDER BY draw) AS block_bare
            FROM ex, (VALUES (1), (2)) v(n) WHERE draw < n GROUP BY ALL),
  grid AS (SELECT p.*, la.pos AS token_a, lb.pos AS token_b, m AS model_tag, CAST(n AS INTEGER) AS n_shot, x AS exp, CAST(s AS INTEGER) AS seed,
                  NOT (x = 'txt' AND m = 'wav-rf4') AS planned
           FROM pairs p JOIN langs la ON la.lang = p.a JOIN langs lb ON lb.lang = p.b,
                (VALUES ('wav-rf2'), ('wav-rf4')) c(m), range(3) d(n), (VALUES ('base'), ('txt'), ('noexemb')) e(x), range(2) f(s)),
  runs AS (SELECT g.*, CASE WHEN n_shot = 0 THEN '' WHEN exp = 'base' THEN block_audio WHEN exp = 'txt' THEN block_text ELSE block_bare END AS block
           FROM grid g LEFT JOIN shots USING (scenarios, seed, n_shot) WHERE planned),
  fit AS (SELECT r.*, doc_id, lang, CASE WHEN lang = r.a THEN 0 ELSE 1 END AS truth,
                 block || CASE WHEN exp = 'txt' THEN text ELSE audio END || '{PROMPT}' AS seq
          FROM runs r JOIN samples USING (scenarios)
          WHERE length(block || CASE WHEN exp = 'txt' THEN text ELSE audio END || '{PROMPT}') <= {LONGEST}
          QUALIFY row_number() OVER (PARTITION BY scenarios, model_tag, n_shot, exp, seed ORDER BY md5(seed || ':' || doc_id), doc_id) <= {CAP + 1}),
  scored AS (SELECT *, {_score('token_a', 'seq')} AS sa, {_score('token_b', 'seq')} AS sb FROM fit),
  probes AS (SELECT scenarios, model_tag, n_shot, exp, seed, k AS class_id,
                    exp(CASE k WHEN 0 THEN {_score('token_a', 'seen')} ELSE {_score('token_b', 'seen')} END)
                    / ({' + '.join(f"exp({_score(str(t), 'seen')})" for t in range(VOCAB))}) AS p
             FROM (SELECT r.*, k, block || content || '{PROMPT}' || ' ' || CASE k WHEN 0 THEN a ELSE b END AS seen
                   FROM runs r, (VALUES ('N/A'), (''), ('[MASK]')) i(content), range(2) c(k))),
  prior AS (SELECT scenarios, model_tag, n_shot, exp, seed, avg(p) FILTER (class_id = 0) AS pa, avg(p) FILTER (class_id = 1) AS pb
            FROM probes GROUP BY ALL),
  judged AS (SELECT s.*, CAST((CASE WHEN sb > sa THEN 1 ELSE 0 END) = truth AS INTEGER)::DOUBLE AS ok,
                    CAST((CASE WHEN exp(sb) / pb > exp(sa) / pa THEN 1 ELSE 0 END) = truth AS INTEGER)::DOUBLE AS ok_cf,
                    row_number() OVER (PARTITION BY scenarios, model_tag, n_shot, exp, seed, truth ORDER BY md5(seed || ':' || doc_id), doc_id) AS rn
             FROM scored s JOIN prior USING (scenarios, model_tag, n_shot, exp, seed)),
  chop AS (SELECT scenarios, model_tag, n_shot, exp, seed, min(c) AS n_chop, count(*) AS n_classes
           FROM (SELECT scenarios, model_tag, n_shot, exp, seed, truth, count(*) AS c FROM scored GROUP BY ALL) GROUP BY ALL),
  done AS (SELECT scenarios, model_tag, n_shot, exp, seed, avg(ok) AS acc, avg(ok_cf) AS acc_cf, count(*) AS n,
                  any_value(n_chop) AS n_chop, any_value(n_classes) AS n_classes
           FROM judged JOIN chop USING (scenarios, model_tag, n_shot, exp, seed) WHERE rn <= n_chop GROUP BY ALL),
  stored AS (SELECT scenarios, model_tag, n_shot, exp, seed, acc, acc_cf, n, n_chop, n_classes
             FROM grid LEFT JOIN done USING (scenarios, model_tag, n_shot, exp, seed))"""

SQL_CELL = "printf('%.2f%% (%.2f) (Nr:%s)', acc_cf * 100, acc * 100, CAST(n_chop AS VARCHAR))"

ORACLES = {
    "ud3_sweep_runs": f"""
      {SQL_SWEEP}
      SELECT scenarios, model_tag, n_shot, exp, seed, round(acc, 6) AS acc, round(acc_cf, 6) AS acc_cf, n, n_chop, n_classes FROM stored""",
    "ud3_sweep_report": f"""
      {SQL_SWEEP},
      means AS (SELECT exp, model_tag, n_shot, avg(acc) AS acc, avg(acc_cf) AS acc_cf, avg(n_chop) AS n_chop
                FROM stored WHERE n_chop >= 10 GROUP BY ALL),
      cells AS (SELECT DISTINCT exp, model_tag, n_shot FROM stored)
      SELECT exp, n_shot, max(CASE WHEN model_tag = 'wav-rf2' AND acc IS NOT NULL THEN {SQL_CELL} END) AS "wav-rf2",
             max(CASE WHEN model_tag = 'wav-rf4' AND acc IS NOT NULL THEN {SQL_CELL} END) AS "wav-rf4"
      FROM cells LEFT JOIN means USING (exp, model_tag, n_shot) GROUP BY exp, n_shot""",
}

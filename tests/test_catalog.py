"""Registered queries beside their SQL twins on the smallest driver tables.

A handful by default; ``EARSHOT_ALL=1`` runs every query, as ``check.py`` does.
"""

import math
import os

import pytest

from earshot import catalog

DATA = "/root/testdata/sf0.001"
SOME = [
    "tx5_first_sentence", "fl3_length_guard", "jn1_alignment_report", "jn9_embed_tokens",
    "ag6_reduce_metrics", "wn1_balanced_head_cells", "sm2_draw_examples", "wn6_token_budget_batches",
    "sc5_calibrate", "ud3_few_shot_eval", "ar6_assemble_prompt", "ar8_decode", "jn5_pending_cells",
    "src1_snk1_read_manifest", "sc1_sc2_document_edits",
]
NAMES = sorted(catalog.queries()) if os.environ.get("EARSHOT_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return sorted(([plain(r[i]) for i in order] for r in values), key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cur.fetchall())


def test_names_are_unique_and_paired():
    assert sum(len(m.QUERIES) for m in catalog.MODULES) == len(catalog.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())

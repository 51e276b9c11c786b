"""Registered queries over the driver tables, each with its SQL twin where there is one."""

from earshot.catalog import (
    aggregates,
    filters,
    joins,
    ranks,
    scores,
    sequences,
    sweep_plan,
    sweeps,
    texts,
    transcripts,
)

MODULES = [texts, filters, joins, aggregates, ranks, scores, sequences, sweeps, sweep_plan, transcripts]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.ORACLES)
    return out

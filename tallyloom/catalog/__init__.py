"""Registered queries: each operator on the given tables, with the SQL that must agree."""
from . import checks, files, lookup, recode, stats, tabulate, weighting

MODULES = (lookup, tabulate, stats, weighting, checks, recode, files)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

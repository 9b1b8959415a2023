"""The registered queries, each beside the SQL that must give the same rows."""

from . import answers, live, loading, lookups, metrics, recommend, runs, texts

MODULES = [loading, lookups, texts, recommend, answers, runs, metrics, live]


def all_queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_sql():
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}

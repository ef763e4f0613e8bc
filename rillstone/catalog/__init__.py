"""The query catalogue: for each key a DataFrame query over the driver's tables and, where SQL can say it,
the same in DuckDB SQL."""

from . import corpus, relational, retrieval, text  # noqa: F401

MODULES = (retrieval, text, corpus, relational)


def all_queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_oracles():
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}

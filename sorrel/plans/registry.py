"""All queries of the core library and their SQL."""

from sorrel.plans import data_queries, graph_queries, reference_queries, source_queries


def queries() -> dict:
    return data_queries.QUERIES | reference_queries.QUERIES | source_queries.QUERIES | graph_queries.QUERIES


def oracles() -> dict:
    return data_queries.ORACLES | reference_queries.ORACLES | source_queries.ORACLES | graph_queries.ORACLES

"""Queries that apply the operators to the given tables."""


def all_queries():
    """(queries, their SQL): importing the modules registers them."""
    from gradelake.plans import grading, metrics  # noqa: F401
    from gradelake.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE

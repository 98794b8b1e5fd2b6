"""Queries that SQL can express, against it, on the smallest tables."""

import pytest

from terrace.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(name, same):
    same(Q.queries()[name], Q.SQL[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))

"""Every query with SQL gives what its SQL gives."""

import pytest

import __spark_entry__ as entry
from quarry.plans import catalogue

from .conftest import SF


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def same(spark, duck, query, sql):
    found = query(spark, SF)
    names = sorted(found.columns)
    result = duck.execute(sql)
    there = [d[0] for d in result.description]
    assert sorted(there) == names
    assert sorted(repr([plain(r[n]) for n in names]) for r in found.collect()) == sorted(repr([plain(r[there.index(n)]) for n in names]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    same(spark, duck, entry.queries()[name], catalogue.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_text_operators_are_optional(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "quarry.llm", None)
    monkeypatch.setitem(sys.modules, "quarry.llm.registry", None)
    assert set(entry.queries()) == set(catalogue.QUERIES)

from __future__ import annotations

import oracle
import pytest

from lectern.plans import adapters as A
from lectern.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    oracle.same_rows(spark, small, catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name, key", [("interp", "seg"), ("rollback", "a0"), ("unit_markers", "seg")])
def test_every_segment_is_answered(spark, small, name, key):
    want = sorted((r.book_id, r.id) for r in A.segments(spark, small).collect())
    assert sorted((r.book_id, r[key]) for r in catalogue.queries()[name](spark, small).collect()) == want


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Rules on rows worked out by hand, each against the rows that it must give."""

import duckdb
import pytest

from . import literal_evidence, literal_rules
from .test_catalogue import rows

CASES = literal_rules.FOUND | literal_evidence.FOUND


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    make, sql = CASES[name]
    got, want = make(spark, None), duckdb.connect().execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())

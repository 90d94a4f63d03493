"""Every checked query against its SQL, at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    outcome = compare(spark, name, str(DATA))
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_gives_rows(spark, name):
    assert queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0

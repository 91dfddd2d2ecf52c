"""Every registered query against its check SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

from leadmill import catalog  # noqa: E402

QUERIES, ORACLES = catalog.load()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, sf_dir):
    assert compare.check(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir) is None


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "quality_score" in df.columns

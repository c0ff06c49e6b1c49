"""Every query with an SQL twin outside the llm subpackage, run beside it on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1] / "tools"))
import compare  # noqa: E402

from indexloom.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return compare.views(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_twin(spark, tables, name):
    assert compare.differences(catalogue.queries()[name](spark, SF).toPandas(), tables.execute(catalogue.oracle_sql()[name]).df(), relative=1e-7) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_a_twin_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0

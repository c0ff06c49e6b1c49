from __future__ import annotations

import re

import __spark_entry__ as entry


def test_every_twin_belongs_to_a_query_and_nothing_samples():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    for n in range(1, 7):
        assert f"p{n}_found" in q
    assert not [k for k, v in s.items() if re.search(r"\bUSING SAMPLE\b|\bTABLESAMPLE\b", v)]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["security_id", "knowledge_date", "item", "period_end", "filed_date"] and df.count() > 0

"""Every registered query against its SQL, and those without SQL for the rows they must give."""

from __future__ import annotations

import pytest
from oracle import differences

from plumbline.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_repeats(spark, sf_dir, name):
    first, again = (sorted(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == again

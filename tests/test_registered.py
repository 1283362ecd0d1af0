"""Every registered query against its oracle at the smallest scale, plus plan and entry checks."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    result = compare(spark, con, SMALL, name)
    assert result.startswith(("ok", "rows")) and result not in ("ok 0", "rows 0"), result


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "doc_id", "score", "rank"] and out.count() > 0


def test_word_scan_reads_only_the_columns_it_needs(spark):
    from workload import bindings

    plan = bindings.table(spark, SMALL, "part").filter("p_size > 3").select("p_name")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,3)]" in plan


def test_coarse_ranking_reads_the_asked_buckets_once(spark):
    plan = entry.queries()["e4_coarse_rank"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    postings = [line for line in scans if "field_weight" in line]
    assert len(postings) == 1 and "dynamicpruning" in postings[0]
    assert not any("content:" in line for line in scans)

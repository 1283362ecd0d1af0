"""Tests of what reviews found in the search and streaming queries."""

from __future__ import annotations

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import vector_index
from tests.oracle import compare, duck
from workload import prep

SMALL = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")


@pytest.fixture
def odd_tables(spark, tmp_path):
    """The smallest tables, with texts and titles without words."""
    for name in os.listdir(SMALL):
        os.symlink(f"{SMALL}/{name}", tmp_path / name)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = F.when(F.col("doc_id") % 40 == 1, "").when(F.col("doc_id") % 40 == 2, "-- ** .").when(F.col("doc_id") % 40 == 3, "| | | | | | | | | words")
    rows = docs.withColumn("text", F.when(F.col("doc_id") % 40 != 4, F.coalesce(odd, "text"))).toPandas()
    os.unlink(tmp_path / "documents.parquet")
    rows.to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path)


@needs_tables
@pytest.mark.parametrize("name", ["n6_stream_vectors", "b8_encode_corpus"])
def test_texts_without_words_have_no_vector(spark, odd_tables, name):
    assert compare(spark, duck(odd_tables), odd_tables, name).startswith("ok")


def test_what_rounds_to_zero_keeps_its_sign(spark):
    df = spark.createDataFrame([(1, [-2e-7, 2e-7, -0.1234565, 0.0])], "k bigint, embedding array<double>")
    values = [str(r.value) for r in prep.unfold(df, "k").orderBy("pos").collect()]
    assert values == ["-0.0", "0.0", "-0.123457", "0.0"]


def test_fitting_cells_takes_bounded_memory():
    """Whatever the sample and the cells, few products exist at a time, and the cells are those of a plain search."""
    random = np.random.default_rng(2)
    data = vector_index.unit_rows(random.normal(size=(30_000, 8)))
    tracemalloc.start()
    centres = vector_index._means(data, 512, 2, random)
    nearest = np.concatenate([((data[at : at + 100, None] - centres) ** 2).sum(axis=2).argmin(axis=1) for at in range(0, len(data), 100)])
    probes = vector_index._probes(data, centres, nearest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 1 < probes <= 512 and peak < 4 * 8 * vector_index.SCORED_CELLS
    assert np.array_equal(vector_index._nearest(data, centres)[:, 0], nearest)

"""Tests of what reviews found in the training-data operators."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, substring_dedup, suffix_tree
from lodestone.llm.common import stored
from lodestone.session import checkpoint_dir
from tests.llm import brute


def edited_copies(n: int, seed: int = 5) -> list[tuple[int, str]]:
    """A text of 400 words, in the middle of the ids, and copies of it that are alike with it but not with each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    docs = []
    for i in range(n):
        words = list(base)
        if i != n // 2:
            for k in range(10):
                words[k * 40 + rng.randrange(35)] = f"x{i}-{k}"
        docs.append((i, " ".join(words)))
    return docs


def test_copies_meet_what_they_were_made_from(spark):
    """Pairs of copies that are not alike grow with the square of their number, so few may be left open."""
    docs = edited_copies(60)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    sets = stored(jaccard_join.shingled(df, "doc_id", "text", np.zeros(0, np.uint64)), "sets")
    base = sets.filter("id = 30").first()["node"]
    groups = jaccard_join.signature_groups(sets, 4)
    with_base = groups.filter(F.col("node") == base).select("sig")
    assert with_base.count() > 100
    assert groups.join(with_base, "sig").filter(F.col("head") != base).isEmpty()
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == {(d, c) for (d, _), c in zip(docs, brute.components(docs)[0])}


def test_copies_in_several_tasks_keep_their_partners(spark):
    docs = edited_copies(4)
    docs = [(10 * k + i, text) for k in range(6) for i, text in docs]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == {(d, c) for (d, _), c in zip(docs, brute.components(docs)[0])}


def test_stored_tables_leave_no_shuffle_behind(spark):
    def files() -> int:
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())
        return sum(f.getName().startswith("shuffle_") for f in found)

    before = files()
    out = stored(spark.range(10_000).withColumn("g", F.col("id") % 97).groupBy("g").count().repartition(3, "g"), "counts")
    assert files() <= before and out.count() == 97


def test_starts_that_enough_functions_cover():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        f = rng.integers(0, substring_dedup.HASHES, n)
        low = rng.integers(-5, 60, n)
        high = low + rng.integers(0, 30, n)
        good = [
            len({int(g) for g, a, b in zip(f, low, high) if a <= x <= b}) >= substring_dedup.ENOUGH for x in range(-10, 100)
        ]
        got = substring_dedup.covered(f, low, high)
        assert [any(a <= x <= b for a, b in got) for x in range(-10, 100)] == good
        # No two of them touch.
        assert all(a <= b for a, b in got) and all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:]))


def test_scores_leave_only_the_values_stored(spark):
    def folders() -> set[str]:
        path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        return {f.getPath().getName().rsplit("-", 1)[0] for f in found}

    kinds = {"grams", "strings", "states", "solved"}
    before = folders() & kinds
    docs = spark.createDataFrame([(i, "a b c a b c d e " * 5) for i in range(20)], "doc_id bigint, text string")
    assert suffix_tree.score(docs).count() == 20
    assert folders() & kinds <= before


def test_look_ups_bring_little_along(spark):
    """Check of op4_suffix_tree, memory: a look-up moves two numbers a string, and no table or bitmap is in its function."""
    from pyspark import cloudpickle

    docs = spark.createDataFrame([(i, "a b c a b c d e " * 5) for i in range(20)], "doc_id bigint, text string")
    listed = pa.table({"k": pa.array([1, 2], pa.int64()), "base": [0.5, 0.0], "lp": [0.25, -0.5]})
    seen = []

    class Watched:
        def mapInArrow(self, run, schema):
            seen.append(len(cloudpickle.dumps(run)))
            return schema

    frame = type(docs)
    held, frame.mapInArrow = frame.mapInArrow, lambda self, run, schema: Watched().mapInArrow(run, schema)
    try:
        schema = suffix_tree.look_ups(docs, "doc_id", "text", listed, np.zeros(1 << (suffix_tree.BITMAP - 3), np.uint8))
    finally:
        frame.mapInArrow = held
    assert seen[0] < 1 << 20
    assert schema.startswith("key bigint, row bigint, own struct")


def test_passages_of_common_lines_all_meet(spark):
    """What a document shares is found though its minima are those of many others, as if all windows met."""
    rng = random.Random(3)
    lines = [[f"w{rng.randrange(10**6)}" for _ in range(12)] for _ in range(30)]
    docs = []
    for _ in range(150):
        body = [w for line in rng.sample(lines, 6) for w in line]
        for _ in range(2):
            words = list(body)
            for _ in range(2):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            around = [[f"y{rng.randrange(10**6)}" for _ in range(30)] for _ in range(2)]
            docs.append(" ".join(around[0] + words + around[1]))
    rng.shuffle(docs)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3).localCheckpoint()
    mine = substring_dedup.windows(df, "doc_id", "text").select("key", "doc", "at")
    other = mine.select("key", F.col("doc").alias("other"), F.col("at").alias("other_at"))
    pairs = (
        mine.join(other, "key")
        .filter("doc > other")
        .groupBy(F.col("doc").alias("a"), F.col("other").alias("b"))
        .agg(F.collect_set(F.struct(F.col("at").alias("x"), F.col("other_at").alias("y"))).alias("pairs"))
    )
    texts = df.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("t"))
    want = {(r.doc_id, r.other_doc_id) for r in substring_dedup.checked(substring_dedup.candidates(pairs), texts).collect()}
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.repeated_passages(df).collect()}
    assert len(want) > 40 and got == want

"""Streams replayed in several micro-batches equal the batch operators; replays change nothing."""

from __future__ import annotations

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.operators import behaviour, profiles
from lodestone.operators.index import build_postings
from lodestone.streaming import jobs
from tests.test_users import EV, brute_pairs, profile_events, random_clicks
from workload.streams import ROCKSDB


@pytest.fixture
def folder():
    path = f"/tmp/spark-test-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def in_files(spark, folder, rows, schema, n):
    """Rows as a stream of n files read one per batch, oldest first."""
    step = -(-len(rows) // n)
    for i in range(n):
        df = spark.createDataFrame(rows[i * step : (i + 1) * step], schema)
        df.coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
        for root, _, files in os.walk(f"{folder}/part={i}"):
            for f in files:
                os.utime(os.path.join(root, f), (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("basePath", folder)
    return stream.parquet(f"{folder}/part=*")


def test_query_stats_in_batches_with_compaction(spark, folder):
    rows = [(f"q{i % 4}", i, f"s{i % 3}") for i in range(30)]
    schema = "query string, ts bigint, source string"
    stream = in_files(spark, f"{folder}/in", rows, schema, 5)
    jobs.stream_query_stats(stream, f"{folder}/out", f"{folder}/cp", compact_every=2).awaitTermination()
    table = jobs.query_stats_table(spark, f"{folder}/out", 2)
    want = behaviour.query_stats(spark.createDataFrame(rows, schema))
    assert sorted(table.read().select(want.columns).collect()) == sorted(want.collect())
    # Writing the last batch again leaves the state as it was.
    last = behaviour.query_stats(spark.createDataFrame(rows[24:], schema))
    table.write(4, last)
    assert sorted(table.read().select(want.columns).collect()) == sorted(want.collect())


def test_cooccurrence_across_batches(spark, folder):
    # Event time zero is the initial watermark, so the clock starts later.
    rows = sorted(((*r[:4], r[4] + 1000, *r[5:]) for r in random_clicks(120)), key=lambda r: (r[4], r[0]))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream = in_files(spark, f"{folder}/in", rows, EV, 3)
        jobs.stream_cooccurrence(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = jobs.cooccurrence_table(spark, f"{folder}/out").read().collect()
    assert {(r.src, r.dst): (r.co_count, r.last_time) for r in got} == brute_pairs(rows)


def test_profiles_in_batches(spark, folder, docs):
    corpus = docs({"doc_id": "t", "category": "tech"}, {"doc_id": "f", "category": "food"})
    rows, as_of = profile_events(), 45 * 86400
    rows = sorted(rows, key=lambda r: (r[4], r[0]))
    stream = in_files(spark, f"{folder}/in", rows, EV, 3)
    jobs.stream_profiles(stream, corpus, f"{folder}/out", f"{folder}/cp", as_of).awaitTermination()
    got = {r.uid: r for r in jobs.profile_table(spark, f"{folder}/out").read().collect()}
    none = profiles.empty_profiles(spark)
    for r in profiles.update_profiles(none, spark.createDataFrame(rows, EV), corpus, as_of).collect():
        want = r.asDict()
        have = {k: got[r.uid][k] for k in want}
        assert have == {**want, "category_weights": pytest.approx(want["category_weights"])}


def test_ingest_rejects_dedups_and_enriches(spark, folder, docs):
    corpus = docs({"doc_id": "a", "click_count": 7, "quality_score": 0.9})
    good = [{"event_id": i, "uid": "u", "doc_id": d, "event_type": t, "ts": 100 + i} for i, (d, t) in enumerate([("a", "click"), ("zzz", "weird")])]
    bodies = [json.dumps(g) for g in [*good, good[0]]] + ["", "{oops"]
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/x.txt", "w", encoding="utf-8") as f:
        f.write("\n".join(bodies) + "\n")
    raw = spark.readStream.text(f"{folder}/in")
    for q in jobs.ingest_events(raw, corpus, f"{folder}/out", f"{folder}/cp"):
        q.awaitTermination()
    rows = {r.event_id: r for r in spark.read.parquet(f"{folder}/out/events").collect()}
    assert (rows[0].click_count, rows[0].doc_quality, rows[0].result_pos) == (7, 0.9, -1)
    assert (rows[1].click_count, rows[1].event_type) == (0, "unknown") and len(rows) == 2
    bad = spark.read.parquet(f"{folder}/out/rejected")
    assert sorted(r.reject for r in bad.collect()) == ["empty body", "invalid JSON"]


def test_late_events_are_dropped_after_the_watermark(spark, folder):
    # Late rows are judged by the watermark two batches back.
    rows = [(i, "u", "a", "click", ts, None, 0, 0) for i, ts in enumerate((1, 10_000, 10_001, 5, 20_000, 20_001))]
    stream = in_files(spark, f"{folder}/in", rows, EV, 6)
    jobs.stream_hot(stream, f"{folder}/out", f"{folder}/cp", window="1 hour", watermark="1 minute", kind="tumbling").awaitTermination()
    got = {r.start: r.clicks for r in spark.read.parquet(f"{folder}/out/windows").collect()}
    assert got == {0: 1, 7200: 2}


def test_corpus_feed(spark, folder, docs):
    base = docs({"title": "one two"}, {"title": "three"}, {"title": "four"})
    changes = [
        [("upsert", 1, {"doc_id": "d0", "title": "one"}), ("delete", 1, {"doc_id": "d1"}), ("delete", 1, {"doc_id": "unknown"})],
        [("upsert", 2, {"doc_id": "d1", "title": "back"}), ("upsert", 1, {"doc_id": "d2", "title": "old"}), ("upsert", 2, {"doc_id": "d2", "title": "newest"})],
    ]
    feed = jobs.CorpusFeed(spark, f"{folder}/feed", base, build_postings(base))

    def batch(rows):
        out = None
        for op, v, d in rows:
            row = docs(d).withColumn("op", F.lit(op)).withColumn("version", F.lit(v))
            out = row if out is None else out.unionByName(row)
        return out

    for i, rows in enumerate(changes):
        feed.apply(batch(rows), i)
    feed.apply(batch(changes[1]), 1)
    assert {r.doc_id: r.title for r in feed.corpus().collect()} == {"d0": "one", "d1": "back", "d2": "newest"}
    want = build_postings(feed.corpus())
    assert sorted(feed.postings().select(want.columns).collect()) == sorted(want.collect())

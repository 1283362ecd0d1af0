"""Query preparation, corpus tables and the text index."""

from __future__ import annotations

import json
import math
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import index, recall, textprep
from lodestone.sources import corpus as docs_io
from lodestone.sources import lists, snapshots


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr("x")).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Ｈｅｌｌｏ　１２", "hello 12"),
        ("iPhone14", "iphone 14"),
        ("14inch", "14 inch"),
        ("gooogle", "google"),
        ("good", "good"),
        ("the of and", ""),
        ("  a  cat & dog!! ", "cat dog"),
        ("rock'n'roll_x-y", "rock'n'roll_x-y"),
        ("是 手机 的", "手机"),
        ("", ""),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, text.normalize) == want


def test_tokens_split_ascii_words_and_single_characters(spark):
    assert one(spark, "AI手机 don't x2", text.tokens) == ["ai", "手", "机", "don", "t", "x2"]


def test_snippet_keeps_whole_characters(spark):
    assert one(spark, "é" * 150, text.snippet) == "é" * 100
    assert one(spark, "a" * 300, text.snippet) == "a" * 200
    assert one(spark, "a" + "手" * 100, text.snippet) == "a" + "手" * 66


def test_validate(spark):
    rows = [(i, q) for i, q in enumerate(["", "x" * 200, "x" * 201, "a\nb", "a\x00b", "ok", "Ok"])]
    ok, bad = textprep.validate_queries(spark.createDataFrame(rows, "query_id int, raw string"))
    assert {r.query_id: r.reason for r in bad.collect()} == {
        0: "empty", 2: "too long", 3: "invalid characters", 4: "invalid characters",
    }
    assert {r.query_id: r.needs_normalization for r in ok.collect()} == {1: False, 5: False, 6: True}


def expand(spark, terms, rows):
    q = spark.createDataFrame([(1, terms)], "query_id int, terms array<string>")
    dicts = spark.createDataFrame(rows, "stage int, term string, ord int, expansion string")
    return textprep.expand_queries(q, dicts).first().terms


def test_expansion_chains_stages_and_caps(spark):
    chain = [(1, "a", 0, "b"), (2, "b", 0, "c"), (3, "c", 0, "d"), (4, "d", 0, "e")]
    assert expand(spark, ["a"], chain) == ["a", "b", "c", "d", "e"]
    many = [(1, "a", i, f"s{i}") for i in range(20)]
    assert expand(spark, ["a"], many) == ["a", "s0", "s1", "s2", "s3"]
    assert expand(spark, ["a", "b", "c", "x", "y", "z"], many) == ["a", "b", "c", "x", "y", "z", *(f"s{i}" for i in range(6))]
    assert expand(spark, [], many) == []
    assert expand(spark, ["a", "s0", "a"], many) == ["a", "s0", "a", "s1", "s2", "s3"]


def test_abbreviations_work_both_ways(spark):
    rows = spark.createDataFrame([(3, "ml", 0, "machine learning")], "stage int, term string, ord int, expansion string")
    both = textprep.both_directions(rows)
    q = spark.createDataFrame([(1, ["machine learning"])], "query_id int, terms array<string>")
    assert textprep.expand_queries(q, both).first().terms == ["machine learning", "ml"]


def test_category_of_first_matching_term(spark):
    q = spark.createDataFrame([(1, ["x", "hotel", "phone"]), (2, ["x"]), (3, [])], "query_id int, terms array<string>")
    kw = spark.createDataFrame([("phone", "tech"), ("hotel", "travel")], "term string, category string")
    got = {r.query_id: r.category for r in textprep.infer_category(q, kw).collect()}
    assert got == {1: "travel", 2: "general", 3: "general"}


def test_line_files(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("a\tb,c\nno tab\nd\te,,f\n", encoding="utf-8")
    rows = lists.read_term_dict(spark, str(tmp_path / "dict.txt"), 1)
    assert sorted((r.term, r.ord, r.expansion) for r in rows.collect()) == [("a", 0, "b"), ("a", 1, "c"), ("d", 0, "e"), ("d", 1, "f")]
    (tmp_path / "black.txt").write_text("# comment\n\nd1\nauthor:Bob\n", encoding="utf-8")
    assert sorted(r.entry for r in lists.read_blacklist(spark, str(tmp_path / "black.txt")).collect()) == ["author:Bob", "d1"]


def test_json_defaults(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"doc_id": "1", "content": "é"}, {"doc_id": "2", "tags": ["x"], "click_count": 3}]))
    rows = {r.doc_id: r for r in docs_io.read_corpus_json(spark, str(tmp_path / "c.json")).collect()}
    assert rows["1"].content_length == 2 and rows["1"].tags == [] and rows["1"].quality_score == 0.0
    assert rows["2"].click_count == 3 and rows["2"].title == ""


def test_upsert_and_tags(spark, docs):
    base = docs({"title": "old"}, {"title": "kept"})
    changes = docs(
        {"doc_id": "d0", "title": "v1"}, {"doc_id": "d0", "title": "v2", "quality_score": None}, {"doc_id": "new"}, {"doc_id": ""}
    ).withColumn("version", F.when(F.col("title") == "v2", 2).otherwise(1))
    out = {r.doc_id: r for r in docs_io.upsert_corpus(base, changes).collect()}
    assert set(out) == {"d0", "d1", "new"} and out["d0"].title == "v2" and out["d0"].quality_score == 0.5
    back = docs_io.csv_to_tags(docs({"tags": ["a", "b"]}).withColumn("tags", F.lit("a,,b,")))
    assert back.first().tags == ["a", "b"]


THREE = (
    {"doc_id": "doc1", "title": "机器", "content": "深度学习", "category": "tech", "tags": ["AI"], "content_length": 50},
    {"doc_id": "doc2", "title": "搜索", "content": "学问", "category": "tech", "tags": ["search"], "content_length": 45},
    {"doc_id": "doc3", "title": "红烧", "content": "烧肉", "category": "food", "tags": ["cook", "烧"], "content_length": 30},
)


def test_postings_count_fields_and_take_the_best_weight(spark, docs):
    got = {(r.term, r.doc_id): (r.tf, r.field_weight, r.doc_len) for r in index.build_postings(docs(*THREE)).collect()}
    assert got[("烧", "doc3")] == (3, 3.0, 30)
    assert got[("ai", "doc1")] == (1, 2.0, 50)
    assert got[("tech", "doc2")] == (1, 1.5, 45)
    assert got[("度", "doc1")] == (1, 1.0, 50)


def test_idf_sign_and_stats(spark, docs):
    ix = index.build_index(docs(*THREE))
    idf = {r.term: r.idf for r in ix.terms.collect()}
    assert idf["烧"] == pytest.approx(math.log(2.5 / 1.5)) and idf["学"] < 0
    row = index.index_health(ix).first()
    assert (row.n_docs, row.total_len) == (3, 125) and row.n_terms == len(idf)


def test_or_and_retrieval(spark, docs):
    ix = index.build_index(docs(*THREE))
    q = spark.createDataFrame([(1, ["学", "习"]), (2, ["nothing"]), (3, ["学", "nothing"])], "query_id int, terms array<string>")
    hits = [(r.query_id, r.doc_id, r.matched) for r in index.search_or(q, ix).orderBy("query_id", "rank").collect()]
    assert hits == [(1, "doc1", 2), (1, "doc2", 1), (3, "doc1", 1), (3, "doc2", 1)]
    assert [(r.query_id, r.doc_id) for r in index.search_and(q, ix).collect()] == [(1, "doc1")]


def test_incremental_equals_rebuild(spark, docs):
    old = docs(*THREE)
    changed = docs({**THREE[0], "content": "短"}, {"doc_id": "doc9", "title": "new one"})
    gone = spark.createDataFrame([("doc3",), ("unknown",)], "doc_id string")
    updated = index.update_postings(index.build_postings(old), changed, gone)
    final = docs_io.upsert_corpus(old, changed.withColumn("version", F.lit(1))).filter("doc_id <> 'doc3'")
    want = index.build_postings(final)
    assert sorted(updated.collect()) == sorted(want.collect())


def test_snapshot_versions(spark, docs):
    path = f"/tmp/spark-test-{uuid.uuid4().hex}"
    corpus = docs(*THREE).withColumn("publish_time", F.lit(100))
    assert snapshots.rebuild_index(corpus, path, as_of=50) == 1
    assert snapshots.rebuild_index(corpus, path, as_of=60, min_doc_changes=4) is None
    assert snapshots.rebuild_index(corpus, path, as_of=70, min_doc_changes=3) == 2
    assert snapshots.rebuild_index(corpus, path, as_of=200, min_doc_changes=3) == 3
    assert snapshots.rebuild_index(corpus, path, as_of=300, min_doc_changes=1) is None
    back = snapshots.read_index(spark, path)
    flat = back.postings.drop("bucket")
    assert sorted(flat.collect()) == sorted(index.build_postings(corpus).select(flat.columns).collect())


def test_vector_snapshot_checks_size(spark):
    path = f"/tmp/spark-test-{uuid.uuid4().hex}"
    good = spark.createDataFrame([("a", [1.0, 2.0])], "doc_id string, embedding array<double>")
    snapshots.write_vectors(good, path, 2)
    assert snapshots.read_vectors(spark, path, 2).count() == 1
    with pytest.raises(PySparkException):
        snapshots.read_vectors(spark, path, 3).collect()


def test_matches_are_summed_where_the_documents_are(spark, docs, monkeypatch):
    words = [[f"w{(i * 7 + j * j) % 23}" for j in range(i % 9 + 1)] for i in range(60)]
    ix = index.build_index(docs(*[{"content": " ".join(w)} for w in words]))
    asked = [[f"w{j}" for j in range(n)] + ["nowhere"] for n in range(1, 12)] + [["w1", "w2"]]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, terms array<string>")
    want = {}
    for i, terms in enumerate(asked):
        hits = {f"d{j}": len(set(terms) & set(w)) for j, w in enumerate(words)}
        want[i] = sorted(((-n, d) for d, n in hits.items() if n), key=lambda x: x)[:5]

    def found():
        rows = index.search_or(q, ix, 5).orderBy("query_id", "rank").collect()
        return {i: [(-r.matched, r.doc_id) for r in rows if r.query_id == i] for i in range(len(asked))}

    assert found() == want
    # Grouping needs no exchange of matches: at most five documents per query leave each task.
    part = index.match_documents(index.query_terms(q), ix, {"n": F.lit(1)}, lambda s: s["n"], 5)
    left = part.withColumn("p", F.spark_partition_id()).groupBy("p", "query_id").count()
    assert left.agg(F.max("count")).first()[0] <= 5
    both = {(11, f"d{j}") for j, w in enumerate(words) if {"w1", "w2"} <= set(w)}
    assert {(r.query_id, r.doc_id) for r in index.search_and(q, ix).collect()} == both and both
    # Small pieces and the shuffled path give the same.
    for name, value in (("TASK_CELLS", 1), ("HELD_ROWS", 3), ("TASK_POSTINGS", 10)):
        monkeypatch.setattr(index, name, value)
    assert found() == want
    monkeypatch.setattr(index, "fits", lambda *a: False)
    assert found() == want
    assert {(r.query_id, r.doc_id) for r in index.search_and(q, ix).collect()} == both


def test_tasks_share_a_bound_of_what_they_pass_on(spark, docs, monkeypatch):
    """what all tasks pass on for a query doesn't grow with the number of tasks."""
    words = [[f"w{(i * 7 + j * j) % 23}" for j in range(i % 19 + 1)] for i in range(400)]
    ix = index.build_index(docs(*[{"content": " ".join(w)} for w in words]))
    asked = [[f"w{j}" for j in range(n)] for n in range(2, 12)]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, terms array<string>")
    want = {}
    for i, terms in enumerate(asked):
        hits = {f"d{j}": len(set(terms) & set(w)) for j, w in enumerate(words)}
        want[i] = sorted(((-n, d) for d, n in hits.items() if n), key=lambda x: x)[:5]
    bm25 = {(r.query_id, r.rank): (r.doc_id, r.score) for r in recall.search_bm25(q, ix, 5).collect()}
    for name, value in (("TASK_POSTINGS", 40), ("BOUND_SHARE", 4), ("QUERY_BLOCK", 3), ("DENSE_TERMS", 2), ("TASK_CELLS", 30)):
        monkeypatch.setattr(index, name, value)
    passed = index.match_documents(index.query_terms(q), ix, {"n": F.lit(1)}, lambda s: s["n"], 5)
    per_query = [r["count"] for r in passed.groupBy("query_id").count().collect()]
    assert 5 <= min(per_query) and max(per_query) <= 60
    for sent in (index.SENT_BYTES, 2000):  # one lot of queries, then several
        monkeypatch.setattr(index, "SENT_BYTES", sent)
        rows = index.search_or(q, ix, 5).orderBy("query_id", "rank").collect()
        assert {i: [(-r.matched, r.doc_id) for r in rows if r.query_id == i] for i in want} == want
        assert {(r.query_id, r.rank): (r.doc_id, r.score) for r in recall.search_bm25(q, ix, 5).collect()} == bm25


def test_pairs_are_matched_with_their_own_query_alone(spark, docs):
    """candidates of one query aren't expanded into matches of all other queries."""
    ix = index.build_index(docs(*[{"content": "a b c"} for _ in range(20)]))
    q = spark.createDataFrame([(i, ["a", "c", "nowhere"]) for i in range(20)], "query_id int, terms array<string>")
    pairs = spark.createDataFrame([(i, f"d{i}") for i in range(20)] + [(0, "gone")], "query_id int, doc_id string")
    got = {(r.query_id, r.doc_id, r.term) for r in index.match_postings(q, ix, pairs).collect()}
    assert got == {(i, f"d{i}", t) for i in range(20) for t in "ac"}

"""Behaviour aggregates, profiles, features, experiments: laws and sequential models."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import behaviour, experiments, features, profiles, vectors

EV = "event_id bigint, uid string, doc_id string, event_type string, ts bigint, query string, result_pos int, duration_ms int"


def random_clicks(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, "hot" if i % 3 == 0 else f"u{rng.randrange(9)}", f"d{rng.randrange(6)}", "click", rng.randrange(60), None, 0, 0) for i in range(n)]


def brute_pairs(rows):
    last, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        before = last.get(r[1])
        if before is not None and before != r[2]:
            for e in ((before, r[2]), (r[2], before)):
                n, t = out.get(e, (0, 0))
                out[e] = (n + 1, max(t, r[4]))
        last[r[1]] = r[2]
    return out


@pytest.mark.parametrize("min_rows", [1, 10**6])
def test_cooccurrence_with_and_without_slices(spark, min_rows):
    rows = random_clicks()
    got = behaviour.cooccurrence(spark.createDataFrame(rows, EV), min_rows=min_rows).collect()
    assert {(r.src, r.dst): (r.co_count, r.last_time) for r in got} == brute_pairs(rows)


def test_hot_user_is_cut_into_slices(spark):
    from lodestone.skew import time_slices

    out = time_slices(spark.createDataFrame(random_clicks(), EV), "uid", "ts", min_rows=50)
    n = {r.uid: r.n for r in out.groupBy("uid").agg(F.countDistinct("_slice").alias("n")).collect()}
    assert n["hot"] > 10 and n["u1"] == 1


def test_merge_equals_recompute(spark):
    log = [(q, t, s) for t, (q, s) in enumerate([("a", "x"), ("b", "y"), ("a", "z"), ("", "x"), ("a", "y")])]
    df = spark.createDataFrame(log, "query string, ts int, source string")
    whole = behaviour.query_stats(df)
    parts = behaviour.merge_query_stats(behaviour.query_stats(df.filter("ts >= 2")), behaviour.query_stats(df.filter("ts < 2")))
    assert sorted(whole.collect()) == sorted(parts.collect())
    a = [r for r in whole.collect() if r.query == "a"][0]
    assert (a.freq, a.last_time, a.source) == (3, 4, "x")
    seed = spark.createDataFrame([("a", 99, 0, "s", 0), ("new", 5, 0, "s", 0), ("new", 4, 0, "r", 0)], whole.schema)
    seeded = {r.query: r.freq for r in behaviour.seed_query_stats(whole, seed).collect()}
    assert seeded == {"a": 3, "b": 1, "new": 4}


def test_top_queries_by_prefix_ignores_case(spark):
    stats = spark.createDataFrame([("Apple", 3), ("apply", 5), ("bee", 9), ("a", 1)], "query string, freq int")
    prefixes = spark.createDataFrame([("AP",), ("b",), ("a",), ("",)], "prefix string")
    got = sorted((r.prefix, r.rank, r.query) for r in behaviour.top_queries(stats, 2, prefixes=prefixes).collect())
    assert got == [("AP", 1, "apply"), ("AP", 2, "Apple"), ("a", 1, "apply"), ("a", 2, "Apple"), ("b", 1, "bee")]


def profile_events():
    day = 86400
    rows = [(i, "u", "t", "click", 40 * day + i, None, 0, 0) for i in range(201)]
    rows += [(300 + i, "u", "f", "search", 41 * day + i, f"q{i}", 0, 0) for i in range(51)]
    rows += [(400, "u", "f", "like", 42 * day, None, 0, 0), (401, "u", "f", "view", 42 * day, None, 0, 29999), (402, "v", "t", "view", 43 * day, None, 0, 30000),
             (403, "v", "none", "share", 1, None, 0, 0), (404, "v", "t", "strange", 43 * day, None, 0, 0)]
    return rows


def test_profiles(spark, docs):
    corpus = docs({"doc_id": "t", "category": "tech"}, {"doc_id": "f", "category": "food"})
    as_of = 45 * 86400
    ev = spark.createDataFrame(profile_events(), EV)
    none = profiles.empty_profiles(spark)
    out = {r.uid: r for r in profiles.update_profiles(none, ev, corpus, as_of).collect()}
    u, v = out["u"], out["v"]
    assert len(u.click_doc_ids) == 200 and u.total_clicks == 201 and u.like_doc_ids == ["f"]
    assert u.query_history == [f"q{i}" for i in range(1, 51)]
    assert u.category_weights == pytest.approx({"tech": 1.0, "food": 0.4}) and u.active_days_last_30 == 3
    assert v.category_weights == pytest.approx({"tech": 0.2}) and v.active_days_last_30 == 1
    counted = {r.uid: r.active_days_last_30 for r in profiles.update_profiles(none, ev, corpus, as_of, mode="events").collect()}
    assert counted == {"u": 30, "v": 3}
    # Updating in two steps gives the same profiles.
    cut = 41 * 86400 + 20
    first = profiles.update_profiles(none, ev.filter(F.col("ts") < cut), corpus, as_of)
    second = {r.uid: r for r in profiles.update_profiles(first, ev.filter(F.col("ts") >= cut), corpus, as_of).collect()}
    for k in out:
        assert second[k].asDict() == {**out[k].asDict(), "category_weights": pytest.approx(out[k].category_weights)}


def brute_refresh(w, clicks, likes, queries, cats, days, keywords, links):
    w = {c: x * 0.95 ** (30 - min(30, days)) for c, x in w.items()}
    for ids, signal in ((clicks, 0.5), (likes, 0.8)):
        for d in ids:
            if d in cats:
                w[cats[d]] = 0.3 * signal + 0.7 * w.get(cats[d], 0)
    for q in queries:
        for k, c in keywords:
            if k in q:
                w[c] = 0.15 * 0.05 + 0.85 * w.get(c, 0)
    more = {}
    for c, x in w.items():
        for l in [b for a, b in links if a == c]:
            more[l] = more.get(l, 0) + 0.3 * x
    for c, x in more.items():
        w[c] = min(1.0, w.get(c, 0) + x)
    total = sum(w.values())
    return {c: x / total for c, x in w.items()} if total > 1 else w


def test_refresh_equals_sequential_updates(spark, docs):
    cats = {"a": "tech", "b": "food", "c": "solo"}
    corpus = docs(*[{"doc_id": k, "category": c} for k, c in cats.items()])
    people = {
        "x": ({"tech": 0.9, "solo": 0.2}, ["a", "b", "a"], ["b", "gone"], ["AI now", "美食"], 30),
        "y": ({"food": 1.0}, [], [], [], 0),
        "z": ({}, ["c"] * 20, ["a"] * 9, ["AI"] * 3, 12),
    }
    df = spark.createDataFrame(
        [(u, q, c, l, w, d) for u, (w, c, l, q, d) in people.items()],
        "uid string, query_history array<string>, click_doc_ids array<string>, like_doc_ids array<string>, category_weights map<string,double>, active_days_last_30 int",
    )
    out = profiles.refresh_interests(df, corpus, profiles.default_keywords(spark), profiles.default_links(spark)).collect()
    got = {}
    for r in out:
        got.setdefault(r.uid, {})[r.category] = r.weight
    links = [(c, x) for c, ls in profiles.LINKS.items() for x in ls]
    for u, (w, c, l, q, d) in people.items():
        assert got[u] == pytest.approx(brute_refresh(dict(w), c, l, q, cats, d, list(profiles.KEYWORDS.items()), links))


@pytest.mark.parametrize("min_rows", [1, 10**6])
def test_interest_vectors_equal_a_loop(spark, min_rows):
    rng = np.random.default_rng(2)
    vecs = {f"d{i}": rng.normal(size=3).tolist() for i in range(6)}
    vecs["d0"] = [1.0]
    rows = random_clicks(120)
    init = {"hot": [1.0, 0.0, 0.0], "quiet": [0.0, 1.0, 0.0]}
    state = dict(init)
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        v, old = vecs[r[2]], state.get(r[1])
        if old is None:
            state[r[1]] = v
        elif len(old) == len(v):
            state[r[1]] = [0.7 * a + 0.3 * b for a, b in zip(old, v)]
    table = spark.createDataFrame(list(vecs.items()), "doc_id string, embedding array<double>")
    start = spark.createDataFrame(list(init.items()), "uid string, embedding array<double>")
    out = profiles.interest_vectors(spark.createDataFrame(rows, EV), table, 0.3, init=start, min_rows=min_rows)
    got = {r.uid: r.embedding for r in out.collect()}
    assert set(got) == set(state)
    for u in state:
        assert got[u] == pytest.approx(state[u])


def test_query_features(spark):
    rows = [(1, "手机 price 价格", ["手", "机", "price"]), (2, "download latest", ["download"]), (3, "", []), (4, "how?", ["how", "how"])]
    q = spark.createDataFrame(rows, "query_id int, raw string, terms array<string>")
    out = {r.query_id: r for r in features.query_features(q).collect()}
    assert (out[1].language, out[1].query_type, out[1].query_length) == (3.0, 3.0, 19.0)
    assert (out[2].query_type, out[2].time_sensitivity, out[2].expected_result_count) == (1.0, 1.0, 0.2)
    assert (out[3].language, out[3].is_hot_query, out[3].query_complexity) == (0.0, 1.0, 0.0)
    assert out[4].has_special_char == 1.0 and out[4].query_complexity == pytest.approx((0.5 + 0.2) / 2)


def test_user_features_defaults_and_entropy(spark):
    prof = spark.createDataFrame(
        [("u", {"a": 0.5, "b": 0.5}, 20, 101, 21, ["x"], 5.0), ("one", {"a": 0.3}, 2, 0, 0, [], 0.0)],
        "uid string, category_weights map<string,double>, active_days_last_30 int, total_clicks bigint, total_likes bigint, click_doc_ids array<string>, avg_click_position double",
    )
    q = spark.createDataFrame([(1, "u", "a"), (2, "none", "a"), (3, "one", "b")], "query_id int, uid string, category string")
    out = {r.query_id: r for r in features.user_features(q, prof).collect()}
    assert out[1].interest_concentration == pytest.approx(1 - (-math.log(0.5)) / math.log(2)) and out[1].is_high_value_user == 1.0
    assert out[1].user_ctr == 0.75 and out[1].category_match == 0.5
    assert (out[2].is_new_user, out[2].user_ctr, out[2].category_match) == (1.0, 0.5, 0.5)
    assert (out[3].interest_concentration, out[3].category_match, out[3].user_activity) == (1.0, 0.0, 0.2)


def test_feature_store_round_trip(spark):
    df = spark.createDataFrame([("q1", 1.0, 2.0), ("q2", 3.0, None)], "id string, a double, b double")
    long = features.to_long(df, "query", "id", ["a", "b"])
    out = {r.entity_id: r.features for r in features.feature_vectors(long, ["b", "missing", "a"]).collect()}
    assert out == {"q1": [2.0, 0.0, 1.0], "q2": [0.0, 0.0, 3.0]}


def djb2(s):
    h = 5381
    for b in s.encode():
        h = (h * 33 + (b - 256 if b > 127 else b)) % 2**32
    return h


def test_experiments(spark):
    exps = spark.createDataFrame(
        [(0, "a", 0.2, {"mmr_lambda": "0.3"}), (1, "b", 0.3, {}), (2, "c", 0.7, {"k": "v"})], "ord int, name string, traffic_ratio double, params map<string,string>"
    )
    ids = [f"user{i}" for i in range(5000)] + ["", "é手"]
    users = spark.createDataFrame([(u,) for u in ids], "uid string")
    got = {r.uid: r for r in experiments.assign_experiments(users, exps).collect()}
    assert got[""].experiment is None and got["é手"].bucket == djb2("é手") % 100
    share = sum(r.experiment == "a" for r in got.values()) / 5000
    assert abs(share - 0.2) < 0.02 and all(got[u].bucket == djb2(u) % 100 for u in ids[:50])
    defaults = spark.createDataFrame([("mmr_lambda", "0.7"), ("k", "d")], "key string, value string")
    values = {(r.uid, r.key): r.value for r in experiments.resolve_params(users, exps, defaults).collect()}
    assert len(values) == 2 * len(ids) and values[("", "k")] == "d"
    for u in ids[:200]:
        assert values[(u, "mmr_lambda")] == ("0.3" if got[u].experiment == "a" else "0.7")


def test_vector_tables(spark):
    a = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0])], "id int, embedding array<double>")
    b = spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 1.0])], "id int, embedding array<double>")
    out = {r.id: r for r in vectors.vector_join(a, b, "id").collect()}
    assert (out[1].dot, out[1].cosine, out[1].l1) == (8.0, 0.8, 5.0) and out[1].l2 == pytest.approx(math.sqrt(13))
    assert out[2].same_dim is False and out[2].dot is None
    added = {r.id: r.embedding for r in vectors.combine_vectors(a, b, "id", "add").collect()}
    assert added == {1: [3.0, 6.0], 2: None}
    assert vectors.normalize_vectors(a.filter("id = 1")).first().embedding == [0.6, 0.8]
    pooled = vectors.mean_pool(spark.createDataFrame([("g", [2.0, 0.0]), ("g", [0.0, 0.0])], "g string, embedding array<double>"), "g").first()
    assert pooled.embedding == [1.0, 0.0]

"""Suggestions, hints and trending words against small brute-force models."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import hints, suggest, trending

LEX = "word string, source string, freq bigint, last_time bigint, source_weight double"


def lev(a, b):
    a, b = a.encode(), b.encode()
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_lexicon_sources(spark, docs):
    corpus = docs({"title": "T1", "tags": ["a", "ab", "é"], "click_count": 9, "publish_time": 50}, {"title": "", "tags": ["zz"]})
    stats = spark.createDataFrame([("q", 4, 7)], "query string, freq bigint, last_time bigint")
    got = {(r.word, r.source): (r.freq, r.last_time) for r in suggest.build_lexicon(corpus, stats, 1000).collect()}
    assert got == {("T1", "title"): (9, 50), ("ab", "tag"): (4, 50), ("é", "tag"): (4, 50), ("zz", "tag"): (1, 1000), ("q", "user_query"): (4, 7)}


def test_prefixes_keep_the_most_frequent(spark):
    rows = [(f"ab{c}", "title", i, 0, 1.0) for i, c in enumerate("xyzw")] + [("手机", "title", 9, 0, 1.0)]
    d = suggest.prefix_dictionary(spark.createDataFrame(rows, LEX), cap=2)
    assert [r.word for r in d.filter("prefix = 'ab'").orderBy("rank").collect()] == ["abw", "abz"]
    assert [r.word for r in d.filter("prefix = '手'").collect()] == ["手机"]


def test_suggest_dedup_length_and_blocked(spark):
    words = [("abcd", 50), ("abce", 40), ("abxyz", 30), ("a", 20), ("a" * 21, 10), ("abqrs", 5)]
    d = suggest.prefix_dictionary(spark.createDataFrame([(w, "title", f, 0, 1.0) for w, f in words], LEX))
    req = spark.createDataFrame([(1, "ab", 2), (2, "ab", None), (3, "nope", None)], "request_id int, prefix string, page_size int")
    out = suggest.suggest(req, d, 0).orderBy("request_id", "position").collect()
    assert [(r.request_id, r.word) for r in out] == [(1, "abcd"), (1, "abxyz"), (2, "abcd"), (2, "abxyz"), (2, "abqrs")]
    assert out[0].highlight_len == 2
    top = out[0].score
    rel = 2 / 4 * 0.3 + 0.3 + 0.2 + 0.2
    assert top == pytest.approx(rel * 0.5 + 0.3 + 0.2, abs=1e-5)
    blocked = spark.createDataFrame([("abcd",)], "word string")
    left = suggest.suggest(req.filter("request_id = 1"), d, 0, blocked=blocked).collect()
    assert [r.word for r in left] == ["abxyz"]


def brute_hints(docs, co, stats, source, query, size, distance, min_j=0.1):
    src = docs[source]
    cands = {}
    tags = set(src["tags"])
    for k, d in docs.items():
        if k == source or not d["title"]:
            continue
        other = set(d["tags"])
        j = len(tags & other) / len(tags | other) if tags and other else 0
        if j > min_j:
            cands[d["title"]] = max(cands.get(d["title"], (0, 0)), (round(0.7 * j, 6), 0))
    tagged = set(cands)
    cat = {}
    for k, d in docs.items():
        if k != source and d["category"] == src["category"] and d["title"] and d["title"] not in tagged:
            heat = round(0.6 * math.log1p(d["clicks"]) + 0.4 * math.log1p(d["likes"]), 6)
            cat[d["title"]] = max(cat.get(d["title"], 0), heat)
    for w, h in cat.items():
        cands[w] = (round(h * 0.08, 6), 1)
    near = sorted(((-n, d) for (s, d), n in co.items() if s == source))[:20]
    for n, d in near:
        w = docs[d]["title"]
        if w and cands.get(w, (0, 2))[1] == 2:
            s = math.log1p(-n)
            cands[w] = max(cands.get(w, (0, 2)), (round(s * 0.15 + s * 0.12, 6), 2))
    if query:
        hits = sorted((-f, w) for w, f in stats.items() if w.lower().encode().startswith(query.lower().encode()[:6]))[:15]
        for f, w in hits:
            if w != query and w not in cands:
                cands[w] = (round(math.log1p(-f) * 0.05 * 0.3, 6), 3)
    cands.pop(query, None)
    ranked = sorted(((-s, w) for w, (s, _) in cands.items() if 2 <= len(w) <= 30))
    kept = []
    for s, w in ranked:
        if len(kept) < size and all(lev(w, k) >= distance for k in kept):
            kept.append(w)
    return kept


@pytest.mark.parametrize("first_limit", [2, 100])
def test_hints_equal_brute_force(spark, docs, first_limit):
    rng = random.Random(4)
    table = {}
    for i in range(60):
        table[f"d{i}"] = {
            "title": rng.choice(["", "red fox", "red box", "red cat"]) if i % 3 == 0 else f"{rng.choice('abcd')}-title-{i % 25}",
            "tags": rng.sample(["t1", "t2", "t3", "t4", "t5"], rng.randint(0, 3)),
            "category": rng.choice(["x", "y", ""]),
            "clicks": rng.randint(0, 20),
            "likes": rng.randint(0, 5),
        }
    for d in table.values():
        d["category"] = d["category"] or "z"
    corpus = docs(*[{"doc_id": k, "title": d["title"], "tags": d["tags"], "category": d["category"], "click_count": d["clicks"], "like_count": d["likes"]} for k, d in table.items()])
    co = {(f"d{rng.randrange(60)}", f"d{rng.randrange(60)}"): rng.randint(1, 9) for _ in range(200)}
    edges = spark.createDataFrame([(s, d, n, 0) for (s, d), n in co.items()], "src string, dst string, co_count bigint, last_time bigint")
    stats = {"red fox": 5, "red fort": 3, "Red form": 3, "blue": 1, "redox": 7}
    qs = spark.createDataFrame(list(stats.items()), "query string, freq bigint")
    asked = {k: rng.choice(["", "red fox", "red f"]) for k in table}
    src = spark.createDataFrame([(k, k, q) for k, q in asked.items()], "source_id string, doc_id string, query string")
    out = hints.hints(src, corpus, edges, qs, page_size=5, first_limit=first_limit).orderBy("source_id", "position").collect()
    got = {}
    for r in out:
        got.setdefault(r.source_id, []).append(r.word)
    want = {k: brute_hints(table, co, stats, k, asked[k], 5, 3) for k in table}
    assert got == {k: v for k, v in want.items() if v}


def test_trending_first_channel_and_presets(spark, docs):
    stats = spark.createDataFrame([("hot word", 10, 0), ("x", 99, 0)], "query string, freq bigint, last_time bigint")
    corpus = docs({"title": "hot word", "click_count": 1000}, {"title": "doc title", "click_count": 3}, {"title": "doc title", "click_count": 5})
    out = trending.trending(trending.trending_candidates(stats, corpus, 0), 4).collect()
    assert [(r.word, r.heat) for r in out[:2]] == [("hot word", 10.0), ("doc title", 5.0)]
    assert len(out) == 4 and {r.source for r in out[2:]} == {"preset"}
    later = trending.trending_candidates(stats, corpus, 7 * 86400).filter(F.col("word") == "hot word").filter("channel_ord = 0").first()
    assert later.heat == pytest.approx(10 * math.exp(-0.693), abs=1e-4)

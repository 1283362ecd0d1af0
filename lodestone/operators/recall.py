"""Candidate generation and fusion. Candidates are keyed (query_id, doc_id)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import snippet
from lodestone.operators.index import TextIndex, match_documents, query_terms
from lodestone.schemas import META
from lodestone.skew import top_k

# Channel names in recall order.
TEXT, HISTORY, HOT, VECTOR = "inverted_index", "user_history", "hot_content", "vector"
CHANNEL_ORDER = [TEXT, HISTORY, HOT, VECTOR]
DAY = 86400


#: What the coarse scores read; titles and snippets are attached to what coarse ranking keeps.
NUMBERS = ("publish_time", "quality_score", "click_count", "like_count")


def enrich(cands: DataFrame, corpus: DataFrame, columns: Sequence[str] = (*META, "snippet")) -> DataFrame:
    """Attach document columns; candidates without a document drop out.

    The 200-byte snippet is read from the corpus if stored there, else cut from the content. Columns that the candidates
    have already are replaced.
    """
    cut = snippet("content").alias("snippet")
    take = [cut if c == "snippet" and c not in corpus.columns else F.col(c) for c in columns]
    return cands.drop(*[c for c in columns if c in cands.columns]).join(corpus.select("doc_id", *take), "doc_id")


def recall_text(
    queries: DataFrame,
    index: TextIndex,
    corpus: DataFrame | None = None,
    max_recall: int = 1000,
    min_term_freq: int = 1,
    bm25: tuple[float, float] | None = None,
    idf: str = "index",
) -> DataFrame:
    """Documents matching most query terms, scored by Σ (1 + ln(1 + tf))·idf.

    Matching and scoring share one pass over the postings, and a task passes on ``max_recall`` documents per query. With ``bm25`` = (k1, b) the
    same pass also gives the column ``bm25``, over all matched terms; ``idf="unit"`` weighs them alike.
    """
    counted = F.col("tf") >= min_term_freq
    values = {
        "matched": counted.cast("int"),
        "recall_score": F.when(counted, (1 + F.log1p("tf")) * F.col("idf")).otherwise(0.0),
    }
    if bm25 is not None:
        values["bm25"] = bm25_value(index, *bm25, idf)
    most = lambda s: np.where(s["matched"] > 0, s["matched"], -np.inf)
    found = match_documents(query_terms(queries), index, values, most, max_recall).filter("matched > 0")
    scored = found.withColumn("matched", F.col("matched").cast("long"))
    if bm25 is not None:
        scored = scored.withColumn("bm25", F.tanh(F.col("bm25") / 10))
    best = top_k(scored, ["query_id"], [F.desc("matched"), F.asc("doc_id")], max_recall, "doc_id")
    cands = best.drop("rank").withColumn("recall_source", F.lit(TEXT))
    return cands if corpus is None else enrich(cands, corpus)


def bm25_term(k1: float, b: float, avg_len: Column, idf: Column) -> Column:
    tf, length = F.col("tf"), F.col("doc_len")
    norm = tf + k1 * (1 - b + b * length / avg_len)
    return F.when(avg_len > 0, idf * tf * (k1 + 1) / norm * F.col("field_weight")).otherwise(0.0)


def bm25_value(index: TextIndex, k1: float, b: float, idf: str = "index") -> Column:
    """What one matched posting adds to the sum of BM25."""
    weight = F.col("idf") if idf == "index" else F.lit(1.0)
    return bm25_term(k1, b, index.stats.select("avg_len").scalar(), weight)


def bm25_sum(index: TextIndex, k1: float, b: float, idf: str = "index") -> Column:
    """tanh(Σ/10) over the matched postings of a (query, document) group."""
    return F.tanh(F.sum(bm25_value(index, k1, b, idf)) / 10)


def search_bm25(
    queries: DataFrame, index: TextIndex, k: int = 10, k1: float = 1.5, b: float = 0.75
) -> DataFrame:
    """The ``k`` best documents per query by BM25, in one pass over the postings."""
    best = lambda s: np.round(np.tanh(s["score"] / 10), 6)
    hits = match_documents(query_terms(queries), index, {"score": bm25_value(index, k1, b)}, best, k)
    hits = hits.withColumn("score", F.round(F.tanh(F.col("score") / 10), 6))
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "doc_id")


def hot_score(clicks: str = "click_count", likes: str = "like_count") -> Column:
    return 0.6 * F.log1p(clicks) + 0.4 * F.log1p(likes)


def hot_list(corpus: DataFrame, as_of: int, window_hours: float = 24, limit: int = 100) -> DataFrame:
    """The 2·limit most popular documents published inside the window."""
    start = as_of - int(window_hours * 3600)
    recent = corpus.filter((F.col("publish_time") >= start) & (F.col("publish_time") <= as_of))
    scored = recent.select("doc_id", F.round(hot_score(), 6).alias("hot_score"))
    return scored.orderBy(F.desc("hot_score"), F.asc("doc_id")).limit(2 * limit)


def recall_hot(queries: DataFrame, hot: DataFrame, limit: int = 100) -> DataFrame:
    """Offer the first ``limit`` hot documents to every query.

    The list has a fixed length, so it travels as one array value and is unfolded per query.
    """
    first = hot.orderBy(F.desc("hot_score"), F.asc("doc_id")).limit(limit)
    packed = first.agg(F.collect_list(F.struct("doc_id", "hot_score"))).scalar()
    return (
        queries.select("query_id", F.explode(packed).alias("h"))
        .select("query_id", "h.doc_id", F.col("h.hot_score").alias("recall_score"))
        .withColumn("recall_source", F.lit(HOT))
    )


def recall_history(
    queries: DataFrame,
    profiles: DataFrame,
    corpus: DataFrame,
    max_recall: int = 200,
    window_days: int | None = None,
    as_of: int | None = None,
) -> DataFrame:
    """Documents a user clicked, then liked, that fit the query's terms or category.

    A profile holds at most 200 ids of each kind, so each user's history is one bounded array that
    is joined with the user's queries and filtered inside the row.
    """
    ids = F.array_distinct(F.concat("click_doc_ids", "like_doc_ids"))
    items = profiles.select("uid", F.posexplode(ids).alias("pos", "doc_id"))
    docs = corpus.select("doc_id", "title", "category", "publish_time")
    if window_days is not None:
        docs = docs.filter(F.col("publish_time") >= as_of - window_days * DAY)
    entry = F.struct("pos", "doc_id", "title", "category")
    history = (
        items.join(docs, "doc_id")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(entry)).alias("history"))
    )
    q = queries.select("query_id", "uid", "terms", F.col("category").alias("_want"))

    def fits(h: Column) -> Column:
        named = F.exists(
            "terms", lambda t: (t != "") & (h["title"].contains(t) | h["category"].contains(t))
        )
        same = (F.col("_want") != "") & (h["category"] == F.col("_want"))
        return (F.size("terms") == 0) | named | F.coalesce(same, F.lit(False))

    kept = F.slice(F.filter("history", fits), 1, max_recall)
    return (
        q.join(history, "uid")
        .select("query_id", F.posexplode(kept).alias("at", "h"))
        .select("query_id", "h.doc_id", (1.0 / (F.col("at") + 1)).alias("recall_score"))
        .withColumn("recall_source", F.lit(HISTORY))
    )


def stack_channels(channels: dict[str, DataFrame]) -> DataFrame:
    """All channels as (channel, channel_ord, query_id, doc_id, recall_score), in the order given, with ``bm25``
    where a channel has it."""
    carried = any("bm25" in df.columns for df in channels.values())
    parts = [
        df.select(
            F.lit(name).alias("channel"),
            F.lit(i).alias("channel_ord"),
            "query_id",
            "doc_id",
            F.col("recall_score").cast("double").alias("recall_score"),
            *([F.col("bm25") if "bm25" in df.columns else F.lit(None).cast("double").alias("bm25")] if carried else []),
        )
        for i, (name, df) in enumerate(channels.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def union_recall(channels: dict[str, DataFrame], order: Sequence[str] | None = None) -> DataFrame:
    """One row per (query, doc): the earliest channel that found it names source and score.

    ``bm25``, where the text channel has it, is kept for all it found.
    """
    ordered = channels if order is None else {c: channels[c] for c in order if c in channels}
    first = F.min(F.struct("channel_ord", "channel", "recall_score")).alias("_f")
    rows = stack_channels(ordered)
    carried = ["bm25"] if "bm25" in rows.columns else []
    return (
        rows.groupBy("query_id", "doc_id")
        .agg(first, *[F.max(c).alias(c) for c in carried])
        .select(
            "query_id",
            "doc_id",
            F.col("_f.recall_score").alias("recall_score"),
            F.col("_f.channel").alias("recall_source"),
            *carried,
        )
    )


def recall_counts(cands: DataFrame) -> DataFrame:
    return cands.groupBy("query_id", "recall_source").agg(F.count(F.lit(1)).alias("n"))


def fuse_rrf(channels: dict[str, DataFrame], k: int = 60, max_total: int = 1500) -> DataFrame:
    """Reciprocal-rank fusion; sources are joined by a blank in channel order."""
    order = [F.desc(F.round("recall_score", 6)), F.asc("doc_id")]
    within = Window.partitionBy("channel", "query_id").orderBy(*order)
    ranked = stack_channels(channels).withColumn("_r", F.row_number().over(within))
    fused = ranked.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (k + F.col("_r"))), 6).alias("recall_score"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("channel_ord", "channel"))), lambda s: s["channel"]), " "
        ).alias("recall_source"),
    )
    return top_k(fused, ["query_id"], [F.desc("recall_score"), F.asc("doc_id")], max_total, "doc_id")


def fuse_weighted(
    channels: dict[str, DataFrame], weights: Sequence[float] = (), max_total: int = 1500
) -> DataFrame:
    """Weighted sum of scores scaled by each channel's maximum; the last channel names the source.

    Missing weights count as 1, a channel whose maximum is below 1e-6 is not scaled.
    """
    names = list(channels)
    table = [float(weights[i]) if i < len(weights) else 1.0 for i in range(len(names))]
    weight = F.element_at(F.array(*[F.lit(w) for w in table]), F.col("channel_ord") + 1)
    rows = stack_channels(channels)
    peaks = rows.groupBy("channel", "query_id").agg(F.max("recall_score").alias("_peak"))
    scale = F.when(F.col("_peak") < 1e-6, 1.0).otherwise(F.col("_peak"))
    fused = (
        rows.join(peaks, ["channel", "query_id"])
        .groupBy("query_id", "doc_id")
        .agg(
            F.round(F.sum(weight * F.col("recall_score") / scale), 6).alias("recall_score"),
            F.max_by("channel", "channel_ord").alias("recall_source"),
        )
    )
    return top_k(fused, ["query_id"], [F.desc("recall_score"), F.asc("doc_id")], max_total, "doc_id")

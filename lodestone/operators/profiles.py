"""User profiles: event updates, interest refresh, interest vectors.

A profile row is (uid, query_history, click_doc_ids, like_doc_ids, category_weights, total_clicks,
total_likes, active_days_last_30, active_dates, avg_click_position, update_time); ``active_dates``
holds the at most 30 recent active days (days since 1970) so that updates can be merged.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import arrays
from lodestone.functions.text import nonempty
from lodestone.operators.recall import DAY
from lodestone.session import cut_lineage
from lodestone.skew import MIN_HOT_ROWS, position_from_end, top_k

# History lengths and interest steps per event type.
HISTORY, QUERY_HISTORY = 200, 50
DWELL_MS = 30_000
DELTAS = {
    "click": 0.15,
    "like": 0.4,
    "share": 0.5,
    "view": 0.2,
    "collect": 0.6,
    "comment": 0.25,
}
SIMPLE_DELTAS = {"click": 0.1, "like": 0.4, "collect": 0.6}

# Interest refresh.
DECAY, ALPHA = 0.95, 0.3
CLICK_SIGNAL, LIKE_SIGNAL, SEARCH_SIGNAL = 0.5, 0.8, 0.05
SPREAD = 0.3
KEYWORDS = {
    "技术": "tech",
    "代码": "tech",
    "编程": "tech",
    "AI": "tech",
    "美食": "food",
    "餐厅": "food",
    "旅游": "travel",
    "酒店": "travel",
    "健康": "health",
    "运动": "sports",
}
LINKS = {
    "technology": ["programming", "AI", "gadget"],
    "tech": ["programming", "AI", "gadget"],
    "food": ["cooking", "restaurant", "nutrition"],
    "travel": ["photography", "outdoor", "culture"],
}

PROFILE_COLUMNS = [
    "uid",
    "query_history",
    "click_doc_ids",
    "like_doc_ids",
    "category_weights",
    "total_clicks",
    "total_likes",
    "active_days_last_30",
    "active_dates",
    "avg_click_position",
    "update_time",
]


def default_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KEYWORDS.items()), "keyword string, category string")


def default_links(spark: SparkSession) -> DataFrame:
    rows = [(c, x) for c, linked in LINKS.items() for x in linked]
    return spark.createDataFrame(rows, "category string, linked string")


def _delta_column(deltas: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for kind, step in deltas.items():
        hit = F.col("event_type") == kind
        if kind == "view":
            hit = hit & (F.col("duration_ms") >= DWELL_MS)
        out = F.when(hit, F.lit(float(step))).otherwise(out)
    return out


def _recent(events: DataFrame, value: str, n: int, order: tuple[str, ...], out: str) -> DataFrame:
    """(uid, out): the newest ``n`` values per user, oldest first."""
    newest = top_k(
        events.select("uid", value, *order), ["uid"], [F.desc(c) for c in (*order, value)], n, order[-1], "_r"
    )
    entry = F.struct((-F.col("_r")).alias("at"), F.col(value).alias("v"))
    return newest.groupBy("uid").agg(F.array_sort(F.collect_list(entry)).alias("_h")).select(
        "uid", F.transform("_h", lambda h: h["v"]).alias(out)
    )


def interest_steps(events: DataFrame, corpus: DataFrame, deltas: Mapping[str, float]) -> DataFrame:
    """(uid, category, step): summed interest steps. Events of one user on one document are combined
    before the document is looked up, so a popular document is joined once per user."""
    steps = (
        events.withColumn("_d", _delta_column(deltas))
        .filter(F.col("_d").isNotNull())
        .groupBy("uid", "doc_id")
        .agg(F.sum("_d").alias("_d"))
    )
    docs = corpus.filter(nonempty("category")).select("doc_id", "category")
    return steps.join(docs, "doc_id").groupBy("uid", "category").agg(F.sum("_d").alias("step"))


def _step_maps(steps: DataFrame) -> DataFrame:
    pair = F.struct("category", "step")
    return steps.groupBy("uid").agg(F.map_from_entries(F.collect_list(pair)).alias("_steps"))


def add_weights(old: Column, steps: Column) -> Column:
    """min(1, old + step) per category. Repeated capped additions of positive steps end at the same
    value as one capped addition of their sum."""
    empty = F.create_map().cast("map<string,double>")
    return F.map_zip_with(
        F.coalesce(old, empty),
        F.coalesce(steps, empty),
        lambda _k, w, d: F.when(
            d.isNull(), w
        ).otherwise(F.least(F.lit(1.0), F.coalesce(w, F.lit(0.0)) + d)),
    )


def empty_profiles(spark: SparkSession, uid_type: str = "string", doc_type: str = "string") -> DataFrame:
    schema = (
        f"uid {uid_type}, query_history array<string>, click_doc_ids array<{doc_type}>,"
        f" like_doc_ids array<{doc_type}>, category_weights map<string,double>, total_clicks bigint,"
        " total_likes bigint, active_days_last_30 int, active_dates array<bigint>, avg_click_position double, update_time bigint"
    )
    return spark.createDataFrame([], schema)


def _merged(profiles: DataFrame, parts: list[DataFrame], mode: str, as_of: int) -> DataFrame:
    """Fold per-user event summaries into the old profiles."""
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.join(part, "uid", "left")
    rows = profiles.withColumn("_known", F.lit(True)).join(summary, "uid", "full")

    def tail(old: str, new: str, n: int) -> Column:
        kind = profiles.schema[old].dataType
        empty = F.array().cast(kind)
        both = F.concat(F.coalesce(F.col(old), empty), F.coalesce(F.col(new).cast(kind), empty))
        return F.slice(both, F.greatest(F.lit(1), F.size(both) - n + 1), F.lit(n))

    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")
    days = F.array_union(F.coalesce("active_dates", none), F.coalesce("_days", none))
    recent = F.array_sort(F.filter(days, lambda d: (d > as_of // DAY - 30) & (d <= as_of // DAY)))
    before = F.coalesce("active_days_last_30", F.lit(0))
    seen = F.size(recent) if mode == "days" else before + F.coalesce("_n_events", zero)
    active = before if mode == "keep" else F.when(F.col("_n_events").isNull(), before).otherwise(F.least(F.lit(30), seen))
    return rows.select(
        "uid",
        tail("query_history", "_queries", QUERY_HISTORY).alias("query_history"),
        tail("click_doc_ids", "_clicked", HISTORY).alias("click_doc_ids"),
        tail("like_doc_ids", "_liked", HISTORY).alias("like_doc_ids"),
        add_weights(F.col("category_weights"), F.col("_steps")).alias("category_weights"),
        (F.coalesce("total_clicks", zero) + F.coalesce("_n_clicks", zero)).alias("total_clicks"),
        (F.coalesce("total_likes", zero) + F.coalesce("_n_likes", zero)).alias("total_likes"),
        active.cast("int").alias("active_days_last_30"),
        recent.alias("active_dates"),
        F.coalesce("avg_click_position", F.lit(0.0)).alias("avg_click_position"),
        F.when(F.col("_n_events").isNotNull(), F.lit(as_of).cast("long")).otherwise(F.col("update_time")).alias("update_time"),
    )


def _summaries(
    events: DataFrame, corpus: DataFrame, deltas: Mapping[str, float], as_of: int, order: tuple[str, ...], searches: bool
) -> list[DataFrame]:
    kind = F.col("event_type")
    day = F.floor(F.col("ts") / DAY)
    recent_day = F.when((day > as_of // DAY - 30) & (day <= as_of // DAY), day)
    counts = events.groupBy("uid").agg(
        F.count(F.lit(1)).alias("_n_events"),
        F.sum((kind == "click").cast("long")).alias("_n_clicks"),
        F.sum((kind == "like").cast("long")).alias("_n_likes"),
        F.collect_set(recent_day).alias("_days"),
    )
    clicked = _recent(events.filter(kind == "click"), "doc_id", HISTORY, order, "_clicked")
    liked = _recent(events.filter(kind == "like"), "doc_id", HISTORY, order, "_liked")
    steps = _step_maps(interest_steps(events, corpus, deltas))
    parts = [counts, clicked, liked, steps]
    if searches:
        asked = events.filter((kind == "search") & nonempty("query"))
        parts.append(_recent(asked, "query", QUERY_HISTORY, order, "_queries"))
    else:
        parts[0] = counts.withColumn("_queries", F.lit(None).cast("array<string>"))
    return parts


def update_profiles_simple(
    profiles: DataFrame, events: DataFrame, corpus: DataFrame, as_of: int, order: tuple[str, ...] = ("ts", "event_id")
) -> DataFrame:
    """Click / like update: newest 200 ids of each kind, totals, category weights."""
    own = events.filter(F.col("event_type").isin(*SIMPLE_DELTAS))
    parts = _summaries(own, corpus, SIMPLE_DELTAS, as_of, order, searches=False)
    return _merged(profiles, parts, "keep", as_of)


def update_profiles(
    profiles: DataFrame,
    events: DataFrame,
    corpus: DataFrame,
    as_of: int,
    deltas: Mapping[str, float] = DELTAS,
    mode: str = "days",
    order: tuple[str, ...] = ("ts", "event_id"),
) -> DataFrame:
    """Update from all event types. Types without a step count as activity only.

    ``mode="days"`` counts distinct active dates in the 30 days before ``as_of``; ``mode="events"``
    adds one per event up to 30.
    """
    parts = _summaries(events.filter(F.col("uid").isNotNull()), corpus, deltas, as_of, order, searches=True)
    return _merged(profiles, parts, mode, as_of)


# ---------------------------------------------------------------- interests


def _ema(weight: Column, signal: float, alpha: float, n: Column) -> Column:
    """n equal EMA steps at once: (1−α)ⁿ·w + s·(1−(1−α)ⁿ)."""
    left = F.pow(F.lit(1.0 - alpha), n)
    return left * weight + signal * (1 - left)


def refresh_interests(
    profiles: DataFrame,
    corpus: DataFrame,
    keywords: DataFrame,
    links: DataFrame,
    decay: float = DECAY,
    alpha: float = ALPHA,
) -> DataFrame:
    """(uid, category, weight) after decay, click, like and search signals, spreading to linked
    categories and scaling to a sum of at most 1.

    Repeated steps towards one signal have a closed form, so each signal is a count per
    (uid, category) and the whole refresh is grouping and joining.
    """
    docs = corpus.filter(nonempty("category")).select("doc_id", "category")
    kept = F.pow(F.lit(decay), 30 - F.least(F.lit(30), F.coalesce("active_days_last_30", F.lit(0))))
    base = profiles.select("uid", kept.alias("_kept"), F.explode("category_weights").alias("category", "_w"))
    base = base.select("uid", "category", (F.col("_w") * F.col("_kept")).alias("weight"))

    def counted(history: str, out: str) -> DataFrame:
        items = profiles.select("uid", F.explode(history).alias("doc_id")).groupBy("uid", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
        return items.join(docs, "doc_id").groupBy("uid", "category").agg(F.sum("_n").alias(out))

    # The keyword table is configuration: it travels as one array value and is matched in the row.
    packed = keywords.agg(F.collect_list(F.struct("keyword", "category"))).scalar()
    asked = profiles.select("uid", F.explode("query_history").alias("query")).withColumn("_kw", packed)
    searched = (
        asked.select("uid", F.explode(F.filter("_kw", lambda k: F.col("query").contains(k["keyword"]))).alias("k"))
        .groupBy("uid", F.col("k.category").alias("category"))
        .agg(F.count(F.lit(1)).alias("n_search"))
    )
    zero = F.lit(0)
    rows = (
        base.join(counted("click_doc_ids", "n_click"), ["uid", "category"], "full")
        .join(counted("like_doc_ids", "n_like"), ["uid", "category"], "full")
        .join(searched, ["uid", "category"], "full")
    )
    w = _ema(F.coalesce("weight", F.lit(0.0)), CLICK_SIGNAL, alpha, F.coalesce("n_click", zero))
    w = _ema(w, LIKE_SIGNAL, alpha, F.coalesce("n_like", zero))
    w = _ema(w, SEARCH_SIGNAL, alpha / 2, F.coalesce("n_search", zero))
    own = rows.select("uid", "category", w.alias("weight"))
    spread = own.join(links, "category").select(
        "uid", F.col("linked").alias("category"), F.lit(0.0).alias("weight"), (F.col("weight") * SPREAD).alias("added")
    )
    both = own.withColumn("added", F.lit(0.0)).withColumn("own", F.lit(1)).unionByName(
        spread.withColumn("own", F.lit(0))
    )
    mixed = both.groupBy("uid", "category").agg(
        F.sum("weight").alias("w"), F.sum("added").alias("a"), F.min("own").alias("only_own")
    )
    # Only categories that received something are capped.
    value = F.when(F.col("only_own") == 1, F.col("w")).otherwise(F.least(F.lit(1.0), F.col("w") + F.col("a")))
    weights = mixed.select("uid", "category", value.alias("weight"))
    totals = weights.groupBy("uid").agg(F.sum("weight").alias("_t"))
    return weights.join(totals, "uid").select(
        "uid", "category", (F.col("weight") / F.greatest(F.lit(1.0), F.col("_t"))).alias("weight")
    )


def with_interests(profiles: DataFrame, interests: DataFrame) -> DataFrame:
    """Profiles with their category weights replaced by refreshed ones."""
    maps = interests.groupBy("uid").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "weight"))).alias("_cw")
    )
    return (
        profiles.join(maps, "uid", "left")
        .withColumn("category_weights", F.coalesce("_cw", "category_weights"))
        .drop("_cw")
    )


def interest_vectors(
    events: DataFrame,
    vectors: DataFrame,
    w: float = 0.5,
    order: tuple[str, ...] = ("event_id",),
    init: DataFrame | None = None,
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """(uid, embedding): moving average over the vectors of clicked items in time order.

    The average equals a weighted mean whose weights depend on the distance to the newest click, so
    it is one grouped sum; users with very many clicks are ranked in time slices. Vectors of another
    size than the user's first one are skipped. The events are read once; they are ranked with the size of their
    vector alone, and the vectors (one per doc_id) meet the weights summed by user and document.
    """
    sizes = vectors.select("doc_id", F.size("embedding").alias("n"))
    hits = cut_lineage(events.select("uid", "doc_id", "ts", *order).join(sizes, "doc_id").filter("n > 0"))
    first = hits.groupBy("uid").agg(F.min_by("n", F.struct("ts", *order)).alias("_dim"))
    if init is not None:
        start = init.filter(F.size("embedding") > 0).select("uid", arrays.doubles("embedding").alias("_v0"))
        first = first.join(start, "uid", "full").select("uid", F.coalesce(F.size("_v0"), F.lit(None).cast("int")).alias("_d0"), "_dim")
        first = first.select("uid", F.when(F.col("_d0") > 0, F.col("_d0")).otherwise(F.col("_dim")).alias("_dim"))
    hits = hits.join(first, "uid").filter(F.col("n") == F.col("_dim")).drop("_dim", "n")
    ranked = position_from_end(hits, "uid", "ts", [*order, "doc_id"], "back", min_rows)
    n = ranked.groupBy("uid").agg(F.max("back").alias("oldest"))
    started = F.lit(False)
    if init is not None:
        n = n.join(start.select("uid").withColumn("_has0", F.lit(True)), "uid", "left")
        started = F.coalesce("_has0", F.lit(False))
    fade = F.pow(F.lit(1.0 - w), F.col("back").cast("double"))
    is_first = (F.col("back") == F.col("oldest")) & ~started
    share = F.when(is_first, fade).otherwise(w * fade)
    weights = ranked.join(n, "uid").groupBy("uid", "doc_id").agg(F.sum(share).alias("share"))
    table = vectors.select("doc_id", arrays.doubles("embedding").alias("v"))
    rows = weights.join(table, "doc_id").select("uid", "v", "share")
    if init is not None:
        opening = start.join(n.select("uid", "oldest"), "uid", "left").select(
            "uid",
            F.col("_v0").alias("v"),
            F.pow(F.lit(1.0 - w), F.coalesce(F.col("oldest") + 1, F.lit(0)).cast("double")).alias("share"),
        )
        rows = rows.unionByName(opening)
    mean = Summarizer.mean(array_to_vector("v"), F.col("share"))
    return rows.groupBy("uid").agg(mean.alias("_m")).select("uid", vector_to_array("_m").alias("embedding"))

"""Query, document and user feature tables, and the long form they are stored in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.arrays import total
from lodestone.functions.text import ascii_lower

# Words that mark query types.
NAVIGATIONAL = ["官网", "登录", "download"]
TRANSACTIONAL = ["购买", "订单", "价格", "buy"]
HOT_WORDS = ["新闻", "热点", "直播", "视频", "音乐", "游戏", "news", "video", "music", "game"]
TIME_WORDS = [
    "最新", "今天", "昨天", "本周", "本月", "最近", "实时",
    "latest", "today", "yesterday", "this week", "recent", "live",
]

QUERY_FEATURES = [
    "query_length", "term_count", "avg_term_length", "has_chinese", "has_english", "has_number",
    "has_special_char", "query_type", "language", "query_complexity", "is_hot_query",
    "time_sensitivity", "expected_result_count",
]
DOC_FEATURES = [
    "quality_score", "freshness", "click_count", "like_count", "title_length", "category_match",
    "keyword_coverage", "doc_popularity", "authority", "readability",
]
USER_FEATURES = [
    "user_activity", "interest_concentration", "history_click_count", "history_view_count",
    "retention_days", "user_ctr", "avg_dwell_time", "is_new_user", "is_high_value_user",
    "device_type", "time_preference", "category_match",
]


def _flag(cond: Column) -> Column:
    return cond.cast("double")


def _any_of(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(words))


def query_features(queries: DataFrame) -> DataFrame:
    """(query_id, 13 features) from the raw text and the terms."""
    q = F.coalesce("raw", F.lit(""))
    low = ascii_lower(q)
    n = F.size("terms")
    chinese, english = q.rlike(r"[\x{4E00}-\x{9FFF}]"), q.rlike("[A-Za-z]")
    kind = F.when(_any_of(low, NAVIGATIONAL), 1.0).when(_any_of(low, TRANSACTIONAL), 3.0).otherwise(2.0)
    bytes_ = total(F.transform("terms", lambda t: F.octet_length(t).cast("double")))
    unique = F.size(F.array_distinct("terms")) / n
    return queries.select(
        "query_id",
        F.octet_length(q).cast("double").alias("query_length"),
        n.cast("double").alias("term_count"),
        F.when(n > 0, bytes_ / n).otherwise(0.0).alias("avg_term_length"),
        _flag(chinese).alias("has_chinese"),
        _flag(english).alias("has_english"),
        _flag(q.rlike("[0-9]")).alias("has_number"),
        _flag(q.rlike("[^A-Za-z0-9 ]")).alias("has_special_char"),
        kind.alias("query_type"),
        F.when(chinese & english, 3.0).when(chinese, 1.0).when(english, 2.0).otherwise(0.0).alias("language"),
        F.when(n > 0, (unique + F.least(n / 10, F.lit(1.0))) / 2).otherwise(0.0).alias("query_complexity"),
        _flag((F.octet_length(q) < 2) | _any_of(low, HOT_WORDS)).alias("is_hot_query"),
        _flag(_any_of(low, TIME_WORDS)).alias("time_sensitivity"),
        F.when(kind == 1.0, 0.2).when(kind == 3.0, 0.5).otherwise(1.0).alias("expected_result_count"),
    )


def doc_features(cands: DataFrame, queries: DataFrame, as_of: int) -> DataFrame:
    """(query_id, doc_id, 10 features) per candidate."""
    q = queries.select("query_id", "terms", F.col("category").alias("_want"))
    rows = cands.join(q, "query_id")
    age = (F.lit(as_of) - F.col("publish_time")) / 86400.0
    have, want = F.coalesce("category", F.lit("")), F.coalesce("_want", F.lit(""))
    text = ascii_lower(F.concat("title", F.lit(" "), "snippet"))
    rows = rows.withColumn("_text", text)
    hits = F.filter("terms", lambda t: F.col("_text").contains(ascii_lower(t)))
    clicks, likes = F.col("click_count").cast("double"), F.col("like_count").cast("double")
    author = F.octet_length(F.coalesce("author", F.lit("")))
    ratio = F.octet_length("title") / F.octet_length("snippet")
    return rows.select(
        "query_id",
        "doc_id",
        F.col("quality_score"),
        F.when(F.col("publish_time") <= 0, 0.5)
        .when(age <= 7, 1.0)
        .when(age <= 30, 0.5)
        .when(age <= 365, 0.2)
        .otherwise(0.1)
        .alias("freshness"),
        F.when(clicks > 0, F.log1p(clicks)).otherwise(0.0).alias("click_count"),
        F.when(likes > 0, F.log1p(likes)).otherwise(0.0).alias("like_count"),
        F.octet_length("title").cast("double").alias("title_length"),
        F.when((have == "") | (want == ""), 0.5)
        .when(have == want, 1.0)
        .when(have.contains(want) | want.contains(have), 0.7)
        .otherwise(0.0)
        .alias("category_match"),
        F.when(F.size("terms") > 0, F.size(hits) / F.size("terms")).otherwise(0.0).alias("keyword_coverage"),
        F.least((F.log1p(clicks) + F.log1p(likes)) / 20, F.lit(1.0)).alias("doc_popularity"),
        F.when(author > 10, 0.8).when(author > 5, 0.5).otherwise(0.3).alias("authority"),
        F.when(F.coalesce(F.octet_length("snippet"), F.lit(0)) == 0, 0.5)
        .when((ratio > 0.1) & (ratio < 0.3), 1.0)
        .when((ratio > 0.05) & (ratio < 0.5), 0.7)
        .otherwise(0.4)
        .alias("readability"),
    )


def interest_concentration(weights: Column) -> Column:
    """1 − entropy / maximum entropy; 1 for a single category, 0 without any."""
    values = F.map_values(weights)
    entropy = -total(F.transform(values, lambda w: F.when(w > 1e-9, w * F.log(w)).otherwise(0.0)))
    n = F.size(values)
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(1 - entropy / F.log(n))


def user_features(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """(query_id, 12 features) of the asking user; users without a profile get the defaults."""
    known = profiles.select(
        "uid",
        F.lit(True).alias("_known"),
        "category_weights",
        F.coalesce("active_days_last_30", F.lit(0)).alias("_days"),
        F.coalesce("total_clicks", F.lit(0)).alias("_clicks"),
        F.coalesce("total_likes", F.lit(0)).alias("_likes"),
        F.coalesce(F.size("click_doc_ids"), F.lit(0)).alias("_seen"),
        F.coalesce("avg_click_position", F.lit(0.0)).alias("_pos"),
    )
    rows = queries.select("query_id", "uid", "category").join(known, "uid", "left")
    has = F.col("_known").isNotNull()
    days = F.col("_days")

    def either(value: Column, default: float) -> Column:
        return F.when(has, value.cast("double")).otherwise(F.lit(default))

    want = F.coalesce("category", F.lit(""))
    weight = F.try_element_at(F.col("category_weights"), want)
    match = F.when(want == "", 0.5).otherwise(F.least(F.lit(1.0), F.coalesce(weight, F.lit(0.0))))
    activity = F.when(days >= 20, 1.0).when(days >= 10, 0.7).when(days >= 3, 0.4).when(days >= 1, 0.2).otherwise(0.0)
    ctr = F.when(F.col("_pos") <= 0, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_pos") / 20))
    weights = F.coalesce("category_weights", F.create_map().cast("map<string,double>"))
    return rows.select(
        "query_id",
        either(activity, 0.0).alias("user_activity"),
        either(interest_concentration(weights), 0.0).alias("interest_concentration"),
        either(F.col("_clicks"), 0.0).alias("history_click_count"),
        either(F.col("_seen"), 0.0).alias("history_view_count"),
        either(days, 0.0).alias("retention_days"),
        either(ctr, 0.5).alias("user_ctr"),
        F.lit(0.5).alias("avg_dwell_time"),
        either(days <= 3, 1.0).alias("is_new_user"),
        either((F.col("_clicks") > 100) & (F.col("_likes") > 20), 0.0).alias("is_high_value_user"),
        F.lit(0.0).alias("device_type"),
        F.lit(0.0).alias("time_preference"),
        either(match, 0.5).alias("category_match"),
    )


def to_long(features: DataFrame, entity_type: str, id_col: str, names: Sequence[str]) -> DataFrame:
    """(entity_type, entity_id, key, value), one row per feature."""
    cells = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names])
    return features.select(
        F.lit(entity_type).alias("entity_type"), F.col(id_col).cast("string").alias("entity_id"), F.explode(cells).alias("c")
    ).select("entity_type", "entity_id", "c.key", "c.value")


def feature_vectors(long: DataFrame, names: Sequence[str], default: float = 0.0) -> DataFrame:
    """(entity_type, entity_id, features): values in the order of ``names``, absent ones replaced.

    One conditional aggregate per name keeps a fixed-size buffer per entity.
    """
    picked = [F.max(F.when(F.col("key") == n, F.col("value"))).alias(f"_f{i}") for i, n in enumerate(names)]
    wide = long.filter(F.col("key").isin(list(names))).groupBy("entity_type", "entity_id").agg(*picked)
    everyone = long.select("entity_type", "entity_id").distinct()
    cells = [F.coalesce(F.col(f"_f{i}"), F.lit(default)) for i in range(len(names))]
    return everyone.join(wide, ["entity_type", "entity_id"], "left").select(
        "entity_type", "entity_id", F.array(*cells).alias("features")
    )

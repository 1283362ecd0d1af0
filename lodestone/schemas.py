"""Row layouts of the library's tables."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("publish_time", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("click_count", T.LongType()),
        T.StructField("like_count", T.LongType()),
    ]
)

# Metadata carried by candidates (everything the ranking and filter stages read).
META = ["title", "author", "publish_time", "category", "quality_score", "click_count", "like_count"]

EVENT_BODY = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("uid", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("result_pos", T.IntegerType()),
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("bm25_score", T.DoubleType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("freshness_score", T.DoubleType()),
        T.StructField("coarse_score", T.DoubleType()),
        T.StructField("fine_score", T.DoubleType()),
        T.StructField("ts", T.LongType()),
    ]
)

# Event types the log accepts.
EVENT_TYPES = ["click", "like", "share", "search", "view", "dismiss", "dwell", "collect", "comment"]

SCORE_SNAPSHOT = ["bm25_score", "quality_score", "freshness_score", "coarse_score", "fine_score"]

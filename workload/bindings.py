"""The driver's tables as the library's tables. Every binding reads whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import snippet, words_prefix
from lodestone.operators import experiments, profiles, textprep
from lodestone.operators.index import TextIndex, build_index
from lodestone.operators.recall import CHANNEL_ORDER
from lodestone.operators.vector_index import VectorCells
from lodestone.session import checkpoint_dir
from lodestone.sources.snapshots import (
    current_version,
    read_index,
    read_vector_index,
    write_index,
    write_vector_index,
)

AS_OF = 1706745600
ANCHOR = 1704067200
DAY = 86400
ROW_GROUP = 4 << 20

EVENT_MAP = {"click": "click", "purchase": "like", "view": "view", "signup": "share", "error": "dismiss"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def app_folder(spark: SparkSession, d: str, name: str) -> str:
    key = hashlib.md5(f"{spark.sparkContext.applicationId}:{d}".encode()).hexdigest()[:12]
    return f"{checkpoint_dir(spark)}/{name}-{key}"


def stored(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per application into the shared folder and read from there."""
    path = app_folder(spark, d, name)
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        # Small row groups: a reader can split a file among as many tasks as it has groups.
        build().write.option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def publish_time(key: str):
    return (F.lit(ANCHOR) - (F.col(key) % 365) * DAY).cast("long")


def item_of(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("long")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents with labels and click counts; the document store of all other queries."""
    return stored(spark, d, "corpus", lambda: build_corpus(spark, d))


def build_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    counts = (
        table(spark, d, "events")
        .groupBy(item_of().alias("doc_id"))
        .agg(
            F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"),
            F.sum((F.col("event_type") == "purchase").cast("long")).alias("likes"),
        )
    )
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("q"))
    zero = F.lit(0).cast("long")
    return (
        docs.join(labels, "doc_id", "left")
        .join(counts, "doc_id", "left")
        .select(
            "doc_id",
            words_prefix("text", 8).alias("title"),
            F.col("text").alias("content"),
            F.col("source").alias("author"),
            F.col("lang").alias("category"),
            publish_time("doc_id").alias("publish_time"),
            F.array("source", "lang").alias("tags"),
            F.coalesce("q", F.lit(0.5)).alias("quality_score"),
            F.coalesce("clicks", zero).alias("click_count"),
            F.coalesce("likes", zero).alias("like_count"),
            F.octet_length("text").alias("content_length"),
            snippet("text").alias("snippet"),
        )
    )


def raw_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        (F.col("item_id") % 100).alias("uid"),
        F.col("text").alias("raw"),
    )


def queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries with terms taken from the raw text and the language of the matching user as category."""
    return textprep.tokenize_queries(raw_queries(spark, d), "raw").withColumn(
        "category", F.when(F.col("query_id") % 2 == 0, "en").otherwise("fr")
    )


def asked_words(text: str = "text") -> Column:
    """Every word of an utterance, one row each."""
    return F.explode(all_words(text))


def all_words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(r"(\S+)"), F.lit(1))


def query_log(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every user turn is a query; ``pos`` is its place in the turn."""
    user = table(spark, d, "conversations").filter(F.col("role") == "user")
    return user.select(
        F.col("conv_id").alias("uid"),
        F.col("turn").alias("ts"),
        F.posexplode(all_words()).alias("pos", "query"),
        F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("source"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event stream as user events; the queries are the benchmark passages in turn."""
    return with_passage(spark, d, shaped_events(table(spark, d, "events")).drop("query"), "doc_id")


def with_passage(spark: SparkSession, d: str, df: DataFrame, key: str) -> DataFrame:
    """``df`` with the whole benchmark passage number ``key`` modulo their count as ``query``."""
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    n = passages.agg(F.count(F.lit(1))).scalar()
    return df.withColumn("_item", F.pmod(F.col(key), n)).join(passages, F.col("_item") == F.col("item_id"), "left").drop("_item", "item_id")


def shaped_events(ev: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    mapped = F.lit(None).cast("string")
    for have, want in EVENT_MAP.items():
        mapped = F.when(kind == have, want).otherwise(mapped)
    return ev.select(
        "event_id",
        F.col("user_id").alias("uid"),
        item_of().alias("doc_id"),
        mapped.alias("event_type"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
        F.lit(None).cast("string").alias("query"),
        (F.col("event_id") % 20).cast("int").alias("result_pos"),
        F.when(kind == "view", F.floor(F.col("value") * 1000)).cast("int").alias("duration_ms"),
        F.round(F.col("value") / 1000, 6).alias("bm25_score"),
        F.round((F.col("value") % 100) / 100, 6).alias("quality_score"),
        F.round(F.exp(F.lit(-0.05) * (F.col("event_id") % 40)), 6).alias("freshness_score"),
        F.get(F.array(*map(F.lit, CHANNEL_ORDER)), (F.col("event_id") % 4).cast("int")).alias("recall_source"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def vector_cells(spark: SparkSession, d: str) -> VectorCells:
    """The stored cells of the embeddings, fitted and written once per application."""
    path = app_folder(spark, d, "cells")
    if current_version(spark, path) is None:
        write_vector_index(vectors(spark, d), path, 64)
    return read_vector_index(spark, path)


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector asks for its neighbours."""
    return vectors(spark, d).select(F.col("doc_id").alias("query_id"), "embedding")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Products as documents: tags are brand and size, category the type."""
    return stored(spark, d, "catalog", lambda: build_catalog(spark, d))


def build_catalog(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    counts = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_partkey").alias("doc_id"))
        .agg(
            F.count(F.lit(1)).alias("clicks"),
            F.sum((F.col("l_returnflag") == "N").cast("long")).alias("likes"),
        )
    )
    zero = F.lit(0).cast("long")
    return parts.withColumnRenamed("p_partkey", "doc_id").join(counts, "doc_id", "left").select(
        "doc_id",
        F.col("p_name").alias("title"),
        F.col("p_name").alias("content"),
        F.col("p_brand").alias("author"),
        publish_time("doc_id").alias("publish_time"),
        F.col("p_type").alias("category"),
        F.array("p_brand", F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("tags"),
        F.coalesce("clicks", zero).alias("click_count"),
        F.coalesce("likes", zero).alias("like_count"),
    )


def interactions(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("uid"),
        F.col("l_partkey").alias("doc_id"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        "o_orderkey",
        "l_linenumber",
    )


INTERACTION_ORDER = ("o_orderkey", "l_linenumber", "doc_id")


def user_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles computed from the whole event stream."""
    none = profiles.empty_profiles(spark, "bigint", "bigint")
    return stored(
        spark, d, "profiles", lambda: profiles.update_profiles(none, events(spark, d), corpus(spark, d), AS_OF)
    )


def experiment_table(spark: SparkSession, d: str) -> DataFrame:
    """One experiment per region: 10, 15, 20, ... % of traffic in key order."""
    return table(spark, d, "region").select(
        F.col("r_regionkey").cast("int").alias("ord"),
        F.col("r_name").alias("name"),
        (F.lit(0.10) + F.col("r_regionkey") * 0.05).cast("double").alias("traffic_ratio"),
        F.create_map(F.lit("mmr_lambda"), F.format_string("0.%d", F.col("r_regionkey") + 3)).alias("params"),
    )


def snapshot(spark: SparkSession, d: str) -> TextIndex:
    """The text index of the corpus, built once per application into the shared checkpoint folder."""
    path = app_folder(spark, d, "index")
    if current_version(spark, path) is None:
        write_index(build_index(corpus(spark, d)), path, AS_OF)
    return read_index(spark, path)


def bucket(uid: str):
    return experiments.bucket(F.col(uid).cast("string"))

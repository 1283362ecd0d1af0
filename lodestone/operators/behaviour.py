"""Query statistics and item co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower, byte_view, nonempty
from lodestone.schemas import SCORE_SNAPSHOT
from lodestone.session import cut_lineage
from lodestone.skew import MIN_HOT_ROWS, previous_value, top_k


def build_event_log(events: DataFrame, corpus: DataFrame) -> DataFrame:
    """Events with defaults filled in and the document's static features (0 when unknown).

    Events of one very popular document make a skewed join partition, which adaptive execution splits.
    """
    docs = corpus.select(
        "doc_id", "click_count", "like_count", F.col("quality_score").alias("doc_quality")
    )
    defaults = {
        "result_pos": F.coalesce("result_pos", F.lit(-1)),
        "duration_ms": F.coalesce("duration_ms", F.lit(0)),
        "query": F.coalesce("query", F.lit("")),
        **{
            s: F.coalesce(F.col(s) if s in events.columns else F.lit(None), F.lit(0.0)).cast("double")
            for s in SCORE_SNAPSHOT
        },
    }
    zero = {
        "click_count": F.coalesce("click_count", F.lit(0)),
        "like_count": F.coalesce("like_count", F.lit(0)),
        "doc_quality": F.coalesce("doc_quality", F.lit(0.0)),
    }
    return (
        events.withColumns(defaults)
        .drop("click_count", "like_count", "doc_quality")
        .join(docs, "doc_id", "left")
        .withColumns(zero)
    )


def append_event_log(log: DataFrame, path: str) -> None:
    """Append to a log partitioned by event date (UTC)."""
    day = F.to_date(F.timestamp_seconds("ts"))
    log.withColumn("date", day).write.mode("append").partitionBy("date").parquet(path)


# ---------------------------------------------------------------- query statistics


def query_stats(events: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(query, freq, last_time, source, first_time): the source is that of the first occurrence."""
    seen = events.filter(nonempty("query"))
    return seen.groupBy("query").agg(
        F.count(F.lit(1)).alias("freq"),
        F.max("ts").alias("last_time"),
        F.min_by("source", F.struct(*order, "source")).alias("source"),
        F.min("ts").alias("first_time"),
    )


def fold_query_stats(stats: DataFrame) -> DataFrame:
    """One row per query from several partial statistics of it."""
    return stats.groupBy("query").agg(
        F.sum("freq").alias("freq"),
        F.max("last_time").alias("last_time"),
        F.min_by("source", F.struct("first_time", "source")).alias("source"),
        F.min("first_time").alias("first_time"),
    )


def merge_query_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Combine two statistics tables; equal to computing them over all events at once."""
    return fold_query_stats(old.unionByName(new))


def seed_query_stats(old: DataFrame, seed: DataFrame) -> DataFrame:
    """Add seed queries that are not known yet; of several seeds with one key the first by source stays."""
    fresh = seed.join(old.select("query"), "query", "left_anti")
    payload = F.struct(*[c for c in old.columns if c != "query"])
    one = fresh.groupBy("query").agg(F.min(payload).alias("_p")).select("query", "_p.*")
    return old.unionByName(one.select(old.columns))


def top_queries(
    stats: DataFrame, n: int, by: str | None = None, prefixes: DataFrame | None = None
) -> DataFrame:
    """The ``n`` most frequent queries: overall, per value of column ``by``, or per requested prefix.

    Prefixes match from the start of the query without regard to ASCII case.
    """
    order = [F.desc("freq"), F.asc("query")]
    if prefixes is not None:
        wanted = prefixes.select("prefix").distinct().withColumn("_p", ascii_lower("prefix"))
        lengths = wanted.select(F.length("_p").alias("_len")).distinct()
        # One row per (query, requested length): an equi-join on the prefix instead of a LIKE pair test.
        packed = lengths.agg(F.collect_set("_len")).scalar()
        keyed = (
            stats.withColumn("_len", F.explode(packed))
            .filter((F.length("query") >= F.col("_len")) & (F.col("_len") > 0))
            .withColumn("_p", F.substring(ascii_lower("query"), F.lit(1), F.col("_len")))
            .drop("_len")
        )
        return top_k(keyed.join(wanted, "_p").drop("_p"), ["prefix"], order, n, "query")
    if by is not None:
        return top_k(stats, [by], order, n, "query")
    return stats.orderBy(*order).limit(n)


def query_count(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n"))


def byte_prefix(c: str, n: int):
    return F.substring(byte_view(ascii_lower(c)), 1, n)


# ---------------------------------------------------------------- co-occurrence


def click_pairs(
    events: DataFrame, order: tuple[str, ...] = ("event_id",), min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """(uid, src, dst, ts): consecutive clicks of one user on two different items.

    A user with a large share of all events is cut into time slices, so no task sorts all of them. The events are read
    once; what slicing reads again are the slim columns checkpointed here.
    """
    clicks = cut_lineage(events.select("uid", "doc_id", "ts", *order))
    full = [*order, "doc_id"] if "doc_id" not in order else list(order)
    before = previous_value(clicks, "uid", "ts", full, "doc_id", "src", min_rows)
    return before.filter(F.col("src") != F.col("doc_id")).select(
        "uid", "src", F.col("doc_id").alias("dst"), "ts"
    )


def count_both_ways(pairs: DataFrame) -> DataFrame:
    """Edge counts in both directions; each pair is mirrored only after it has been counted."""
    edges = pairs.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("t")
    )
    both = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src"), F.col("dst"), "n", "t"),
                F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", "t"),
            )
        ).alias("e")
    ).select("e.*")
    return both.groupBy("src", "dst").agg(
        F.sum("n").alias("co_count"), F.max("t").alias("last_time")
    )


def cooccurrence(
    events: DataFrame, order: tuple[str, ...] = ("event_id",), min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """Edges (src, dst, co_count, last_time) from click events (uid, doc_id, ts, order columns)."""
    return count_both_ways(click_pairs(events, order, min_rows))


def fold_cooccurrence(edges: DataFrame) -> DataFrame:
    """One row per edge from several partial counts of it."""
    return edges.groupBy("src", "dst").agg(
        F.sum("co_count").alias("co_count"), F.max("last_time").alias("last_time")
    )


def merge_cooccurrence(old: DataFrame, new: DataFrame) -> DataFrame:
    return fold_cooccurrence(old.unionByName(new))


def top_cooccur(cooccur: DataFrame, limit: int = 20) -> DataFrame:
    return top_k(cooccur, ["src"], [F.desc("co_count"), F.asc("dst")], limit, "dst")

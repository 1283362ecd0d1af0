"""The daily refresh: behaviour tables, profiles, word lists, index and training set from the event log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import behaviour, profiles, ranking, recall, suggest
from lodestone.sources.snapshots import rebuild_index


@dataclass(frozen=True)
class RefreshTables:
    """Events carry (event_id, uid, doc_id, event_type, query, result_pos, duration_ms, ts)."""

    corpus: DataFrame
    events: DataFrame
    profiles: DataFrame
    keywords: DataFrame
    links: DataFrame
    query_stats: DataFrame | None = None
    cooccur: DataFrame | None = None


def refresh_all(tables: RefreshTables, as_of: int, path: str, min_doc_changes: int = 10) -> dict[str, DataFrame]:
    """Write every derived table under ``path`` and return them as read back.

    The enriched log is written once and read by all later steps, so nothing is recomputed and a
    lost executor only repeats its own tasks.
    """
    spark = tables.corpus.sparkSession

    def saved(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    log = saved("event_log", behaviour.build_event_log(tables.events, tables.corpus))
    clicks = log.filter(F.col("event_type") == "click")
    stats = behaviour.query_stats(clicks.withColumn("source", F.lit("search_click")))
    if tables.query_stats is not None:
        stats = behaviour.merge_query_stats(tables.query_stats, stats)
    stats = saved("query_stats", stats)
    edges = behaviour.cooccurrence(clicks)
    if tables.cooccur is not None:
        edges = behaviour.merge_cooccurrence(tables.cooccur, edges)
    out = {"event_log": log, "query_stats": stats, "cooccur": saved("cooccur", edges)}
    updated = saved("profiles_updated", profiles.update_profiles(tables.profiles, log, tables.corpus, as_of))
    interests = saved(
        "interests", profiles.refresh_interests(updated, tables.corpus, tables.keywords, tables.links)
    )
    out["interests"] = interests
    out["profiles"] = saved("profiles", profiles.with_interests(updated, interests))
    lexicon = saved("lexicon", suggest.build_lexicon(tables.corpus, stats, as_of))
    out["lexicon"] = lexicon
    out["prefixes"] = saved("prefixes", suggest.prefix_dictionary(lexicon))
    out["hot"] = saved("hot", recall.hot_list(tables.corpus, as_of))
    out["training"] = saved("training", ranking.training_set(log, corpus=tables.corpus, profiles=out["profiles"]))
    rebuild_index(tables.corpus, f"{path}/index", as_of, min_doc_changes=min_doc_changes)
    return out

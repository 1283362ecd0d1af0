"""Suggestions, hints and trending words for a table of mixed requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import filters, hints, suggest, trending


@dataclass(frozen=True)
class WordTables:
    corpus: DataFrame
    query_stats: DataFrame
    cooccur: DataFrame
    dictionary: DataFrame | None = None
    blocked: DataFrame | None = None
    rules: DataFrame | None = None


@dataclass(frozen=True)
class WordConfig:
    as_of: int
    suggest_size: int = 10
    hint_size: int = 10
    trend_size: int = 6
    dedup: bool = True


def recommend(requests: DataFrame, tables: WordTables, cfg: WordConfig) -> DataFrame:
    """requests(request_id, type, query, doc_id) → (request_id, type, position, word, score).

    ``type`` is sug (query = typed prefix), hint (doc_id = clicked document) or nav. Intervention rules, where the
    tables have any, are applied to every request's page, which is short; a word that a rule forces has no score.
    """
    dictionary = tables.dictionary
    if dictionary is None:
        dictionary = suggest.prefix_dictionary(suggest.build_lexicon(tables.corpus, tables.query_stats, cfg.as_of))
    kind = F.col("type")
    typed = requests.filter(kind == "sug").select("request_id", F.col("query").alias("prefix"))
    sug = suggest.suggest(
        typed, dictionary, cfg.as_of, cfg.suggest_size, tables.blocked, dedup_distance=2 if cfg.dedup else 0
    )
    clicked = requests.filter(kind == "hint").select(F.col("request_id").alias("source_id"), "doc_id", "query")
    hint = hints.hints(
        clicked,
        tables.corpus,
        tables.cooccur,
        tables.query_stats,
        cfg.hint_size,
        dedup_distance=3 if cfg.dedup else 0,
        blocked=tables.blocked,
    ).withColumnRenamed("source_id", "request_id")
    hot = trending.trending(
        trending.trending_candidates(tables.query_stats, tables.corpus, cfg.as_of), cfg.trend_size
    )
    order = F.array_sort(F.collect_list(F.struct((-F.col("heat")).alias("neg"), "word")))
    # The list has trend_size entries; it is attached to every request as one array value.
    packed = hot.agg(order).scalar()
    nav = (
        requests.filter(kind == "nav")
        .select("request_id", F.posexplode(packed).alias("pos", "w"))
        .select("request_id", (F.col("pos") + 1).alias("position"), "w.word", (-F.col("w.neg")).alias("score"))
    )
    parts = [("sug", sug), ("hint", hint), ("nav", nav)]
    tagged = [
        df.select("request_id", F.lit(name).alias("type"), "position", "word", "score") for name, df in parts
    ]
    pages = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    if tables.rules is None:
        return pages
    keyed = pages.select(F.struct("request_id", "type").alias("request_id"), "word", "score")
    kept, _ = filters.apply_rules(keyed, tables.rules)
    return kept.select("request_id.request_id", "request_id.type", "position", "word", "score")

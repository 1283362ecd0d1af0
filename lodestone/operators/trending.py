"""Trending words shown before anything is typed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import nonempty
from lodestone.operators.behaviour import top_queries

# Words offered when nothing else is known, decay per day.
PRESET_WORDS = ["深度学习", "算法面试", "系统设计", "Redis", "分布式系统", "搜索推荐"]
DECAY = 0.099
PRESET_HEAT = 0.1


def trending_candidates(
    query_stats: DataFrame,
    corpus: DataFrame,
    as_of: int,
    presets: Sequence[str] = tuple(PRESET_WORDS),
    rate: float = DECAY,
    n_queries: int = 30,
) -> DataFrame:
    """(word, source, channel_ord, heat): one row per word and channel, hottest occurrence."""

    def heat(weight: str, at: str):
        days = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col(at)) / 86400.0)
        return F.round(F.col(weight) * F.exp(-rate * days), 6)

    logged = top_queries(query_stats.filter(nonempty("query")), n_queries).select(
        F.col("query").alias("word"), F.lit("hot").alias("source"), F.lit(0).alias("channel_ord"), heat("freq", "last_time").alias("heat")
    )
    titles = corpus.filter(nonempty("title")).groupBy(F.col("title").alias("word")).agg(
        F.max(heat("click_count", "publish_time")).alias("heat")
    ).select("word", F.lit("doc_hot").alias("source"), F.lit(1).alias("channel_ord"), "heat")
    out = logged.unionByName(titles)
    if presets:
        words = F.explode(F.array(*[F.lit(w) for w in presets]))
        fixed = corpus.sparkSession.range(1).select(
            words.alias("word"), F.lit("preset").alias("source"), F.lit(2).alias("channel_ord"), F.lit(PRESET_HEAT).alias("heat")
        )
        out = out.unionByName(fixed)
    return out


def trending(cands: DataFrame, page_size: int = 6, min_len: int = 2, max_len: int = 20) -> DataFrame:
    """The hottest words; the first channel that offers a word decides its heat."""
    first = cands.groupBy("word").agg(F.min(F.struct("channel_ord", "source", "heat")).alias("f"))
    fits = first.filter(F.char_length("word").between(min_len, max_len))
    return (
        fits.select("word", "f.source", "f.heat")
        .orderBy(F.desc("heat"), F.asc("word"))
        .limit(page_size)
    )

"""Prefix suggestions for many prefixes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import byte_view, nonempty
from lodestone.operators.behaviour import top_queries
from lodestone.skew import top_k

# Source weights and mixing weights.
TITLE_WEIGHT, TAG_WEIGHT, QUERY_WEIGHT = 1.0, 0.8, 1.2
DECAY = 0.099
MIN_LEN, MAX_LEN = 2, 20

ENTRY_ORDER = ["word", "source", "last_time"]


def build_lexicon(corpus: DataFrame, query_stats: DataFrame, as_of: int, n_queries: int = 200) -> DataFrame:
    """(word, source, freq, last_time, source_weight) from titles, tags and the top logged queries.

    Titles and tags come from one scan of the corpus.
    """
    clicks = F.col("click_count").cast("long")
    when_ = F.when(F.col("publish_time") > 0, F.col("publish_time")).otherwise(F.lit(as_of)).cast("long")

    def entry(word: Column, source: str, freq: Column, weight: float) -> Column:
        return F.struct(
            word.alias("word"),
            F.lit(source).alias("source"),
            F.greatest(F.lit(1).cast("long"), freq).alias("freq"),
            when_.alias("last_time"),
            F.lit(weight).alias("source_weight"),
        )

    title = F.array(entry(F.col("title"), "title", clicks, TITLE_WEIGHT))
    half = F.floor(clicks / 2).cast("long")
    tags = F.transform("tags", lambda t: entry(t, "tag", half, TAG_WEIGHT))
    kept = F.filter(
        F.concat(title, F.coalesce(tags, F.array())),
        lambda e: F.coalesce(e["word"] != "", F.lit(False)) & ((e["source"] == "title") | (F.octet_length(e["word"]) >= 2)),
    )
    docs = corpus.select(F.explode(kept).alias("e")).select("e.*")
    logged = top_queries(query_stats, n_queries).select(
        F.col("query").alias("word"),
        F.lit("user_query").alias("source"),
        F.col("freq").cast("long").alias("freq"),
        F.col("last_time").cast("long").alias("last_time"),
        F.lit(QUERY_WEIGHT).alias("source_weight"),
    )
    return docs.unionByName(logged)


def prefix_dictionary(lexicon: DataFrame, cap: int = 200) -> DataFrame:
    """Every prefix with its ``cap`` most frequent entries (rank from 1).

    An entry outside the first ``cap`` of its own word cannot be among the first ``cap`` of any of
    its prefixes, so words with many copies shrink before they are unfolded.
    """
    order = [F.desc("freq"), *[F.asc(c) for c in ENTRY_ORDER]]
    words = top_k(lexicon.filter(nonempty("word")), ["word"], order, cap, "last_time", "_own").drop("_own")
    lengths = F.sequence(F.lit(1), F.length("word"))
    prefixes = words.withColumn("_n", F.explode(lengths)).withColumn(
        "prefix", F.substring(F.col("word"), F.lit(1), F.col("_n"))
    )
    return top_k(prefixes.drop("_n"), ["prefix"], order, cap, "word")


def suggest_recall(prefixes: DataFrame, dictionary: DataFrame, as_of: int, limit: int = 50) -> DataFrame:
    """Up to ``limit`` entries per distinct requested prefix with match ratio, frequency and freshness."""
    wanted = prefixes.select("prefix").filter(nonempty("prefix")).distinct()
    found = dictionary.filter(F.col("rank") <= limit).join(wanted, "prefix", "left_semi")
    peak = F.greatest(F.lit(1.0), F.max("freq").over(Window.partitionBy("prefix")).cast("double"))
    days = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("last_time")) / 86400.0)
    return found.withColumns(
        {
            "prefix_match_ratio": F.octet_length("prefix") / F.greatest(F.lit(1), F.octet_length("word")),
            "freq_norm": F.log1p(F.col("freq").cast("double")) / F.log1p(peak),
            "freshness": F.exp(-DECAY * days),
        }
    )


def byte_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(byte_view(a), byte_view(b))


def suggest_score(cands: DataFrame, min_len: int = MIN_LEN, max_len: int = MAX_LEN) -> DataFrame:
    """Add cover, edit similarity and relevance; drop weak matches and words of unusual length."""
    p, w = byte_view("prefix"), byte_view("word")
    head = F.substring(w, F.lit(1), F.length(p))
    letters = F.filter(F.split(p, ""), lambda c: c != "")
    hits = F.size(F.filter(letters, lambda c: F.instr(w, c) > 0))
    longest = F.greatest(F.length(p), F.length(head))
    scored = cands.withColumns(
        {
            "cover": F.when(F.length(p) > 0, hits / F.length(p)).otherwise(0.0),
            "edit_sim": F.when(longest > 0, 1 - F.levenshtein(p, head) / longest).otherwise(0.0),
        }
    ).withColumn(
        "relevance",
        F.col("prefix_match_ratio") * 0.3
        + F.col("cover") * 0.3
        + F.col("edit_sim") * 0.2
        + F.col("source_weight") * 0.2,
    )
    weak = (F.col("cover") < 0.2) & (F.col("edit_sim") < 0.3)
    return scored.filter(~weak & F.char_length("word").between(min_len, max_len))


def suggest_rank(scored: DataFrame) -> DataFrame:
    """Add the final score."""
    mixed = F.col("relevance") * 0.5 + F.col("freq_norm") * 0.3 + F.col("freshness") * 0.2
    return scored.withColumn("score", F.round(mixed * F.col("source_weight"), 6))


def keep_distinct_words(items: Column, empty: Column, distance: int, limit: int | Column) -> Column:
    """Fold a ranked array of structs with a ``bytes`` view of their word: keep a word unless it is
    closer than ``distance`` byte edits to one kept before; stop growing at ``limit``."""

    def step(kept: Column, item: Column) -> Column:
        near = F.exists(kept, lambda k: F.levenshtein(k["bytes"], item["bytes"], distance - 1) >= 0)
        return F.when((F.size(kept) >= limit) | near, kept).otherwise(F.concat(kept, F.array(item)))

    return F.aggregate(items, empty, step)


def suggest(
    prefixes: DataFrame,
    dictionary: DataFrame,
    as_of: int,
    page_size: int = 10,
    blocked: DataFrame | None = None,
    dedup_distance: int = 2,
    limit: int = 50,
    max_len: int = MAX_LEN,
) -> DataFrame:
    """Ranked suggestions per request (request_id, prefix[, page_size]).

    Requests with the same prefix share one list of at most ``limit`` entries; ``dedup_distance=0``
    turns the edit-distance step off. Blocked words leave after the page is cut.
    """
    ranked = suggest_rank(suggest_score(suggest_recall(prefixes, dictionary, as_of, limit), max_len=max_len))
    item = F.struct(
        (-F.col("score")).alias("neg"), "word", "source", "last_time", "freq", byte_view("word").alias("bytes")
    )
    lists = ranked.groupBy("prefix").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = lists.schema["items"].dataType
    if dedup_distance > 0:
        items = keep_distinct_words(F.col("items"), F.array().cast(kind), dedup_distance, limit)
        lists = lists.withColumn("items", items)
    size = F.coalesce(F.col("page_size"), F.lit(page_size)) if "page_size" in prefixes.columns else F.lit(page_size)
    out = (
        prefixes.withColumn("_size", size)
        .join(lists, "prefix")
        .select("request_id", "prefix", F.posexplode(F.slice("items", F.lit(1), F.col("_size"))).alias("pos", "i"))
        .select(
            "request_id",
            "prefix",
            (F.col("pos") + 1).alias("position"),
            "i.word",
            "i.source",
            (-F.col("i.neg")).alias("score"),
            F.octet_length("prefix").alias("highlight_len"),
        )
        .filter(F.col("score") >= 0.01)
    )
    if blocked is not None:
        out = out.join(blocked.select("word").distinct(), "word", "left_anti")
    return out

"""Related-item hints after a click, for many clicked items at once.

A hint is a word: the title of another document or a logged query. Documents are first grouped by
tag set and title, so items that share tags are never paired one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import byte_view, nonempty
from lodestone.operators.behaviour import byte_prefix, top_cooccur
from lodestone.operators.recall import hot_score
from lodestone.operators.suggest import keep_distinct_words
from lodestone.session import cut_lineage
from lodestone.skew import hot_keys, salted_join, top_k

# Channel order and mixing weights.
TAG, CATEGORY, COOCCUR, QUERY = 0, 1, 2, 3
CHANNELS = ["tag_match", "category_hot", "cooccur", "query_expand"]
RECALL_W, TAG_W, COOCCUR_W, CATEGORY_W = 0.3, 0.4, 0.12, 0.05
MIN_LEN, MAX_LEN = 2, 30

_SEP = "\x1f"


def tag_key(tags: str = "tags") -> Column:
    """One string per tag set."""
    return F.array_join(F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>")))), _SEP)


def _described(sources: DataFrame, corpus: DataFrame) -> DataFrame:
    """Sources with the tag set, category and title of their document."""
    docs = corpus.select("doc_id", tag_key().alias("tag_set"), F.col("category").alias("src_category"), F.col("title").alias("src_title"))
    keep = ["source_id", "doc_id", *(["query"] if "query" in sources.columns else [])]
    return sources.select(*keep).join(docs, "doc_id")


def tag_set_words(sources: DataFrame, corpus: DataFrame, min_jaccard: float = 0.1) -> DataFrame:
    """(tag_set, word, overlap, other_overlap, n_same) for every tag set that occurs in ``sources``.

    ``overlap`` is the best Jaccard of the tag set with one of the word's documents, ``other_overlap``
    the best among different tag sets, ``n_same`` the number of documents with exactly this set.
    """
    words = (
        corpus.filter(nonempty("title"))
        .groupBy(tag_key().alias("other_set"), F.col("title").alias("word"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    all_sets = words.select("other_set").filter(F.col("other_set") != "").distinct()
    tags = F.split("other_set", _SEP)
    right = all_sets.withColumn("n_other", F.size(tags)).withColumn("tag", F.explode(tags))
    mine = sources.select("tag_set").filter(F.col("tag_set") != "").distinct()
    own = F.split("tag_set", _SEP)
    left = mine.withColumn("n_own", F.size(own)).withColumn("tag", F.explode(own))
    hot = hot_keys(right.groupBy("tag").agg(F.count(F.lit(1)).alias("_n")), ["tag"], "_n")
    common = (
        salted_join(right, left, "tag", hot, spread_on=["other_set"])
        .groupBy("tag_set", "other_set", "n_own", "n_other")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    overlap = F.col("c") / (F.col("n_own") + F.col("n_other") - F.col("c"))
    close = common.withColumn("overlap", overlap).filter(F.col("overlap") > min_jaccard)
    same = F.col("other_set") == F.col("tag_set")
    return (
        close.join(words, "other_set")
        .groupBy("tag_set", "word")
        .agg(
            F.max("overlap").alias("overlap"),
            F.max(F.when(~same, F.col("overlap"))).alias("other_overlap"),
            F.coalesce(F.sum(F.when(same, F.col("n_docs"))), F.lit(0)).alias("n_same"),
        )
    )


def category_words(corpus: DataFrame) -> DataFrame:
    """(category, word, heat, hottest, next_heat): the word's two hottest documents in a category."""
    heat = F.round(hot_score(), 6)
    docs = corpus.filter(nonempty("title") & nonempty("category")).select(
        "category", F.col("title").alias("word"), "doc_id", heat.alias("h")
    )
    two = top_k(docs, ["category", "word"], [F.desc("h"), F.asc("doc_id")], 2, "doc_id", "_r")
    return two.groupBy("category", "word").agg(
        F.max(F.when(F.col("_r") == 1, F.col("h"))).alias("heat"),
        F.max(F.when(F.col("_r") == 1, F.col("doc_id"))).alias("hottest"),
        F.max(F.when(F.col("_r") == 2, F.col("h"))).alias("next_heat"),
    )


def _own_overlap() -> Column:
    """The word's overlap seen from a source: its own document does not count."""
    alone = (F.col("word") == F.col("src_title")) & (F.col("n_same") <= 1)
    return F.when(alone, F.col("other_overlap")).otherwise(F.col("overlap"))


def _own_heat() -> Column:
    return F.when(F.col("hottest") == F.col("doc_id"), F.col("next_heat")).otherwise(F.col("heat"))


def _tag_channel(src: DataFrame, set_words: DataFrame, limit: int | None) -> DataFrame:
    table = set_words
    if limit is not None:
        table = top_k(set_words, ["tag_set"], [F.desc("overlap"), F.asc("word")], limit + 1, "word", "_r").drop("_r")
    rows = src.join(table, "tag_set").withColumn("tag_overlap", _own_overlap()).filter(F.col("tag_overlap").isNotNull())
    out = rows.select("source_id", "word", "tag_overlap")
    if limit is not None:
        out = top_k(out, ["source_id"], [F.desc("tag_overlap"), F.asc("word")], limit, "word")
    return out


def _category_channel(src: DataFrame, cat_words: DataFrame, limit: int | None) -> DataFrame:
    table = cat_words
    if limit is not None:
        table = top_k(cat_words, ["category"], [F.desc("heat"), F.asc("word")], limit + 1, "word", "_r").drop("_r")
    rows = src.join(table, F.col("src_category") == F.col("category")).withColumn("category_heat", _own_heat())
    out = rows.filter(F.col("category_heat").isNotNull()).select("source_id", "word", "category_heat")
    if limit is not None:
        out = top_k(out, ["source_id"], [F.desc("category_heat"), F.asc("word")], limit, "word")
    return out


def hint_tags(sources: DataFrame, corpus: DataFrame, min_jaccard: float = 0.1, limit: int | None = None) -> DataFrame:
    """(source_id, word, tag_overlap): titles of other documents whose tags overlap enough.

    With ``limit`` the exact best words per source are taken per tag set before they meet the sources.
    """
    src = _described(sources, corpus)
    out = _tag_channel(src, tag_set_words(src, corpus, min_jaccard), limit)
    return out.select("source_id", "word", "tag_overlap", F.col("tag_overlap").alias("recall_score"))


def hint_category(sources: DataFrame, corpus: DataFrame, limit: int | None = None) -> DataFrame:
    """(source_id, word, category_heat, recall_score): hottest titles of the source's category."""
    out = _category_channel(_described(sources, corpus), category_words(corpus), limit)
    return out.select("source_id", "word", "category_heat", (F.col("category_heat") * 0.1).alias("recall_score"))


def hint_cooccur(sources: DataFrame, cooccur: DataFrame, corpus: DataFrame, limit: int = 20) -> DataFrame:
    """(source_id, word, cooccur_score, recall_score): titles clicked next to the source."""
    near = top_cooccur(cooccur, limit).select(F.col("src").alias("doc_id"), F.col("dst"), "co_count")
    titles = corpus.filter(nonempty("title")).select(F.col("doc_id").alias("dst"), F.col("title").alias("word"))
    # Titles are looked up once per edge, before the edges are copied to the sources.
    worded = near.join(titles, "dst").groupBy("doc_id", "word").agg(F.max("co_count").alias("n"))
    score = F.log1p(F.col("n").cast("double"))
    return sources.select("source_id", "doc_id").join(worded, "doc_id").select(
        "source_id", "word", score.alias("cooccur_score"), (score * 0.5).alias("recall_score")
    )


def hint_queries(sources: DataFrame, query_stats: DataFrame, prefix_len: int = 6, limit: int = 15) -> DataFrame:
    """(source_id, word, recall_score): frequent logged queries starting like the source's query."""
    asked = sources.select("source_id", "query", byte_prefix("query", prefix_len).alias("p")).filter(nonempty("query"))
    keyed = (
        query_stats.filter(nonempty("query"))
        .select(F.col("query").alias("word"), "freq", byte_prefix("query", prefix_len).alias("head"))
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.length("head"))))
        .withColumn("p", F.substring(F.col("head"), F.lit(1), F.col("n")))
    )
    best = top_k(keyed.drop("n", "head"), ["p"], [F.desc("freq"), F.asc("word")], limit, "word")
    return (
        asked.join(best, "p")
        .filter(F.col("word") != F.col("query"))
        .select("source_id", "word", (F.log1p(F.col("freq").cast("double")) * 0.05).alias("recall_score"))
    )


@dataclass(frozen=True)
class HintTables:
    """Lookup tables shared by all rounds of :func:`hints`."""

    set_words: DataFrame
    cat_words: DataFrame
    cooccur: DataFrame | None
    query_words: DataFrame | None


def _score() -> Column:
    tag, heat, co = F.col("tag_overlap"), F.col("category_heat"), F.col("cooccur_score")
    return F.round(
        F.when(tag.isNotNull(), tag * RECALL_W + tag * TAG_W)
        .when(heat.isNotNull(), heat * 0.1 * RECALL_W + heat * CATEGORY_W)
        .when(co.isNotNull(), co * 0.5 * RECALL_W + co * COOCCUR_W)
        .otherwise(F.col("query_score") * RECALL_W),
        6,
    )


def _ranked(src: DataFrame, tables: HintTables, limit: int) -> tuple[DataFrame, DataFrame]:
    """Scored words per source, and (source_id, bound) where a channel was cut: the words of such a
    source are complete up to its bound, and only those are returned."""
    tags = _tag_channel(src, tables.set_words, limit)
    cats = _category_channel(src, tables.cat_words, limit)
    tag_key_ = F.struct((-F.round(F.col("tag_overlap") * (RECALL_W + TAG_W), 6)).alias("neg"), "word")
    cat_key_ = F.struct((-F.round(F.col("category_heat") * (0.1 * RECALL_W + CATEGORY_W), 6)).alias("neg"), "word")
    last = (
        tags.filter(F.col("rank") == limit)
        .select("source_id", tag_key_.alias("k"))
        .unionByName(cats.filter(F.col("rank") == limit).select("source_id", cat_key_.alias("k")))
        .groupBy("source_id")
        .agg(F.min("k").alias("bound"))
    )
    words = tags.select("source_id", "word").unionByName(cats.select("source_id", "word"))
    extra = []
    if tables.cooccur is not None:
        extra.append(tables.cooccur.select("source_id", "word", "cooccur_score", F.lit(None).cast("double").alias("query_score")))
    if tables.query_words is not None:
        extra.append(tables.query_words.select("source_id", "word", F.lit(None).cast("double").alias("cooccur_score"), F.col("recall_score").alias("query_score")))
    blank = F.lit(None).cast("double")
    rows = words.withColumn("cooccur_score", blank).withColumn("query_score", blank)
    for part in extra:
        rows = rows.unionByName(part)
    merged = rows.groupBy("source_id", "word").agg(
        F.max("cooccur_score").alias("cooccur_score"), F.max("query_score").alias("query_score")
    )
    # Every word is looked up in the complete tag and category tables: the first channel wins even
    # where that channel's own list was cut before the word.
    full = (
        merged.join(src, "source_id")
        .join(tables.set_words, ["tag_set", "word"], "left")
        .join(tables.cat_words.withColumnRenamed("category", "src_category"), ["src_category", "word"], "left")
        .withColumn("tag_overlap", _own_overlap())
        .withColumn("category_heat", _own_heat())
    )
    found = F.coalesce("tag_overlap", "category_heat", "cooccur_score", "query_score").isNotNull()
    asked = F.coalesce(F.col("query"), F.lit("")) if "query" in src.columns else F.lit("")
    channel = (
        F.when(F.col("tag_overlap").isNotNull(), CHANNELS[TAG])
        .when(F.col("category_heat").isNotNull(), CHANNELS[CATEGORY])
        .when(F.col("cooccur_score").isNotNull(), CHANNELS[COOCCUR])
        .otherwise(CHANNELS[QUERY])
    )
    scored = (
        full.filter(found & (F.col("word") != asked) & F.char_length("word").between(MIN_LEN, MAX_LEN))
        .withColumn("score", _score())
        .select("source_id", "word", channel.alias("source"), "score", F.struct((-F.col("score")).alias("neg"), "word").alias("k"))
    )
    inside = F.col("bound").isNull() | (F.col("k") <= F.col("bound"))
    return scored.join(last, "source_id", "left").filter(inside), last


def hints(
    sources: DataFrame,
    corpus: DataFrame,
    cooccur: DataFrame | None = None,
    query_stats: DataFrame | None = None,
    page_size: int = 10,
    dedup_distance: int = 3,
    blocked: DataFrame | None = None,
    min_jaccard: float = 0.1,
    first_limit: int = 100,
) -> DataFrame:
    """Ranked hints per source: (source_id, position, word, source, score).

    Works on the best ``first_limit`` words of the tag and category channels. Where edit-distance
    dedup uses them up before the page is full and more exist, those sources alone are redone with
    eight times as many, so the result never depends on the starting limit.
    """
    src = cut_lineage(_described(sources, corpus))
    tables = HintTables(
        cut_lineage(tag_set_words(src, corpus, min_jaccard)),
        cut_lineage(category_words(corpus)),
        None if cooccur is None else hint_cooccur(sources, cooccur, corpus),
        None if query_stats is None or "query" not in sources.columns else hint_queries(sources, query_stats),
    )
    limit, pending, done = first_limit, src, None
    while True:
        rows, last = _ranked(pending, tables, limit)
        item = F.struct((-F.col("score")).alias("neg"), "word", "source", byte_view("word").alias("bytes"))
        lists = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
        empty = F.array().cast(lists.schema["items"].dataType)
        if dedup_distance > 0:
            kept = keep_distinct_words(F.coalesce("items", empty), empty, dedup_distance, page_size)
        else:
            kept = F.slice(F.coalesce("items", empty), 1, page_size)
        full = F.size("kept") == page_size
        lists = cut_lineage(
            pending.select("source_id")
            .join(lists, "source_id", "left")
            .join(last, "source_id", "left")
            .select("source_id", kept.alias("kept"), F.col("bound").isNotNull().alias("cut"))
            .withColumn("ended", ~F.col("cut") | full)
        )
        ended = lists.filter("ended").select("source_id", "kept")
        done = ended if done is None else done.unionByName(ended)
        short = lists.filter(~F.col("ended")).select("source_id")
        if short.isEmpty():
            break
        pending, limit = pending.join(short, "source_id", "left_semi"), limit * 8
    out = done.select("source_id", F.posexplode("kept").alias("pos", "i")).select(
        "source_id", (F.col("pos") + 1).alias("position"), "i.word", "i.source", (-F.col("i.neg")).alias("score")
    )
    if blocked is not None:
        out = out.join(blocked.select("word").distinct(), "word", "left_anti")
    return out

"""Duplicates in a whole corpus: exact ones by fingerprint, near ones by the characters of their titles.

Titles are first reduced to their distinct character sets, each with its documents' smallest id, so copies of a title
are never compared. Two sets of at most ``m`` characters whose Jaccard reaches the threshold differ in at most
d = 2m(1 - t)/(1 + t) characters; dealt by hash into d + 1 parts, they agree in one part at least. Pairs meet only
there, and the comparison is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import jaccard, title_chars
from lodestone.operators.experiments import fingerprint
from lodestone.session import checkpoint_dir, cut_lineage

_SEP = "\x1f"


def remove_exact_duplicates(df: DataFrame, cols: list[str], key: str = "doc_id") -> DataFrame:
    """The row of the smallest ``key`` among those equal in ``cols``; ties of the key all stay.

    Only keys and digests are shuffled; a very common content is combined before the shuffle.
    """
    marked = fingerprint(df.select(key, *[c for c in cols if c != key]), cols).select(key, "md5", "sha1")
    firsts = marked.groupBy("md5", "sha1").agg(F.min(key).alias(key)).select(key)
    return df.join(firsts.distinct(), key, "left_semi")


def title_sets(corpus: DataFrame) -> DataFrame:
    """(set_id, chars, n_docs): every distinct character set of a title, named by its smallest document."""
    chars = F.array_sort(title_chars("title"))
    keyed = corpus.select("doc_id", F.array_join(chars, _SEP).alias("_key")).filter(F.col("_key") != "")
    return keyed.groupBy("_key").agg(F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("n_docs")).select(
        "set_id", F.split("_key", _SEP).alias("chars"), "n_docs"
    )


def similar_sets(sets: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(first_id, second_id, similarity) of all pairs of sets (set_id, chars) at or above the threshold, each once."""
    slack = 1e-9
    n = F.size("chars")

    def parts(m: Column) -> Column:
        return (F.floor(2 * m * (1 - threshold) / (1 + threshold) + slack) + 1).cast("int")

    def signatures(m: Column) -> Column:
        """One key per part: the larger set's size, the part and the characters in it."""

        def key(p: Column) -> Column:
            inside = F.filter("chars", lambda c: F.pmod(F.hash(c), parts(m)) == p)
            return F.xxhash64(m, p, F.array_join(inside, _SEP))

        return F.transform(F.sequence(F.lit(0), parts(m) - 1), key)

    # A set meets larger ones under each size they can have, and offers itself under its own.
    sizes = F.sequence(n, F.floor(n / threshold + slack).cast("int"))
    small = sets.select(
        F.col("set_id").alias("_s"), F.col("chars").alias("_x"), F.explode(F.flatten(F.transform(sizes, signatures))).alias("_k")
    )
    large = sets.select(F.col("set_id").alias("_l"), F.col("chars").alias("_y"), F.explode(signatures(n)).alias("_k"))
    fits = (F.size("_x") < F.size("_y")) | ((F.size("_x") == F.size("_y")) & (F.col("_s") < F.col("_l")))
    return (
        small.join(large, "_k")
        .filter(fits & (F.size("_x") >= F.size("_y") * (threshold - slack)))
        .withColumn("similarity", jaccard(F.col("_x"), F.col("_y")))
        .filter(F.col("similarity") >= threshold)
        .select(F.least("_s", "_l").alias("first_id"), F.greatest("_s", "_l").alias("second_id"), "similarity")
        .distinct()
    )


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node it is connected with.

    Rounds of hash-to-min: every node tells its smallest neighbour to all its neighbours, and its neighbours to the
    smallest; the table of edges is written each round and paths halve.
    """
    checkpoint_dir(links.sparkSession)
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        told = both.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = cut_lineage(told.unionByName(low.select("u", F.col("m").alias("v")).filter("u > v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicate_groups(corpus: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(doc_id, group_id): the smallest document connected by similar titles; a document without title characters is its own."""
    sets = cut_lineage(title_sets(corpus))
    pairs = similar_sets(sets, threshold)
    roots = smallest_reachable(pairs.select(F.col("first_id").alias("a"), F.col("second_id").alias("b")))
    named = sets.join(roots, F.col("set_id") == F.col("node"), "left").select(
        F.array_join("chars", _SEP).alias("_key"), F.coalesce("root", "set_id").alias("_group")
    )
    keyed = corpus.select("doc_id", F.array_join(F.array_sort(title_chars("title")), _SEP).alias("_key"))
    return keyed.join(named, "_key", "left").select("doc_id", F.coalesce("_group", "doc_id").alias("group_id"))


def remove_near_duplicates(corpus: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One document of each group of similar titles: the one of the smallest id."""
    groups = near_duplicate_groups(corpus, threshold)
    return corpus.join(groups.filter("doc_id = group_id").select("doc_id").distinct(), "doc_id", "left_semi")

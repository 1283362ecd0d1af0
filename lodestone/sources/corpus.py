"""Corpus tables: load, look up, upsert, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.text import nonempty


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill absent fields with their type's default and measure the content in bytes."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("doc_id", "title", "content", "author", "category")}
    whole = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("publish_time", "click_count", "like_count")}
    return df.withColumns(
        {
            **text,
            **whole,
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "quality_score": F.coalesce("quality_score", F.lit(0.0)),
        }
    ).withColumn("content_length", F.octet_length("content").cast("int"))


def read_corpus_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents from JSON: arrays of objects, or one object per line (splittable) without multi_line."""
    raw = spark.read.schema(schemas.CORPUS).option("multiLine", multi_line).json(path)
    return with_defaults(raw)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").parquet(path)


def corpus_lookup(corpus: DataFrame, ids: DataFrame | list) -> DataFrame:
    """Documents by id. A list becomes a pushed-down filter, a table a semi join."""
    if isinstance(ids, DataFrame):
        return corpus.join(ids.select("doc_id"), "doc_id", "left_semi")
    return corpus.filter(F.col("doc_id").isin(ids))


def tags_to_csv(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.concat_ws(",", "tags"))


def csv_to_tags(df: DataFrame) -> DataFrame:
    parts = F.split(F.coalesce("tags", F.lit("")), ",")
    return df.withColumn("tags", F.filter(parts, lambda t: t != ""))


def upsert_corpus(corpus: DataFrame, changes: DataFrame, version_col: str = "version") -> DataFrame:
    """Replace documents by id and add new ones; the highest version of an id wins.

    Changes without an id are ignored and an absent quality becomes 0.5. Unchanged documents are
    only filtered by an anti join on the changed ids; their rows are never grouped.
    """
    columns = [c for c in corpus.columns if c != version_col]
    valid = changes.filter(nonempty(F.col("doc_id").cast("string"))).withColumn(
        "quality_score", F.coalesce("quality_score", F.lit(0.5))
    )
    payload = F.struct(*[c for c in columns if c != "doc_id"])
    newest = (
        valid.groupBy("doc_id")
        .agg(F.max_by(payload, F.col(version_col)).alias("_row"))
        .select("doc_id", "_row.*")
        .select(columns)
    )
    kept = corpus.select(columns).join(newest.select("doc_id"), "doc_id", "left_anti")
    return kept.select(columns).unionByName(newest)


def delete_docs(
    corpus: DataFrame, postings: DataFrame, vectors: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove documents with their postings and vectors; unknown ids have no effect."""
    gone = ids.select("doc_id").distinct()
    return (
        corpus.join(gone, "doc_id", "left_anti"),
        postings.join(gone, "doc_id", "left_anti"),
        vectors.join(gone, "doc_id", "left_anti"),
    )

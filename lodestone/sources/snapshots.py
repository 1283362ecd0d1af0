"""Versioned snapshots of the text index, of vectors and of what they were made from.

Every write goes to a new version folder; a row appended to ``manifest`` after the data is complete
makes the version visible, so readers switch at once, readers of an older version go on undisturbed, and a lost
executor leaves nothing half-written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import vector_index
from lodestone.operators.index import TextIndex, build_index, term_bucket, term_stats

MANIFEST = "version long, built_at long, docs long, buckets int"

#: Documents per term bucket; a stored index has a power of two of buckets, from MIN_BUCKETS to MAX_BUCKETS.
BUCKET_DOCS, MIN_BUCKETS, MAX_BUCKETS = 100_000, 16, 4096
#: Documents whose postings of one bucket share a file; a term in more documents is spread over several files.
FILE_DOCS = 2_000_000


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if fs.exists(hadoop) else None


def current_version(spark: SparkSession, path: str) -> int | None:
    table = _manifest(spark, path)
    return None if table is None else table.agg(F.max("version")).first()[0]


def _published(spark: SparkSession, path: str, version: int | None):
    """The manifest row of a version, by default of the newest."""
    table = _manifest(spark, path)
    if table is None:
        raise FileNotFoundError(f"no snapshot under {path}")
    rows = table if version is None else table.filter(F.col("version") == version)
    row = rows.orderBy(F.desc("version")).first()
    if row is None:
        raise FileNotFoundError(f"no version {version} under {path}")
    return row


def _publish(spark: SparkSession, path: str, version: int, built_at: int, docs: int, buckets: int | None) -> None:
    row = spark.createDataFrame([(version, built_at, docs, buckets)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def bucket_count(n_docs: int) -> int:
    wanted = max(1, -(-n_docs // BUCKET_DOCS))
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (wanted - 1).bit_length()))


def write_index(
    index: TextIndex,
    path: str,
    built_at: int = 0,
    corpus: DataFrame | None = None,
    vectors: DataFrame | None = None,
    dim: int | None = None,
) -> int:
    """Write a new version and publish it, with the documents' fingerprints and vectors where they are given.

    Postings are partitioned by term bucket in one hash exchange; within a bucket they are dealt out by document,
    so a frequent term is spread over several files, and sorted by term.
    """
    spark = index.postings.sparkSession
    version = (current_version(spark, path) or 0) + 1
    base = f"{path}/v={version}"
    index.stats.write.mode("overwrite").parquet(f"{base}/stats")
    stats = spark.read.parquet(f"{base}/stats")
    n_docs = stats.first()["n_docs"]
    buckets = bucket_count(n_docs)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(-(-n_docs // FILE_DOCS) or 1))
    columns = [c for c in index.postings.columns if c != "bucket"]
    (
        index.postings.select(*columns, term_bucket("term", buckets).alias("bucket"))
        .repartition("bucket", part)
        .sortWithinPartitions("bucket", "term", "doc_id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{base}/postings")
    )
    terms = term_stats(spark.read.parquet(f"{base}/postings"), stats)
    terms.withColumn("bucket", term_bucket("term", buckets)).write.mode("overwrite").parquet(f"{base}/terms")
    if corpus is not None:
        fingerprints(corpus).write.mode("overwrite").parquet(f"{base}/documents")
    if vectors is not None:
        checked_vectors(vectors, dim).write.mode("overwrite").parquet(f"{base}/vectors")
    _publish(spark, path, version, built_at, n_docs, buckets)
    return version


def read_index(spark: SparkSession, path: str, version: int | None = None) -> TextIndex:
    row = _published(spark, path, version)
    base = f"{path}/v={row['version']}"
    return TextIndex(
        spark.read.parquet(f"{base}/postings"),
        spark.read.parquet(f"{base}/terms"),
        spark.read.parquet(f"{base}/stats"),
        row["buckets"],
    )


# ---------------------------------------------------------------- changes


def content_hash(corpus: DataFrame) -> Column:
    """A 64-bit hash of everything the index is made from; nulls and empty values differ."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("title", "content", "category", "content_length") if c in corpus.columns]
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "\x1f", "\x00")
    return F.xxhash64(*parts, tags)


def fingerprints(corpus: DataFrame) -> DataFrame:
    """(doc_id, content_hash) of every document."""
    return corpus.select("doc_id", content_hash(corpus).alias("content_hash"))


def changed_documents(corpus: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """(doc_id, change) of the documents inserted, edited or deleted since a version; one join of hashes."""
    spark = corpus.sparkSession
    base = f"{path}/v={_published(spark, path, version)['version']}"
    old = spark.read.parquet(f"{base}/documents").withColumnRenamed("content_hash", "_old")
    both = fingerprints(corpus).join(old, "doc_id", "full")
    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("content_hash").isNull(), "delete")
        .when(F.col("content_hash") != F.col("_old"), "edit")
    )
    return both.select("doc_id", change.alias("change")).filter("change IS NOT NULL")


def rebuild_index(
    corpus: DataFrame,
    path: str,
    as_of: int,
    changed_col: str | None = "publish_time",
    min_doc_changes: int = 10,
    vectors: DataFrame | None = None,
    dim: int | None = None,
) -> int | None:
    """Full rebuild into a new version when enough documents changed since the last one.

    A document counts as changed if it was inserted, edited or deleted, or if ``changed_col`` is later than the last
    build. Vectors, where given, are published with the same manifest row.
    """
    spark = corpus.sparkSession
    if _manifest(spark, path) is not None:
        changed = changed_documents(corpus, path).select("doc_id")
        if changed_col is not None:
            since = _published(spark, path, None)["built_at"]
            changed = changed.unionByName(corpus.filter(F.col(changed_col) > since).select("doc_id"))
        if changed.distinct().limit(min_doc_changes).count() < min_doc_changes:
            return None
    return write_index(build_index(corpus), path, as_of, corpus, vectors, dim)


# ---------------------------------------------------------------- vectors


def write_vectors(vectors: DataFrame, path: str, dim: int, built_at: int = 0) -> int:
    """Write a new version of a vector table of its own and publish it."""
    spark = vectors.sparkSession
    version = (current_version(spark, path) or 0) + 1
    base = f"{path}/v={version}/vectors"
    checked_vectors(vectors, dim).write.mode("overwrite").parquet(base)
    _publish(spark, path, version, built_at, spark.read.parquet(base).count(), None)
    return version


def read_vectors(spark: SparkSession, path: str, dim: int, version: int | None = None) -> DataFrame:
    """The vectors of a version, of an index snapshot or of a table of their own."""
    row = _published(spark, path, version)
    return checked_vectors(spark.read.parquet(f"{path}/v={row['version']}/vectors"), dim)


def write_vector_index(
    vectors: DataFrame, path: str, dim: int, n_cells: int | None = None, subspaces: int = 8, built_at: int = 0
) -> int:
    """Fit cells and codebooks, write all vectors by cell, and publish them as a new version."""
    spark = vectors.sparkSession
    version = (current_version(spark, path) or 0) + 1
    base = f"{path}/v={version}"
    centres, codebooks, n_probe = vector_index.fit(vectors, n_cells, subspaces)
    rows = vector_index.encode(checked_vectors(vectors, dim), centres, codebooks)
    # A cell's rows are dealt out by id among four files.
    (
        rows.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
        .sortWithinPartitions("cell", "doc_id")
        .write.mode("overwrite")
        .partitionBy("cell")
        .parquet(f"{base}/cells")
    )
    parts = [("centre", 0, i, c.tolist()) for i, c in enumerate(centres)]
    parts += [("code", m, i, c.tolist()) for m, book in enumerate(codebooks) for i, c in enumerate(book)]
    parts += [("probes", 0, n_probe, [])]
    model = spark.createDataFrame(parts, "kind string, part int, pos int, vector array<double>")
    model.coalesce(1).write.mode("overwrite").parquet(f"{base}/codebook")
    _publish(spark, path, version, built_at, spark.read.parquet(f"{base}/cells").count(), None)
    return version


def read_vector_index(spark: SparkSession, path: str, version: int | None = None) -> vector_index.VectorCells:
    base = f"{path}/v={_published(spark, path, version)['version']}"
    parts: dict[tuple, list] = {}
    for r in spark.read.parquet(f"{base}/codebook").orderBy("kind", "part", "pos").collect():  # bounded by the codes
        parts.setdefault((r["kind"], r["part"]), []).append(r["pos"] if r["kind"] == "probes" else r["vector"])
    books = [np.array(parts[key]) for key in sorted(parts) if key[0] == "code"]
    (n_probe,) = parts["probes", 0]
    return vector_index.VectorCells(np.array(parts["centre", 0]), np.stack(books), n_probe, spark.read.parquet(f"{base}/cells"))


def checked_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Fail the job on a row whose vector does not have ``dim`` components."""
    bad = F.size("embedding") != dim
    guard = F.when(bad, F.raise_error(F.concat(F.lit(f"vector is not of size {dim}: "), F.col("doc_id"))).cast("array<double>"))
    return vectors.withColumn("embedding", F.when(bad, guard).otherwise(F.col("embedding").cast("array<double>")))

"""Tables kept current by foreachBatch: one delta folder per batch, folded into a base now and then.

A delta folder is named after its batch id and overwritten when the batch is replayed, and reading
the state for a batch looks only at older batches, so replays change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame], DataFrame]


def finished(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete ``prefix=<n>`` folders under a path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    mine = [n for n in names if n.startswith(f"{prefix}=")]
    return sorted(int(n.split("=")[1]) for n in mine if fs.exists(hadoop(f"{path}/{n}/_SUCCESS")))


class DeltaTable:
    """``merge`` folds the union of base and delta rows (which carry a ``batch`` column)."""

    def __init__(self, spark: SparkSession, path: str, merge: Merge, compact_every: int = 20) -> None:
        self.spark, self.path, self.merge, self.compact_every = spark, path, merge, compact_every

    def rows(self, before: int | None = None) -> DataFrame | None:
        """Base and delta rows of batches below ``before``, unmerged, with their ``batch``."""
        limit = before if before is not None else 1 << 62
        bases = [v for v in finished(self.spark, f"{self.path}/base", "batch") if v < limit]
        start = max(bases, default=-1)
        folders = [f"{self.path}/base/batch={start}"] if bases else []
        deltas = finished(self.spark, f"{self.path}/delta", "batch")
        folders += [f"{self.path}/delta/batch={b}" for b in deltas if start < b < limit]
        return self.spark.read.parquet(*folders) if folders else None

    def read(self, before: int | None = None) -> DataFrame | None:
        rows = self.rows(before)
        return None if rows is None else self.merge(rows)

    def write(self, batch_id: int, delta: DataFrame) -> None:
        delta.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{self.path}/delta/batch={batch_id}"
        )
        if batch_id > 0 and batch_id % self.compact_every == 0:
            merged = self.merge(self.rows(batch_id + 1)).withColumn("batch", F.lit(batch_id).cast("long"))
            merged.write.mode("overwrite").parquet(f"{self.path}/base/batch={batch_id}")


def newest_rows(keys: list[str]) -> Merge:
    """Merge rule: the row of the latest batch per key."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
        return newest.select(*keys, "_r.*")

    return merge

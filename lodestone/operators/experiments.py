"""Experiment assignment, parameter resolution and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.hashing import djb2
from lodestone.functions.text import nonempty

BUCKETS = 100


def bucket(uid: Column | str) -> Column:
    return F.pmod(djb2(uid), F.lit(BUCKETS)).cast("int")


def bucket_table(experiments: DataFrame) -> DataFrame:
    """(bucket, name, params): the experiment that owns each of the 100 buckets; at most 100 rows.

    Traffic shares add up in experiment order; buckets beyond the total belong to none.
    """
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    end = F.floor(F.round(F.sum("traffic_ratio").over(upto) * BUCKETS, 6)).cast("int")
    ends = experiments.withColumn("_end", F.least(F.lit(BUCKETS), end))
    start = F.coalesce(F.lag("_end").over(Window.orderBy("ord")), F.lit(0))
    ranged = ends.withColumn("_start", start).filter(F.col("_end") > F.col("_start"))
    return ranged.select(F.explode(F.sequence("_start", F.col("_end") - 1)).alias("bucket"), "name", "params")


def assign_experiments(users: DataFrame, experiments: DataFrame) -> DataFrame:
    """(uid, bucket, experiment): null for the control group and for an empty uid.

    The cumulative ranges become a bucket table of at most 100 rows, so assignment is an equi-join
    that can always be broadcast.
    """
    owned = F.broadcast(bucket_table(experiments).select("bucket", F.col("name").alias("experiment")))
    keyed = users.withColumn("bucket", F.when(nonempty("uid"), bucket("uid")))
    return keyed.join(owned, "bucket", "left").select("uid", "bucket", "experiment")


def resolve_params(users: DataFrame, experiments: DataFrame, defaults: DataFrame) -> DataFrame:
    """(uid, key, value): the experiment's value where it sets the key, else the default.

    Values are resolved per bucket first, at most 101 × keys rows, then attached to users.
    """
    params = bucket_table(experiments)
    all_buckets = defaults.sparkSession.range(-1, BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    keyed = defaults.agg(F.collect_list(F.struct("key", "value"))).scalar()
    per_bucket = (
        all_buckets.join(params, "bucket", "left")
        .select("bucket", "params", F.explode(keyed).alias("d"))
        .select(
            "bucket",
            F.col("d.key").alias("key"),
            F.coalesce(F.try_element_at("params", F.col("d.key")), F.col("d.value")).alias("value"),
        )
    )
    packed = per_bucket.groupBy("bucket").agg(F.collect_list(F.struct("key", "value")).alias("kv"))
    mine = users.select("uid", F.when(nonempty("uid"), bucket("uid")).otherwise(F.lit(-1)).alias("bucket"))
    return (
        mine.join(F.broadcast(packed), "bucket")
        .select("uid", F.explode("kv").alias("kv"))
        .select("uid", "kv.key", "kv.value")
    )


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``md5`` and ``sha1`` of the columns joined by a unit separator (nulls as empty text)."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return df.withColumn("md5", F.md5(text)).withColumn("sha1", F.sha1(text))

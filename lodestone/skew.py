"""Top-k, ordered slices and joins that stay spread out when one key holds much of the data.

``SHARE`` fixes what counts as a hot key: more than 1/SHARE of all rows (and at least ``min_rows``).
There can be at most SHARE such keys, so tables of hot keys are broadcast with a proven bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE = 1000
MIN_HOT_ROWS = 1_000_000
PRUNED_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold default


def top_k(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    tie: str,
    rank_col: str = "rank",
    own: str | None = None,
) -> DataFrame:
    """First ``k`` rows of every group, ranked from 1.

    ``own`` names a column with a smaller limit of the row's group; null means ``k``. The common limit prunes before
    the shuffle, the group's own at the ranking.

    Up to 1000 rows per group the optimizer keeps only k rows per map task before the shuffle. For
    a larger k the same is done explicitly: rank inside 64 hashed parts of each group, then merge.
    """
    if k > PRUNED_LIMIT:
        part = F.pmod(F.xxhash64(tie), F.lit(64)).cast("int")
        inner = Window.partitionBy(*by, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_rn", F.row_number().over(inner))
            .filter(F.col("_rn") <= k)
            .drop("_part", "_rn")
        )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = df.withColumn(rank_col, rank).filter(F.col(rank_col) <= k)
    return ranked if own is None else ranked.filter(F.col(own).isNull() | (F.col(rank_col) <= F.col(own)))


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Keys of a (keys, n) count table holding more than 1/SHARE of all rows: < SHARE rows."""
    limit = counts.agg(
        F.greatest(F.lit(float(min_rows)), F.sum(n) / F.lit(float(SHARE))).alias("limit")
    ).scalar()
    return counts.filter(F.col(n) > limit).select(*keys, n)


def salted_join(
    fact: DataFrame,
    other: DataFrame,
    key: str,
    hot: DataFrame,
    spread_on: Sequence[str],
    salts: int = 64,
    how: str = "inner",
) -> DataFrame:
    """Equi-join where rows of hot keys in ``fact`` are spread over ``salts`` tasks.

    ``hot`` comes from :func:`hot_keys`. Rows of ``other`` are copied once per salt for hot keys
    only; all other rows join on the plain key.
    """
    flags = F.broadcast(hot.select(F.col(key).alias("_hk")).withColumn("_hot", F.lit(True)))
    left = (
        fact.join(flags, F.col(key) == F.col("_hk"), "left")
        .withColumn(
            "_salt",
            F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_on), F.lit(salts)).cast("int")).otherwise(0),
        )
        .drop("_hk", "_hot")
    )
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    right = (
        other.join(flags, F.col(key) == F.col("_hk"), "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))))
        .drop("_hk", "_hot")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def time_slices(
    df: DataFrame, key: str, at: str, min_rows: int = MIN_HOT_ROWS, slices: int = 64
) -> DataFrame:
    """Add ``_slice``: 0 for ordinary keys; hot keys are cut into ordered slices of their ``at`` values.

    Rows with equal ``at`` share a slice, and slices follow the order of ``at``, so ordered work can
    run per (key, slice) and be stitched afterwards over one row per slice.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, [key], "_n", min_rows).select(F.col(key).alias("_hk"))
    probs = [i / slices for i in range(1, slices)]
    cuts = (
        df.join(F.broadcast(hot), F.col(key) == F.col("_hk"))
        .groupBy("_hk")
        .agg(F.array_distinct(F.percentile_approx(F.col(at), probs, 1000)).alias("_cuts"))
    )
    return (
        df.join(F.broadcast(cuts), F.col(key) == F.col("_hk"), "left")
        .withColumn(
            "_slice",
            F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(at))), F.lit(0)),
        )
        .withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_slice")))
        .drop("_hk", "_cuts")
    )


def previous_value(
    df: DataFrame, key: str, at: str, order: Sequence[str], value: str, out: str, min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """``lag(value)`` over ``key`` ordered by (at, *order), exact for keys of any size."""
    sliced = time_slices(df, key, at, min_rows)
    full = [at, *order]
    inside = Window.partitionBy(key, "_slice").orderBy(*full)
    last = sliced.groupBy(key, "_slice").agg(F.max_by(value, F.struct(*full)).alias("_last"))
    across = Window.partitionBy(key).orderBy("_slice")
    carry = last.select(
        key, "_slice", F.lag("_last").over(across).alias("_carry")
    ).filter(F.col("_carry").isNotNull())
    rows = sliced.withColumn("_first", F.row_number().over(inside) == 1).withColumn(
        "_lag", F.lag(value).over(inside)
    )
    return (
        rows.join(carry, [key, "_slice"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_slice", "_first", "_lag", "_carry")
    )


def position_from_end(
    df: DataFrame, key: str, at: str, order: Sequence[str], out: str, min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """0 for the newest row of each key, 1 for the one before, ...; exact for keys of any size."""
    sliced = time_slices(df, key, at, min_rows)
    full = [F.col(c).desc() for c in (at, *order)]
    sizes = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(key).orderBy(F.col("_slice").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offset = sizes.select(key, "_slice", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(key, "_slice").orderBy(*full)
    return (
        sliced.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offset, [key, "_slice"])
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_slice", "_rn", "_off")
    )

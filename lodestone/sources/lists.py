"""Line files: term dictionaries and blacklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_term_dict(spark: SparkSession, path: str, stage: int) -> DataFrame:
    """``term<TAB>a,b,c`` lines as (stage, term, ord, expansion); lines without a tab are skipped.

    A term on several lines keeps the list of the last line of its file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")
    )
    tab = F.instr("value", "\t")
    rows = lines.filter(tab > 0).select(
        F.substring_index("value", "\t", 1).alias("term"),
        F.expr("substring(value, instr(value, '\\t') + 1)").alias("list"),
        F.struct("file", "line").alias("at"),
    )
    last = rows.groupBy("term").agg(F.max_by("list", "at").alias("list"))
    return last.select(
        F.lit(stage).alias("stage"),
        "term",
        F.posexplode(F.filter(F.split("list", ","), lambda x: x != "")).alias("ord", "expansion"),
    )


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line; blank lines and lines starting with # are skipped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\r\t]", "")).alias("entry"))
    return lines.filter((F.col("entry") != "") & ~F.col("entry").startswith("#")).distinct()

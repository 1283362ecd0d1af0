"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import checkpoint_dir

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: lineage ends, nothing is recomputed.

    Nothing reads the shuffles of the write again, so Spark removes their files at its end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes what ``stored`` wrote for these tables, or tables read from it alone, when nothing reads it again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def spaced(text: Column) -> Column:
    """The text with every separator turned into a space; literal replacement, no regular expression."""
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order."""
    return F.array_remove(F.split(spaced(text), " "), "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among the single-byte ``chars``."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable can't be inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


class RecentCache:
    """A bounded look-up: when the young half is full, it becomes the old half and what the old half held goes.

    What is asked for stays; what was used once goes after a while.
    """

    def __init__(self, size: int):
        self.half = max(1, size // 2)
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """The unknown ones of ``keys``; all others are in ``young`` until the next call."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        lost = keys.difference(self.young)
        found = {k: self.old[k] for k in lost.intersection(self.old)}
        self.young.update(found)
        return list(lost.difference(found))

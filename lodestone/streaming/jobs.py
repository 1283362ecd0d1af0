"""Structured Streaming counterparts of the batch operators.

Streams carry ``ts`` in Unix seconds; event time is derived from it. Late rows beyond the watermark
are dropped. Sinks are idempotent per batch id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestone.functions.text import nonempty
from lodestone.operators import behaviour, profiles
from lodestone.operators.index import build_postings
from lodestone.operators.recall import hot_score
from lodestone.schemas import EVENT_BODY, EVENT_TYPES
from lodestone.streaming.state import DeltaTable, newest_rows


def _start(df: DataFrame, run, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def event_time(ts: str = "ts") -> Column:
    return F.timestamp_seconds(F.col(ts))


# ---------------------------------------------------------------- event ingest


def parse_events(raw: DataFrame, body: str = "value") -> DataFrame:
    """Parse JSON bodies; ``reject`` says why a body is refused (null for good ones)."""
    corrupt = "_corrupt"
    schema = T.StructType([*EVENT_BODY.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(
        body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    )
    rows = raw.withColumn("e", parsed)
    reject = (
        F.when(~nonempty(F.trim(body)), "empty body")
        .when(F.col(f"e.{corrupt}").isNotNull() | F.col("e").isNull(), "invalid JSON")
    )
    fields = [F.col(f"e.{f.name}").alias(f.name) for f in EVENT_BODY.fields]
    out = rows.select(F.col(body).alias("body"), reject.alias("reject"), *fields)
    known = F.when(F.col("event_type").isin(EVENT_TYPES), F.col("event_type")).otherwise("unknown")
    return out.withColumns(
        {
            "event_type": known,
            "uid": F.coalesce("uid", F.lit("")),
            "doc_id": F.coalesce("doc_id", F.lit("")),
        }
    )


def ingest_events(
    raw: DataFrame,
    corpus: DataFrame,
    path: str,
    checkpoint: str,
    watermark: str = "1 hour",
    trigger: dict | None = None,
) -> list[StreamingQuery]:
    """Write good events, enriched, under ``path/events`` and refused bodies under ``path/rejected``.

    An event id that arrives again within the watermark is ignored.
    """
    parsed = parse_events(raw)
    good = (
        parsed.filter(F.col("reject").isNull())
        .drop("reject", "body")
        .withColumn("event_time", event_time())
        .withWatermark("event_time", watermark)
        .dropDuplicatesWithinWatermark(["event_id"])
    )
    enriched = behaviour.build_event_log(good, corpus).withColumn("date", F.to_date("event_time"))
    refused = parsed.filter(F.col("reject").isNotNull()).select("body", "reject")

    def keep(df: DataFrame, batch_id: int) -> None:
        df.drop("event_time").write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")

    def refuse(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")

    return [
        _start(enriched, keep, f"{checkpoint}/events", trigger),
        _start(refused, refuse, f"{checkpoint}/rejected", trigger),
    ]


# ---------------------------------------------------------------- running aggregates


def query_stats_table(spark, path: str, compact_every: int = 20) -> DeltaTable:
    return DeltaTable(spark, path, behaviour.fold_query_stats, compact_every)


def stream_query_stats(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact_every: int = 20
) -> StreamingQuery:
    """Running query statistics; read them with ``query_stats_table(spark, path).read()``."""
    table = query_stats_table(events.sparkSession, path, compact_every)

    def run(df: DataFrame, batch_id: int) -> None:
        table.write(batch_id, behaviour.query_stats(df))

    return _start(events, run, checkpoint, trigger)


class LastClick(StatefulProcessor):
    """Emits (src, dst, ts) for consecutive clicks of a user. State is the user's last click and the
    event time at which it is forgotten."""

    def __init__(self, ttl_ms: int, doc_type: str) -> None:
        self.ttl_ms, self.doc_type = ttl_ms, doc_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"doc_id {self.doc_type}, forget_at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id", "doc_id"])
        before = batch["doc_id"].shift(1)
        forget_at = int(batch["ts"].iloc[-1]) * 1000 + self.ttl_ms
        if self.last.exists():
            doc_id, old = self.last.get()
            before.iloc[0] = doc_id
            self.handle.deleteTimer(old)
            forget_at = max(forget_at, old)
        self.last.update((batch["doc_id"].iloc[-1], forget_at))
        self.handle.registerTimer(forget_at)
        pairs = pd.DataFrame({"src": before, "dst": batch["doc_id"], "ts": batch["ts"]})
        pairs = pairs[pairs["src"].notna() & (pairs["src"] != pairs["dst"])]
        yield pairs.astype({"src": batch["doc_id"].dtype}).reset_index(drop=True)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def click_pair_stream(events: DataFrame, ttl_ms: int = 30 * 86_400_000, watermark: str = "1 hour") -> DataFrame:
    """Stream of (src, dst, ts). Clicks are ordered inside a batch, clicks behind the watermark are
    dropped, and a user idle for ``ttl_ms`` of event time is forgotten. Equal to the batch operator
    when batches arrive in time order."""
    doc_type = events.schema["doc_id"].dataType.simpleString()
    clicks = events.select("uid", "doc_id", "ts", "event_id", event_time().alias("event_time"))
    return clicks.withWatermark("event_time", watermark).groupBy("uid").transformWithStateInPandas(
        statefulProcessor=LastClick(ttl_ms, doc_type),
        outputStructType=f"src {doc_type}, dst {doc_type}, ts bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def cooccurrence_table(spark, path: str, compact_every: int = 20) -> DeltaTable:
    return DeltaTable(spark, path, behaviour.fold_cooccurrence, compact_every)


def stream_cooccurrence(
    events: DataFrame,
    path: str,
    checkpoint: str,
    ttl_ms: int = 30 * 86_400_000,
    watermark: str = "1 hour",
    trigger: dict | None = None,
    compact_every: int = 20,
) -> StreamingQuery:
    """Running co-occurrence of clicks; needs the RocksDB state store."""
    table = cooccurrence_table(events.sparkSession, path, compact_every)

    def run(df: DataFrame, batch_id: int) -> None:
        table.write(batch_id, behaviour.count_both_ways(df))

    return _start(click_pair_stream(events, ttl_ms, watermark), run, checkpoint, trigger)


def profile_table(spark, path: str, compact_every: int = 20) -> DeltaTable:
    return DeltaTable(spark, path, newest_rows(["uid"]), compact_every)


def stream_profiles(
    events: DataFrame,
    corpus: DataFrame,
    path: str,
    checkpoint: str,
    as_of: int | None = None,
    trigger: dict | None = None,
    compact_every: int = 20,
) -> StreamingQuery:
    """Running profiles: each batch rewrites only the users it touches.

    Active days count back from ``as_of``, or without one from the newest event of the batch.
    """
    spark = events.sparkSession
    table = profile_table(spark, path, compact_every)
    types = {c: events.schema[c].dataType.simpleString() for c in ("uid", "doc_id")}

    def run(df: DataFrame, batch_id: int) -> None:
        rows = table.rows(before=batch_id)
        if rows is None:
            touched = profiles.empty_profiles(df.sparkSession, types["uid"], types["doc_id"])
        else:
            # Users that the batch doesn't touch are dropped before versions are merged.
            touched = table.merge(rows.join(df.select("uid").distinct(), "uid", "left_semi"))
        now = as_of if as_of is not None else df.agg(F.max("ts")).first()[0]
        if now is not None:
            table.write(batch_id, profiles.update_profiles(touched, df, corpus, now))

    return _start(events, run, checkpoint, trigger)


# ---------------------------------------------------------------- hot list


def seconds(span: str) -> int:
    """Length of an interval such as ``24 hours``."""
    return int(pd.Timedelta(span).total_seconds())


def _counts(events: DataFrame, span: Column, watermark: str) -> DataFrame:
    timed = events.withColumn("event_time", event_time())
    if events.isStreaming:
        timed = timed.withWatermark("event_time", watermark)
    return timed.groupBy(span.alias("w"), "doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"),
        F.sum((F.col("event_type") == "like").cast("long")).alias("likes"),
    )


def hot_panes(events: DataFrame, window: str, slide: str, watermark: str = "1 hour") -> DataFrame:
    """(pane, doc_id, n, clicks, likes) per tumbling pane, whose length divides window and slide; one row per
    document and pane however many windows overlap."""
    size = math.gcd(seconds(window), seconds(slide))
    counted = _counts(events, F.window("event_time", f"{size} seconds"), watermark)
    return counted.select(F.unix_timestamp("w.start").alias("pane"), "doc_id", "n", "clicks", "likes")


def slide_panes(panes: DataFrame, window: str, slide: str) -> DataFrame:
    """(start, end, doc_id, clicks, likes) of every sliding window that has an event of the document.

    A pane enters at the first window start that covers it and leaves after the last; the running sum of these
    changes, two a pane, is the count of every window up to the next change.
    """
    size, step = seconds(window), seconds(slide)
    pane = math.gcd(size, step)
    first = F.ceil((F.col("pane") + pane - size) / step) * step
    after = (F.floor(F.col("pane") / step) + 1) * step

    def change(at: Column, sign: int) -> Column:
        return F.struct(at.cast("long").alias("start"), *[(F.col(c) * sign).alias(c) for c in ("n", "clicks", "likes")])

    changes = (
        panes.select("doc_id", F.explode(F.array(change(first, 1), change(after, -1))).alias("c"))
        .groupBy("doc_id", "c.start")
        .agg(*[F.sum(f"c.{c}").alias(c) for c in ("n", "clicks", "likes")])
    )
    order = Window.partitionBy("doc_id").orderBy("start")
    running = changes.select(
        "doc_id",
        "start",
        (F.lead("start").over(order) - step).alias("last"),
        *[F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("n", "clicks", "likes")],
    )
    starts = F.explode(F.sequence("start", "last", F.lit(step).cast("long")))
    return running.filter("n > 0").select(starts.alias("start"), "doc_id", "clicks", "likes").select(
        "start", (F.col("start") + size).alias("end"), "doc_id", "clicks", "likes"
    )


def _scored(windows: DataFrame) -> DataFrame:
    return windows.withColumn("hot_score", F.round(hot_score("clicks", "likes"), 6))


def hot_windows(
    events: DataFrame,
    window: str = "24 hours",
    slide: str | None = "5 minutes",
    watermark: str = "1 hour",
    kind: str = "sliding",
) -> DataFrame:
    """(start, end, doc_id, clicks, likes, hot_score) per event-time window.

    ``kind`` is sliding, tumbling or session (a session ends after ``window`` without an event of the document).
    Counts are combined before the shuffle. Sliding windows are running sums over panes, for tables only; their
    stream is :func:`stream_hot`.
    """
    if kind == "sliding":
        return _scored(slide_panes(hot_panes(events, window, slide, watermark), window, slide))
    span = F.window("event_time", window) if kind == "tumbling" else F.session_window("event_time", window)
    counted = _counts(events, span, watermark)
    return _scored(
        counted.select(
            F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), "doc_id", "clicks", "likes"
        )
    )


class SlidingHot:
    """Sliding windows of a stream of closed panes.

    Every batch stores its panes and the end of the newest one, and emits the windows that end after the newest
    pane known before and not after the newest one now: all their panes have been closed. A batch that is run again
    overwrites its own folders.
    """

    def __init__(self, spark, path: str, window: str, slide: str) -> None:
        self.spark, self.path, self.window, self.slide = spark, path, window, slide
        self.pane = math.gcd(seconds(window), seconds(slide))

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        folder = f"{self.path}/{name}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        exists = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        rows = self.spark.read.schema(schema).parquet(folder) if exists else self.spark.createDataFrame([], schema)
        return rows.filter(F.col("batch") < before)

    def _windows(self, panes: DataFrame, done: int | None) -> DataFrame:
        """Windows ending after ``done``; only panes that such windows can cover are read."""
        if done is not None:
            panes = panes.filter(F.col("pane") >= done - seconds(self.window))
        windows = slide_panes(panes, self.window, self.slide)
        return _scored(windows if done is None else windows.filter(F.col("end") > done))

    def apply(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/panes/batch={batch_id}")
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, batch int"
        newest = self.spark.read.parquet(f"{self.path}/panes/batch={batch_id}").agg(F.max("pane").cast("long").alias("pane"))
        top = newest.first()["pane"]
        if top is None:
            return
        done = self._done(batch_id)
        closed = max(top + self.pane, done or 0)
        windows = self._windows(self._read("panes", schema, batch_id + 1), done).filter(F.col("end") <= closed)
        windows.write.mode("overwrite").parquet(f"{self.path}/windows/batch={batch_id}")
        self.spark.range(1).select(F.lit(closed).cast("long").alias("closed")).write.mode("overwrite").parquet(
            f"{self.path}/closed/batch={batch_id}"
        )

    def _done(self, before: int) -> int | None:
        return self._read("closed", "closed long, batch int", before).agg(F.max("closed")).first()[0]

    def open_windows(self) -> DataFrame:
        """Windows that end after the newest closed pane, with what they have so far."""
        panes = self.spark.read.parquet(f"{self.path}/panes")
        return self._windows(panes, self._done((1 << 31) - 1))


def stream_hot(
    events: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    window: str = "24 hours",
    slide: str | None = "5 minutes",
    watermark: str = "1 hour",
    kind: str = "sliding",
) -> StreamingQuery:
    """Append each window's counts to ``path``/windows once the watermark has passed it."""
    if kind == "sliding":
        counted = hot_panes(events, window, slide, watermark)
        run = SlidingHot(events.sparkSession, path, window, slide).apply
    else:
        counted = hot_windows(events, window, slide, watermark, kind)

        def run(df: DataFrame, batch_id: int) -> None:
            df.write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")

    writer = counted.writeStream.outputMode("append").foreachBatch(run)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# ---------------------------------------------------------------- corpus changes


def newest_versions(rows: DataFrame) -> DataFrame:
    """The row of the highest (version, batch) per document."""
    rest = [c for c in rows.columns if c not in ("doc_id", "batch")]
    newest = rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct("version", "at_batch")).alias("_r"))
    return newest.select("doc_id", "_r.*")


def terms_of_newest(rows: DataFrame) -> DataFrame:
    """Postings that came with the highest (version, batch) per document."""
    top = rows.groupBy("doc_id").agg(F.max(F.struct("version", "at_batch")).alias("_top"))
    last = top.select("doc_id", "_top.version", "_top.at_batch")
    return rows.drop("batch").join(last, ["doc_id", "version", "at_batch"], "left_semi")


class CorpusFeed:
    """Corpus and postings kept current from a change stream (op, version, document columns).

    A batch stores its changed documents (deletes flagged) and their postings, both with the version
    and the batch they came in. Per document the highest version counts, of equal versions the latest
    batch, whatever order they arrive in; untouched documents come from the base tables. With ``encode``, which gives
    (doc_id, embedding) of documents, the vectors of changed documents are kept in the same way.
    """

    def __init__(
        self,
        spark,
        path: str,
        corpus: DataFrame,
        postings: DataFrame,
        compact_every: int = 20,
        vectors: DataFrame | None = None,
        encode: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        self.encoded = DeltaTable(spark, f"{path}/vectors", terms_of_newest, compact_every)
        self.base_vectors, self.encode = vectors, encode
        self.docs = DeltaTable(spark, f"{path}/docs", newest_versions, compact_every)
        self.terms = DeltaTable(spark, f"{path}/postings", terms_of_newest, compact_every)
        self.base_corpus, self.base_postings = corpus, postings

    def apply(self, df: DataFrame, batch_id: int) -> None:
        columns = [c for c in self.base_corpus.columns if c != "doc_id"]
        valid = df.filter(nonempty(F.col("doc_id").cast("string"))).withColumn(
            "quality_score", F.coalesce("quality_score", F.lit(0.5))
        )
        row = F.struct((F.col("op") == "delete").alias("deleted"), "version", *columns)
        newest = valid.groupBy("doc_id").agg(F.max_by(row, "version").alias("_r")).select("doc_id", "_r.*")
        newest = newest.withColumn("at_batch", F.lit(batch_id).cast("long"))
        newest.persist()
        try:
            self.docs.write(batch_id, newest)
            terms = build_postings(newest.filter(~F.col("deleted")))
            stamp = newest.select("doc_id", "version", "at_batch")
            self.terms.write(batch_id, terms.join(stamp, "doc_id"))
            if self.encode is not None:
                self.encoded.write(batch_id, self.encode(newest.filter(~F.col("deleted"))).join(stamp, "doc_id"))
        finally:
            newest.unpersist()

    def corpus(self) -> DataFrame:
        changed = self.docs.read()
        if changed is None:
            return self.base_corpus
        kept = self.base_corpus.join(changed.select("doc_id"), "doc_id", "left_anti")
        return kept.unionByName(changed.filter(~F.col("deleted")).select(kept.columns))

    def _current(self, base: DataFrame, table: DeltaTable) -> DataFrame:
        """Base rows of untouched documents, and the rows that came with each other document's newest version."""
        changed = self.docs.read()
        if changed is None:
            return base
        latest = changed.select("doc_id", "at_batch")
        kept = base.join(latest, "doc_id", "left_anti")
        return kept.unionByName(table.rows().join(latest, ["doc_id", "at_batch"], "left_semi").select(kept.columns))

    def postings(self) -> DataFrame:
        return self._current(self.base_postings, self.terms)

    def vectors(self) -> DataFrame:
        return self._current(self.base_vectors, self.encoded)


def stream_corpus(
    changes: DataFrame, feed: CorpusFeed, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    return _start(changes, feed.apply, checkpoint, trigger)

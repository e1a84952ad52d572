"""Changes of a source tree, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import cut
from ..sources.scan import scan


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content_hash, modified) of a tree as it is now."""
    return cut(scan(spark, root).select("file_path", "content_hash", "modified"))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, op): what was added, changed (a later time of change) or deleted from one snapshot to the next."""
    a = old.select("file_path", F.col("modified").alias("before"))
    b = new.select("file_path", F.col("modified").alias("after"))
    op = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("after") > F.col("before"), "changed")
    return a.join(b, "file_path", "full").select("file_path", op.alias("op")).where("op is not null")


def watch(spark: SparkSession, root: str, on_change: Callable[[DataFrame, DataFrame], None], interval: str = "1 second") -> StreamingQuery:
    """Calls on_change(differences, snapshot) whenever the tree has changed; a trigger of the rate source drives the polls.

    Spark's file stream tells neither changed nor deleted files, so whole snapshots are compared.
    """
    state = {"last": snapshot(spark, root)}

    def poll(_: DataFrame, __: int) -> None:
        now = snapshot(spark, root)
        changed = cut(differences(state["last"], now))
        if not changed.isEmpty():
            state["last"] = now
            on_change(changed, now)

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(poll).trigger(processingTime=interval).start()


def watch_graph(spark: SparkSession, root: str, load: Callable[[], tuple[DataFrame, DataFrame]], on_graph: Callable[[DataFrame, DataFrame, DataFrame], None], interval: str = "1 second") -> StreamingQuery:
    """Calls on_graph(differences, nodes, edges) with the graph that load() builds anew whenever the tree has changed."""
    return watch(spark, root, lambda changed, _: on_graph(changed, *load()), interval)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which wants times with a zone; other tables as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, users and values by window and type; on a stream, rows later than `late` are left out."""
    kind = dict(events.dtypes)["ts"]
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").cast(kind).alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    kind = dict(events.dtypes)["ts"]
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast(kind).alias("session_start"), F.col("session_window.end").cast(kind).alias("session_end"), "n")

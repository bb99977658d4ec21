"""The registry's change feed as a structured stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGE = "seq bigint, id string, doc struct<`dist-tags`:map<string,string>,versions:map<string,struct<dist:struct<shasum:string,tarball:string>>>>"


def feed(spark: SparkSession, path: str, since: int = 0, files: int = 100) -> DataFrame:
    """Changes after a sequence number, from files of JSON lines as they arrive; text kept for the rejects."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return raw.select("value", F.from_json("value", CHANGE).alias("c")).where(F.col("c.seq").isNull() | (F.col("c.seq") > since))


def rejects(changes: DataFrame) -> DataFrame:
    """Records that can't be read; they don't stop the stream."""
    return changes.where("c.seq is null").select("value")


def tarballs(changes: DataFrame) -> DataFrame:
    """The latest version's tarball and checksum."""
    latest = F.col("c.doc.versions")[F.col("c.doc.`dist-tags`")["latest"]]["dist"]
    return changes.where("c.seq is not null").select("c.seq", "c.id", latest["tarball"].alias("tarball"), latest["shasum"].alias("shasum")).where("tarball is not null")


def once(rows: DataFrame) -> DataFrame:
    """Each tarball once, over the whole stream (state by tarball)."""
    return rows.dropDuplicates(["tarball"])


def store(rows: DataFrame, known: Callable[[], DataFrame], put: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch, without what is stored already, to `put`; offsets are in the checkpoint folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        put(df.join(known().select("tarball"), "tarball", "left_anti"), epoch)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prunable(stored: DataFrame, upstream: DataFrame) -> DataFrame:
    """Stored objects that upstream still has; deleting them is the caller's decision."""
    return stored.join(upstream.select("tarball"), "tarball", "left_semi")


def per_window(rows: DataFrame, time: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: changes by tumbling window, with a watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count("*").alias("n"))

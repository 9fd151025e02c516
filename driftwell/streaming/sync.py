"""Incremental ingestion as a stream of files: each micro-batch merges the notes that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwell.sources import vault


def stream_notes(spark: SparkSession, root: str, out: str, checkpoint: str, rules: vault.JournalRules = vault.JournalRules()) -> StreamingQuery:
    """Append parsed notes of new files under ``root`` to ``out``, once each; a restart goes on from the checkpoint.

    The latest version of a note is the one with the greatest ``file_mtime``. Deletions need the batch ``vault.sync``.
    """
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).schema("value string").load(root)
    when = F.col("_metadata.file_modification_time")
    files = raw.select(vault.below(root).alias("path"), F.col("value").alias("content"), (F.unix_micros(when) / 1e6).alias("file_mtime"), when.alias("modified"))

    def merge(batch: DataFrame, epoch: int) -> None:
        vault.parse(batch, rules).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(notes: DataFrame) -> DataFrame:
    """The newest version of every note."""
    cols = [c for c in notes.columns if c not in ("path", "epoch")]
    newest = notes.groupBy("path").agg(F.max_by(F.struct(*cols), "file_mtime").alias("n"))
    return newest.select("path", "n.*")


def counted_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window and kind, late ones up to ``late``; for batch and streaming tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

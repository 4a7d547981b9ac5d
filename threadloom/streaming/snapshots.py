"""Snapshots as a stream: an extension, the batch ingest run on each directory as it arrives.

A text file with one snapshot directory per line is a source of directories; each micro-batch ingests its
directories in order. The archive is written as a new version before its name is published, so a failed
batch leaves the version before it, and the same batch run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.common import list_names, write_text
from threadloom.operators.ingest import Report, ingest
from threadloom.sources.archive import Archive, write_archive
from threadloom.sources.snapshot import Settings


def current(spark: SparkSession, store: str) -> Archive:
    """The archive a store published last, or an empty one."""
    published = list_names(spark, f"{store}/published")
    return Archive.load(spark, f"{store}/{published[-1]}", unique=True) if published else Archive.empty(spark)


def ingest_all(spark: SparkSession, directories: list[str], settings: Settings, store: str, version: str) -> list[Report]:
    """Ingest directories in their order and publish the result as a version of the store; a version that is published stays as it is."""
    if version in list_names(spark, f"{store}/published"):
        return []
    archive, reports = current(spark, store), []
    for d in directories:
        archive, report = ingest(spark, Settings(d, settings.media_root_path, settings.site_name, settings.site_url), archive, strict=False)
        reports.append(report)
    write_archive(archive, f"{store}/{version}", mode="overwrite")
    write_text(spark, f"{store}/published/{version}", "")
    return reports


def ingest_stream(spark: SparkSession, lists: str, settings: Settings, store: str, checkpoint: str):
    """A streaming query over files that list snapshot directories; ends when all that is there is read."""

    def each(batch: DataFrame, epoch: int) -> None:
        directories = sorted(r["value"].strip() for r in batch.collect() if r["value"].strip())  # names of directories, a few a batch
        ingest_all(spark, directories, settings, store, f"v{epoch:08d}")

    stream = spark.readStream.text(lists)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Ingest of a snapshot into an archive: what is missing at each level is added, with ids and ordinals.

Ingesting the same snapshot again adds nothing. All boards are read at once; each level is one anti-join
with the archive and one append. Failures have three severities: settings or a key that occurs twice end
the run, a bad catalog loses its board's new threads, a bad thread file its posts; the last two are
reported.
"""

from __future__ import annotations

import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.common import stage, unstage, utc
from threadloom.functions import media
from threadloom.operators import search, upsert
from threadloom.sources import snapshot
from threadloom.sources.archive import SCHEMAS, Archive, unique_violations


class DuplicateKeys(ValueError):
    """A batch repeats a key."""


@dataclass
class Report:
    """New rows by table, rejected files (path) and their number, and sums of ids over the posts of the snapshot."""

    added: dict[str, int]
    rejected: DataFrame
    rejected_count: int
    sum_post_id: int
    sum_board_post_id: int


def _greatest(df: DataFrame, column: str) -> int:
    return df.agg(F.max(column)).first()[0] or 0


def _as(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def _text(column: str) -> Column:
    return F.col(column)


def ingest(spark: SparkSession, settings: snapshot.Settings, archive: Archive, strict: bool = True, copy_media: bool = False, phash=None, index: str | None = None, config: str = "english") -> tuple[Archive, Report]:
    """The archive with the snapshot's rows, and a report.

    strict: a key that a batch repeats is an error; else its first row is taken. phash: a function from a
    column of file paths to a column of perceptual hashes, where a decoder of pictures is at hand. index: a
    folder of this run's own for the search postings of the new posts; folders side by side are one index.
    """
    root = settings.backup_read_root.rstrip("/")
    added: dict[str, int] = {}

    def append(name: str, old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        new = stage(_as(new, name), f"new-{name}")
        if strict and not (twice := unique_violations(new, keys).limit(5)).isEmpty():
            raise DuplicateKeys(f"{name}: {[tuple(r)[:-1] for r in twice.collect()]}")
        added[name] = new.count()
        return _as(old, name).unionByName(new), new

    def batch(df: DataFrame, keys: list[str]) -> DataFrame:
        return df if strict else df.dropDuplicates(keys)

    # site and boards
    site = spark.createDataFrame([(settings.site_name, settings.site_url)], "name string, url string")
    site = upsert.assign_ids(upsert.missing(site, archive.sites, ["name"]), "site_id", ["name"], _greatest(archive.sites, "site_id"), 1)
    sites, _ = append("sites", archive.sites, site, ["name"])
    site_id = sites.where(F.col("name") == settings.site_name).first()["site_id"]
    dirs = snapshot.boards_of(spark, root)
    new = upsert.missing(dirs.select(F.col("board_dir").alias("pathpart"), F.lit(site_id).alias("site_id")), archive.boards, ["site_id", "pathpart"])
    boards, _ = append("boards", archive.boards, upsert.assign_ids(new, "board_id", ["pathpart"], _greatest(archive.boards, "board_id"), 1), ["site_id", "pathpart"])
    here = boards.where(F.col("site_id") == site_id).select("board_id", F.col("pathpart").alias("board_dir"))

    # threads, of all boards that have a catalog
    listed, bad_catalogs = snapshot.read_catalogs(spark, root)
    listed = listed.join(here, "board_dir").select("board_dir", "board_id", F.col("no").alias("board_thread_id"), F.timestamp_seconds("time").alias("creation_time"))
    # a thread may move between two pages of a catalog while it is saved: that is no repeated key
    listed = stage(listed.dropDuplicates(["board_id", "board_thread_id"]), "threads-listed")
    keys = ["board_id", "board_thread_id"]
    new = upsert.assign_ids(upsert.missing(listed, archive.threads, keys), "thread_id", keys, _greatest(archive.threads, "thread_id"))
    threads, _ = append("threads", archive.threads, new, keys)
    of_snapshot = threads.join(listed.select(*keys, "board_dir"), keys).select("thread_id", "board_dir", F.col("board_thread_id").alias("thread_no"))

    # posts: what is new is told and numbered by keys alone, then texts are joined to the numbers once
    parsed = snapshot.parsed_posts(spark, root)
    read, bad_threads = snapshot.posts_of(spark, parsed, root)
    keys, of_read = ["thread_id", "board_post_id"], ["board_dir", "thread_no", "no"]
    named = batch(read.select(*of_read), of_read).join(of_snapshot, ["board_dir", "thread_no"]).withColumn("board_post_id", F.col("no"))
    new = upsert.next_local_idx(upsert.missing(named, archive.posts, keys), archive.posts)
    new = upsert.assign_ids(new, "post_id", keys, _greatest(archive.posts, "post_id"))
    texts = read.select(*of_read, F.timestamp_seconds("time").alias("creation_time"), F.col("com").alias("body"), F.col("sub").alias("subject"), "name", "email", "embed")
    # texts are not moved where all posts are known
    new = new.limit(0).withColumns({"creation_time": F.lit(None).cast("timestamp")}) if new.isEmpty() else batch(texts, of_read).join(new, of_read)
    posts, new = append("posts", archive.posts, new, keys)

    if index and added["posts"]:
        search.build_index(new.withColumn("creation_time", utc("creation_time")), index, config, mode="overwrite")

    # attachments: known by post and name; only files that exist
    ids = posts.join(of_snapshot.select("thread_id"), "thread_id", "left_semi").select("post_id", "thread_id", F.col("board_post_id").alias("no"))
    in_threads = read.select("board_dir", "thread_no", "no", "time", "board", "files", "tim", "ext", "filename", "fsize", "spoiler", "w", "h").join(of_snapshot.select("board_dir", "thread_no"), ["board_dir", "thread_no"], "left_semi")
    listed_files = stage(snapshot.files_of(in_threads), "files-listed")
    files = stage(listed_files.join(of_snapshot, ["board_dir", "thread_no"]).join(ids, ["thread_id", "no"]), "files-read")
    if (lost := listed_files.count() - files.count()) > 0:
        raise LookupError(f"{lost} files belong to posts that the archive does not have")
    keys = ["post_id", "board_filename"]
    new = upsert.missing(batch(files, keys), archive.attachments, keys)
    new = hashed_files = stage(snapshot.with_hashes(new, root), "files-hashed")  # numbering looks at its rows twice
    hashed = phash(F.concat(F.lit(root), "file_path")) if phash else F.lit(None).cast("bigint")
    value = F.when(F.col("mimetype").isin(*media.HASHED_MIME), media.zigzag_decode(hashed))
    new = new.withColumn("phash", F.when(value != 0, value)).withColumn("illegal", F.lit(False)).withColumn("creation_time", F.timestamp_seconds("time"))
    attachments, _ = append("attachments", archive.attachments, upsert.assign_ids(new, "attachment_id", keys, _greatest(archive.attachments, "attachment_id")), keys)

    if copy_media:
        copy_files(files, settings)
    sums = ids.agg(F.sum("post_id").alias("a"), F.sum("no").alias("b")).first()
    rejected = stage(bad_catalogs.unionByName(bad_threads), "rejected")
    unstage(parsed, listed_files, files, hashed_files)
    return Archive(sites, boards, threads, posts, attachments), Report(added, rejected, rejected.count(), sums["a"] or 0, sums["b"] or 0)


def copy_plan(files: DataFrame, settings: snapshot.Settings) -> DataFrame:
    """(source, target) of every file and thumbnail of the snapshot's attachments."""
    where = [F.lit(settings.media_root_path.rstrip("/")), F.lit(settings.site_name), F.col("board_dir"), F.col("thread_no"), F.col("board_filename")]
    root = F.lit(settings.backup_read_root.rstrip("/"))
    full = files.select(F.concat(root, "file_path").alias("source"), media.media_path(*where, F.col("file_extension")).alias("target"), F.lit(0).alias("thumb"), media.media_path(*where, F.col("file_extension")).alias("full"))
    thumb = files.select(F.concat(root, "thumb_path").alias("source"), media.media_path(*where, F.col("thumb_extension"), thumbnail=True).alias("target"), F.lit(1).alias("thumb"), media.media_path(*where, F.col("file_extension")).alias("full"))
    return full.unionByName(thumb)


def copy_files(files: DataFrame, settings: snapshot.Settings) -> None:
    """Copy media on the executors, between folders that all of them mount; where the file is there already, it and its thumbnail are left alone."""

    def run(rows) -> None:
        done: dict[str, bool] = {}
        for r in rows:
            there = done.setdefault(r["full"], Path(r["full"]).exists())
            if there or not Path(r["source"]).is_file():
                continue
            target = Path(r["target"])
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(target.name + ".part")
            shutil.copyfile(r["source"], part)
            part.rename(target)  # a task that runs twice leaves no half file

    copy_plan(files, settings).repartition(F.col("full")).sortWithinPartitions("full", "thumb").foreachPartition(run)

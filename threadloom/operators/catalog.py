"""Catalog pages as of a moment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.common import moment, stage, utc
from threadloom.operators.ranking import bump, newest, top_threads
from threadloom.sources.archive import Archive

#: Columns of a page, in order; search results have the same.
PAGE = [
    "estimated_post_count", "post_id", "board_post_id", "creation_time", "bump_time", "body", "subject", "thread_id", "embed", "board_thread_id",
    "pathpart", "site_name", "file_mimetype", "file_illegal", "file_name", "file_extension", "file_thumb_extension",
]


def with_places(rows: DataFrame, archive: Archive) -> DataFrame:
    """Adds thread number, board path and site name. Boards and sites are a few rows a site and are broadcast by size."""
    places = archive.boards.select("board_id", "pathpart", "site_id").join(archive.sites.select("site_id", F.col("name").alias("site_name")), "site_id")
    threads = archive.threads.select("thread_id", "board_thread_id", "board_id")
    return rows.join(threads, "thread_id").join(places, "board_id").drop("board_id", "site_id")


def with_first_file(rows: DataFrame, archive: Archive) -> DataFrame:
    """Adds the first file's columns, null for posts without one: the file is filtered before the outer join."""
    files = archive.attachments.where("attachment_idx = 1").select(
        "post_id", F.col("mimetype").alias("file_mimetype"), F.col("illegal").alias("file_illegal"), F.col("board_filename").alias("file_name"), "file_extension", F.col("thumb_extension").alias("file_thumb_extension")
    )
    return rows.join(files, "post_id", "left")


def fetch_catalog(archive: Archive, max_time: datetime | str, max_row_read: int = 10_000) -> DataFrame:
    """First posts of the top threads with place, first file and the count of posts within the lookback, the last bumped first.

    Threads without a post 1 before the moment are left out.
    """
    top = stage(top_threads(archive.posts, max_time, max_row_read).select("thread_id", "bump_time", F.col("post_count").alias("estimated_post_count")), "top")
    first = archive.posts.where((F.col("local_idx") == 1) & (utc("creation_time") < moment(max_time)))
    rows = first.join(top, "thread_id")
    return with_first_file(with_places(rows, archive), archive).select(PAGE).orderBy(F.col("bump_time").desc(), F.col("thread_id").desc())


def fetch_catalog_exact(archive: Archive, max_time: datetime | str, max_row_read: int = 10_000) -> DataFrame:
    """As fetch_catalog with the first post by number and the exact count of all posts of the thread.

    The top threads (at most max_row_read rows) are found once; counts and first posts come from narrow columns of
    their posts, combined before anything is shuffled; whole posts are read for the first ones only.
    """
    top = stage(top_threads(archive.posts, max_time, max_row_read).select("thread_id", "bump_time"), "top")
    mine = archive.posts.select("thread_id", "board_post_id", "post_id").join(top, "thread_id", "left_semi")
    counts = mine.groupBy("thread_id").agg(F.count("*").alias("post_count"), F.min(F.struct("board_post_id", "post_id")).alias("first"))
    counts = stage(counts.join(top, "thread_id").select(F.col("first.post_id").alias("post_id"), "post_count", "bump_time"), "counts")
    rows = with_places(archive.posts.join(counts, "post_id"), archive)
    return rows.select("post_count", "post_id", "board_post_id", "creation_time", "bump_time", "body", "subject", "thread_id", "embed", "board_thread_id", "pathpart", "site_name").orderBy(F.col("bump_time").desc(), F.col("thread_id").desc())


def fetch_catalog_paged(posts: DataFrame, max_time: datetime | str, count: int, offset: int) -> DataFrame:
    """(bump_time, post_count, post_id, thread_id, body): a page of threads by bump time over all posts, with the post of the least id."""
    before = posts.where(utc("creation_time") < moment(max_time))
    groups = before.groupBy("thread_id").agg(F.max("creation_time").alias("bump_time"), F.count("*").alias("post_count"), F.min("post_id").alias("post_id"))
    page = groups.orderBy(F.col("bump_time").desc(), F.col("thread_id").desc()).offset(offset).limit(count)
    return page.join(posts.select("post_id", "body"), "post_id").select("bump_time", "post_count", "post_id", "thread_id", "body").orderBy(F.col("bump_time").desc(), F.col("thread_id").desc())


def union_bump(posts: DataFrame, times: list[str], n: int) -> DataFrame:
    """Bump rows of the n newest posts before each time, stacked."""
    parts = [bump(newest(posts, t, n)) for t in times]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_bump_then_agg(posts: DataFrame, windows: list[tuple[str, int]]) -> DataFrame:
    """Bump rows over stacked windows of newest posts; posts in two windows count twice."""
    rows = None
    for t, n in windows:
        part = newest(posts.select("post_id", "thread_id", "creation_time"), t, n)
        rows = part if rows is None else rows.unionByName(part)
    return bump(rows)

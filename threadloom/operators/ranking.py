"""Most recently active threads as of a moment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.common import moment, stage, utc

#: Rows looked back over by default, and at most.
LOOKBACK, LOOKBACK_CAP = 10_000, 250_000


def _before(posts: DataFrame, as_of: datetime | str) -> DataFrame:
    return posts.where(utc("creation_time") < moment(as_of))


def newest(posts: DataFrame, as_of: datetime | str, n: int) -> DataFrame:
    """The n newest posts before a moment; ties by the greater post_id. A top-n: each task keeps n rows."""
    return _before(posts, as_of).orderBy(F.col("creation_time").desc_nulls_last(), F.col("post_id").desc()).limit(n)


def bump(posts: DataFrame) -> DataFrame:
    """(bump_time, post_count, thread_id, where_to_leave_off): newest time, number and oldest time of each thread's posts."""
    return posts.groupBy("thread_id").agg(F.max("creation_time").alias("bump_time"), F.count("*").alias("post_count"), F.min("creation_time").alias("where_to_leave_off")).select("bump_time", "post_count", "thread_id", "where_to_leave_off")


def top_threads(posts: DataFrame, as_of: datetime | str, lookback: int | None = LOOKBACK) -> DataFrame:
    """Threads of the newest `lookback` posts before a moment; no lookback means the greatest that is allowed.

    The next page begins at the least where_to_leave_off of this one.
    """
    n = LOOKBACK_CAP if lookback is None else min(lookback, LOOKBACK_CAP)
    return bump(newest(posts.select("post_id", "thread_id", "creation_time"), as_of, n))


def top_threads_exact(posts: DataFrame, as_of: datetime | str, threads: int) -> DataFrame:
    """The most recently bumped threads over all posts, in one pass."""
    return bump(_before(posts, as_of)).orderBy(F.col("bump_time").desc(), F.col("thread_id").desc()).limit(threads)


def top_threads_iterative(posts: DataFrame, as_of: datetime | str, threads: int, first: int = 2000, rounds: int = 10, merge: bool = False) -> DataFrame:
    """Deepening: windows of posts, each twice as long and older than the one before, until enough different threads are met.

    As it stands a thread occurs once for each window it is met in, with that window's count; merge=True adds them up.
    Posts at the exact time at which a window ends are not met again (a strict cursor).
    """
    posts = posts.select("post_id", "thread_id", "creation_time")
    found, cursor, size = None, as_of, first
    for _ in range(rounds):
        window = stage(bump(newest(posts, cursor, size)), "top-threads")
        found = window if found is None else found.unionByName(window)
        low = window.agg(F.min(utc("where_to_leave_off")).cast("string")).first()[0]
        if low is None or found.select("thread_id").distinct().count() >= threads:
            break
        cursor, size = low, size * 2
    if merge:
        found = found.groupBy("thread_id").agg(F.max("bump_time").alias("bump_time"), F.sum("post_count").alias("post_count"), F.min("where_to_leave_off").alias("where_to_leave_off"))
    return found.select("bump_time", "post_count", "thread_id")


def posts_of_top_threads(posts: DataFrame, as_of: datetime | str, lookback: int) -> DataFrame:
    """All posts of the top threads; the side that has one row a thread is as small as the lookback, so it is the one AQE may broadcast. The last bumped thread comes last."""
    return posts.join(top_threads(posts, as_of, lookback).select("thread_id", "bump_time"), "thread_id").orderBy("bump_time", "thread_id", "post_id")


def thread_bodies(posts: DataFrame, as_of: datetime | str, lookback: int) -> DataFrame:
    """(thread_id, bodies): the bodies of each top thread in post order, nulls kept in their place."""
    rows = posts.join(top_threads(posts, as_of, lookback).select("thread_id"), "thread_id")
    ordered = F.array_sort(F.collect_list(F.struct("board_post_id", "post_id", "body")))
    return rows.groupBy("thread_id").agg(F.transform(ordered, lambda x: x["body"]).alias("bodies"))

"""The first post of each thread, in the forms that differ in how they treat ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.common import first_by, moment, stage, utc
from threadloom.operators.ranking import top_threads_exact


def distinct_on(posts: DataFrame) -> DataFrame:
    """One row a thread: the least number, then id."""
    return first_by(posts, ["thread_id"], [F.col("board_post_id"), F.col("post_id")])


def by_row_number(posts: DataFrame) -> DataFrame:
    """One row a thread: the earliest time, then id."""
    return first_by(posts, ["thread_id"], [F.col("creation_time"), F.col("post_id")])


def by_rank(posts: DataFrame) -> DataFrame:
    """All rows of the earliest time."""
    w = Window.partitionBy("thread_id").orderBy("creation_time")
    return posts.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def by_min_join(posts: DataFrame) -> DataFrame:
    """All rows of the earliest time, by a join with the aggregate."""
    least = posts.groupBy("thread_id").agg(F.min("creation_time").alias("creation_time"))
    return posts.join(least, ["thread_id", "creation_time"], "left_semi")


def by_first_value(posts: DataFrame) -> DataFrame:
    """(thread_id, bump_time, post_count, body): one row a thread, the body of the earliest time, then id; one aggregation without a window."""
    return posts.groupBy("thread_id").agg(F.max("creation_time").alias("bump_time"), F.count("*").alias("post_count"), F.min_by("body", F.struct("creation_time", "post_id")).alias("body"))


def by_lateral(posts: DataFrame) -> DataFrame:
    """(thread_id, post_id): one row a thread by a correlated top-1, which Catalyst turns into a join."""
    return posts.sparkSession.sql(
        """SELECT t.thread_id, f.post_id FROM (SELECT DISTINCT thread_id FROM {p}) t
           JOIN LATERAL (SELECT p.post_id FROM {p} p WHERE p.thread_id = t.thread_id ORDER BY p.creation_time, p.post_id LIMIT 1) f""",
        p=posts.select("thread_id", "post_id", "creation_time"),
    )


def by_correlated_min(posts: DataFrame) -> DataFrame:
    """(thread_id, post_id): all rows of the earliest time by a correlated scalar subquery."""
    return posts.sparkSession.sql("SELECT p.thread_id, p.post_id FROM {p} p WHERE p.creation_time = (SELECT min(q.creation_time) FROM {p} q WHERE q.thread_id = p.thread_id)", p=posts.select("thread_id", "post_id", "creation_time"))


FORMS = {"first_value": by_row_number, "rank": by_rank, "min_join": by_min_join, "lateral": by_lateral, "correlated_min": by_correlated_min}


def page(posts: DataFrame, form: str, as_of: str, threads: int = 100) -> DataFrame:
    """(bump_time, post_count, thread_id, post_id, body): the threads bumped last before a moment with their first posts, the last bumped first.

    The threads come first (at most `threads` rows), then the first posts of these by the form, then their bodies; forms
    that keep ties give a thread several rows.
    """
    top = stage(top_threads_exact(posts, as_of, threads).select("bump_time", "post_count", "thread_id"), "top")
    mine = posts.select("thread_id", "post_id", "creation_time").where(utc("creation_time") < moment(as_of)).join(top, "thread_id", "left_semi")
    first = FORMS[form](mine).select("thread_id", "post_id").join(top, "thread_id")
    return posts.select("post_id", "body").join(first, "post_id").select("bump_time", "post_count", "thread_id", "post_id", "body").orderBy(F.col("bump_time").desc(), F.col("thread_id").desc(), "post_id")


def first_agg(df: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """(key, first): the first value that is not null, in order."""
    return df.groupBy(key).agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("first"))

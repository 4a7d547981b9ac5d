"""Writing without repeating: missing rows, upserts, ordinals, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.common import stage


def missing(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key does not exist."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def assign_ids(df: DataFrame, id_col: str, keys: list[str], start: Column | int, parts: int | None = None) -> DataFrame:
    """Dense ids from start + 1 in the order of the keys, without one task that numbers all rows.

    Rows are ranged by their keys and written; each range is numbered by itself, after as many rows as the
    ranges before it hold. The counts are one row a range, so sending them to all tasks is bounded by the
    number of tasks. The ids do not depend on where the ranges begin.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ids")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    start = F.lit(start) if isinstance(start, int) else start
    return rows.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(id_col, start + F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def next_local_idx(new: DataFrame, posts: DataFrame) -> DataFrame:
    """new with local_idx: after the greatest of the thread, in the order of board_post_id; a late post with a small number still comes last."""
    greatest = posts.join(new.select("thread_id").distinct(), "thread_id", "left_semi").groupBy("thread_id").agg(F.max("local_idx").alias("_max"))
    order = F.row_number().over(Window.partitionBy("thread_id").orderBy("board_post_id"))
    return new.join(greatest, "thread_id", "left").withColumn("local_idx", (F.coalesce("_max", F.lit(0)) + order).cast("int")).drop("_max")


def renumber(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Ordinals 1..n within each group, from scratch."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def insert_ignore(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows an insert that ignores conflicts adds: those missing, the first of each key within the batch."""
    return missing(incoming, existing, keys).dropDuplicates(keys)


def upsert_ids(incoming: DataFrame, posts: DataFrame, version: int = 3) -> DataFrame:
    """(thread_id, board_post_id, post_id, action) of an incoming batch of posts.

    Version 1 and 2 answer the inserted rows and those that exist; version 3 also tells rows whose embed
    differs (null included), which are then updated. Inserted rows get the ids that follow the greatest, in
    the order of their keys.
    """
    keys = ["thread_id", "board_post_id"]
    old = posts.select(*keys, "post_id", F.col("embed").alias("_embed"))
    rows = incoming.join(old, keys)
    action = F.when(~F.col("embed").eqNullSafe(F.col("_embed")), "updated").otherwise("selected") if version >= 3 else F.lit("selected")
    start = posts.agg(F.max("post_id")).first()[0] or 0
    new = assign_ids(missing(incoming.select(*keys), posts, keys), "post_id", keys, start)
    return rows.select(*keys, "post_id", action.alias("action")).unionByName(new.select(*keys, "post_id", F.lit("inserted").alias("action")))


def embed_changed(incoming: DataFrame, posts: DataFrame) -> DataFrame:
    """(post_id, embed) of the rows an upsert updates: the incoming embed is distinct from the stored one."""
    keys = ["thread_id", "board_post_id"]
    old = posts.select(*keys, "post_id", F.col("embed").alias("_embed"))
    return incoming.select(*keys, "embed").join(old, keys).where(~F.col("embed").eqNullSafe(F.col("_embed"))).select("post_id", "embed")


def apply_embed(posts: DataFrame, changes: DataFrame) -> DataFrame:
    """posts with the embeds of `changes` (post_id, embed) in place of theirs, null ones too."""
    new = changes.select("post_id", F.col("embed").alias("_new"), F.lit(True).alias("_hit"))
    return posts.join(new, "post_id", "left").withColumn("embed", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("embed"))).drop("_new", "_hit")

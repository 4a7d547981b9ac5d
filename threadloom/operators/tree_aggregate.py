"""Problem 1: exact per-key results when a few keys hold most records.

Multi-level tree aggregation. Every input chunk (a split of spark.sql.files.maxPartitionBytes, or a
shuffle partition) is combined locally first: Spark's partial aggregation makes one state per key and
chunk before anything is sent. States then merge in rounds of a fixed fan-in: in round l the states of
key k from `fan_in` neighbouring nodes meet at node chunk // fan_in^l, so a key of any weight is spread
over chunks / fan_in tasks in the first round, and no task ever receives more than `fan_in` states of
one key. After log_fan_in(chunks) rounds one state per key is left; a last round by the key alone holds even
where the planner made more partitions than it was asked for. Every row is counted; nothing is
sampled, and results are exact because count, sum, min and max merge exactly.

Defined results: an empty input gives no rows. A null key is a key of its own in the per-key results
(and never a value in p1_found). Null measures are skipped, so a key with nulls only has null min/max
and 0 counts. Repeated rows: `rows` counts them, `distinct` results first reduce them by their id, which
spreads evenly because ids are unique.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.common import table, utc

FAN_IN = 8
_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def rounds_for(chunks: int, fan_in: int) -> int:
    """Rounds until one state per key is left."""
    return max(1, math.ceil(math.log(max(2, chunks), fan_in) - 1e-9))


def tree_aggregate(df: DataFrame, key: str, measures: dict[str, tuple[str, str | Column]], chunks: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """(key, *measures): measures maps a result name to ("count" | "sum" | "min" | "max", column).

    chunks is the number of input partitions where the caller knows it; else it is taken from the plan.
    """
    chunks = chunks or df.rdd.getNumPartitions()
    columns = {name: F.lit(1) if kind == "count" and column == "*" else F.col(column) if isinstance(column, str) else column for name, (kind, column) in measures.items()}
    states = df.select(F.col(key).alias("_k"), F.spark_partition_id().alias("_node"), *[c.alias(f"_m_{n}") for n, c in columns.items()])
    step = dict(_FIRST)
    for _ in range(rounds_for(chunks, fan_in)):
        states = states.withColumn("_node", F.floor(F.col("_node") / fan_in))
        states = states.groupBy("_k", "_node").agg(*[step[kind](f"_m_{n}").alias(f"_m_{n}") for n, (kind, _) in measures.items()])
        step = dict(_MERGE)
    # nodes are as many as partitions, whatever the planner made of them: what is left of a key are some states at most
    states = states.groupBy("_k").agg(*[_MERGE[kind](f"_m_{n}").alias(f"_m_{n}") for n, (kind, _) in measures.items()])
    return states.select(F.col("_k").alias(key), *[F.col(f"_m_{n}").alias(n) for n in measures])


def _shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, key: str, share: float, field: str) -> DataFrame:
    """(field, key_value) of the keys that hold at least `share` of all rows."""
    rows = df.count()  # from the Parquet footers
    counts = tree_aggregate(df.select(key), key, {"n": ("count", "*")})
    return counts.where(F.col(key).isNotNull() & (F.col("n") >= share * rows)).select(F.lit(field).alias("field"), F.col(key).cast("long").alias("key_value"))


def per_thread(posts: DataFrame) -> DataFrame:
    """thread_id, posts (different post_id), rows, first_time, last_time, max_local_idx."""
    spark = posts.sparkSession
    one = posts.groupBy("thread_id", "post_id").agg(F.count("*").alias("n"), F.min("creation_time").alias("t0"), F.max("creation_time").alias("t1"), F.max("local_idx").alias("i"))
    return tree_aggregate(one, "thread_id", {"posts": ("count", "post_id"), "rows": ("sum", "n"), "first_time": ("min", "t0"), "last_time": ("max", "t1"), "max_local_idx": ("max", "i")}, chunks=_shuffle_partitions(spark))


def per_board(threads: DataFrame, posts: DataFrame) -> DataFrame:
    """board_id, threads (different thread_id), thread_rows, posts (different post_id in them)."""
    spark = threads.sparkSession
    one = threads.groupBy("board_id", "thread_id").agg(F.count("*").alias("n"))
    sizes = per_thread(posts).select("thread_id", F.col("posts").alias("p"))
    joined = one.join(sizes, "thread_id", "left")
    return tree_aggregate(joined, "board_id", {"threads": ("count", "thread_id"), "thread_rows": ("sum", "n"), "posts": ("sum", F.coalesce("p", F.lit(0)))}, chunks=_shuffle_partitions(spark))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values with at least 3% of posts (thread_id) or 5% of threads (board_id)."""
    posts, threads = table(spark, sf_dir, "posts"), table(spark, sf_dir, "threads")
    return heavy_keys(posts, "thread_id", 0.03, "posts.thread_id").unionByName(heavy_keys(threads, "board_id", 0.05, "threads.board_id"))


def p1_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_thread(table(spark, sf_dir, "posts")).withColumns({c: utc(c) for c in ("first_time", "last_time")})


def p1_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_board(table(spark, sf_dir, "threads"), table(spark, sf_dir, "posts"))


QUERIES = {"p1_found": p1_found, "p1_threads": p1_threads, "p1_boards": p1_boards}

SQL = {
    "p1_found": """
        SELECT 'posts.thread_id' AS field, thread_id AS key_value FROM posts WHERE thread_id IS NOT NULL
        GROUP BY thread_id HAVING count(*) >= 0.03 * (SELECT count(*) FROM posts)
        UNION ALL
        SELECT 'threads.board_id', CAST(board_id AS BIGINT) FROM threads WHERE board_id IS NOT NULL
        GROUP BY board_id HAVING count(*) >= 0.05 * (SELECT count(*) FROM threads)""",
    "p1_threads": """
        SELECT thread_id, count(DISTINCT post_id) AS posts, count(*) AS rows, min(creation_time) AT TIME ZONE 'UTC' AS first_time,
               max(creation_time) AT TIME ZONE 'UTC' AS last_time, max(local_idx) AS max_local_idx
        FROM posts GROUP BY thread_id""",
    "p1_boards": """
        WITH t AS (SELECT board_id, thread_id, count(*) AS n FROM threads GROUP BY ALL),
             p AS (SELECT thread_id, count(DISTINCT post_id) AS p FROM posts GROUP BY thread_id)
        SELECT board_id, count(thread_id) AS threads, CAST(sum(n) AS BIGINT) AS thread_rows, CAST(sum(coalesce(p, 0)) AS BIGINT) AS posts
        FROM t LEFT JOIN p USING (thread_id) GROUP BY board_id""",
}

"""The five archive tables as DataFrames, and the scans that read functions make of them.

The tables may hold rows fetched twice; `Archive.load` keeps one row per key, so that the constraints of
the model (unique ids) hold for everything built on it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.common import list_names, staged_root, table

SITES = T.StructType().add("site_id", "integer", False).add("name", "string", False).add("url", "string", False)
BOARDS = T.StructType().add("board_id", "integer", False).add("name", "string").add("pathpart", "string", False).add("site_id", "integer", False)
THREADS = T.StructType().add("thread_id", "long", False).add("board_thread_id", "long", False).add("creation_time", "timestamp", False).add("board_id", "integer", False)
POSTS = (
    T.StructType().add("post_id", "long", False).add("board_post_id", "long", False).add("creation_time", "timestamp", False).add("body", "string").add("subject", "string")
    .add("name", "string").add("email", "string").add("thread_id", "long", False).add("embed", "string").add("local_idx", "integer", False)
)
DIMENSION = T.StructType().add("width", "integer").add("height", "integer")
ATTACHMENTS = (
    T.StructType().add("attachment_id", "long", False).add("mimetype", "string", False).add("creation_time", "timestamp", False).add("sha256_hash", "string", False)
    .add("phash", "long").add("illegal", "boolean", False).add("post_id", "long", False).add("resolution", DIMENSION).add("file_extension", "string").add("thumb_extension", "string")
    .add("original_filename", "string").add("board_filename", "string", False).add("spoiler", "boolean", False).add("file_size_bytes", "integer").add("attachment_idx", "integer", False)
)
SCHEMAS = {"sites": SITES, "boards": BOARDS, "threads": THREADS, "posts": POSTS, "attachments": ATTACHMENTS}
KEYS = {"sites": ["site_id"], "boards": ["board_id"], "threads": ["thread_id"], "posts": ["post_id"], "attachments": ["attachment_id"]}
UNIQUE = {
    "sites": [["site_id"], ["name"]], "boards": [["board_id"], ["site_id", "pathpart"]], "threads": [["thread_id"], ["board_id", "board_thread_id"]],
    "posts": [["post_id"], ["thread_id", "board_post_id"], ["thread_id", "local_idx"]], "attachments": [["attachment_id"], ["post_id", "attachment_idx"]],
}


#: Columns that are equal in every copy of a row: with the key they are the groups, so filters on them reach the scan.
STABLE = {"threads": ["board_thread_id", "creation_time", "board_id"], "posts": ["board_post_id", "creation_time", "thread_id", "local_idx"], "attachments": ["post_id", "attachment_idx", "illegal"]}


def one_per_key(df: DataFrame, keys: list[str], stable: list[str] | None = None) -> DataFrame:
    """One row per key: copies are equal, except that a value (not a stable one) may be null in one of them."""
    groups = [*keys, *(stable or [])]
    rest = [c for c in df.columns if c not in groups]
    if not rest:
        return df.distinct()
    return df.groupBy(*groups).agg(*[F.max(c).alias(c) if df.schema[c].dataType.typeName() == "string" else F.first(c, ignorenulls=True).alias(c) for c in rest]).select(df.columns)


@dataclass
class Archive:
    sites: DataFrame
    boards: DataFrame
    threads: DataFrame
    posts: DataFrame
    attachments: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str, unique: bool = False) -> Archive:
        """The tables of a directory. With unique=True the keys are known to be unique and nothing is compared."""
        raw = {t: table(spark, sf_dir, t) for t in SCHEMAS}
        return cls(**{t: df if unique or t in ("sites", "boards") else one_per_key(df, KEYS[t], STABLE[t]) for t, df in raw.items()})

    @classmethod
    def stored(cls, spark: SparkSession, sf_dir: str) -> Archive:
        """The tables of a directory as of stored_table()."""
        return cls(**{t: stored_table(spark, sf_dir, t) for t in SCHEMAS})

    @classmethod
    def empty(cls, spark: SparkSession) -> Archive:
        return cls(**{t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()})


def _ordered(name: str, df: DataFrame) -> DataFrame:
    """A table as it is written: reads by time and thread skip row groups."""
    if name == "posts":
        return df.repartitionByRange("creation_time", "post_id").sortWithinPartitions("creation_time", "post_id")
    order = {"threads": ["creation_time"], "attachments": ["post_id"]}.get(name)
    return df.sortWithinPartitions(*order) if order else df


def write_archive(archive: Archive, path: str, mode: str = "errorifexists") -> None:
    """Write all tables beside each other."""
    for name in SCHEMAS:
        _ordered(name, getattr(archive, name)).write.mode(mode).parquet(f"{path}/{name}.parquet")


def stored_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a directory as it lies in an archive: repeats are removed once, when it is written, and posts lie in order of time.

    It is written at the first use in an application, into the folder of staged tables, and read by the later ones.
    """
    if name in ("sites", "boards"):
        return table(spark, sf_dir, name)
    path = f"{staged_root(spark)}/archive-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    if "_SUCCESS" not in list_names(spark, f"{path}/{name}.parquet"):
        raw = table(spark, sf_dir, name)
        keys = [c for c in STABLE[name] if c in raw.columns]
        _ordered(name, one_per_key(raw, KEYS[name], keys)).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return table(spark, path, name)


def statistics(df: DataFrame) -> DataFrame:
    """(column_name, rows, nulls, distinct_values) of every column of a table, in one pass: what an optimizer plans by."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("struct", "array", "map")]
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in plain], *[F.count_distinct(c).alias(f"d_{c}") for c in plain])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("rows"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in plain])))


def rows_as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, in the order of the columns; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def all_sites(archive: Archive) -> DataFrame:
    return archive.sites


def site_boards(archive: Archive, site_id: int) -> DataFrame:
    return archive.boards.where(F.col("site_id") == site_id)


def threads_of_board(archive: Archive, board_id: int, board_thread_ids: DataFrame) -> DataFrame:
    """Threads of a board whose numbers are given as a DataFrame; an empty one gives no rows."""
    return archive.threads.where(F.col("board_id") == board_id).join(board_thread_ids.select("board_thread_id").distinct(), "board_thread_id", "left_semi")


def attachments_of_posts(archive: Archive, post_ids: DataFrame) -> DataFrame:
    """Attachments of any number of posts in one semi-join; a client's chunking has no counterpart."""
    return archive.attachments.join(post_ids.select("post_id"), "post_id", "left_semi")


def get_posts(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """Posts by (thread_id, board_post_id); keys that do not exist give nothing, repeated keys nothing more."""
    return posts.join(keys.select("thread_id", "board_post_id"), ["thread_id", "board_post_id"], "left_semi")


def max_local_idx(posts: DataFrame, thread_ids: DataFrame) -> DataFrame:
    """(thread_id, max_idx) of the given threads that have posts."""
    return posts.join(thread_ids.select("thread_id"), "thread_id", "left_semi").groupBy("thread_id").agg(F.max("local_idx").alias("max_idx"))


def post_by_board_path(archive: Archive, pathpart: str, board_post_id: int) -> DataFrame:
    """Posts with a number on the boards with a path."""
    boards = archive.boards.where(F.col("pathpart") == pathpart).select("board_id")
    threads = archive.threads.join(boards, "board_id", "left_semi").select("thread_id")
    return archive.posts.where(F.col("board_post_id") == board_post_id).join(threads, "thread_id", "left_semi")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count: what a unique constraint would refuse."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cascade(archive: Archive, boards: DataFrame) -> Archive:
    """The archive without the given boards (board_id) and everything below them."""
    keep_boards = archive.boards.join(boards.select("board_id"), "board_id", "left_anti")
    gone_threads = archive.threads.join(boards.select("board_id"), "board_id", "left_semi").select("thread_id")
    gone_posts = archive.posts.join(gone_threads, "thread_id", "left_semi").select("post_id")
    return Archive(archive.sites, keep_boards, archive.threads.join(gone_threads, "thread_id", "left_anti"), archive.posts.join(gone_posts, "post_id", "left_anti"), archive.attachments.join(gone_posts, "post_id", "left_anti"))

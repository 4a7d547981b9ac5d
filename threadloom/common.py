"""Table access and staging shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data directory; Catalyst prunes its columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir of the session.

    Where that is unset, a session on one machine (tests) gets a folder of its own; on a cluster it is an
    error, since the folder of one machine would lose what the executors write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("threadloom.local.work", None) or tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("threadloom.local.work", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{staged_root(spark)}/{tag}-{uuid.uuid4().hex}"


def staged_root(spark: SparkSession) -> str:
    """The folder of all staged tables of this application."""
    return f"{work_root(spark)}/threadloom/{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Remove all staged tables of this application; for its end, when no result is read any more."""
    drop_staged(spark, staged_root(spark))


def stage(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: what was computed survives the loss of any executor, and is read, not
    computed again, by each later use, with column pruning. `unstage` removes it when nothing reads it any more.
    options: those of Spark's writer.
    """
    path = new_path(df.sparkSession, tag)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Remove tables of stage() that no later step reads."""
    for df in staged:
        drop_staged(df.sparkSession, df._staged)


def _path(spark: SparkSession, path: str):
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hp


def drop_staged(spark: SparkSession, *paths: str) -> None:
    """Remove folders of any file system Spark can reach."""
    for p in paths:
        fs, hp = _path(spark, p)
        fs.delete(hp, True)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; empty where there is none."""
    fs, hp = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(hp)) if fs.exists(hp) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file of any file system Spark can reach."""
    fs, hp = _path(spark, path)
    stream = fs.open(hp)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file whole or not at all; an error where it exists, so of two writers one fails."""
    fs, hp = _path(spark, path)
    _, part = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(hp) or not fs.rename(part, hp):
        fs.delete(part, False)
        raise FileExistsError(path)


def moment(as_of: datetime | str) -> Column:
    """A moment as a timestamp without zone, in UTC: one with an offset is moved to UTC, one without is UTC already."""
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(re.sub(r"\s+(?=(?:[+-]\d\d(?::?\d\d)?|Z)$)", "", as_of.strip()))
    if as_of.tzinfo:
        as_of = as_of.astimezone(UTC).replace(tzinfo=None)
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def utc(column: str | Column) -> Column:
    """A time of either timestamp type as a timestamp without zone, in UTC."""
    return F.col(column).cast("timestamp_ntz") if isinstance(column, str) else column.cast("timestamp_ntz")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in `order` (the DISTINCT ON of other engines).

    A window with row_number = 1 plans as WindowGroupLimit: rows beyond the first are dropped
    before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

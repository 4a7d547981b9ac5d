"""Snapshots: directories of JSON catalogs, threads and media files.

Layout: <root>/<board>/catalog.json, <root>/<board>/res/<number>.json, media under <root>. All files of a
kind are read by one scan, thread files some hundred a task; media are opened by the paths that posts give. A file is taken as a whole or not at all: one that is not JSON, has a value of
the wrong type or lacks a required field in any element gives no rows, and a row in `rejected`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from threadloom.common import stage
from threadloom.functions import media

#: Directories that hold no board.
NO_BOARDS = ("sfw", "alt", "overboard")
#: What opening a file counts as, in bytes, where files are many and small. Spark's own 4 MB make a task of every few files.
FILE_COST = 64 * 1024

FILE = "id string, mime string, ext string, h int, w int, fsize int, filename string, spoiler boolean, md5 string, file_path string, thumb_path string"
POST = (
    "no bigint, com string, name string, sub string, email string, time bigint, omitted_posts int, omitted_images int, sticky int, locked int, cyclical string, last_modified bigint, "
    f"embed string, board string, files array<struct<{FILE.replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean')}>>, resto bigint, unique_ips int, "
    "filename string, h int, w int, ext string, tim string, fsize int, spoiler int"
)
THREAD = POST.replace("embed string, ", "").split(", filename string, h int")[0] + ", capcode string, replies int, images int"


def _struct(ddl: str) -> str:
    """A column list as a struct type."""
    depth, out, part = 0, [], ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += c
    return f"struct<{', '.join(out)}>"


CATALOG_SCHEMA = f"page int, threads array<{_struct(THREAD)}>, _bad string"
THREAD_SCHEMA = f"posts array<{_struct(POST)}>, _bad string"
REQUIRED = ("no", "time", "last_modified", "board", "resto")
REQUIRED_FILE = ("id", "ext", "fsize", "filename", "md5", "file_path", "thumb_path")


@dataclass(frozen=True)
class Settings:
    """What an ingest needs to know; read from a JSON file of these fields, others are ignored."""

    backup_read_root: str
    media_root_path: str
    site_name: str
    site_url: str

    @classmethod
    def read(cls, path: str) -> Settings:
        given = json.loads(Path(path).read_text())
        missing = [f for f in cls.__dataclass_fields__ if f not in given]
        if missing:
            raise ValueError(f"settings lack {', '.join(missing)}")
        return cls(**{f: given[f] for f in cls.__dataclass_fields__})


@contextmanager
def _small_files(spark: SparkSession) -> Iterator[None]:
    """Scans that run inside take hundreds of small files a task."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(FILE_COST))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _json(spark: SparkSession, schema: str, path: str, names: str = "*") -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", names)
    try:
        df = reader.json(path)
    except AnalysisException:  # no such file in the whole snapshot
        df = spark.createDataFrame([], schema).withColumn("path", F.lit(""))
        return df.withColumn("board_dir", F.lit(""))
    path_col = F.col("_metadata.file_path")
    return df.select("*", path_col.alias("path"))


def _board_of(pattern: str) -> Column:
    return F.url_decode(F.regexp_extract("path", pattern, 1))


def _complete(elements: Column, files: bool = True) -> Column:
    """Has every element its required fields, and every file of it those of files?"""

    def element(p: Column) -> Column:
        ok = p.isNotNull()
        for f in REQUIRED:
            ok = ok & p[f].isNotNull()
        if not files:
            return ok

        def one(f: Column) -> Column:
            good = f.isNotNull()
            for r in REQUIRED_FILE:
                good = good & f[r].isNotNull()
            return good

        return ok & F.coalesce(F.forall(p["files"], one), F.lit(True))

    return F.coalesce(F.forall(elements, element), F.lit(False))


def _split(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of good files, paths of the others): one bad row rejects its whole file."""
    bad = df.where(~good).select("path").distinct()
    return df.join(bad, "path", "left_anti"), bad


def read_catalogs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(threads: board_dir and the fields of a catalog thread; rejected: path)."""
    df = _json(spark, CATALOG_SCHEMA, f"{root}/*/catalog.json").withColumn("board_dir", _board_of(r"([^/]+)/catalog\.json$"))
    df = df.where(~F.col("board_dir").isin(*NO_BOARDS))
    good, bad = _split(df, F.col("_bad").isNull() & F.col("page").isNotNull() & (F.col("threads").isNull() | _complete(F.col("threads"))))
    return good.select("board_dir", F.inline("threads")), bad


def boards_of(spark: SparkSession, root: str) -> DataFrame:
    """board_dir of the directories with a catalog, without reading any."""
    df = spark.read.format("binaryFile").load(f"{root}/*/catalog.json").select("path")
    df = df.select(_board_of(r"([^/]+)/catalog\.json$").alias("board_dir"))
    return df.where(~F.col("board_dir").isin(*NO_BOARDS)).distinct()


def parsed_posts(spark: SparkSession, root: str) -> DataFrame:
    """Every thread file read once, staged: path, board_dir, thread_no, _ok (is it good?) and the fields of a post; a file that is bad or gives no post is one row without a post.

    The folders are listed, not the files one by one, and the result is written, so later steps read neither the names nor the JSON again.
    """
    df = _json(spark, THREAD_SCHEMA, f"{root}/*/res", "*.json")
    df = df.withColumn("board_dir", _board_of(r"([^/]+)/res/[^/]+\.json$")).withColumn("thread_no", F.regexp_extract("path", r"/res/(\d+)\.json$", 1).try_cast("bigint"))
    df = df.withColumn("_ok", F.col("_bad").isNull() & _complete(F.col("posts")))
    df = df.select("path", "board_dir", "thread_no", "_ok", F.inline_outer(F.when(F.col("_ok"), F.col("posts"))))
    with _small_files(spark):
        return stage(df, "threads-parsed")


def posts_of(spark: SparkSession, parsed: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(posts: board_dir, thread_no and the fields of a post; rejected: path) of parsed_posts()."""
    bad = parsed.where("not _ok").select("path").distinct()
    good = parsed.where("_ok and no is not null")
    # only a file whose text is a list of threads has good rows beside bad ones
    if not (mixed := good.select("path").join(bad, "path", "left_semi")).isEmpty():
        good = good.join(mixed.distinct(), "path", "left_anti")
    # a file whose text is an empty list gives the reader no row at all
    try:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/*/res").select(F.col("_metadata.file_path").alias("path"))
    except AnalysisException:  # no such folder in the whole snapshot
        listed = parsed.select("path").limit(0)
    with _small_files(spark):
        empty = stage(listed.join(parsed.select("path"), "path", "left_anti"), "threads-empty")
    return good.drop("path", "_ok"), bad.unionByName(empty)


def read_posts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(posts: board_dir, thread_no and the fields of a post; rejected: path)."""
    return posts_of(spark, parsed_posts(spark, root), root)


def files_of(posts: DataFrame) -> DataFrame:
    """One row per file of a post: its place from 1 among the post's files, paths below the root, names, size.

    Files whose path ends in "deleted" go after they were counted, so places may have gaps. A post without
    a list of files but with the old single-file fields has that one.
    """
    keep = ["board_dir", "thread_no", "no", "time"]
    listed = posts.where("files is not null").select(*keep, F.posexplode("files").alias("i", "f"))
    listed = listed.select(
        *keep, (F.col("i") + 1).alias("attachment_idx"), "f.file_path", "f.thumb_path", F.coalesce("f.mime", media.mime_of(F.col("f.ext"))).alias("mimetype"),
        media.bare(F.col("f.ext")).alias("file_extension"), media.bare(media.extension(F.col("f.thumb_path"))).alias("thumb_extension"), F.col("f.filename").alias("original_filename"),
        F.col("f.id").alias("board_filename"), F.coalesce("f.spoiler", F.lit(False)).alias("spoiler"), F.col("f.fsize").alias("file_size_bytes"), _resolution(F.col("f.w"), F.col("f.h")),
    )
    old = posts.where("files is null and tim is not null and ext is not null and filename is not null and fsize is not null")
    old = old.select(
        *keep, F.lit(1).alias("attachment_idx"), F.concat(F.lit("/"), "board", F.lit("/src/"), "tim", "ext").alias("file_path"), F.concat(F.lit("/"), "board", F.lit("/thumb/"), "tim", "ext").alias("thumb_path"),
        media.mime_of(F.col("ext")).alias("mimetype"), media.bare(F.col("ext")).alias("file_extension"), F.lit("png").alias("thumb_extension"), F.col("filename").alias("original_filename"),
        F.col("tim").alias("board_filename"), (F.coalesce("spoiler", F.lit(0)) > 0).alias("spoiler"), F.col("fsize").alias("file_size_bytes"), _resolution(F.col("w"), F.col("h")),
    )
    return listed.unionByName(old).where(~F.col("file_path").endswith("deleted"))


def _resolution(w: Column, h: Column) -> Column:
    """Both or nothing."""
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("width"), h.alias("height"))).alias("resolution")


def _below(path: str | None) -> bool:
    """Does a path stay below the root it is appended to?"""
    return bool(path) and path[0] == "/" and not {"", ".", ".."} & set(path[1:].split("/"))


def with_hashes(files: DataFrame, root: str) -> DataFrame:
    """The rows whose file (file_path, below the root) exists, with sha256_hash of its contents.

    Executors open the named files and no other, so neither a list of the snapshot's media is made nor a file read
    that no row needs. The root is a folder that all executors mount, or a URI that Arrow can open.
    """
    base = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = pafs.FileSystem.from_uri(base) if "://" in base else (None, base)

        def digest(path: str | None) -> str | None:
            if not _below(path):
                return None
            try:
                with open(top + path, "rb") if where is None else where.open_input_file(top + path) as f:
                    return hashlib.file_digest(f, "sha256").hexdigest()
            except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                return None

        for batch in batches:
            hashes = pa.array([digest(p) for p in batch.column("file_path").to_pylist()], pa.string())
            yield batch.append_column("sha256_hash", hashes).filter(hashes.is_valid())

    # an explicit number, so that small rows whose files are long to read are not put into few tasks
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "file_path").mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("sha256_hash", T.StringType())]))

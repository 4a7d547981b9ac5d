"""Queries on ingest: a snapshot of all tables is written as a site would serve it, ingested, and compared with the tables.

The snapshot has a directory for each board, named by its id, with a catalog of pages of its threads, a
JSON file for each thread with all its posts, and the media. So that every rule of an ingest occurs: a file
of unknown size is listed as deleted; the only file of a post without a thumbnail is given in the old
single-file fields; a file without a perceptual hash does not exist on disk; every board has a thread file
that breaks off. The contents of a media file are its stored hash, so the ingested hash is that of a hash.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.common import list_names, staged_root, table, utc, write_text
from threadloom.functions import media
from threadloom.operators.ingest import copy_plan, ingest
from threadloom.plans.activity import PE, T
from threadloom.plans.writing import _EXT, _MIMES
from threadloom.sources import snapshot
from threadloom.sources.archive import KEYS, STABLE, Archive, one_per_key

SITE, URL, MEDIA = "snapshot.example", "https://snapshot.example", "/media"
PAGE_THREADS = 100
#: A moment that divides the posts into two snapshots.
FIRST_UNTIL = "2013-06-01 00:00:00"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """(post_id, f: the file as JSON has it, place, path, old: given in the old fields, sha: contents or null)."""
    a = one_per_key(table(spark, d, "attachments"), KEYS["attachments"], STABLE["attachments"])
    of_post = Window.partitionBy("post_id")
    ext, id_ = F.coalesce(media.bare(F.col("file_extension")), F.lit("")), F.col("attachment_id").cast("string")
    a = a.withColumn("of_post", F.count("*").over(of_post)).withColumn("place", F.row_number().over(of_post.orderBy("attachment_idx", "attachment_id")))
    old = (F.col("of_post") == 1) & F.col("thumb_extension").isNull() & F.col("file_size_bytes").isNotNull() & (ext != "")
    return a.select("post_id", "place", old.alias("old"), id_.alias("id"), ext.alias("ext"), "mimetype", "file_size_bytes", F.coalesce("original_filename", F.lit("")).alias("filename"), "spoiler", "resolution", "sha256_hash", "phash")


def _snapshot(spark: SparkSession, d: str, until: str | None = None) -> str:
    """The directory of the snapshot of all posts (before a time), written once an application."""
    root = f"{staged_root(spark)}/snapshot-{hashlib.sha256(f'{d} {until}'.encode()).hexdigest()[:16]}"
    if "done" in list_names(spark, root):
        return root
    folder = Path(root.removeprefix("file://").removeprefix("file:"))
    threads = one_per_key(table(spark, d, "threads"), KEYS["threads"], STABLE["threads"])
    posts = one_per_key(table(spark, d, "posts"), KEYS["posts"], STABLE["posts"])
    if until:
        posts = posts.where(utc("creation_time") < F.lit(until).cast("timestamp_ntz"))
    seconds = F.unix_seconds("creation_time")
    board = F.col("board_id").cast("string")
    head = [F.lit(1).alias("last_modified"), F.lit(0).cast("bigint").alias("resto")]

    pages = threads.select("board_id", F.floor(F.row_number().over(Window.partitionBy("board_id").orderBy("board_thread_id")) / PAGE_THREADS).cast("int").alias("page"), F.struct(F.col("board_thread_id").alias("no"), seconds.alias("time"), board.alias("board"), *head).alias("t"))
    pages = pages.groupBy("board_id", "page").agg(F.collect_list("t").alias("threads")).groupBy("board_id").agg(F.to_json(F.collect_list(F.struct("page", "threads"))).alias("text"))
    catalogs = pages.select(F.concat(board, F.lit("/catalog.json")).alias("path"), "text")

    f = _files(spark, d).join(posts.select("post_id", "thread_id"), "post_id").join(threads.select("thread_id", "board_id"), "thread_id")
    name = F.concat(F.col("id"), F.when(F.col("ext") != "", F.concat(F.lit("."), F.col("ext"))).otherwise(""))
    path = F.when(F.col("file_size_bytes").isNull(), F.concat(F.lit("/"), board, F.lit("/src/deleted"))).otherwise(F.concat(F.lit("/"), board, F.lit("/src/"), name))
    f = f.withColumn("file_path", path)
    w, h = F.col("resolution.width").alias("w"), F.col("resolution.height").alias("h")
    one = F.struct("place", F.struct("id", F.col("mimetype").alias("mime"), "ext", w, h, F.coalesce("file_size_bytes", F.lit(0)).alias("fsize"), "filename", "spoiler", F.lit("").alias("md5"), "file_path", F.concat(F.lit("/"), board, F.lit("/thumb/"), "id", F.lit(".png")).alias("thumb_path")).alias("f"))
    listed = f.where("not old").groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["f"]).alias("files"))
    single = f.where("old").select("post_id", F.col("id").alias("tim"), F.concat(F.lit("."), "ext").alias("ext"), "filename", F.col("file_size_bytes").alias("fsize"), F.col("spoiler").cast("int").alias("spoiler"), w, h)
    rows = posts.join(threads.select("thread_id", "board_thread_id", "board_id"), "thread_id").join(listed, "post_id", "left").join(single, "post_id", "left")
    post = F.struct(F.col("board_post_id").alias("no"), F.col("body").alias("com"), "name", F.col("subject").alias("sub"), "email", seconds.alias("time"), "embed", board.alias("board"), *head, "files", "tim", "ext", "filename", "fsize", "spoiler", "w", "h")
    of_threads = rows.groupBy("board_id", "board_thread_id").agg(F.to_json(F.struct(F.collect_list(post).alias("posts"))).alias("text"))
    of_threads = of_threads.select(F.concat(board, F.lit("/res/"), "board_thread_id", F.lit(".json")).alias("path"), "text")
    broken = threads.select("board_id").distinct().select(F.concat(board, F.lit("/res/0.json")).alias("path"), F.lit('{"posts": [{"no"').alias("text"))
    there = f.where("phash is not null and file_size_bytes is not null").select(F.expr("substring(file_path, 2)").alias("path"), F.col("sha256_hash").alias("text"))

    def write(part) -> None:
        for r in part:
            target = folder / r["path"]
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(r["text"], encoding="utf-8")

    catalogs.unionByName(of_threads).unionByName(broken).unionByName(there).foreachPartition(write)
    write_text(spark, f"{root}/done", "")
    return root


def _settings(root: str) -> snapshot.Settings:
    return snapshot.Settings(root.removeprefix("file://").removeprefix("file:"), MEDIA, SITE, URL)


def _ingested(spark: SparkSession, d: str, until: list[str | None] = (None,)):
    archive, reports = Archive.empty(spark), []
    for u in until:
        archive, report = ingest(spark, _settings(_snapshot(spark, d, u)), archive, strict=False)
        reports.append(report)
    return archive, reports


def _with_places(archive: Archive) -> DataFrame:
    """Posts with site, board and thread number."""
    places = archive.threads.select("thread_id", "board_thread_id", "board_id").join(archive.boards.select("board_id", "pathpart", "site_id"), "board_id").join(archive.sites.select("site_id", F.col("name").alias("site_name"), "url"), "site_id")
    return archive.posts.join(places, "thread_id")


def _posts(spark: SparkSession, d: str) -> DataFrame:
    archive, _ = _ingested(spark, d)
    return _with_places(archive).select("site_name", "url", "pathpart", "board_thread_id", "board_post_id", utc("creation_time").alias("creation_time"), "body", "subject", "name", "email", "embed", F.col("local_idx").cast("bigint").alias("local_idx"))


def _threads(spark: SparkSession, d: str) -> DataFrame:
    archive, _ = _ingested(spark, d)
    return archive.threads.join(archive.boards, "board_id").select("pathpart", "board_thread_id", utc("creation_time").alias("creation_time"))


def _attachments(spark: SparkSession, d: str) -> DataFrame:
    archive, _ = _ingested(spark, d)
    files = archive.attachments.drop("creation_time").join(_with_places(archive).select("post_id", "pathpart", "board_post_id"), "post_id")
    return files.select("pathpart", "board_post_id", "board_filename", "mimetype", "sha256_hash", "illegal", F.col("resolution.width").alias("width"), F.col("resolution.height").alias("height"), "file_extension", "thumb_extension", "original_filename", "spoiler", "file_size_bytes", F.col("attachment_idx").cast("bigint").alias("attachment_idx"))


def _again(spark: SparkSession, d: str) -> DataFrame:
    """Rows added by an ingest, and by the same one again; files rejected; checksum of the posts' numbers."""
    _, reports = _ingested(spark, d, [None, None])
    rows = [(i, t, n) for i, r in enumerate(reports) for t, n in [*r.added.items(), ("rejected", r.rejected_count), ("sum_board_post_id", r.sum_board_post_id)]]
    return spark.createDataFrame(rows, "run int, what string, n long")


def _incremental(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals after a snapshot of the older posts and then one of all: posts that came late follow, whatever their number."""
    archive, _ = _ingested(spark, d, [FIRST_UNTIL, None])
    return _with_places(archive).select("pathpart", "board_thread_id", "board_post_id", F.col("local_idx").cast("bigint").alias("local_idx"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    """From where to where the media of a snapshot are copied; sources below the snapshot."""
    root = _settings(_snapshot(spark, d)).backup_read_root
    posts, _ = snapshot.read_posts(spark, root)
    plan = copy_plan(snapshot.files_of(posts), _settings(root))
    return plan.select(F.expr(f"substring(source, {len(root) + 1})").alias("source"), "target")


QUERIES = {"ingest_posts": _posts, "ingest_threads": _threads, "ingest_attachments": _attachments, "ingest_again": _again, "ingest_incremental": _incremental, "ingest_copies": _copies}

_S = "date_trunc('second', {c})"
_POSTS = f"""WITH {PE}, {T}, x AS (SELECT pe.*, t.board_id, t.board_thread_id FROM pe JOIN t ON t.thread_id = pe.thread_id)"""
_FILES = f"""u AS (SELECT attachment_id, any_value(post_id) AS post_id, max(mimetype) AS mimetype, max(sha256_hash) AS sha256_hash, any_value(phash) AS phash, any_value(resolution) AS resolution, max(file_extension) AS file_extension,
        max(thumb_extension) AS thumb_extension, max(original_filename) AS original_filename, any_value(spoiler) AS spoiler, any_value(file_size_bytes) AS file_size_bytes, any_value(attachment_idx) AS attachment_idx FROM attachments GROUP BY attachment_id),
        v AS (SELECT u.*, coalesce({_EXT.format(c='u.file_extension')}, '') AS ext, count(*) OVER (PARTITION BY u.post_id) AS n, row_number() OVER (PARTITION BY u.post_id ORDER BY attachment_idx, attachment_id) AS place,
              CAST(x.board_id AS VARCHAR) AS pathpart, x.board_thread_id, x.board_post_id FROM u JOIN x ON x.post_id = u.post_id),
        f AS (SELECT *, n = 1 AND thumb_extension IS NULL AND ext <> '' AS single, CAST(attachment_id AS VARCHAR) AS id FROM v WHERE file_size_bytes IS NOT NULL)"""

SQL = {
    "ingest_posts": _POSTS + f"""SELECT '{SITE}' AS site_name, '{URL}' AS url, CAST(board_id AS VARCHAR) AS pathpart, board_thread_id, board_post_id, {_S.format(c='creation_time')} AS creation_time, body, subject, name, email, embed,
        row_number() OVER (PARTITION BY thread_id ORDER BY board_post_id) AS local_idx FROM x""",
    "ingest_threads": f"WITH {T} SELECT CAST(board_id AS VARCHAR) AS pathpart, board_thread_id, {_S.format(c='creation_time')} AS creation_time FROM t",
    "ingest_attachments": _POSTS + f""", {_FILES} SELECT pathpart, board_post_id, id AS board_filename, CASE WHEN single THEN CASE ext {_MIMES} ELSE '{media.DEFAULT_MIME}' END ELSE mimetype END AS mimetype, sha256(sha256_hash) AS sha256_hash, false AS illegal,
        CASE WHEN resolution.width IS NOT NULL AND resolution.height IS NOT NULL THEN resolution.width END AS width, CASE WHEN resolution.width IS NOT NULL AND resolution.height IS NOT NULL THEN resolution.height END AS height,
        nullif(ext, '') AS file_extension, 'png' AS thumb_extension, coalesce(original_filename, '') AS original_filename, coalesce(spoiler, false) AS spoiler, file_size_bytes, CASE WHEN single THEN 1 ELSE place END AS attachment_idx FROM f WHERE phash IS NOT NULL""",
    "ingest_again": _POSTS + f""", {_FILES}, c AS (SELECT 'sites' AS what, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'boards', count(DISTINCT board_id) FROM t UNION ALL SELECT 'threads', count(*) FROM t UNION ALL SELECT 'posts', count(*) FROM x UNION ALL SELECT 'attachments', count(*) FROM f WHERE phash IS NOT NULL),
        s AS (SELECT 'rejected' AS what, count(DISTINCT board_id) AS n FROM t UNION ALL SELECT 'sum_board_post_id', CAST(sum(board_post_id) AS BIGINT) FROM x)
        SELECT 0 AS run, what, n FROM c UNION ALL SELECT 1, what, 0 FROM c UNION ALL SELECT 0, what, n FROM s UNION ALL SELECT 1, what, n FROM s""",
    "ingest_incremental": _POSTS + f" SELECT CAST(board_id AS VARCHAR) AS pathpart, board_thread_id, board_post_id, row_number() OVER (PARTITION BY thread_id ORDER BY creation_time >= TIMESTAMP '{FIRST_UNTIL}', board_post_id) AS local_idx FROM x",
    "ingest_copies": _POSTS + f""", {_FILES}, g AS (SELECT *, CASE WHEN ext <> '' THEN '.' || ext ELSE '' END AS dot FROM f)
        SELECT '/' || pathpart || '/src/' || id || dot AS source, '{MEDIA}/{SITE}/' || pathpart || '/' || board_thread_id || '/' || id || dot AS target FROM g
        UNION ALL SELECT '/' || pathpart || '/thumb/' || id || CASE WHEN single THEN dot ELSE '.png' END, '{MEDIA}/{SITE}/' || pathpart || '/' || board_thread_id || '/thumbnail_' || id || '.png' FROM g""",
}

"""Queries on writing: missing rows, upserts, ordinals, ids, field mappings. Each with its SQL.

The incoming batches of posts are all batches of `incoming_posts`, with their numbers in every form they are
written in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.common import table, utc
from threadloom.functions import media
from threadloom.functions.text import WIDE, number_of
from threadloom.functions.timefn import age_since
from threadloom.operators import upsert
from threadloom.plans.activity import AS_OF, P, T, _archive, _narrow
from threadloom.sources.archive import cascade, get_posts, max_local_idx, one_per_key, unique_violations

KEYS = ["thread_id", "board_post_id"]
#: Incoming records as rows of posts: all whose number can be read.
I = f"""i AS (SELECT thread_id, CAST(n AS BIGINT) AS board_post_id, min(body) AS body, min(incoming_id) AS incoming_id FROM (SELECT *, regexp_extract(trim(translate(board_post_id, '{WIDE[0]}', '{WIDE[1]}')), '(?i)^(?:(?:no[.]?|>>|#) *)?0*([0-9]{{1,18}})(?:[.]0*)?$', 1) AS n FROM incoming_posts) WHERE n <> '' GROUP BY 1, 2)"""  # noqa: E741


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "incoming_posts").withColumn("board_post_id", number_of(F.col("board_post_id"))).where("board_post_id is not null")
    return rows.groupBy(*KEYS).agg(F.min("body").alias("body"), F.min("incoming_id").alias("incoming_id"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, *KEYS)


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch for upserts: every stored post, its embed changed, removed or kept, and new ones."""
    kind = F.col("post_id") % 4
    embed = F.when(kind == 0, F.lit("https://tube.example/new")).when(kind != 2, F.col("embed"))
    return _stored(spark, d).select(*KEYS, embed.alias("embed")).unionByName(_incoming(spark, d).select(*KEYS, F.lit(None).cast("string").alias("embed")))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, *KEYS, "embed")


E = """e AS (SELECT post_id, any_value(thread_id) AS thread_id, any_value(board_post_id) AS board_post_id, max(embed) AS embed FROM posts GROUP BY post_id),
       n AS (SELECT thread_id, board_post_id, CASE post_id % 4 WHEN 0 THEN 'https://tube.example/new' WHEN 2 THEN NULL ELSE embed END AS embed FROM e
             UNION ALL SELECT thread_id, board_post_id, NULL FROM i)"""


def _applied(spark: SparkSession, d: str) -> DataFrame:
    old = _stored(spark, d)
    return upsert.apply_embed(old, upsert.embed_changed(_batch(spark, d), old)).select("post_id", "embed")


def _renumbered(spark: SparkSession, d: str) -> DataFrame:
    return upsert.renumber(_narrow(spark, d, *KEYS), "thread_id", ["board_post_id", "post_id"], "idx").select("post_id", F.col("idx").cast("bigint").alias("idx"))


def _attachment_idx(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "attachments").select("attachment_id", "post_id").distinct()
    return upsert.renumber(files, "post_id", ["attachment_id"], "idx").select("attachment_id", F.col("idx").cast("bigint").alias("idx"))


def _new_ids(spark: SparkSession, d: str) -> DataFrame:
    """What ids the missing posts get: as many different ones as rows, following the greatest."""
    start = table(spark, d, "posts").agg(F.max("post_id")).first()[0] or 0
    new = upsert.assign_ids(upsert.missing(_incoming(spark, d), _keys(spark, d), KEYS), "post_id", KEYS, start)
    return new.agg(F.count("*").alias("rows"), F.count_distinct("post_id").alias("ids"), F.min("post_id").alias("least"), F.max("post_id").alias("greatest"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    a = _archive(spark, d)
    files = one_per_key(table(spark, d, "attachments").select("attachment_id", "post_id", "board_filename", "file_extension", "thumb_extension"), ["attachment_id"])
    rows = files.join(_narrow(spark, d, "thread_id"), "post_id").join(a.threads.select("thread_id", "board_thread_id", "board_id"), "thread_id").join(a.boards.select("board_id", "pathpart", "site_id"), "board_id")
    rows = rows.join(a.sites.select("site_id", F.col("name").alias("site")), "site_id")
    where = [F.lit("media"), F.col("site"), F.regexp_replace("pathpart", "/+$", ""), F.col("board_thread_id"), F.col("board_filename")]
    return rows.select("attachment_id", media.media_path(*where, F.col("file_extension")).alias("path"), media.media_path(*where, F.col("thumb_extension"), thumbnail=True).alias("thumb_path"))


def _extensions(spark: SparkSession, d: str) -> DataFrame:
    files = one_per_key(table(spark, d, "attachments").select("attachment_id", "original_filename", "file_extension"), ["attachment_id"])
    ext = F.coalesce(media.bare(F.col("file_extension")), media.bare(media.extension(F.coalesce("original_filename", F.lit("")))))
    return files.select("attachment_id", ext.alias("ext"), media.mime_of(ext).alias("mime"))


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    a = _archive(spark, d)
    left = cascade(a, a.boards.where(F.col("board_id") % 3 == 0))
    rows = [("boards", left.boards), ("threads", left.threads.select("thread_id")), ("posts", left.posts.select("post_id")), ("attachments", left.attachments.select("attachment_id"))]
    out = None
    for name, df in rows:
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_EXT = "nullif(regexp_replace(lower(trim({c})), '^[.]+|[.]+$', '', 'g'), '')"
_MIMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in media.MIME.items())
_FILES = "a AS (SELECT attachment_id, any_value(post_id) AS post_id, max(board_filename) AS board_filename, max(file_extension) AS file_extension, max(thumb_extension) AS thumb_extension, max(original_filename) AS original_filename FROM attachments GROUP BY attachment_id)"


QUERIES = {
    "get_posts_by_key": lambda s, d: get_posts(_keys(s, d), _incoming(s, d)),
    "missing_posts": lambda s, d: upsert.missing(_incoming(s, d), _keys(s, d), KEYS).select(*KEYS, "incoming_id"),
    "insert_ignore": lambda s, d: upsert.insert_ignore(_incoming(s, d), _keys(s, d), KEYS).agg(F.count("*").alias("rows")),
    "upsert_ids_v1": lambda s, d: upsert.upsert_ids(_batch(s, d), _stored(s, d), 1),
    "upsert_ids_v3": lambda s, d: upsert.upsert_ids(_batch(s, d), _stored(s, d), 3),
    "embed_changed": lambda s, d: upsert.embed_changed(_batch(s, d), _stored(s, d)),
    "update_from": lambda s, d: _applied(s, d),
    "max_local_idx": lambda s, d: max_local_idx(_narrow(s, d, "thread_id", "local_idx"), _incoming(s, d)),
    "assign_local_idx": lambda s, d: upsert.next_local_idx(upsert.missing(_incoming(s, d), _keys(s, d), KEYS).select(*KEYS), _narrow(s, d, "thread_id", "local_idx")).select(*KEYS, "local_idx"),
    "new_ids": lambda s, d: _new_ids(s, d),
    "renumber_posts": _renumbered,
    "attachment_idx": _attachment_idx,
    "unique_violations": lambda s, d: unique_violations(table(s, d, "posts").select(*KEYS), KEYS),
    "cascade_delete": _cascade,
    "media_paths": _paths,
    "file_types": _extensions,
    "zigzag_roundtrip": lambda s, d: table(s, d, "attachments").where("phash is not null").select("phash", media.zigzag_encode(F.col("phash")).alias("bits"), media.zigzag_decode(media.zigzag_encode(F.col("phash"))).alias("again")).distinct(),
    "doc_sha256": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")),
    "props_json_extract": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")),
    "age_epoch": lambda s, d: _narrow(s, d, "creation_time").select("post_id", F.round(age_since(F.lit(AS_OF).cast("timestamp_ntz"), utc("creation_time")), 6).alias("age_s")),
    "epoch_times": lambda s, d: _narrow(s, d, "creation_time").select("post_id", F.unix_seconds(F.col("creation_time").cast("timestamp")).alias("epoch_s")),
}

SQL = {
    "get_posts_by_key": f"WITH {P}, {I} SELECT post_id, thread_id, board_post_id FROM p WHERE (thread_id, board_post_id) IN (SELECT thread_id, board_post_id FROM i)",
    "missing_posts": f"WITH {P}, {I} SELECT thread_id, board_post_id, incoming_id FROM i WHERE (thread_id, board_post_id) NOT IN (SELECT thread_id, board_post_id FROM p)",
    "insert_ignore": f"WITH {P}, {I} SELECT count(*) AS rows FROM i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.thread_id = i.thread_id AND p.board_post_id = i.board_post_id)",
    "upsert_ids_v1": f"WITH {I}, {E} SELECT n.thread_id, n.board_post_id, CASE WHEN e.post_id IS NULL THEN (SELECT max(post_id) FROM posts) + row_number() OVER (PARTITION BY e.post_id IS NULL ORDER BY n.thread_id, n.board_post_id) ELSE e.post_id END AS post_id, CASE WHEN e.post_id IS NULL THEN 'inserted' ELSE 'selected' END AS action FROM n LEFT JOIN e ON e.thread_id = n.thread_id AND e.board_post_id = n.board_post_id",
    "upsert_ids_v3": f"WITH {I}, {E} SELECT n.thread_id, n.board_post_id, CASE WHEN e.post_id IS NULL THEN (SELECT max(post_id) FROM posts) + row_number() OVER (PARTITION BY e.post_id IS NULL ORDER BY n.thread_id, n.board_post_id) ELSE e.post_id END AS post_id, CASE WHEN e.post_id IS NULL THEN 'inserted' WHEN n.embed IS DISTINCT FROM e.embed THEN 'updated' ELSE 'selected' END AS action FROM n LEFT JOIN e ON e.thread_id = n.thread_id AND e.board_post_id = n.board_post_id",
    "embed_changed": f"WITH {I}, {E} SELECT e.post_id, n.embed FROM n JOIN e ON e.thread_id = n.thread_id AND e.board_post_id = n.board_post_id WHERE n.embed IS DISTINCT FROM e.embed",
    "update_from": f"WITH {I}, {E}, c AS (SELECT e.post_id, n.embed FROM n JOIN e ON e.thread_id = n.thread_id AND e.board_post_id = n.board_post_id WHERE n.embed IS DISTINCT FROM e.embed) SELECT e.post_id, CASE WHEN c.post_id IS NOT NULL THEN c.embed ELSE e.embed END AS embed FROM e LEFT JOIN c ON c.post_id = e.post_id",
    "max_local_idx": f"WITH {P}, {I} SELECT thread_id, max(local_idx) AS max_idx FROM p WHERE thread_id IN (SELECT thread_id FROM i) GROUP BY thread_id",
    "assign_local_idx": f"""WITH {P}, {I}, m AS (SELECT thread_id, max(local_idx) AS m FROM p GROUP BY thread_id),
        new AS (SELECT thread_id, board_post_id FROM i WHERE (thread_id, board_post_id) NOT IN (SELECT thread_id, board_post_id FROM p))
        SELECT new.thread_id, board_post_id, CAST(coalesce(m, 0) + row_number() OVER (PARTITION BY new.thread_id ORDER BY board_post_id) AS INTEGER) AS local_idx FROM new LEFT JOIN m ON m.thread_id = new.thread_id""",
    "renumber_posts": f"WITH {P} SELECT post_id, row_number() OVER (PARTITION BY thread_id ORDER BY board_post_id, post_id) AS idx FROM p",
    "attachment_idx": "WITH u AS (SELECT DISTINCT attachment_id, post_id FROM attachments) SELECT attachment_id, row_number() OVER (PARTITION BY post_id ORDER BY attachment_id) AS idx FROM u",
    "new_ids": f"""WITH {P}, {I}, new AS (SELECT count(*) AS n FROM i WHERE (thread_id, board_post_id) NOT IN (SELECT thread_id, board_post_id FROM p)), m AS (SELECT max(post_id) AS m FROM posts)
        SELECT n AS rows, n AS ids, m + 1 AS least, m + n AS greatest FROM new, m""",
    "unique_violations": "SELECT thread_id, board_post_id, count(*) AS n FROM posts GROUP BY 1, 2 HAVING count(*) > 1",
    "cascade_delete": f"""WITH {P}, {T}, b AS (SELECT * FROM boards WHERE board_id % 3 <> 0), gt AS (SELECT thread_id FROM t WHERE board_id IN (SELECT board_id FROM boards WHERE board_id % 3 = 0)),
        gp AS (SELECT post_id FROM p WHERE thread_id IN (SELECT thread_id FROM gt)), u AS (SELECT DISTINCT attachment_id, post_id FROM attachments)
        SELECT 'boards' AS table_name, count(*) AS rows FROM b UNION ALL SELECT 'threads', count(*) FROM t WHERE thread_id NOT IN (SELECT thread_id FROM gt)
        UNION ALL SELECT 'posts', count(*) FROM p WHERE post_id NOT IN (SELECT post_id FROM gp) UNION ALL SELECT 'attachments', count(*) FROM u WHERE post_id NOT IN (SELECT post_id FROM gp)""",
    "media_paths": f"""WITH {P}, {T}, {_FILES}, r AS (SELECT attachment_id, board_filename, 'media/' || s.name || '/' || regexp_replace(pathpart, '/+$', '') || '/' || board_thread_id || '/' AS dir, {_EXT.format(c='file_extension')} AS e, {_EXT.format(c='thumb_extension')} AS te
        FROM a JOIN (SELECT post_id, thread_id FROM p) p USING (post_id) JOIN t USING (thread_id) JOIN boards b USING (board_id) JOIN sites s USING (site_id))
        SELECT attachment_id, dir || board_filename || coalesce('.' || e, '') AS path, dir || 'thumbnail_' || board_filename || coalesce('.' || te, '') AS thumb_path FROM r""",
    "file_types": f"""WITH {_FILES}, r AS (SELECT attachment_id, coalesce({_EXT.format(c='file_extension')}, {_EXT.format(c="regexp_extract(coalesce(original_filename, ''), '[.]([^./]*)$', 1)")}) AS ext FROM a)
        SELECT attachment_id, ext, CASE ext {_MIMES} ELSE '{media.DEFAULT_MIME}' END AS mime FROM r""",
    "zigzag_roundtrip": "SELECT DISTINCT phash, CAST(CASE WHEN phash >= 0 AND phash < 4611686018427387904 THEN phash::HUGEINT * 2 WHEN phash >= 0 THEN phash::HUGEINT * 2 - 18446744073709551616::HUGEINT WHEN -phash::HUGEINT * 2 - 1 < 9223372036854775808::HUGEINT THEN -phash::HUGEINT * 2 - 1 ELSE -phash::HUGEINT * 2 - 1 - 18446744073709551616::HUGEINT END AS BIGINT) AS bits, phash AS again FROM attachments WHERE phash IS NOT NULL",
    "doc_sha256": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "props_json_extract": "SELECT event_id, props->>'$.k' AS k FROM events",
    "age_epoch": f"WITH {P} SELECT post_id, round(epoch(age(date_trunc('day', TIMESTAMP '{AS_OF}'), creation_time)), 6) AS age_s FROM p",
    "epoch_times": f"WITH {P} SELECT post_id, CAST(floor(epoch(creation_time)) AS BIGINT) AS epoch_s FROM p",
}

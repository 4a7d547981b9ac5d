"""Queries on activity: top threads, catalogs, first posts, counts. Each with its SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.common import table, utc
from threadloom.operators import catalog, first_post, ranking
from threadloom.sources.archive import Archive, post_by_board_path, rows_as_json, statistics, stored_table
from threadloom.functions.timefn import on_day

AS_OF, LATER = "2013-11-02 00:00:00", "2014-01-15 12:00:00"
DAY = "2013-07-04"
#: AS_OF as a clock four hours behind UTC shows it.
AS_OF_ELSEWHERE = "2013-11-01 20:00:00 -04:00"

#: One row per post, thread and attachment: what the archive's keys promise.
P = "p AS (SELECT DISTINCT post_id, board_post_id, creation_time AT TIME ZONE 'UTC' AS creation_time, body, subject, name, email, thread_id, local_idx FROM posts)"
PE = """pe AS (SELECT post_id, any_value(board_post_id) AS board_post_id, any_value(creation_time AT TIME ZONE 'UTC') AS creation_time, max(body) AS body,
        max(subject) AS subject, max(name) AS name, max(email) AS email, any_value(thread_id) AS thread_id, max(embed) AS embed, any_value(local_idx) AS local_idx FROM posts GROUP BY post_id)"""
T = "t AS (SELECT DISTINCT thread_id, board_thread_id, creation_time AT TIME ZONE 'UTC' AS creation_time, board_id FROM threads)"
A = """a AS (SELECT attachment_id, max(mimetype) AS mimetype, any_value(illegal) AS illegal, any_value(post_id) AS post_id, max(file_extension) AS file_extension,
       max(thumb_extension) AS thumb_extension, max(board_filename) AS board_filename, any_value(attachment_idx) AS attachment_idx FROM attachments GROUP BY attachment_id)"""
TOP = """top AS (SELECT max(creation_time) AS bump_time, count(*) AS post_count, thread_id, min(creation_time) AS where_to_leave_off
         FROM (SELECT * FROM p WHERE creation_time < TIMESTAMP '{t}' ORDER BY creation_time DESC, post_id DESC LIMIT {n}) GROUP BY thread_id)"""


def _archive(spark: SparkSession, d: str) -> Archive:
    """The tables as an archive holds them: one row a key, times without zone."""
    a = Archive.stored(spark, d)
    a.posts, a.threads = a.posts.withColumn("creation_time", utc("creation_time")), a.threads.withColumn("creation_time", utc("creation_time"))
    return a


def _narrow(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Posts of a few columns."""
    df = stored_table(spark, d, "posts").select("post_id", *columns)
    return df.withColumn("creation_time", utc("creation_time")) if "creation_time" in columns else df


def _activity(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, "thread_id", "creation_time")


def _per_board(spark: SparkSession, d: str) -> DataFrame:
    """Posts per board: per thread first, so that a popular board is no single group of posts."""
    a = _archive(spark, d)
    counts = a.posts.groupBy("thread_id").agg(F.count("*").alias("n"))
    return counts.join(a.threads.select("thread_id", "board_id"), "thread_id").groupBy("board_id").agg(F.sum("n").alias("posts"))


def _natural(spark: SparkSession, d: str) -> DataFrame:
    a = _archive(spark, d)
    return spark.sql("SELECT board_id, count(*) AS posts FROM {p} NATURAL JOIN {t} GROUP BY board_id", p=a.posts.select("thread_id", "creation_time", "post_id"), t=a.threads.select("thread_id", "creation_time", "board_id"))


def _threads_per_board(spark: SparkSession, d: str) -> DataFrame:
    a = _archive(spark, d)
    return spark.sql("SELECT board_id, pathpart, count(*) AS threads FROM {t} NATURAL JOIN {b} GROUP BY board_id, pathpart", t=a.threads.select("thread_id", "board_id"), b=a.boards.select("board_id", "pathpart"))


def _two_latest(spark: SparkSession, d: str) -> DataFrame:
    p = _activity(spark, d)
    top = ranking.top_threads_exact(p, LATER, 2)
    return top.agg(F.coalesce(F.sum("post_count"), F.lit(0)).cast("bigint").alias("posts"))


def _count_top(spark: SparkSession, d: str) -> DataFrame:
    return ranking.newest(_activity(spark, d), LATER, 2000).agg(F.count_distinct("thread_id").alias("threads"))


QUERIES = {
    "count_posts": lambda s, d: table(s, d, "posts").agg(F.count("*").alias("rows"), F.count_distinct("post_id").alias("posts")),
    "checksum_ids": lambda s, d: _narrow(s, d, "board_post_id").agg(F.sum("post_id").alias("sum_post_id"), F.sum("board_post_id").alias("sum_board_post_id")),
    "posts_per_board": _per_board,
    "posts_per_board_total": lambda s, d: _per_board(s, d).agg(F.sum("posts").alias("posts")),
    "natural_join_counts": _natural,
    "threads_per_board": _threads_per_board,
    "top_threads": lambda s, d: ranking.top_threads(_activity(s, d), AS_OF, 1001),
    "top_threads_offset": lambda s, d: ranking.top_threads(_activity(s, d), AS_OF_ELSEWHERE, 1001),
    "top_threads_default": lambda s, d: ranking.top_threads(_activity(s, d), LATER),
    "top_threads_cap": lambda s, d: ranking.top_threads(_activity(s, d), LATER, None),
    "top100_threads_full": lambda s, d: ranking.top_threads_exact(_activity(s, d), LATER, 100),
    "top_threads_iterative": lambda s, d: ranking.top_threads_iterative(_activity(s, d), LATER, 200, first=500, rounds=3, merge=True),
    "count_distinct_threads": _count_top,
    "count_posts_today": lambda s, d: _activity(s, d).where(on_day(F.col("creation_time"), DAY)).agg(F.count("*").alias("posts")),
    "posts_in_two_latest_threads": _two_latest,
    "union_bump": lambda s, d: catalog.union_bump(_activity(s, d), [AS_OF, LATER], 500),
    "union_bump_then_agg": lambda s, d: catalog.union_bump_then_agg(_activity(s, d), [(LATER, 1500), (AS_OF, 500)]),
    "posts_of_top_threads": lambda s, d: ranking.posts_of_top_threads(_narrow(s, d, "thread_id", "board_post_id", "creation_time"), AS_OF, 1000),
    "thread_bodies_array_agg": lambda s, d: ranking.thread_bodies(_narrow(s, d, "thread_id", "board_post_id", "creation_time", "body"), AS_OF, 1000),
    "fetch_catalog": lambda s, d: catalog.fetch_catalog(_archive(s, d), AS_OF, 1001),
    "fetch_catalog_exact_counts": lambda s, d: catalog.fetch_catalog_exact(_archive(s, d), AS_OF, 1000),
    "fetch_catalog_paged": lambda s, d: catalog.fetch_catalog_paged(_narrow(s, d, "thread_id", "creation_time", "body"), AS_OF, 40, 20),
    "first_post_distinct_on": lambda s, d: first_post.distinct_on(_narrow(s, d, "thread_id", "board_post_id")),
    "first_post_row_number": lambda s, d: first_post.by_row_number(_activity(s, d)),
    "first_post_rank": lambda s, d: first_post.by_rank(_activity(s, d)),
    "first_post_min_join": lambda s, d: first_post.by_min_join(_activity(s, d)),
    "first_post_first_value": lambda s, d: first_post.by_first_value(_narrow(s, d, "thread_id", "creation_time", "body")),
    "first_post_lateral": lambda s, d: first_post.by_lateral(_activity(s, d)),
    "first_post_correlated_min": lambda s, d: first_post.by_correlated_min(_activity(s, d)),
    **{f"first_page_{form}": lambda s, d, form=form: first_post.page(_narrow(s, d, "thread_id", "creation_time", "body"), form, LATER) for form in first_post.FORMS},
    "first_agg_udaf": lambda s, d: first_post.first_agg(_narrow(s, d, "thread_id", "board_post_id", "subject"), "thread_id", "subject", ["board_post_id", "post_id"]),
    "post_by_board_path": lambda s, d: post_by_board_path(_archive(s, d), "tech", 66_486).select("post_id", "thread_id", "board_post_id", "creation_time", "body"),
    "rows_as_json": lambda s, d: rows_as_json(_narrow(s, d, "thread_id", "local_idx")),
    "table_statistics": lambda s, d: statistics(_narrow(s, d, "thread_id", "board_post_id", "subject", "name", "email", "local_idx")),
    "attachments_per_type": lambda s, d: stored_table(s, d, "attachments").groupBy(F.lower("mimetype").alias("mimetype")).agg(F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes")),
}

_PAGE_FIRST = """
    SELECT post_count AS estimated_post_count, f.post_id, board_post_id, f.creation_time, bump_time, body, subject, f.thread_id, embed, board_thread_id, pathpart,
           s.name AS site_name, mimetype AS file_mimetype, illegal AS file_illegal, board_filename AS file_name, file_extension, thumb_extension AS file_thumb_extension
    FROM top JOIN pe f ON f.thread_id = top.thread_id AND f.local_idx = 1 AND f.creation_time < TIMESTAMP '{t}'
    JOIN t ON t.thread_id = f.thread_id JOIN boards b ON b.board_id = t.board_id JOIN sites s ON s.site_id = b.site_id
    LEFT JOIN a ON a.post_id = f.post_id AND a.attachment_idx = 1"""
_FULL = "SELECT max(creation_time) AS bump_time, count(*) AS post_count, thread_id, min(creation_time) AS where_to_leave_off FROM p WHERE creation_time < TIMESTAMP '{t}' GROUP BY thread_id"


def _top(t: str, n: int) -> str:
    return f"WITH {P}, {TOP.format(t=t, n=n)} "


def _window(t: str, n: int) -> str:
    return f"(SELECT * FROM p WHERE creation_time < TIMESTAMP '{t}' ORDER BY creation_time DESC, post_id DESC LIMIT {n})"


def _iterative_sql(t: str, wanted: int, first: int, rounds: int) -> str:
    """The rounds unrolled: each window begins below the least time of the one before, if too few threads were met."""
    ctes, size, cursor = [P], first, f"TIMESTAMP '{t}'"
    for i in range(rounds):
        go = "" if i == 0 else f" AND (SELECT count(DISTINCT thread_id) FROM ({' UNION ALL '.join(f'SELECT thread_id FROM w{j}' for j in range(i))})) < {wanted}"
        ctes.append(f"w{i} AS (SELECT * FROM p WHERE creation_time < {cursor}{go} ORDER BY creation_time DESC, post_id DESC LIMIT {size})")
        cursor, size = f"(SELECT min(creation_time) FROM w{i})", size * 2
    rows = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(rounds))
    return f"WITH {', '.join(ctes)} SELECT max(creation_time) AS bump_time, count(*) AS post_count, thread_id FROM ({rows}) GROUP BY thread_id"


def _first_page(form: str) -> str:
    """The first posts of the top 100 threads: forms with ties keep every post of the least time."""
    ties = form in ("rank", "min_join", "correlated_min")
    first = "m.m = p.creation_time" if ties else "p.post_id = (SELECT q.post_id FROM q WHERE q.thread_id = p.thread_id)"
    return f"""WITH {P}, g AS ({_FULL.format(t=LATER)} ORDER BY bump_time DESC, thread_id DESC LIMIT 100), m AS (SELECT thread_id, min(creation_time) AS m FROM p GROUP BY thread_id),
        q AS (SELECT DISTINCT ON (thread_id) thread_id, post_id FROM p ORDER BY thread_id, creation_time, post_id)
        SELECT bump_time, post_count, g.thread_id, p.post_id, body FROM g JOIN p ON p.thread_id = g.thread_id JOIN m ON m.thread_id = g.thread_id WHERE {first}"""


SQL = {
    "count_posts": "SELECT count(*) AS rows, count(DISTINCT post_id) AS posts FROM posts",
    "checksum_ids": f"WITH {P} SELECT CAST(sum(post_id) AS BIGINT) AS sum_post_id, CAST(sum(board_post_id) AS BIGINT) AS sum_board_post_id FROM p",
    "posts_per_board": f"WITH {P}, {T} SELECT board_id, count(*) AS posts FROM p JOIN t USING (thread_id) GROUP BY board_id",
    "posts_per_board_total": f"WITH {P}, {T} SELECT CAST(sum(n) AS BIGINT) AS posts FROM (SELECT board_id, count(*) AS n FROM p JOIN t USING (thread_id) GROUP BY board_id)",
    "natural_join_counts": f"WITH {P}, {T}, np AS (SELECT thread_id, creation_time, post_id FROM p), nt AS (SELECT thread_id, creation_time, board_id FROM t) SELECT board_id, count(*) AS posts FROM np NATURAL JOIN nt GROUP BY board_id",
    "threads_per_board": f"WITH {T}, nt AS (SELECT thread_id, board_id FROM t), nb AS (SELECT board_id, pathpart FROM boards) SELECT board_id, pathpart, count(*) AS threads FROM nt NATURAL JOIN nb GROUP BY board_id, pathpart",
    "top_threads": _top(AS_OF, 1001) + "SELECT * FROM top",
    "top_threads_offset": f"WITH {P}, z AS (SELECT TIMESTAMPTZ '{AS_OF_ELSEWHERE.replace(' -', '-')}' AT TIME ZONE 'UTC' AS t) SELECT max(creation_time) AS bump_time, count(*) AS post_count, thread_id, min(creation_time) AS where_to_leave_off FROM (SELECT p.* FROM p, z WHERE creation_time < t ORDER BY creation_time DESC, post_id DESC LIMIT 1001) GROUP BY thread_id",
    "top_threads_default": _top(LATER, 10_000) + "SELECT * FROM top",
    "top_threads_cap": _top(LATER, 250_000) + "SELECT * FROM top",
    "top100_threads_full": f"WITH {P} {_FULL.format(t=LATER)} ORDER BY bump_time DESC, thread_id DESC LIMIT 100",
    "top_threads_iterative": _iterative_sql(LATER, 200, 500, 3),
    "count_distinct_threads": f"WITH {P} SELECT count(DISTINCT thread_id) AS threads FROM {_window(LATER, 2000)}",
    "count_posts_today": f"WITH {P} SELECT count(*) AS posts FROM p WHERE creation_time >= TIMESTAMP '{DAY}' AND creation_time < TIMESTAMP '{DAY}' + INTERVAL 1 DAY",
    "posts_in_two_latest_threads": f"WITH {P} SELECT CAST(coalesce(sum(post_count), 0) AS BIGINT) AS posts FROM ({_FULL.format(t=LATER)} ORDER BY bump_time DESC, thread_id DESC LIMIT 2)",
    "union_bump": f"WITH {P}, {TOP.format(t=AS_OF, n=500).replace('top AS', 't1 AS')}, {TOP.format(t=LATER, n=500).replace('top AS', 't2 AS')} SELECT * FROM t1 UNION ALL SELECT * FROM t2",
    "union_bump_then_agg": f"WITH {P} SELECT max(creation_time) AS bump_time, count(*) AS post_count, thread_id, min(creation_time) AS where_to_leave_off FROM (SELECT * FROM {_window(LATER, 1500)} UNION ALL SELECT * FROM {_window(AS_OF, 500)}) GROUP BY thread_id",
    "posts_of_top_threads": _top(AS_OF, 1000) + "SELECT thread_id, post_id, board_post_id, creation_time, bump_time FROM p JOIN top USING (thread_id)",
    "thread_bodies_array_agg": _top(AS_OF, 1000) + "SELECT thread_id, list(body ORDER BY board_post_id, post_id) AS bodies FROM p JOIN top USING (thread_id) GROUP BY thread_id",
    "fetch_catalog": f"WITH {P}, {PE}, {T}, {A}, {TOP.format(t=AS_OF, n=1001)}" + _PAGE_FIRST.format(t=AS_OF),
    "fetch_catalog_exact_counts": f"""WITH {P}, {PE}, {T}, {TOP.format(t=AS_OF, n=1000)},
        f AS (SELECT DISTINCT ON (thread_id) * FROM pe WHERE thread_id IN (SELECT thread_id FROM top) ORDER BY thread_id, board_post_id, post_id),
        c AS (SELECT thread_id, count(*) AS post_count FROM p GROUP BY thread_id)
        SELECT c.post_count, f.post_id, f.board_post_id, f.creation_time, top.bump_time, f.body, f.subject, f.thread_id, f.embed, t.board_thread_id, b.pathpart, s.name AS site_name
        FROM top JOIN f ON f.thread_id = top.thread_id JOIN c ON c.thread_id = top.thread_id JOIN t ON t.thread_id = f.thread_id JOIN boards b ON b.board_id = t.board_id JOIN sites s ON s.site_id = b.site_id""",
    "fetch_catalog_paged": f"""WITH {P}, g AS (SELECT max(creation_time) AS bump_time, count(*) AS post_count, min(post_id) AS post_id, thread_id FROM p WHERE creation_time < TIMESTAMP '{AS_OF}' GROUP BY thread_id),
        pg AS (SELECT * FROM g ORDER BY bump_time DESC, thread_id DESC LIMIT 40 OFFSET 20) SELECT bump_time, post_count, post_id, pg.thread_id, body FROM pg JOIN (SELECT post_id, body FROM p) USING (post_id)""",
    "first_post_distinct_on": f"WITH {P} SELECT DISTINCT ON (thread_id) post_id, thread_id, board_post_id FROM p ORDER BY thread_id, board_post_id, post_id",
    "first_post_row_number": f"WITH {P} SELECT post_id, thread_id, creation_time FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY creation_time, post_id) AS rn FROM p) WHERE rn = 1",
    "first_post_rank": f"WITH {P} SELECT post_id, thread_id, creation_time FROM (SELECT *, rank() OVER (PARTITION BY thread_id ORDER BY creation_time) AS r FROM p) WHERE r = 1",
    "first_post_min_join": f"WITH {P}, m AS (SELECT thread_id, min(creation_time) AS m FROM p GROUP BY thread_id) SELECT post_id, p.thread_id, creation_time FROM p JOIN m ON m.thread_id = p.thread_id AND m.m = p.creation_time",
    "first_post_first_value": f"""WITH {P} SELECT thread_id, max(creation_time) AS bump_time, count(*) AS post_count, min(fb) AS body FROM
        (SELECT *, first_value(body) OVER (PARTITION BY thread_id ORDER BY creation_time, post_id) AS fb FROM p) GROUP BY thread_id""",
    "first_post_lateral": f"WITH {P} SELECT t.thread_id, f.post_id FROM (SELECT DISTINCT thread_id FROM p) t JOIN LATERAL (SELECT post_id FROM p WHERE p.thread_id = t.thread_id ORDER BY creation_time, post_id LIMIT 1) f ON true",
    "first_post_correlated_min": f"WITH {P} SELECT thread_id, post_id FROM p WHERE creation_time = (SELECT min(q.creation_time) FROM p q WHERE q.thread_id = p.thread_id)",
    **{f"first_page_{form}": _first_page(form) for form in first_post.FORMS},
    "first_agg_udaf": f"WITH {P} SELECT thread_id, first(subject ORDER BY board_post_id, post_id) FILTER (subject IS NOT NULL) AS first FROM p GROUP BY thread_id",
    "post_by_board_path": f"WITH {P}, {T} SELECT post_id, p.thread_id, board_post_id, p.creation_time, body FROM p JOIN t ON t.thread_id = p.thread_id JOIN boards b ON b.board_id = t.board_id WHERE pathpart = 'tech' AND board_post_id = 66486",
    "rows_as_json": f"WITH {P} SELECT '{{\"post_id\":' || post_id || ',\"thread_id\":' || thread_id || ',\"local_idx\":' || local_idx || '}}' AS json FROM p",
    "table_statistics": f"WITH {P} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM p" for c in ("post_id", "thread_id", "board_post_id", "subject", "name", "email", "local_idx")),
    "attachments_per_type": "WITH u AS (SELECT attachment_id, any_value(mimetype) AS mimetype, any_value(file_size_bytes) AS file_size_bytes FROM attachments GROUP BY attachment_id) SELECT lower(mimetype) AS mimetype, count(*) AS files, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM u GROUP BY lower(mimetype)",
}

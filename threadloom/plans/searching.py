"""Queries on text search and picture similarity, with their SQL.

Searches read an index of postings, as it lies beside an archive: it is made at the first search of a
configuration over a directory, in the folder of staged tables, and read by the later ones. SQL has no
stemmer: the words of a stem are listed in it, from the usual endings.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.common import list_names, staged_root, table, utc
from threadloom.functions.text import RANK_WEIGHTS, ZETA2, lexeme
from threadloom.operators import phash, search
from threadloom.plans.activity import AS_OF, A, P, PE, T, _archive, _narrow
from threadloom.sources.archive import one_per_key

#: Midnight after the last post of every scale: no age is negative.
NOW = "2014-06-01 00:00:00"
RADIUS, K = 14, 5
NEAR = 8
ENGLISH = "compiling keyboards"


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, "creation_time", "subject", "name", "body")


def _match(text: str, config: str = "simple"):
    return lambda s, d: search.search_match(_posts(s, d), text, config).select("post_id")


def _index(spark: SparkSession, d: str, config: str) -> DataFrame:
    path = f"{staged_root(spark)}/search-{config}-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    if "_SUCCESS" not in list_names(spark, path):
        search.build_index(_posts(spark, d), path, config, mode="overwrite")
    return search.read_index(spark, path)


def _hits(text: str):
    return lambda s, d: search.hits(_index(s, d, "simple"), text, NOW, "simple").select("post_id", F.round("rank", 6).alias("rank"), F.round("relevance", 9).alias("relevance"))


def _page(text: str, config: str, rank_first: bool):
    return lambda s, d: search.search_posts(_archive(s, d), _index(s, d, config), text, NOW, 100, config, rank_first).withColumn("relevance", F.round("relevance", 9))


def _by_term(postings: DataFrame) -> DataFrame:
    rows = postings.select("term", "post_id", F.explode("places.weight").alias("weight"))
    return rows.groupBy("term", "weight").agg(F.count_distinct("post_id").alias("posts"), F.count("*").alias("places"))


def _reindexed(spark: SparkSession, d: str) -> DataFrame:
    """The index after the subject of every post that has one became its name."""
    changed = _posts(spark, d).where("subject is not null").withColumn("subject", F.col("name"))
    return _by_term(search.reindexed(_index(spark, d, "simple"), changed, "simple"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return one_per_key(table(spark, d, "attachments").select("attachment_id", "phash"), ["attachment_id"])


def _nearest(spark: SparkSession, d: str, k: int = K, radius: int | None = NEAR) -> DataFrame:
    files = _files(spark, d)
    near = phash.nearest(files, files.where("attachment_id % 20 = 0"), k, radius)
    return near.select("query", "phash", F.col("distance").cast("bigint").alias("distance"), F.col("place").cast("bigint").alias("place"))


QUERIES = {
    "search_match_and": _match("keyboard thread"),
    "search_match_phrase": _match('"the old"'),
    "search_match_or": _match("keyboard or typewriter"),
    "search_match_not": _match("keyboard -thread"),
    "search_match_english": _match(ENGLISH, "english"),
    "search_index_match": lambda s, d: search.hits(_index(s, d, "simple"), '"the old" thread or keyboard -radio', NOW, "simple").select("post_id"),
    "search_rank": _hits("thread"),
    "search_rank_terms": _hits("old thread"),
    "search_posts": _page(ENGLISH, "english", True),
    "search_posts_simple": lambda s, d: _page("keyboard", "simple", False)(s, d).select("estimated_post_count", "post_id", "board_thread_id", "pathpart", "site_name", "file_name", "relevance"),
    "search_posts_v1": lambda s, d: _hits("archive")(s, d).select("post_id", "relevance"),
    "search_index_weighted": lambda s, d: _by_term(search.postings(_posts(s, d), "simple")),
    "search_index_updated": _reindexed,
    "phash_radius": lambda s, d: phash.within_radius(_files(s, d), RADIUS).withColumn("distance", F.col("distance").cast("bigint")),
    "phash_knn": _nearest,
    # each query hash itself and its K neighbours, however far
    "phash_knn_exact": lambda s, d: _nearest(s, d, K + 1, None),
}

_WORDS = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
_F = {f: _WORDS.format(c=f) for f in ("subject", "name", "body")}
D = f"d AS (SELECT post_id, creation_time, {_F['subject']} AS s, {_F['name']} AS n, {_F['body']} AS b, {_F['subject']} || {_F['name']} || {_F['body']} AS w FROM p)"
_HAS = "list_contains(w, '{}')"


def _sql_match(where: str) -> str:
    return f"WITH {P}, {D} SELECT post_id FROM d WHERE {where}"


def _phrase(words: list[str]) -> str:
    tests = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"len(list_filter(range(1, len(w) + 1), lambda i: {tests})) > 0"


def _sql_rank(term: str) -> str:
    """One term: its weights in order, each divided by the square of its place."""
    ones = " || ".join(f"list_transform(list_filter({f}, lambda x: x = '{term}'), lambda x: CAST({w} AS DOUBLE))" for f, w in zip("snb", (RANK_WEIGHTS[c] for c in "ABC")))
    rank = f"list_sum(list_transform(range(1, len(ws) + 1), lambda j: ws[j] / (j * j))) / {ZETA2}"
    return f"WITH {P}, {D}, m AS (SELECT post_id, creation_time, {ones} AS ws FROM d WHERE {_HAS.format(term)}), r AS (SELECT post_id, {rank} AS rank, epoch(age(TIMESTAMP '{NOW}', creation_time)) AS age_s FROM m)"


def _words_of(stem: str, base: str) -> list[str]:
    """The words on a base that the English configuration brings to a stem."""
    endings = ("", "s", "e", "es", "ed", "er", "ers", "ing", "ings", "ation", "ations", "able", "ator", "ators", "ative", "ly", "ist", "ists", "istic")
    return sorted(w for w in {base + e for e in endings} if lexeme(w) == stem)


def _sql_pairs(one: list[str], two: list[str]) -> str:
    """The rank of two terms, each a list of words: every pair of their places counts by its distance."""
    a, b = (f"[{', '.join(repr(w) for w in ws)}]" for ws in (one, two))
    w = RANK_WEIGHTS
    return f"""WITH {P}, {D}, m AS (SELECT post_id, creation_time, w, len(s) AS ns, len(n) AS nn FROM d WHERE list_has_any(w, {a}) AND list_has_any(w, {b})),
        x AS (SELECT post_id, i, list_contains({a}, w[i]) AS one, CAST(CASE WHEN i <= ns THEN {w['A']} WHEN i <= ns + nn THEN {w['B']} ELSE {w['C']} END AS DOUBLE) AS wt FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m) WHERE list_contains({a} || {b}, w[i])),
        pr AS (SELECT a.post_id, abs(a.i - b.i) AS dist, a.wt * b.wt AS ww FROM x a JOIN x b ON a.post_id = b.post_id WHERE a.one AND NOT b.one),
        r AS (SELECT post_id, rank, epoch(age(TIMESTAMP '{NOW}', creation_time)) AS age_s FROM m JOIN (SELECT post_id, 1 - exp(sum(ln(1 - CASE WHEN dist <= 100 THEN sqrt(ww / (1.005 + 0.05 * exp(dist / 1.5 - 2))) ELSE 0 END))) AS rank FROM pr GROUP BY post_id) USING (post_id))"""


_ENGLISH_WORDS = (_words_of("compil", "compil"), _words_of("keyboard", "keyboard"))
_SQL_PAGE = """
    SELECT CAST(0 AS BIGINT) AS estimated_post_count, f.post_id, board_post_id, f.creation_time, f.creation_time AS bump_time, body, subject, f.thread_id, embed, board_thread_id, pathpart,
           s.name AS site_name, mimetype AS file_mimetype, illegal AS file_illegal, board_filename AS file_name, file_extension, thumb_extension AS file_thumb_extension, relevance
    FROM top JOIN pe f ON f.post_id = top.post_id JOIN t ON t.thread_id = f.thread_id JOIN boards b ON b.board_id = t.board_id JOIN sites s ON s.site_id = b.site_id
    LEFT JOIN a ON a.post_id = f.post_id AND a.attachment_idx = 1""".replace("file_extension, thumb_extension AS", "a.file_extension, thumb_extension AS")
_DIST = "CASE WHEN ({a} < 0) = ({b} < 0) THEN bit_count(xor({a}, {b})) ELSE 65 - bit_count(xor({a}, {b})) END"
SQL = {
    "search_match_and": _sql_match(f"{_HAS.format('keyboard')} AND {_HAS.format('thread')}"),
    "search_match_phrase": _sql_match(_phrase(["the", "old"])),
    "search_match_or": _sql_match(f"{_HAS.format('keyboard')} OR {_HAS.format('typewriter')}"),
    "search_match_not": _sql_match(f"{_HAS.format('keyboard')} AND NOT {_HAS.format('thread')}"),
    "search_match_english": f"WITH {P}, {D} SELECT post_id FROM d WHERE list_has_any(w, {_ENGLISH_WORDS[0]}) AND list_has_any(w, {_ENGLISH_WORDS[1]})",
    "search_rank_terms": _sql_pairs(["old"], ["thread"]) + " SELECT post_id, round(rank, 6) AS rank, round(rank / (1 + age_s / 86400), 9) AS relevance FROM r",
    "search_posts": _sql_pairs(*_ENGLISH_WORDS) + f", {PE}, {T}, {A}, top AS (SELECT post_id, round(rank / (1 + age_s / 86400), 9) AS relevance FROM r ORDER BY relevance DESC, post_id LIMIT 100)" + _SQL_PAGE,
    "search_index_updated": f"""WITH {P}, c AS (SELECT post_id, CASE WHEN subject IS NOT NULL THEN name END AS subject, name, body FROM p), d AS (SELECT post_id, {_F['subject']} AS s, {_F['name']} AS n, {_F['body']} AS b FROM c),
        u AS (SELECT post_id, unnest(s) AS term, 'A' AS weight FROM d UNION ALL SELECT post_id, unnest(n), 'B' FROM d UNION ALL SELECT post_id, unnest(b), 'C' FROM d)
        SELECT term, weight, count(DISTINCT post_id) AS posts, count(*) AS places FROM u GROUP BY 1, 2""",
    "search_index_match": _sql_match(f"({_phrase(['the', 'old'])} AND {_HAS.format('thread')}) OR ({_HAS.format('keyboard')} AND NOT {_HAS.format('radio')})"),
    "search_rank": _sql_rank("thread") + " SELECT post_id, round(rank, 6) AS rank, round(rank / (1 + age_s / 86400), 9) AS relevance FROM r",
    "search_posts_v1": _sql_rank("archive") + " SELECT post_id, round(rank / (1 + age_s / 86400), 9) AS relevance FROM r",
    "search_posts_simple": _sql_rank("keyboard") + """, x AS (SELECT * FROM r ORDER BY post_id LIMIT 100), t AS (SELECT DISTINCT thread_id, board_thread_id, board_id FROM threads),
        a AS (SELECT DISTINCT post_id, board_filename FROM attachments WHERE attachment_idx = 1)
        SELECT CAST(0 AS BIGINT) AS estimated_post_count, x.post_id, board_thread_id, pathpart, s.name AS site_name, board_filename AS file_name, round(rank / (1 + age_s / 86400), 9) AS relevance
        FROM x JOIN (SELECT post_id, thread_id FROM p) p USING (post_id) JOIN t USING (thread_id) JOIN boards b USING (board_id) JOIN sites s USING (site_id) LEFT JOIN a USING (post_id)""",
    "search_index_weighted": f"""WITH {P}, {D}, u AS (SELECT post_id, unnest(s) AS term, 'A' AS weight FROM d UNION ALL SELECT post_id, unnest(n), 'B' FROM d UNION ALL SELECT post_id, unnest(b), 'C' FROM d)
        SELECT term, weight, count(DISTINCT post_id) AS posts, count(*) AS places FROM u GROUP BY 1, 2""",
    "phash_radius": f"WITH h AS (SELECT DISTINCT phash FROM attachments WHERE phash IS NOT NULL) SELECT a.phash AS phash_a, b.phash AS phash_b, CAST({_DIST.format(a='a.phash', b='b.phash')} AS BIGINT) AS distance FROM h a JOIN h b ON a.phash < b.phash WHERE {_DIST.format(a='a.phash', b='b.phash')} <= {RADIUS}",
    "phash_knn": f"""WITH h AS (SELECT DISTINCT phash FROM attachments WHERE phash IS NOT NULL), q AS (SELECT DISTINCT phash AS query FROM attachments WHERE phash IS NOT NULL AND attachment_id % 20 = 0),
        d AS (SELECT query, phash, CAST({_DIST.format(a='query', b='phash')} AS BIGINT) AS distance FROM q JOIN h ON true), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, phash) AS place FROM d WHERE distance <= {NEAR})
        SELECT query, phash, distance, place FROM n WHERE place <= {K}""",
    "phash_knn_exact": f"""WITH h AS (SELECT DISTINCT phash FROM attachments WHERE phash IS NOT NULL), q AS (SELECT DISTINCT phash AS query FROM attachments WHERE phash IS NOT NULL AND attachment_id % 20 = 0),
        d AS (SELECT query, phash, CAST({_DIST.format(a='query', b='phash')} AS BIGINT) AS distance FROM q JOIN h ON true), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, phash) AS place FROM d)
        SELECT query, phash, distance, place FROM n WHERE place <= {K + 1}""",
}

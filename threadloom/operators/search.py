"""Full-text search over posts: relevance is rank divided by age, as a page of catalog columns.

`build_index` writes postings (term, post_id, creation_time, places) in folders by a hash of the term; ingest
appends those of new posts. A search reads the postings of its terms only: match, rank, relevance and limit
need nothing else, and posts are read for the hits alone. `search_match` and `postings` also work on posts that
have no index.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.common import moment, utc
from threadloom.functions import text as tx
from threadloom.functions.timefn import age_since
from threadloom.operators.catalog import PAGE, with_first_file, with_places
from threadloom.sources.archive import Archive

#: Weight classes of the fields, in the order of their positions.
FIELDS = (("subject", "A"), ("name", "B"), ("body", "C"))
#: Folders of an index: a search reads those of its terms.
FOLDERS = 64


def documents(posts: DataFrame, config: str = "english") -> DataFrame:
    """posts with `terms`: the terms of subject, name and body in order; `_ends`: where each field's terms end."""
    parts = [tx.terms_of(F.col(f), config) for f, _ in FIELDS]
    out = posts.select("*", *[p.alias(f"_t{i}") for i, p in enumerate(parts)])
    ends, total = [], F.lit(0)
    for i in range(len(parts)):
        total = total + F.size(f"_t{i}")
        ends.append(total)
    return out.select(*posts.columns, F.concat(*[f"_t{i}" for i in range(len(parts))]).alias("terms"), F.array(*ends).alias("_ends"))


def postings(posts: DataFrame, config: str = "english") -> DataFrame:
    """(term, post_id, creation_time, places): one row a post and term; places (pos, weight) count from 1 over all fields."""
    docs = documents(posts.select("post_id", "creation_time", "subject", "name", "body"), config)
    rows = docs.select("post_id", "creation_time", "_ends", F.posexplode("terms").alias("i", "term")).where("term is not null")
    weight = F.when(F.col("i") < F.col("_ends")[0], "A").when(F.col("i") < F.col("_ends")[1], "B").otherwise("C")
    return rows.groupBy("term", "post_id", "creation_time").agg(F.array_sort(F.collect_list(F.struct((F.col("i") + 1).alias("pos"), weight.alias("weight")))).alias("places"))


def _folder(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def build_index(posts: DataFrame, path: str, config: str = "english", mode: str = "errorifexists") -> None:
    """Write the postings by folder and term; mode="append" adds those of new posts."""
    # a term that most posts have is spread over the tasks by the post
    rows = postings(posts, config).withColumn("folder", _folder("term"))
    rows.repartitionByRange("folder", "term", "post_id").sortWithinPartitions("folder", "term", "post_id").write.mode(mode).option("compression", "zstd").partitionBy("folder").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index, or all indexes in folders `run=...` of a folder."""
    schema = "term string, post_id long, creation_time timestamp_ntz, places array<struct<pos: int, weight: string>>, folder int"
    return spark.read.schema(schema).parquet(path).select("term", "post_id", "creation_time", "places", "folder")


def reindexed(index: DataFrame, changed: DataFrame, config: str = "english") -> DataFrame:
    """The index's postings after posts changed (`changed`: whole rows): theirs are made anew, those of a post without text any more are gone."""
    return index.drop("folder").join(changed.select("post_id"), "post_id", "left_anti").unionByName(postings(changed, config), allowMissingColumns=True)


def _asked(query: tx.Query) -> list[str]:
    return sorted({w for a in query for t in a for w in (t.of if isinstance(t, tx.Not) else t).words if w})


def _has(places: dict[str, Column], t: tx.Term) -> Column:
    first = places[t.words[0]]
    if len(t.words) == 1:
        return F.size(first) > 0

    def stands(w: str, pos: Column) -> Column:
        return F.exists(places[w], lambda y: y["pos"] == pos)

    def follows(x: Column) -> Column:
        out = F.lit(True)
        for i, w in enumerate(t.words[1:], 1):
            if w is not None:
                out = out & stands(w, x["pos"] + i)
        return out

    return F.exists(first, follows)


def hits(index: DataFrame, text: str, as_of: datetime | str, config: str = "english") -> DataFrame:
    """(post_id, rank, relevance) of the posts that satisfy a query, from the postings of its terms alone; relevance = rank / (1 + age in days).

    An alternative of exclusions only would need every post: it is an error.
    """
    query = tx.parse_web(text, config)
    if any(all(isinstance(t, tx.Not) for t in a) for a in query):
        raise ValueError("an alternative of exclusions only needs the posts themselves: use search_match")
    words = _asked(query)
    mine = index.where(F.col("term").isin(words))
    if "folder" in index.columns:
        known = index.sparkSession.createDataFrame([(w,) for w in words], "term string").select(_folder("term").alias("f")).distinct()
        mine = mine.where(F.col("folder").isin([r["f"] for r in known.collect()]))  # one a word of the query
    docs = mine.groupBy("post_id", "creation_time").agg(*[F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("places")))).alias(f"p{i}") for i, w in enumerate(words)])
    places = {w: F.col(f"p{i}") for i, w in enumerate(words)}
    found = F.lit(False)
    for a in query:
        every = F.lit(True)
        for t in a:
            every = every & (~_has(places, t.of) if isinstance(t, tx.Not) else _has(places, t))
        found = found | every
    rank = tx.rank_of({w: F.transform(p, lambda x: F.struct(x["pos"].alias("pos"), _weight(x["weight"]).alias("w"))) for w, p in places.items()}, query)
    age = age_since(moment(as_of), utc("creation_time"))
    docs = docs.where(found).withColumn("rank", rank)
    # the day after as_of has age -1: the quotient has no value there
    return docs.select("post_id", "rank", F.try_divide(F.col("rank"), 1 + age / (3600 * 24)).alias("relevance"))


def _weight(c: Column) -> Column:
    return F.when(c == "A", tx.RANK_WEIGHTS["A"]).when(c == "B", tx.RANK_WEIGHTS["B"]).otherwise(tx.RANK_WEIGHTS["C"])


def search_match(posts: DataFrame, text: str, config: str = "english") -> DataFrame:
    """The posts that satisfy a web-style query, without an index."""
    return documents(posts, config).where(tx.matches(F.col("terms"), tx.parse_web(text, config))).select(posts.columns)


def search_posts(archive: Archive, index: DataFrame, text: str, as_of: datetime | str, max_rows: int = 1000, config: str = "english", rank_first: bool = True) -> DataFrame:
    """Matching posts as catalog rows with `relevance`, the most relevant first.

    rank_first=True returns the most relevant rows. False takes the first max_rows matches by post_id, as an
    engine does that limits before it sorts.
    """
    order = [F.col("relevance").desc_nulls_last(), F.col("post_id")]
    top = hits(index, text, as_of, config).orderBy(*(order if rank_first else order[1:])).limit(max_rows)
    rows = archive.posts.join(top.drop("rank"), "post_id").withColumn("estimated_post_count", F.lit(0).cast("bigint")).withColumn("bump_time", F.col("creation_time"))
    return with_first_file(with_places(rows, archive), archive).select(*PAGE, "relevance").orderBy(*order)

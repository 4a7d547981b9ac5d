from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadloom.operators import catalog, first_post, ranking, search, upsert
from threadloom.sources.archive import Archive, cascade, get_posts, max_local_idx, one_per_key, unique_violations

T0 = datetime(2024, 1, 1)


def at(minute):
    return T0.replace(hour=minute // 60, minute=minute % 60)


@pytest.fixture(scope="module")
def archive(spark):
    posts = [
        # post_id, number, minute, body, subject, name, email, thread, embed, idx
        (1, 100, 1, "first of one", "keyboard", "anon", None, 1, None, 1),
        (2, 101, 2, "the old keyboard clicks", None, "bob", None, 1, None, 2),
        (3, 102, 9, None, None, None, None, 1, None, 3),
        (4, 103, 3, "first of two", "radio", None, None, 2, "v", 1),
        (5, 104, 3, "tied first of two", None, None, None, 2, None, 2),
        (6, 105, 4, "no first post", None, None, None, 3, None, 2),
    ]
    files = [(1, "image/png", at(1), "h", None, False, 1, None, "png", "png", "o", "f1", False, 1, 1), (2, "image/png", at(1), "h", None, False, 1, None, "png", "png", "o", "f2", False, 1, 2)]
    a = Archive.empty(spark)
    from threadloom.sources.archive import SCHEMAS

    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    return Archive(
        make("sites", [(1, "s", "http://s.example")]), make("boards", [(1, "B", "b", 1), (2, None, "c", 1)]), make("threads", [(1, 100, at(1), 1), (2, 103, at(3), 1), (3, 105, at(4), 2)]),
        make("posts", [(p, n, at(m), b, s, na, e, t, em, i) for p, n, m, b, s, na, e, t, em, i in posts]), make("attachments", files) if a else None,
    )


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_top_threads(archive):
    got = rows(ranking.top_threads(archive.posts, "2024-01-01 00:09:00", 10), "thread_id", "post_count")
    assert got == [(1, 2), (2, 2), (3, 1)]  # the post at the moment itself is not before it
    # two posts have one time at the end of the lookback: the greater id is the newer
    assert rows(ranking.top_threads(archive.posts, "2024-01-01 00:09:00", 2), "thread_id", "where_to_leave_off") == [(2, at(3)), (3, at(4))]
    assert ranking.top_threads(archive.posts, "2024-01-02", None).count() == 3
    assert ranking.top_threads(archive.posts, "2020-01-01", 10).count() == 0


def test_iterative(archive):
    split = ranking.top_threads_iterative(archive.posts, "2024-01-02", 3, first=2)
    assert rows(split, "thread_id", "post_count") == [(1, 1), (1, 2), (2, 2), (3, 1)]  # a thread in two windows
    merged = ranking.top_threads_iterative(archive.posts, "2024-01-02", 3, first=2, merge=True)
    assert rows(merged, "thread_id", "post_count") == [(1, 3), (2, 2), (3, 1)]


def test_bodies_keep_nulls(archive):
    got = {r.thread_id: r.bodies for r in ranking.thread_bodies(archive.posts, "2024-01-02", 100).collect()}
    assert got[1] == ["first of one", "the old keyboard clicks", None]


def test_catalog(archive):
    page = catalog.fetch_catalog(archive, "2024-01-02", 100)
    assert page.columns == catalog.PAGE
    # thread 3 has no post 1; of two files the first is shown, a post without file stays
    assert rows(page, "thread_id", "estimated_post_count", "pathpart", "site_name") == [(1, 3, "b", "s"), (2, 2, "b", "s")]
    assert {r.thread_id: r.file_name for r in page.collect()} == {1: "f1", 2: None}
    assert rows(catalog.fetch_catalog_exact(archive, "2024-01-02", 100), "thread_id", "post_count", "board_post_id") == [(1, 3, 100), (2, 2, 103), (3, 1, 105)]
    assert rows(catalog.fetch_catalog_paged(archive.posts, "2024-01-02", 1, 1), "thread_id", "post_id") == [(3, 6)]


def test_unions_count_overlap_twice(archive):
    got = {r.thread_id: r.post_count for r in catalog.union_bump_then_agg(archive.posts, [("2024-01-02", 2), ("2024-01-02", 1)]).collect()}
    assert got == {1: 2, 3: 1}
    assert catalog.union_bump(archive.posts, ["2024-01-02", "2024-01-02"], 1).count() == 2


def test_first_posts_and_ties(archive):
    p = archive.posts
    one = [(1, 1), (2, 4), (3, 6)]
    tied = [(1, 1), (2, 4), (2, 5), (3, 6)]
    for f in (first_post.distinct_on, first_post.by_row_number, first_post.by_lateral):
        assert rows(f(p), "thread_id", "post_id") == one, f
    for f in (first_post.by_rank, first_post.by_min_join, first_post.by_correlated_min):
        assert rows(f(p), "thread_id", "post_id") == tied, f
    assert rows(first_post.by_first_value(p), "thread_id", "body") == [(1, "first of one"), (2, "first of two"), (3, "no first post")]
    got = {r.thread_id: r["first"] for r in first_post.first_agg(p, "thread_id", "embed", ["post_id"]).collect()}
    assert got == {1: None, 2: "v", 3: None}


def test_reads(spark, archive):
    keys = spark.createDataFrame([(1, 101), (1, 101), (9, 9), (None, None)], "thread_id long, board_post_id long")
    assert rows(get_posts(archive.posts, keys), "post_id") == [(2,)]
    assert rows(max_local_idx(archive.posts, keys), "thread_id", "max_idx") == [(1, 3)]
    assert max_local_idx(archive.posts, keys.limit(0)).count() == 0
    left = cascade(archive, archive.boards.where("board_id = 1"))
    assert [df.count() for df in (left.boards, left.threads, left.posts, left.attachments)] == [1, 1, 1, 0]


def test_writes(spark, archive):
    new = spark.createDataFrame([(1, 50, None), (1, 200, "x"), (1, 100, "e"), (2, 103, None), (7, 1, None)], "thread_id long, board_post_id long, embed string")
    keys = ["thread_id", "board_post_id"]
    missing = upsert.missing(new, archive.posts, keys)
    # a late post with a small number comes last all the same
    assert rows(upsert.next_local_idx(missing, archive.posts), "thread_id", "board_post_id", "local_idx") == [(1, 50, 4), (1, 200, 5), (7, 1, 1)]
    ids = [r.id for r in upsert.assign_ids(missing, "id", keys, 6, 3).collect()]
    assert sorted(ids) == [7, 8, 9]
    assert rows(upsert.upsert_ids(new, archive.posts).where("action <> 'inserted'"), "post_id", "action") == [(1, "updated"), (4, "updated")]
    assert {r.action for r in upsert.upsert_ids(new, archive.posts, 1).collect()} == {"inserted", "selected"}
    after = upsert.apply_embed(archive.posts, upsert.embed_changed(new, archive.posts))
    assert {r.post_id: r.embed for r in after.collect()} == {1: "e", 2: None, 3: None, 4: None, 5: None, 6: None}
    # inserted rows have the ids that follow, in the order of their keys
    assert rows(upsert.upsert_ids(new, archive.posts).where("action = 'inserted'"), "thread_id", "board_post_id", "post_id") == [(1, 50, 7), (1, 200, 8), (7, 1, 9)]
    twice = new.unionByName(new)
    assert upsert.insert_ignore(twice, archive.posts, keys).count() == 3
    assert unique_violations(twice, keys).count() == 5
    assert one_per_key(twice.unionByName(spark.createDataFrame([(7, 1, "late")], new.schema)), keys).where("thread_id = 7").first().embed == "late"


def test_search(archive):
    found = lambda q, c="simple": rows(search.search_match(archive.posts, q, c), "post_id")
    assert found("keyboard") == [(1,), (2,)] and found("keyboard old") == [(2,)]
    assert found('"the old"') == [(2,)] and found('"old the"') == [] and found("keyboard -clicks") == [(1,)]
    assert found("radio or clicks") == [(2,), (4,)] and found("") == []
    assert found("keyboards clicking", "english") == [(2,)]
    assert found('"one keyboard"') == []  # fields do not run into each other in this order


def test_search_index(spark, archive, tmp_path):
    path = str(tmp_path / "index")
    search.build_index(archive.posts.where("post_id < 3"), path, "simple")
    search.build_index(archive.posts.where("post_id >= 3"), path, "simple", mode="append")
    index = search.read_index(spark, path)
    for q in ("keyboard", '"the old" keyboard', "keyboard -clicks", "radio or clicks", '"the old"', "old keyboard"):
        assert rows(search.hits(index, q, "2024-06-01", "simple"), "post_id") == rows(search.search_match(archive.posts, q, "simple"), "post_id"), q
    with pytest.raises(ValueError):
        search.hits(index, "-keyboard", "2024-06-01", "simple")
    got = search.search_posts(archive, index, "keyboard", "2024-06-01", 10, "simple").collect()
    assert [h.post_id for h in got] == [1, 2] and got[0].file_name == "f1" and got[0].bump_time == got[0].creation_time and got[0].relevance >= got[1].relevance
    assert search.search_posts(archive, index, "keyboard", "2024-06-01", 1, "simple", rank_first=False).first().post_id == 1
    # the day before the post: age -1 day has no quotient
    assert search.hits(index, "keyboard", "2023-12-31", "simple").where("post_id = 1").first().relevance is not None
    # a post that changed is found by its new words only
    changed = archive.posts.where("post_id = 1").withColumn("subject", F.lit("typewriter")).withColumn("body", F.lit(None).cast("string"))
    after = search.reindexed(index, changed, "simple")
    assert rows(search.hits(after, "typewriter", "2024-06-01", "simple"), "post_id") == [(1,)] and rows(search.hits(after, "keyboard", "2024-06-01", "simple"), "post_id") == [(2,)]

from collections import Counter

from threadloom.operators.tree_aggregate import heavy_keys, per_board, per_thread, rounds_for, tree_aggregate


def test_rounds():
    assert [rounds_for(n, 8) for n in (1, 8, 9, 64, 65, 512)] == [1, 1, 2, 2, 3, 3]


def test_exact_with_a_heavy_key_and_nulls(spark):
    rows = [(None if i % 11 == 0 else 1 if i % 3 else i % 7, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(37)
    got = {r.k: (r.n, r.s, r.a, r.b) for r in tree_aggregate(df, "k", {"n": ("count", "*"), "s": ("sum", "v"), "a": ("min", "v"), "b": ("max", "v")}, fan_in=3).collect()}
    want = {}
    for k, v in rows:
        n, s, a, b = want.get(k, (0, 0, v, v))
        want[k] = (n + 1, s + v, min(a, v), max(b, v))
    assert got == want


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(i,) for i in range(2, 72)] + [(None,)] * 3, "k long")
    assert [tuple(r) for r in heavy_keys(df, "k", 0.03, "f").collect()] == [("f", 1)]
    assert heavy_keys(df.limit(0), "k", 0.03, "f").count() == 0


def test_per_thread_and_board(spark):
    posts = spark.createDataFrame(
        [(1, 10, 1, 1), (1, 10, 1, 1), (1, 11, 5, 2), (2, 12, 3, None), (None, 13, None, 1)], "thread_id long, post_id long, t int, local_idx int"
    ).selectExpr("thread_id", "post_id", "timestamp_seconds(t) AS creation_time", "local_idx", "'x' AS n", "'y' AS rows")
    got = {r.thread_id: (r.posts, r["rows"], r.max_local_idx) for r in per_thread(posts).collect()}
    assert got == {1: (2, 3, 2), 2: (1, 1, None), None: (1, 1, 1)}
    threads = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 8)], "thread_id long, board_id int")
    got = {r.board_id: (r.threads, r.thread_rows, r.posts) for r in per_board(threads, posts).collect()}
    assert got == {7: (2, 3, 3), 8: (1, 1, 0)}
    assert Counter(per_thread(posts.limit(0)).collect()) == Counter()

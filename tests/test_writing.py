from threadloom.plans import writing


def test_numbers_in_all_forms_are_written(spark, tmp_path):
    """Forms that are not plain digits are posts to write too; what cannot be read is not."""
    forms = ["1", "No. 2", "#3", ">>4", " 5 ", "6.0", "７", "0001", "x9", "9.5", None]
    rows = [(i, 1, 5, n, "b", None) for i, n in enumerate(forms)]
    spark.createDataFrame(rows, "incoming_id long, batch_no int, thread_id long, board_post_id string, body string, sha256_hash string").write.parquet(f"{tmp_path}/incoming_posts.parquet")
    posts = [(10, 5, 1, 1, None, None), (11, 5, 4, 2, None, None)]
    spark.createDataFrame(posts, "post_id long, thread_id long, board_post_id long, local_idx int, embed string, creation_time timestamp").write.parquet(f"{tmp_path}/posts.parquet")
    run = lambda name: writing.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r.board_post_id for r in run("missing_posts")) == [2, 3, 5, 6, 7]
    assert sorted((r.board_post_id, r.local_idx) for r in run("assign_local_idx")) == [(2, 3), (3, 4), (5, 5), (6, 6), (7, 7)]
    assert sorted(r.post_id for r in run("get_posts_by_key")) == [10, 11]
    assert run("insert_ignore")[0].rows == 5 and run("new_ids")[0].ids == 5


def test_batch_has_every_stored_post(spark, tmp_path):
    spark.createDataFrame([], "incoming_id long, thread_id long, board_post_id string, body string").write.parquet(f"{tmp_path}/incoming_posts.parquet")
    spark.createDataFrame([(i, 5, i, "e", None) for i in range(8)], "post_id long, thread_id long, board_post_id long, embed string, creation_time timestamp").write.parquet(f"{tmp_path}/posts.parquet")
    rows = writing.QUERIES["upsert_ids_v3"](spark, str(tmp_path)).collect()
    assert sorted((r.post_id, r.action) for r in rows) == [(i, "updated" if i % 4 in (0, 2) else "selected") for i in range(8)]

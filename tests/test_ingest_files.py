"""Snapshots of many small files: how often they are opened, by how many tasks, and which media are found."""

import uuid

from test_ingest import head, media, tree

from threadloom.operators import ingest as ing
from threadloom.sources import snapshot
from threadloom.sources.archive import Archive


def tasks(spark, run):
    """Tasks of the largest stage of what `run` does, and its result."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds]
    return max(i.numTasks for i in stages if i), out


def test_thread_files_are_read_once_and_by_few_tasks(spark, tmp_path):
    tree(tmp_path, {no: [head(no)] for no in range(1, 401)} | {500: "[]", 501: '{"posts": ['})
    most, (posts, bad) = tasks(spark, lambda: snapshot.read_posts(spark, str(tmp_path)))
    assert most <= 8  # 32 files a task would be 13
    for f in (tmp_path / "b" / "res").iterdir():
        f.unlink()
    assert posts.count() == 400 and sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["500.json", "501.json"]


def test_a_bad_thread_in_a_list_rejects_its_whole_file(spark, tmp_path):
    tree(tmp_path, {1: '[{"posts": [{"no": 1, "time": 1, "last_modified": 1, "board": "b", "resto": 0}]}, {"posts": [{"no": 2}]}]', 3: [head(3)]})
    posts, bad = snapshot.read_posts(spark, str(tmp_path))
    assert [r.no for r in posts.collect()] == [3] and bad.count() == 1


def test_media_of_any_name_are_found_by_their_path(spark, tmp_path):
    root, names = tmp_path / "snap", ["_a", "b+c", "d%41", "e f", "g"]
    outside = media("out", file_path="/../out.png")
    tree(root, {1: [head(1, files=[media(n) for n in names] + [media("log", ext="json", file_path="/b/src/log.json"), media("not there"), media("src", file_path="/b/src"), outside])]})
    for n in names:
        (root / "b" / "src" / f"{n}.png").write_text(n)
    (root / "b" / "src" / "log.json").write_text("{}")
    (tmp_path / "out.png").write_text("x")
    (root / "b" / "src" / "named by no post.png").write_text("x")
    done, report = ing.ingest(spark, snapshot.Settings(str(root), "m", "s", "u"), Archive.empty(spark))
    assert sorted(r.board_filename for r in done.attachments.collect()) == sorted([*names, "log"]) and report.added["attachments"] == 6


def test_known_posts_are_not_moved_again(spark, tmp_path):
    """The second of two ingests numbers nothing and scans by few tasks; of a key that comes twice one row is taken, with its own text."""
    settings = snapshot.Settings(str(tmp_path), "m", "s", "u")
    tree(tmp_path, {no: [head(no, com=f"text {no}"), head(no, com=f"text {no}")] for no in range(1, 401)})
    first, report = ing.ingest(spark, settings, Archive.empty(spark), strict=False)
    most, (again, second) = tasks(spark, lambda: ing.ingest(spark, settings, first, strict=False))
    assert most <= 8 and report.added["posts"] == 400 and set(second.added.values()) == {0}
    assert {(r.board_post_id, r.body, r.local_idx) for r in again.posts.collect()} == {(no, f"text {no}", 1) for no in range(1, 401)}
    # then a snapshot with more
    tree(tmp_path, {7: [head(7), head(3, com="late")]})
    third, report = ing.ingest(spark, settings, again, strict=False)
    assert report.added["posts"] == 1 and [(r.body, r.local_idx) for r in third.posts.where("board_post_id = 3 and local_idx = 2").collect()] == [("late", 2)]

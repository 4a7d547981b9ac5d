import hashlib
import json

import pytest

from threadloom.__main__ import main
from threadloom.operators import search
from threadloom.operators.ingest import DuplicateKeys, copy_files, copy_plan, ingest
from threadloom.sources import snapshot
from threadloom.sources.archive import UNIQUE, Archive, unique_violations
from threadloom.streaming.snapshots import current, ingest_stream


def head(no, **more):
    return {"no": no, "time": 1_700_000_000 + no, "last_modified": 1, "board": "b", "resto": 0, "ignored": {"x": 1}} | more


def media(name, **more):
    return {"id": name, "ext": "png", "fsize": 3, "filename": "orig", "md5": "m", "file_path": f"/b/src/{name}.png", "thumb_path": f"/b/thumb/{name}.jpg"} | more


def tree(root, threads, board="b"):
    (root / board / "res").mkdir(parents=True, exist_ok=True)
    (root / board / "src").mkdir(exist_ok=True)
    (root / board / "thumb").mkdir(exist_ok=True)
    (root / board / "catalog.json").write_text(json.dumps([{"page": 0, "threads": [head(no, cyclical="3") for no in threads]}, {"page": 1}]))
    for no, posts in threads.items():
        (root / board / "res" / f"{no}.json").write_text(posts if isinstance(posts, str) else json.dumps({"posts": posts}))


@pytest.fixture
def site(tmp_path):
    root = tmp_path / "snap"
    files = [media("a", w=4, h=5), media("gone", file_path="/b/src/deleted"), media("c", spoiler=True, w=1)]
    tree(root, {1: [head(1, com="op", sub="s", files=files), head(3, com="late")], 2: [head(2, tim="55", ext=".gif", filename="f", fsize=0), head(4, tim="56", ext=".gif", filename="f")], 9: '{"posts": [{"no": 9'})
    tree(root, {5: [head(5)]}, "c")
    (root / "sfw").mkdir()
    (root / "sfw" / "catalog.json").write_text("[]")
    (root / "empty").mkdir()
    for name in ("a", "c"):
        (root / "b" / "src" / f"{name}.png").write_bytes(name.encode())
    (root / "b" / "thumb" / "a.jpg").write_bytes(b"t")
    (root / "b" / "src" / "55.gif").write_bytes(b"gif")
    return root, snapshot.Settings(str(root), str(tmp_path / "media"), "site", "http://site.example")


def test_ingest_twice(spark, site):
    root, settings = site
    index = str(root.parent / "index")
    first, report = ingest(spark, settings, Archive.empty(spark), index=index, config="simple")
    assert search.hits(search.read_index(spark, index), "late", "2024-06-01", "simple").count() == 1
    assert report.added == {"sites": 1, "boards": 2, "threads": 4, "posts": 5, "attachments": 3}
    assert report.rejected_count == 1 and report.rejected.first().path.endswith("9.json")
    for name, keys in UNIQUE.items():
        assert all(unique_violations(getattr(first, name), k).isEmpty() for k in keys), name
    files = {r.board_filename: r for r in first.attachments.collect()}
    assert set(files) == {"a", "c", "55"} and files["c"].attachment_idx == 3  # the place of a deleted file stays free
    assert files["a"].sha256_hash == hashlib.sha256(b"a").hexdigest() and tuple(files["a"].resolution) == (4, 5) and files["c"].resolution is None
    assert (files["a"].spoiler, files["c"].spoiler, files["55"].spoiler) == (False, True, False) and files["55"].mimetype == "image/gif" and files["a"].illegal is False
    again, second = ingest(spark, settings, first, index=index)
    assert set(second.added.values()) == {0} and again.posts.count() == 5
    assert (second.sum_post_id, second.sum_board_post_id) == (report.sum_post_id, report.sum_board_post_id) == (15, 15)

    # a late post with a small number, a new thread on the other board
    tree(root, {1: [head(1), head(2), head(3), head(8)], 2: [head(2)]})
    tree(root, {5: [head(5)], 6: [head(6), head(7)]}, "c")
    third, report = ingest(spark, settings, again)
    assert report.added == {"sites": 0, "boards": 0, "threads": 1, "posts": 4, "attachments": 0}
    assert {(r.board_post_id, r.local_idx) for r in third.posts.where("board_post_id in (1, 2, 3, 8)").collect() if r.thread_id == third.posts.where("board_post_id = 8").first().thread_id} == {(1, 1), (3, 2), (2, 3), (8, 4)}


def test_repeated_key_is_an_error_only_in_strict_mode(spark, site):
    root, settings = site
    tree(root, {1: [head(1), head(1)]})
    with pytest.raises(DuplicateKeys):
        ingest(spark, settings, Archive.empty(spark))
    assert ingest(spark, settings, Archive.empty(spark), strict=False)[1].added["posts"] == 2


def test_bad_files_are_rejected_whole(spark, tmp_path):
    tree(tmp_path, {1: [head(1), {k: v for k, v in head(2).items() if k != "no"}], 2: [head(2, time="x")], 3: [head(3, files=[{"id": "a"}])], 4: [head(4)], 5: "[]"})
    posts, bad = snapshot.read_posts(spark, str(tmp_path))
    assert [r.no for r in posts.collect()] == [4]
    assert sorted(r.path.rsplit('/', 1)[1] for r in bad.collect()) == ["1.json", "2.json", "3.json", "5.json"]


def test_copy(spark, site, tmp_path):
    root, settings = site
    posts, _ = snapshot.read_posts(spark, str(root))
    files = snapshot.files_of(posts)
    assert copy_plan(files, settings).count() == 6
    copy_files(files, settings)
    out = tmp_path / "media" / "site" / "b" / "1"
    assert (out / "a.png").read_bytes() == b"a" and (out / "thumbnail_a.jpg").read_bytes() == b"t"
    (root / "b" / "src" / "a.png").write_bytes(b"new")
    copy_files(files, settings)
    assert (out / "a.png").read_bytes() == b"a"


def test_stream(spark, site, tmp_path):
    root, settings = site
    (tmp_path / "lists").mkdir()
    (tmp_path / "store").mkdir()
    for i in range(2):
        (tmp_path / "lists" / f"{i}.txt").write_text(f"{root}\n")
        q = ingest_stream(spark, str(tmp_path / "lists"), settings, str(tmp_path / "store"), str(tmp_path / "chk"))
        assert q.awaitTermination(120)
        assert current(spark, str(tmp_path / "store")).posts.count() == 5


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"backup_read_root": "r", "media_root_path": "m", "site_name": "n", "site_url": "u", "other": 1}))
    assert snapshot.Settings.read(str(p)).site_name == "n"
    p.write_text("{}")
    with pytest.raises(ValueError):
        snapshot.Settings.read(str(p))


def test_command(spark, site, tmp_path, capsys, monkeypatch):
    _, settings = site
    (tmp_path / "settings.json").write_text(json.dumps(settings.__dict__))
    monkeypatch.chdir(tmp_path)
    assert main(["--store", str(tmp_path / "store")], spark) == 0
    assert main(["settings.json", "--store", str(tmp_path / "store")], spark) == 0
    first, second = capsys.readouterr().out.splitlines()
    assert "'posts': 5" in first and "'posts': 0" in second and "rejected files 1" in second
    assert current(spark, str(tmp_path / "store")).posts.count() == 5
    assert search.hits(search.read_index(spark, str(tmp_path / "store" / "search")), "late", "2024-06-01").count() == 1
    assert main(["missing.json", "--store", "x"], spark) == 1

import base64
import random

import pytest

from pyspark.sql import functions as F

from threadloom.common import list_names, new_path
from threadloom.llm import linkage, near_dup

VOCABULARY = [f"word{i}" for i in range(900)]
POSTS = "post_id long, thread_id long, board_post_id long, body string"
FILES = "sha256_hash string, post_id long"
INCOMING = "incoming_id long, batch_no int, thread_id long, board_post_id string, body string, sha256_hash string, entity string, fp string"


def new_index(spark, posts, files, **more):
    return linkage.LinkageIndex.create(spark, new_path(spark, "index"), posts, files, **more)


def test_forms(spark):
    df = spark.createDataFrame([(" 0012 ", "0x" + "AB" * 32), ("No.12", "sha256:" + "ab" * 32), (">>12", ":".join(["ab"] * 32)), ("#12", "ab" * 31), ("12.0", ""), ("１２", "ab" * 32 + "\n"), ("x12", None), ("12.5", "zz" * 32), (None, "SHA256-" + "ab" * 32)], "n string, h string")
    rows = df.select(linkage.number_of(F.col("n")), linkage.hash_of(F.col("h"))).collect()
    assert [r[0] for r in rows] == [12] * 6 + [None] * 3
    h = "ab" * 32
    assert [r[1] for r in rows] == [h, h, h, None, None, h, None, None, h]


def test_base64_hashes(spark):
    """The same 32 bytes in base64 and in hex digits are one hash; the bytes are read by Python here, not by hash_of."""
    raw = bytes(range(200, 232))
    b64 = base64.b64encode(raw).decode()
    forms = [b64, f" {b64}\n", b64.rstrip("="), f"sha256-{b64}", f"SHA-256: {b64}", raw.hex(), b64.lower(), b64[1:], b64 + "A", base64.b64encode(raw[1:]).decode()]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(forms)], "i long, h string").select("i", linkage.hash_of(F.col("h")).alias("h")).collect()
    assert {r.i: r.h for r in rows} == {i: raw.hex() if i < 6 else base64.b64decode(b64.lower()).hex() if i == 6 else None for i in range(len(forms))}
    index = new_index(spark, spark.createDataFrame([(1, 1, 1, None)], POSTS), spark.createDataFrame([(raw.hex(), 1)], "sha256_hash string, post_id long"))
    other = base64.b64encode(bytes(32)).decode()
    records = [(1, 1, 5, None, None, b64), (2, 1, 5, None, None, other), (3, 1, 5, None, None, bytes(32).hex())]
    decisions, _ = index.process(spark.createDataFrame([(*r, "", "") for r in records], INCOMING))
    assert {r.incoming_id for r in decisions.where("repeat").collect()} == {1, 3}


def make(seed):
    rnd = random.Random(seed)
    bodies = [" ".join(rnd.sample(VOCABULARY, 60)) for _ in range(8)]
    edit = lambda b: " ".join(w if rnd.random() > 0.12 else rnd.choice(VOCABULARY) for w in b.split())
    h = lambda i: f"{i:064x}"
    posts = [(i, i % 3, i // 3, bodies[i] if i < 4 else None) for i in range(30)] + [(0, 0, 0, bodies[0])]
    files = [(h(i), i) for i in range(5)] + [(None, 3), ("bad", 4)]
    incoming = []
    for i in range(160):
        number = rnd.choice([None, str(rnd.randint(0, 40)), f">>{rnd.randint(0, 40)}", "?"])
        body = rnd.choice([None, "", "short", edit(rnd.choice(bodies)), edit(rnd.choice(bodies)), rnd.choice(bodies)])
        hash_ = rnd.choice([None, None, h(rnd.randint(0, 40)), "0x" + h(rnd.randint(0, 40)).upper(), "junk"])
        incoming.append((i, 1 + i // 40, rnd.choice([0, 1, 2, 7, None]), number, body, hash_, "e", "f"))
    return posts, files, incoming


def brute(posts, files, incoming):
    numbers = {(t, n) for _, t, n, _ in posts}
    hashes = {h for h, _ in files if h and len(h) == 64}
    sets = [(t, near_dup.word_set(b)) for _, t, _, b in posts if b]
    cases = set()
    for i, _, t, n, b, h, *_ in sorted(incoming, key=lambda r: (r[1], r[0])):
        n = int(n.strip(">")) if n and n.strip(">").isdigit() else None
        h = h.lower().removeprefix("0x") if h and h != "junk" else None
        w = near_dup.word_set(b) if b else set()
        near = t is not None and len(w) >= 40 and any(t == u and len(s) >= 40 and len(w & s) >= 0.65 * len(w | s) for u, s in sets)
        if t is not None and n is not None and (t, n) in numbers or h in hashes or near:
            cases.add(i)
        else:
            numbers.add((t, n))
            hashes |= {h} if h else set()
            sets.append((t, w))
    return cases


def test_equals_brute_force(spark):
    for seed in (1,):
        posts, files, incoming = make(seed)
        p, f = spark.createDataFrame(posts, POSTS), spark.createDataFrame(files, "sha256_hash string, post_id long")
        i = spark.createDataFrame(incoming + incoming[:3], INCOMING).repartition(3)
        index = new_index(spark, p, f)
        decisions, links = index.process(i)
        got = {r.incoming_id for r in decisions.where("repeat").collect()}
        assert got == brute(posts, files, incoming)
        assert decisions.count() == len(incoming) and {r.incoming_id for r in links.collect()} == got


def test_empty(spark):
    index = new_index(spark, spark.createDataFrame([], POSTS), spark.createDataFrame([], "sha256_hash string, post_id long"))
    decisions, links = index.process(spark.createDataFrame([], INCOMING))
    assert decisions.count() == links.count() == 0
    decisions, _ = index.process(spark.createDataFrame([(1, 1, None, None, None, None, "", "")], INCOMING))
    assert [tuple(r) for r in decisions.collect()] == [(1, False)]


def test_chain_is_decided_in_order(spark):
    """1 ~ 2 ~ 3 by different keys: 2 repeats 1, so 3 has nothing accepted to repeat."""
    a, b = "a" * 64, "b" * 64
    rows = [(1, 1, 5, "1", None, a), (2, 1, 5, "2", None, a), (3, 1, 5, "2", None, b), (4, 1, 5, "9", None, b)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], INCOMING)
    decisions, _ = new_index(spark, spark.createDataFrame([], POSTS), spark.createDataFrame([], FILES)).process(df)
    assert {r.incoming_id for r in decisions.where("repeat").collect()} == {2, 4}


def test_weights():
    counts = {(1, 0, 1): 50, (1, 0, 0): 20, (0, 1, 0): 10, (0, 0, 0): 400}
    w = linkage.learned_weights(counts, {"number": 1e-4, "hash": 1e-5, "body": 1e-6})
    assert all(v > 5 for v in w.gains.values()) and w.gains["body"] > w.gains["number"] and w.alone == list(linkage.FIELDS)
    # more candidates that agree in the body are worth more than fewer; nothing known is worth the least
    fewer = linkage.learned_weights(counts | {(1, 0, 1): 5}, {"number": 1e-4, "hash": 1e-5, "body": 1e-6})
    assert fewer.gains["body"] < w.gains["body"]
    assert linkage.learned_weights({}, dict.fromkeys(linkage.FIELDS, 0.5)).gains == dict.fromkeys(linkage.FIELDS, linkage.MIN_GAIN)


def test_weights_decide(spark):
    """A file hash that is not worth enough by itself decides only together with another field."""
    a = "a" * 64
    posts = spark.createDataFrame([(1, 5, 7, None)], POSTS)
    rows = [(1, 1, 6, "1", None, a), (2, 1, 5, "7", None, a), (3, 1, 6, "2", None, "b" * 64), (4, 1, 6, "2", None, "c" * 64), (5, 1, 9, "1", None, "c" * 64), (6, 1, 6, "2", None, "b" * 64)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], INCOMING)
    repeats = lambda w: {r.incoming_id for r in new_index(spark, posts, spark.createDataFrame([(a, 1)], FILES)).process(df, w)[0].where("repeat").collect()}
    assert repeats(None) == {1, 2, 4, 6}
    assert repeats(linkage.Weights({"number": 8.0, "hash": 1.0, "body": 8.0}, 4.0)) == {2, 4, 6}
    assert repeats(linkage.Weights({"number": 3.0, "hash": 2.0, "body": 8.0}, 4.0)) == {2, 6}


def test_reopened_index_goes_on(spark, monkeypatch):
    """Batches given to an index that is opened anew each time, with many folders and merged segments, decide as one call does."""
    posts, files, incoming = make(4)
    p, f = spark.createDataFrame(posts, POSTS), spark.createDataFrame(files, FILES)
    want = brute(posts, files, incoming)
    index, got = new_index(spark, p, f, folder_rows=7), set()
    assert index.state["folders"]["bands"] > 4
    monkeypatch.setattr(linkage, "FAN_IN", 3)
    for k in range(4):
        index = linkage.LinkageIndex.open(spark, index.path)
        part = spark.createDataFrame(incoming[40 * k : 40 * k + 40], INCOMING)
        got |= {r.incoming_id for r in index.process(part)[0].where("repeat").collect()}
        if k == 1:
            again = linkage.LinkageIndex.open(spark, index.path)
            assert {r.incoming_id for r in again.process(part)[0].where("repeat").collect()} == {i for i in got if 40 <= i < 80}  # decided before: kept
            index = again
    assert got == want and len(index.state["segments"]) == 4
    index.vacuum()
    assert len(list_names(spark, f"{index.path}/keys")) == len(index.state["segments"])
    assert linkage.LinkageIndex.open(spark, index.path).table("seen").count() == len(incoming)


def test_failed_batch_leaves_no_trace(spark):
    index = new_index(spark, spark.createDataFrame([], POSTS), spark.createDataFrame([], FILES))
    df = spark.createDataFrame([(1, 1, 5, "1", None, None, "", "")], INCOMING)
    other = linkage.LinkageIndex.open(spark, index.path)
    index.process(df)
    with pytest.raises(FileExistsError):  # a second writer from the same version
        other.process(df)
    assert linkage.LinkageIndex.open(spark, index.path).table("seen").count() == 1


def test_first_load_into_an_empty_archive(spark, tmp_path):
    """Without a history nothing is known about the fields; repeats in two of them still are cases."""
    body, h = " ".join(VOCABULARY[:60]), "c" * 64
    rows = [(0, 1, 5, "7", None, h)] + [(i, 2, 5, "7", None, h) for i in range(1, 11)] + [(i, 3, 6, None, body, None) for i in range(11, 102)] + [(102, 3, 6, "1", None, None)]
    spark.createDataFrame([], POSTS).write.parquet(f"{tmp_path}/posts.parquet")
    spark.createDataFrame([], "sha256_hash string, post_id long").write.parquet(f"{tmp_path}/attachments.parquet")
    spark.createDataFrame([(*r, "", "") for r in rows], INCOMING).write.parquet(f"{tmp_path}/incoming_posts.parquet")
    want = set(range(1, 11)) | set(range(12, 102))
    assert sorted(r.incoming_id for r in linkage.p3_found(spark, str(tmp_path)).collect()) == sorted(want)
    links = linkage.p3_links(spark, str(tmp_path)).collect()
    assert {r.incoming_id for r in links} == want and {r.id for r in links} == {0, 11}


def all_links(posts, files, incoming, cases):
    """Every agreement of a case with posts, files and earlier records that are no cases."""
    sets = lambda t, b: (t, near_dup.word_set(b) if b else set())
    number = lambda n: int(n.strip(">")) if n and n.strip(">").isdigit() else None
    plain = lambda h: h.lower().removeprefix("0x") if h and len(h) >= 64 else None
    known = [(2 * p, t, n, None, sets(t, b)) for p, t, n, b in posts] + [(2 * p, None, None, plain(h), sets(None, None)) for h, p in files]
    found = set()
    for i, _, t, n, b, h, *_ in sorted(incoming, key=lambda r: (r[1], r[0])):
        n, h, (_, w) = number(n), plain(h), sets(t, b)
        if i not in cases:
            known.append((2 * i + 1, t, n, h, (t, w)))
            continue
        for e, t2, n2, h2, (u, x) in known:
            if t is not None and n is not None and (t, n) == (t2, n2):
                found.add((i, "number", e))
            if h is not None and h == h2:
                found.add((i, "hash", e))
            if t is not None and t == u and len(w) >= 40 and len(x) >= 40 and len(w & x) >= 0.65 * len(w | x):
                found.add((i, "body", e))
    return found


def test_links_are_complete_at_any_split(spark):
    posts, files, incoming = make(3)
    files += [(f"{2:064x}", 9), (f"{3:064x}", 9)]
    p, f = spark.createDataFrame(posts, POSTS), spark.createDataFrame(files, "sha256_hash string, post_id long")
    i = spark.createDataFrame(incoming, INCOMING).repartition(3)
    want, clusters = all_links(posts, files, incoming, brute(posts, files, incoming)), []
    for batches in (["true"], ["batch_no < 3", "batch_no >= 3"]):
        index, got = new_index(spark, p, f), set()
        for b in batches:
            links = index.process(i.where(b))[1]
            index.merge(links)
            got |= {tuple(r) for r in links.collect()}
        assert got == want
        clusters.append(sorted(map(tuple, index.clusters().collect())))
    parent = {}
    find = lambda x: find(parent[x]) if x in parent else x
    for r, _, e in want:
        a, b = sorted((find(2 * r + 1), find(e - (1 << 62) if e % 2 == 0 else e)))
        if a != b:
            parent[b] = a
    assert clusters[0] == clusters[1] == sorted((x, find(x)) for x in parent)


def test_link_to_history_and_to_an_accepted_record(spark):
    index = new_index(spark, spark.createDataFrame([(1, 5, 7, None)], POSTS), spark.createDataFrame([], "sha256_hash string, post_id long"))
    rows = [(1, 1, 5, "8", None, "a" * 64), (2, 1, 5, "7", None, "a" * 64)]
    links = index.process(spark.createDataFrame([(*r, "", "") for r in rows], INCOMING))[1]
    assert sorted(tuple(r) for r in links.collect()) == [(2, "hash", 3), (2, "number", 2)]

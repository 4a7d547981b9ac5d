import base64
import os

import pytest

from threadloom.llm import packing, tokens

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json"), reason="no tokenizer files")

TEXTS = [
    None, "", " ", "hello world", "Hello  WORLD\r\n\r\n\tit's they'll DON'T", "naïve café — Straße", "日本語のテキスト", "при́вет мир", "👩‍💻🏳️‍🌈", "<|endoftext|> x", "a" * 5000, "ab" * 3000, "lol" * 999,
    "1234567 3.14 0x1F", "x​y﻿z\xa0w", "\x00\x07", "...---...", "word " * 4000, "'s 't're", "   trailing   ", "é", "१२३ ١٢٣",
]


@pytest.fixture(scope="module")
def reference():
    path = f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_reference(spark, reference):
    rows = [(i, t, "extra", [1]) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", [2]), (None, "null id", "", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, ids array<int>").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in tokens.encode_ids(df).collect())
    assert got == sorted((i if i is not None else -1, reference.encode_ordinary(t) if t else []) for i, t, *_ in rows)
    assert tokens.encode_ids(df.limit(0)).count() == 0
    counts = {r.doc_id: r.n_tokens for r in tokens.encode_ids(df.where("doc_id < 10"), counts_only=True).collect()}
    assert counts[0] == counts[1] == 0 and counts[3] == 2


def test_small_batches(spark, reference, monkeypatch):
    """Many dictionary batches, replays and outputs give what one does."""
    for name in ("BATCH_ROWS", "OUT_ROWS", "REPLAY_WORDS"):
        monkeypatch.setattr(tokens, name, 2)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id string, text string").repartition(2)
    assert {int(r.doc_id): list(r.ids) for r in tokens.encode_ids(df).collect()} == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_ascii_pattern_equals_general():
    import re

    import regex

    for t in TEXTS:
        if t and t.isascii():
            assert re.findall(tokens.ASCII_PATTERN, t) == regex.findall(tokens.WORD_PATTERN, t)


def check_packing(rows, sizes, capacity):
    """Every item once, whole unless too long; no overlap; nothing beyond the capacity."""
    pieces, used = {}, {}
    for r in rows:
        pieces.setdefault(r.id, []).append((r.from_token, r.n_tokens))
        if r.n_tokens:
            used.setdefault(r.container, []).append((r.place, r.n_tokens))
        else:
            assert r.container is None
    for c in used.values():
        at = 0
        for place, n in sorted(c):
            assert place >= at
            at = place + n
        assert at <= capacity
    for i, n in sizes:
        p = sorted(pieces[i])
        assert sum(x for _, x in p) == (n or 0) and [a for a, _ in p] == [k * capacity for k in range(len(p))]
        assert len(p) == max(1, -(-(n or 0) // capacity))
    return len(used)


def test_packing(spark):
    sizes = [(i, (i * 37) % 150) for i in range(2000)] + [(5000 + i, 60) for i in range(1500)] + [(9001, 1000), (9002, None), (9003, 0), (9004, 100), (9005, 300)]
    df = spark.createDataFrame([(*s, 1, "x") for s in sizes], "id long, n int, rank int, length string")
    rows = packing.pack(df, "id", "n", 100).collect()
    bins = check_packing(rows, sizes, 100)
    total = sum(n or 0 for _, n in sizes)
    assert bins <= 1.1 * -(-total // 100) + 1500 * 0.35  # 1,500 items of 60 leave room of 40 for others
    assert sorted(packing.pack(df, "id", "n", 100).collect()) == sorted(rows)
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0


def test_plan_follows_best_fit():
    plan = packing.plan({6: 2, 5: 2, 4: 1, 1: 3}, 10)
    containers = {}
    for length, _, ranks, per, first, _ in plan:
        for r in range(ranks):
            containers.setdefault(first + r // per, []).append(length)
    assert sorted(map(sorted, containers.values())) == [[1, 1, 1, 6], [4, 6], [5, 5]]
    for length, n in {6: 2, 5: 2, 4: 1, 1: 3}.items():
        assert sorted(x for ln, a, k, *_ in plan if ln == length for x in range(a, a + k)) == list(range(1, n + 1))
    assert packing.plan({}, 10) == []


def test_repeated_ids_are_items(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 5)], "id long, n int")
    assert sorted(r.place for r in packing.pack(df, "id", "n", 15).collect()) == [0, 5, 10]


def test_no_row_holds_a_whole_batch(spark, reference, monkeypatch):
    """Texts of a batch lie in pieces of bounded size, with its words in the first row; the ids are the same."""
    monkeypatch.setattr(tokens, "PIECE_WORDS", 10)
    texts = [f"one two three text{i} " * (i % 4) for i in range(60)] + [None, "", "long " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = tokens.dictionary_batches(df, "doc_id", "text").collect()
    assert len({r.batch for r in rows}) == 1 and len(rows) > 20 and [bool(r.words) for r in rows] == [True] + [False] * (len(rows) - 1)
    assert all(sum(r.sizes) <= 10 or len(r.sizes) == 1 for r in rows)
    want = {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: list(r.ids) for r in tokens.encode_ids(df).collect()} == want
    assert {r.doc_id: r.n_tokens for r in tokens.encode_ids(df, counts_only=True).collect()} == {i: len(x) for i, x in want.items()}

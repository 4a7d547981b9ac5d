import random

import numpy as np
import pytest

from threadloom.llm import batches
from threadloom.llm import near_dup as n

VOCABULARY = [f"word{i}" for i in range(900)]


def texts(seed=3):
    """Some groups of near copies, by a share of words replaced, among unrelated texts; (id, body)."""
    rnd, rows, i = random.Random(seed), [], 0
    for group in range(60):
        base = rnd.sample(VOCABULARY, rnd.randint(40, 90))
        for copy in range(rnd.choice([1, 1, 2, 4])):
            words = list(base)
            for _ in range(int(len(words) * rnd.choice([0, 0.03, 0.1, 0.15]))):
                words[rnd.randrange(len(words))] = rnd.choice(VOCABULARY)
            rnd.shuffle(words)
            i += 1
            rows.append((i, " ".join(words) if copy % 2 else "<b>" + "&nbsp;".join(w.upper() for w in words) + "</b><br/>"))
    return rows


def brute(rows, similarity=n.SIMILARITY, least=n.LEAST_WORDS):
    sets = {i: n.word_set(b) for i, b in rows if b}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def found(spark, rows):
    df = spark.createDataFrame([(i, b, 0, "x") for i, b in rows], "post_id long, body string, fp int, words string").repartition(4)
    members, links = n.near_duplicates(df, "post_id", "body")
    return [tuple(r) for r in n.member_pairs(members, links, "post_id").collect()]


def test_words():
    assert n.word_set("<p>It&#39;s &amp; A_b café café</p>12") == {"it", "s", "a", "b", "café", "12"}


def test_equals_brute_force(spark):
    rows = texts()
    rows += [(1000, None), (1001, ""), (1002, "too short"), (1003, "x " * 5000), rows[0], (1004, rows[0][1]), (1005, rows[0][1]), (1006, "z" * 100_000)]
    got = found(spark, rows)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert found(spark, rows[:1]) == [] and found(spark, [(1, None)]) == []


def test_plans(spark, monkeypatch):
    """More places a band and more bands for more texts, with the same chance to meet a pair; and the same pairs."""
    assert n.band_plan(0) == n.band_plan(2_000_000) == (n.BANDS, n.ROWS)
    for count in (2_000_001, 16_000_001, 10**9):
        bands, rows = n.band_plan(count)
        assert rows > n.ROWS and abs((1 - n.SIMILARITY**rows) ** bands - (1 - n.SIMILARITY**n.ROWS) ** n.BANDS) < 0.001
    monkeypatch.setattr(n, "FIRST_PLAN", 1)
    rows = texts()
    assert n.band_plan(len(rows))[1] > n.ROWS
    assert set(found(spark, rows)) == brute(rows)


def test_large_classes_are_salted(spark, monkeypatch):
    monkeypatch.setattr(batches, "GROUP_PART", 3)
    base, other = texts()[0][1], " ".join(f"w{i}" for i in range(50))
    near = " ".join([*other.split()[:-2], "x", "y"])
    rows = [(i, base) for i in range(20)] + [(100 + i, other) for i in range(11)] + [(200 + i, near) for i in range(7)]
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.65, 0.9):
        words = rnd.integers(0, 2**63, 200).astype(np.uint64)
        k = int(200 * 2 * share / (1 + share)) // 2 * 2
        a, b = words[:k], words[:k]
        extra = rnd.integers(0, 2**63, 2 * (200 - k)).astype(np.uint64)
        a, b = np.concatenate([a, extra[: 200 - k]]), np.concatenate([b, extra[200 - k :]])
        sig = n.signatures(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 2048 // 8)
        true = k / (400 - k)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.1
    assert (n.signatures(a, np.zeros(200, int), 1) == n.signatures(a[::-1].copy(), np.zeros(200, int), 1)).all()


def test_groups(spark, tmp_path):
    rows = texts(5) + [(2000, texts(5)[0][1])]
    df = spark.createDataFrame([(i, b) for i, b in rows], "post_id long, body string")
    df.write.parquet(str(tmp_path / "posts.parquet"))
    got = {r.post_id: (r.group_id, r.links) for r in n.p4_groups(spark, str(tmp_path)).collect()}
    parent, degree = {}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: (find(x), degree[x]) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(30)], [(5, 3), (3, 4), (9, 8), (8, 7), (7, 9)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r.node: r.root for r in n.components(df, "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


def test_more_places_than_a_byte_counts():
    """Plans for very many texts have more than 255 places: a set of few words fills them in rounds beyond 255, which have their own values."""
    places = n.band_plan(10**8)[0] * n.band_plan(10**8)[1]
    words = np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = n.signatures(np.concatenate([words, words[:2], words]), np.repeat([0, 1, 2], [3, 2, 3]), 3, places)
    assert places > 255 and (sig[0] == sig[2]).all() and (sig < 0xFFFFFFFF).all()
    assert abs((sig[0] == sig[1]).mean() - 2 / 3) < 0.08
    low = 32 - places.bit_length()
    assert (sig[0] >> low).max() > 255

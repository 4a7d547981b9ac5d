import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import unicode_forms as u

SAME = [
    ("é", "é"), ("ａｂＣ１", "abC1"), ("ﬁn", "fin"), ("раураl", "paypal"), ("a​b⁠c﻿", "abc"), ("a\xa0b　c d", "a b c d"), ("й", "й"), ("ё", "ë"), ("ệ", "ệ"),
    ("각", "각"), ("ガ", "ｶﾞ"), ("K", "K"), ("ậ", "ậ"), ("̣́", "̣́"), ("soft\xadhyphen", "softhyphen"), ("ΑΒΕ", "ABE"), ("x̧́", "x̧́"),
]
APART = [("x²", "x2"), ("a b", "a  b"), ("a", "A"), ("é", "e"), ("👩‍💻", "👩💻"), ("l", "1"), ("a\nb", "a b"), ("½", "1/2"), ("™", "TM"), ("'", "’"), ("a", "a."), ("١", "1")]


@pytest.fixture(scope="module")
def canon():
    return u.Canonical(u.mapping_tables())


def test_same_and_apart(canon):
    for a, b in SAME:
        x, y = canon([a, b])
        assert x == y, (a, b, x, y)
    for a, b in APART:
        x, y = canon([a, b])
        assert x != y, (a, b)
    assert canon([None, "", "plain"]) == [None, "", "plain"]


def test_batch_equals_single(canon):
    texts = [t for p in SAME + APART for t in p] * 3
    assert canon(texts) == [canon([t])[0] for t in texts]


@settings(max_examples=300)
@given(st.text(alphabet=st.sampled_from("aeiouEIxzAỌ̧́̀̈̂̆éüñçệ각가각 \n"), max_size=12))
def test_is_nfc_and_idempotent(text):
    canon = _CANON
    form = canon([text])[0]
    assert canon([form])[0] == form
    assert canon([unicodedata.normalize("NFD", text)])[0] == form
    assert form == unicodedata.normalize("NFC", text)


_CANON = u.Canonical(u.mapping_tables())


def test_expressions_equal_arrays(spark, canon, monkeypatch):
    """The plan and the arrays in Python agree, on all kinds of characters, alone and mixed."""
    import random

    rnd = random.Random(4)
    alphabet = "aeiou" + "".join(map(chr, [0x301, 0x327, 0x323, 0x302, 0x300, 0x345, 0xE9, 0x1EC7, 0xFB01, 0xFF21, 0xFF76, 0xFF9E, 0xA0, 0x3000, 0x200B, 0x200D, 0x200C, 0xFE0F, 0x1F469, 0x1F4BB, 0x430, 0x43E, 0x438, 0x306, 0x1100, 0x1161, 0x11A8, 0xAC00, 0xD55C, 0x915, 0x94D, 0xA8, 0x344, 0x340, 0x2028, 0x85, 0xAD])) + " \n\t1"
    texts = [t for p in SAME + APART for t in p] + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 14))) for _ in range(600)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.text_norm for r in u.canonical_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    with monkeypatch.context() as m:
        m.setattr(u, "BROADCAST_CLUSTERS", 0)
        assert {r.doc_id: r.text_norm for r in u.canonical_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == got
    bad = [(t, got[i], f) for (i, t), f in zip(rows, canon(texts)) if got[i] != f]
    assert not bad, bad[:5]


def test_pairs(spark):
    rows = [(1, "paypal"), (2, "раураl"), (3, "paypal"), (4, "Paypal"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "　"), (10, "pay​pal"), (2, "раураl")]
    df = spark.createDataFrame([(i, t, "l", "r") for i, t in rows], "doc_id long, text string, look string, raw string")
    got = sorted(tuple(r) for r in u.lookalike_pairs(df).collect())
    assert got == [(1, 2), (1, 10), (2, 3), (2, 10), (3, 10)]
    assert u.lookalike_pairs(df.limit(0)).count() == 0
    long = "x" * 200_000
    norm = {r.doc_id: r.text_norm for r in u.canonical_text(spark.createDataFrame([(1, long + "é"), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert norm == {1: long + "é", 2: None, 3: ""}

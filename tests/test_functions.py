import math
from datetime import datetime, timedelta

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import media, text
from threadloom.functions.timefn import age_since, on_day


def test_age_matches_sql(spark):
    times = [datetime(2023, 1, 20), datetime(2004, 4, 30, 5), datetime(2023, 1, 31, 23, 59, 59), datetime(2024, 2, 29, 12), datetime(2024, 3, 15, 1), datetime(2025, 12, 31)]
    times += [datetime(2020, 1, 1) + timedelta(hours=37 * i, seconds=i) for i in range(400)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = {r.t: r.a for r in df.select("t", age_since(F.lit("2024-03-15 18:00:00").cast("timestamp_ntz"), F.col("t")).alias("a")).collect()}
    c = duckdb.connect()
    for t in times:
        assert got[t] == c.execute("SELECT extract(epoch FROM age(TIMESTAMP '2024-03-15', ?::TIMESTAMP))", [t]).fetchone()[0], t


def test_day(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 23, 59),), (datetime(2024, 1, 2),), (datetime(2024, 1, 3),)], "t timestamp_ntz")
    assert df.where(on_day(F.col("t"), "2024-01-02")).count() == 1


def test_zigzag_and_distance(spark):
    values = [0, 1, -1, 2, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert all(r.v == r.w for r in df.select("v", media.zigzag_decode(media.zigzag_encode(F.col("v"))).alias("w")).collect())
    mask = 2**64 - 1
    decode = lambda n: ((n >> 1) ^ -(n & 1)) & mask
    signed = lambda n: n - 2**64 if n >> 63 else n
    pairs = [(0b1011, 0b1010), (2**63 + 5, 4), (mask, 0)]
    df = spark.createDataFrame([(signed(decode(a)), signed(decode(b)), bin(a ^ b).count("1")) for a, b in pairs], "a long, b long, d int")
    assert all(r.d == r.h for r in df.select("d", media.hamming(F.col("a"), F.col("b")).alias("h")).collect())


def test_files(spark):
    df = spark.createDataFrame([(".PNG", "a/b.c/d.tar.gz"), (" jpg. ", "noext"), (None, "x.JPG")], "e string, p string")
    got = [tuple(r) for r in df.select(media.bare(F.col("e")), media.mime_of(F.col("e")), media.extension(F.col("p"))).collect()]
    assert got == [("png", "image/png", "gz"), ("jpg", "image/jpeg", ""), (None, "application/octet-stream", "JPG")]
    df = spark.createDataFrame([("3",), ("3.7",), ("x",), (None,), ("-1.5",)], "v string")
    assert [r[0] for r in df.select(media.int_of(F.col("v"))).collect()] == [3, 3, None, None, -2]


def test_stems():
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "filing": "file",
        "happy": "happi", "relational": "relat", "conditional": "condit", "generalizations": "general", "hopefulness": "hope", "consistency": "consist", "knightly": "knight", "probate": "probat",
        "controlling": "control", "skies": "sky", "dying": "die", "news": "news", "compiling": "compil", "keyboards": "keyboard", "sky": "sky", "by": "by", "say": "say", "bed": "bed",
    }
    assert {w: text.stem(w) for w in pairs} == pairs


def test_parse():
    T, N = text.Term, text.Not
    p = lambda s: text.parse_web(s, "simple")
    assert p("a b") == [[T(("a",)), T(("b",))]]
    assert p('"a b" or c') == [[T(("a", "b"))], [T(("c",))]]
    assert p('a -b -"c d"') == [[T(("a",)), N(T(("b",))), N(T(("c", "d")))]]
    assert p("") == p('or -"" ""') == []
    assert text.parse_web("the of", "english") == []
    assert text.parse_web("found this board", "english") == [[T(("found",)), T(("board",))]]


def test_rank(spark):
    schema = "a array<struct<pos: int, w: double>>, b array<struct<pos: int, w: double>>"

    def rank(a, b, q):
        row = spark.createDataFrame([(a, b)], schema).select(text.rank_of({"a": F.col("a"), "b": F.col("b")}, text.parse_web(q, "simple")).alias("r")).first()
        return row.r

    assert abs(rank([(1, 1.0)], [], "a") - 1 / text.ZETA2) < 1e-12
    assert abs(rank([(1, 0.2), (9, 0.2)], [], "a") - 0.25 / text.ZETA2) < 1e-12
    # the best weight counts whole, wherever it stands
    assert abs(rank([(1, 0.2), (9, 0.4)], [], "a") - (0.4 + 0.2 + 0.1 - 0.1) / text.ZETA2) < 1e-12
    assert rank([(1, 0.2)], [(2, 0.2)], "a b") > rank([(1, 0.2)], [(30, 0.2)], "a b") > 0 == rank([], [], "a b") == rank([(1, 0.2)], [(102, 0.2)], "a b")
    v = lambda d: math.sqrt(0.2 * 0.4 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    assert abs(rank([(1, 0.2), (8, 0.2)], [(3, 0.4)], "a b") - (1 - (1 - v(2)) * (1 - v(5)))) < 1e-12
    assert abs(rank([(1, 1.0)], [], "a or b") - 0.5 / text.ZETA2) < 1e-12


@settings(max_examples=50)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz'", max_size=20))
def test_stem_never_fails(word):
    assert len(text.stem(word)) <= max(2, len(word) + 1)

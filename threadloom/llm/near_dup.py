"""Problem 4: near-duplicate records by SuperMinHash, banding, verification and union-find.

One pass over the texts gives, per record, a digest of its word set; and per different word set met in
a task, its words, its SuperMinHash bands and a short sketch. Copies of one word set are one class from
there on, so a text that a third of all records share adds one row a task. Band rows meet by an
equi-join on the band's hash; a sketch of 128 bits in the row discards chance meetings before they are
written; the remaining pairs are verified exactly on their words.

SuperMinHash: every word has a pseudo-random permutation of the signature's places; in round j it
offers j + r at its j-th place. The rounds run over all words of a batch together, and a record leaves
as soon as no later round can lower any place (early stopping), after some twenty rounds of 180.

With 36 bands of 5 places a pair of similarity 0.65 is met with probability 0.988, of 0.70 with 0.999,
of 0.75 with 0.9998; the sketch (at most 36 of 128 bits apart) keeps 0.999 of pairs at 0.65. Unrelated
texts share some words, so they meet by chance, and the more often the more texts there are; `band_plan`
therefore takes one place more a band, and as many more bands as keep these probabilities, for every
eightfold of texts. The number of tasks follows the number of band rows (BAND_ROWS each).

Defined results: null, empty and short texts (fewer than `least_words` different words) have no
partner. Rows that repeat an id count once (same id and word set). Order and repetition of words do not
matter. No bucket, partner or candidate is capped.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.common import stage
from threadloom.llm.batches import parts, salted

SIMILARITY, LEAST_WORDS = 0.65, 40
BANDS, ROWS = 36, 5
PLACES = BANDS * ROWS
#: Texts up to which a band has ROWS places; each eightfold of them takes one more.
FIRST_PLAN = 2_000_000
#: Band rows of one task of the join, on average.
BAND_ROWS = 250_000
SKETCH_BITS, SKETCH_APART = 128, 36
#: Bytes kept of each word's hash for verification: two words of one pair collide with odds of 1 in 10^8.
WORD_BYTES = 5

_TAG, _WORD = re.compile(r"<[^>]*>"), re.compile(r"[^\W_]+")


def band_plan(texts: int) -> tuple[int, int]:
    """(bands, places a band) for so many texts: as likely to meet a pair at the similarity as BANDS bands of ROWS places are."""
    rows = ROWS + max(0, math.ceil(math.log(max(1, texts) / FIRST_PLAN, 8) - 1e-9))
    missed = BANDS * math.log1p(-(SIMILARITY**ROWS))
    return math.ceil(missed / math.log1p(-(SIMILARITY**rows)) - 1e-9), rows


def word_set(body: str) -> set[str]:
    """Different words: tags become spaces, entities are decoded, letters lower; runs of letters or digits."""
    text = _TAG.sub(" ", body) if "<" in body else body
    if "&" in text:
        text = html.unescape(text)
    return set(_WORD.findall(text.lower()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(words: np.ndarray, owner: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of n sets: words (uint64 hashes), the set each belongs to; returns uint32[n, places].

    A value is round << 24 | 24 random bits, so its order is that of round + r; where there are more than 255
    places, the round has as many bits as it needs and the rest are random.
    """
    low = min(24, 32 - places.bit_length())
    sig = np.full((n, places), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    distinct, which = np.unique(words, return_inverse=True)
    perm = np.tile(np.arange(places, dtype=np.uint16), (len(distinct), 1))
    rows = np.arange(len(distinct))
    base = owner.astype(np.int64) * places
    for j in range(places):
        rnd = _mix(distinct + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((rnd & np.uint64(0xFFFFFFFF)) % np.uint64(places - j)).astype(np.int64)
        place = perm[rows, k]
        perm[rows, k] = perm[:, j]
        perm[:, j] = place
        value = (np.uint64(j) << np.uint64(low) | rnd >> np.uint64(64 - low)).astype(np.uint32)
        np.minimum.at(flat, base + place[which], value[which])
        if j >= 3:
            live = (sig >= np.uint32(j + 1 << low)).any(axis=1)
            if not live.any():
                break
            keep = live[owner]
            if keep.mean() < 0.7:
                which, owner, base = which[keep], owner[keep], base[keep]
    return sig


def bands_of(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """int64[n, places // rows]: a hash of each band's places and its number."""
    n, places = sig.shape
    out = np.empty((n, places // rows), np.uint64)
    for b in range(places // rows):
        h = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            h = _mix(h * np.uint64(0x100000001B3) + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def sketch_of(sig: np.ndarray) -> np.ndarray:
    """int64[n, 2]: one bit of each of the first 128 places."""
    bits = (_mix(sig[:, :SKETCH_BITS].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


class _Words(dict):
    """Hashes of words, kept per task."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, words: set[str]) -> np.ndarray:
        out = np.sort(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        if len(self) > 500_000:  # memory only
            self.clear()
        return out


_OUT = "fp long, words binary, bands array<long>, sketch long, sketch2 long"


def features(df: DataFrame, id_col: str, body_col: str, least_words: int = LEAST_WORDS, group_col: str | None = None, plan: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """id (and group), fp of every record with enough words; words, bands and sketch at the first of its word set (and group) in the task.

    fp is a 64-bit digest of the word set, with the group mixed in, so records of different groups never
    share a class or a band.
    """
    group, (n_bands, n_rows) = [group_col] if group_col else [], plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Words(), set()
        for whole in batches:
            for batch in parts(whole, [whole.num_columns - 1], 2048):
                groups = batch.column(1).to_pylist() if group else [None] * batch.num_rows
                rows, fps, sets, first = [], [], [], []
                for i, body in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    words = word_set(body)
                    if len(words) < least_words:
                        continue
                    h = hashes(words)
                    digest = xxhash.xxh3_64_digest(h.tobytes() if groups[i] is None else h.tobytes() + b"|%d" % groups[i])
                    if new := digest not in seen:
                        seen.add(digest)
                        sets.append((h, groups[i]))
                    rows.append(i)
                    fps.append(digest)
                    first.append(new)
                fp = np.frombuffer(b"".join(fps), np.int64)
                bands, sketch = np.empty((0, n_bands), np.int64), np.zeros((1, 2), np.int64)
                if sets:
                    sig = signatures(np.concatenate([h for h, _ in sets]), np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets]), len(sets), n_bands * n_rows)
                    bands, sketch = bands_of(sig, n_rows), sketch_of(sig)
                    if group:
                        salt = _mix(np.array([g & 0xFFFFFFFFFFFFFFFF for _, g in sets], np.uint64))
                        bands = (bands.view(np.uint64) ^ salt[:, None]).view(np.int64)
                packed = iter([np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes() for h, _ in sets])
                first = np.array(first, bool)
                at = np.cumsum(first) - 1
                band_sizes = np.where(first, n_bands, 0)
                offsets = pa.array(np.concatenate([[0], np.cumsum(band_sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(rows, pa.int32())) for c in range(batch.num_columns - 1)]
                    + [pa.array(fp), pa.array([next(packed) if f else None for f in first], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1))), *(pa.array(sketch[np.maximum(at, 0), k]) for k in (0, 1))],
                    names=[id_col, *group, "fp", "words", "bands", "sketch", "sketch2"],
                )

    kept = df.select(id_col, *group, F.col(body_col).cast("string").alias("_body"))
    # that many different words, with something between them, take at least so many characters
    kept = kept.where(F.length("_body") >= 2 * least_words - 1)
    if group:
        kept = kept.where(F.col(group_col).isNotNull())
    types = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in [id_col, *group]) + ", " + _OUT)


def overlap_at_least(similarity: float):
    """A pandas UDF: do two packed word sets reach the similarity?"""

    @F.pandas_udf("boolean")
    def reaches(a, b):
        import pandas as pd

        def one(x: bytes, y: bytes) -> bool:
            x, y = ({s[i : i + WORD_BYTES] for i in range(0, len(s), WORD_BYTES)} for s in (x, y))
            both = len(x & y)
            return both >= similarity * (len(x) + len(y) - both) - 1e-9

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    return reaches


def class_links(feat: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(fp_a, fp_b), fp_a < fp_b: all links between different word sets; feat is a staged table of features()."""
    rows = feat.where("words is not null").select("fp", "sketch", "sketch2", F.explode("bands").alias("band"))
    tasks = max(int(feat.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BAND_ROWS))
    rows = rows.repartition(tasks, F.col("band")).dropDuplicates(["band", "fp"])
    a = rows.select("band", F.col("fp").alias("fp_a"), F.col("sketch").alias("sketch_a"), F.col("sketch2").alias("sketch2_a"))
    b = rows.select("band", F.col("fp").alias("fp_b"), F.col("sketch").alias("sketch_b"), F.col("sketch2").alias("sketch2_b"))
    met = a.join(b, "band").where("fp_a < fp_b").where(F.expr("bit_count(sketch_a ^ sketch_b) + bit_count(sketch2_a ^ sketch2_b)") <= SKETCH_APART)
    met = met.select("fp_a", "fp_b").distinct()
    words = feat.where("words is not null").select("fp", "words").dropDuplicates(["fp"])
    met = met.join(words.select(F.col("fp").alias("fp_a"), F.col("words").alias("words_a")), "fp_a")
    met = met.join(words.select(F.col("fp").alias("fp_b"), F.col("words").alias("words_b")), "fp_b")
    # exact where the sizes alone do not rule the pair out
    short, long = F.least(F.length("words_a"), F.length("words_b")), F.greatest(F.length("words_a"), F.length("words_b"))
    return met.where(short >= similarity * long - 0.001).where(overlap_at_least(similarity)("words_a", "words_b")).select("fp_a", "fp_b")


def member_pairs(members: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """All pairs of ids: within each class, and between linked classes. Its size is that of the result; classes of many members are salted."""
    m = members.select(F.col(id_col).alias("id"), "fp").distinct()
    shared = m.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    a, b = salted(m.join(shared, "fp", "left_semi"), "fp", ["id"])
    within = a.join(b, ["fp", "salt"]).where("id_a < id_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    # a link of two classes: its first class in parts, each with the whole of the other
    a, _ = salted(m, "fp", ["id"])
    sizes = a.groupBy("fp").agg(F.max("salt").alias("last"))
    spread = links.join(sizes.select(F.col("fp").alias("fp_a"), "last"), "fp_a").select("fp_a", "fp_b", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("salt"))
    between = spread.join(m.select(F.col("fp").alias("fp_b"), F.col("id").alias("y")), "fp_b").join(a.select(F.col("fp").alias("fp_a"), "salt", F.col("id_a").alias("x")), ["fp_a", "salt"])
    between = between.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return within.unionByName(between).select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): connected components, root the least node.

    Each task first merges its own links by union-find and passes on one link per node to its root;
    then rounds of linking every node and its neighbours to the least of them (large star, small star)
    run until nothing changes. Each round is written, so a lost executor costs one round.
    """
    pairs = links.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u <> v")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := parent.get(root, root)) != root:
                root = p
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        def out() -> pa.RecordBatch:
            rows = [(x, find(x)) for x in list(parent) if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                lo, hi = (a, b) if a < b else (b, a)
                parent.setdefault(lo, lo)
                parent[hi] = lo
            if len(parent) > 1_000_000:  # memory only: what is passed on says the same
                yield out()
                parent.clear()
        yield out()

    edges = stage(pairs.mapInArrow(local, "u long, v long"), "links")
    before = None
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours and itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small.where("u <> v"), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, id_col: str, body_col: str, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members: id, fp) and (links between classes: fp_a, fp_b)."""
    feat = stage(features(df, id_col, body_col, least_words, plan=band_plan(df.count())), "near-dup")
    return feat.select(id_col, "fp"), class_links(feat, similarity)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id_a < post_id_b of all pairs of posts with nearly equal bodies."""
    posts = spark.read.parquet(f"{sf_dir}/posts.parquet")
    members, links = near_duplicates(posts, "post_id", "body")
    return member_pairs(members, links, "post_id")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, group_id, links: each post with a near-duplicate, its group, and the number of its links."""
    posts = spark.read.parquet(f"{sf_dir}/posts.parquet")
    members, links = near_duplicates(posts, "post_id", "body")
    links = stage(links, "near-dup-links")
    members = members.select("post_id", "fp").distinct()
    sizes = members.groupBy("fp").agg(F.count("*").alias("copies"), F.min("post_id").alias("least"))
    ends = links.unionByName(links.select(F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b")))
    degree = ends.join(sizes.select(F.col("fp").alias("fp_b"), "copies"), "fp_b").groupBy(F.col("fp_a").alias("fp")).agg(F.sum("copies").alias("others"))
    roots = components(links, "fp_a", "fp_b").select(F.col("node").alias("fp"), "root")
    classes = sizes.join(roots, "fp", "left").join(degree, "fp", "left").where("copies > 1 or others > 0")
    classes = classes.select("fp", "least", F.coalesce("root", "fp").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    heads = classes.groupBy("root").agg(F.min("least").alias("group_id"))
    return members.join(classes.join(heads, "root").select("fp", "group_id", "links"), "fp").select("post_id", "group_id", "links")

"""Problem 3: checking new batches against all that was accepted, by incremental record linkage.

`LinkageIndex` is a folder that any later application opens again. It holds segments (one of the history,
one of the accepted records of each batch; many small ones are merged into one) of these tables, each in
folders by a hash of its blocking key, so a batch reads only the folders that its own keys fall into:

    keys      key, entity      digests of exact keys: thread and number; file hash
    bands     band, fp         bands of each different body (within its thread)
    sketches  fp, sketch       128 bits a body, against chance meetings
    words     fp, words        word sets, read for the candidates that are left
    owners    fp, entity       who has a body
    seen      entity, repeat   decided records

and a manifest, which names the segments that count, the statistics of the weights and the weights. A batch
is committed by the next manifest; what a failed batch wrote is named by none. Bodies of the history are
split into words once, when its segment is made.

A batch is probed in three steps: keys, bands, and the words of candidates that share a band. Where the
batch's rows are few (BROADCAST_ROWS, counted first) they are sent to the folders that are read and the
index is not shuffled; beyond that both sides are. Candidate pairs are compared field by field. What the
agreement of a field is worth is learned from all candidates so far, those that share a band and do not
agree included (m by expectation-maximisation, u from the index's sizes), and kept as counts of agreement
patterns in the manifest. A candidate whose gains together reach the threshold is a repeat. The problem
demands that one agreeing field suffices: learned gains are at least MIN_GAIN, and the threshold lies half
way between no agreement and the least one. Other weights (`process(..., weights=)`) decide otherwise.

Records of one batch are decided in their order, in rounds: a record that agrees with no earlier undecided
one is accepted; what agrees with it is a repeat. Only records that agree with another one take part.

Links lead from each repeat to every entity accepted before it, in every field that agrees. Clusters are a
union-find forest in the index: `merge` looks up the representatives that its links touch and writes only
those that change.

Defined results: nulls and unreadable numbers or hashes match nothing; a record without any key is
accepted. Rows that repeat an incoming_id count once. A record that was decided before keeps its decision.
An empty batch or history is allowed. The result does not depend on how the records are split into
batches: decisions, links and clusters are the same.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.common import drop_staged, list_names, new_path, read_text, stage, unstage, write_text
from threadloom.functions.text import WIDE, number_of
from threadloom.llm import near_dup

FIELDS = ("number", "hash", "body")
#: Rows of a batch (some 50 bytes each) that are sent to the index's folders rather than shuffled with them.
BROADCAST_ROWS = 1_000_000
#: Rows of a folder of the history's tables, about.
FOLDER_ROWS = 500_000
#: Segments of one level that are merged into one of the next.
FAN_IN = 8
#: Records of waiting batches that one call of the queries takes together.
CALL_ROWS = 20_000
#: What an agreement is worth at least, in bits.
MIN_GAIN = 2.0

_TABLES = {
    "keys": ("key", "key binary, entity long"), "bands": ("band", "band long, fp long"), "sketches": ("fp", "fp long, sketch long, sketch2 long"), "words": ("fp", "fp long, words binary"),
    "owners": ("fp", "fp long, entity long"), "seen": ("entity", "entity long, repeat boolean"), "parents": ("node", "node long, root long"),
}


def hash_of(c: Column) -> Column:
    """A SHA-256 hash written in any of the usual ways (hex digits, base64, base64url), as 64 lower-case digits; else null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, *WIDE)), r"^\s*(?:sha-?256\s*[:=\-]?\s*|0x)", ""), r"[\s:\-]", "")
    # 43 characters of base64, with or without the filling one, are 32 bytes; case counts, so this reads the text as it is
    base64 = F.regexp_extract(F.regexp_replace(c, r"\s", ""), r"^(?:(?i:sha-?256)[:=\-]?)?([A-Za-z0-9+/_-]{43})=?$", 1)
    return F.when(base64 != "", F.lower(F.hex(F.unbase64(F.concat(F.translate(base64, "-_", "+/"), F.lit("=")))))).when(plain.rlike("^[0-9a-f]{64}$"), plain)


def _key(kind: str, *parts: Column) -> Column:
    """A 128-bit digest of a key; null if a part is null."""
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.unhex(F.md5(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]))))


@dataclass(frozen=True)
class Weights:
    """What the agreement of each field is worth, in bits, and what a repeat must reach."""

    gains: dict[str, float]
    threshold: float

    @property
    def alone(self) -> list[str]:
        """Fields whose agreement decides by itself."""
        return [f for f in FIELDS if self.gains[f] >= self.threshold]


def learned_weights(patterns: dict[tuple[int, ...], int], rates: dict[str, float], steps: int = 50) -> Weights:
    """Weights from counts of agreement patterns (in the order of FIELDS) of candidate pairs.

    u, the chance that two random entities agree in a field, is given; m is fitted by
    expectation-maximisation. A candidate that agrees in nothing is no match; a field without any
    agreement so far has m = 0.5.
    """
    m, u, p = [0.5] * len(FIELDS), [max(1e-12, min(0.5, rates[f])) for f in FIELDS], 0.5
    total = sum(patterns.values())
    for _ in range(steps if total else 0):
        match = {}
        for g, n in patterns.items():
            a = p * math.prod(x if y else 1 - x for x, y in zip(m, g))
            b = (1 - p) * math.prod(x if y else 1 - x for x, y in zip(u, g))
            match[g] = n * a / max(a + b, 1e-300) if any(g) else 0.0
        p = min(1 - 1e-6, max(1e-6, sum(match.values()) / total))
        m = [(sum(w for g, w in match.items() if g[i]) + 0.5) / (sum(match.values()) + 1) for i in range(len(FIELDS))]
    gains = {f: max(MIN_GAIN, math.log2(m[i] / u[i]) - math.log2((1 - m[i]) / (1 - u[i]))) for i, f in enumerate(FIELDS)}
    return Weights(gains, min(gains.values()) / 2)


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _record(entity: Column) -> Column:
    return ((entity - 1) / 2).cast("bigint")


class LinkageIndex:
    """The accepted entities (2 * post_id for posts, 2 * incoming_id + 1 for records) in a folder."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state

    # --- the folder

    @classmethod
    def create(cls, spark: SparkSession, path: str, posts: DataFrame, attachments: DataFrame, folder_rows: int = FOLDER_ROWS) -> LinkageIndex:
        """Make an index of the history in a new folder."""
        numbers = posts.select(_key("number", F.col("thread_id"), F.col("board_post_id")).alias("key"), (F.col("post_id") * 2).alias("entity"))
        hashes = attachments.select(_key("hash", hash_of(F.col("sha256_hash"))).alias("key"), (F.col("post_id") * 2).alias("entity"))
        keys = numbers.unionByName(hashes).where("key is not null and entity is not null").distinct()
        body = stage(_bodies(posts.where("post_id is not null").select((F.col("post_id") * 2).alias("entity"), "thread_id", "body")), "link-bodies")
        size = {"number": posts.count(), "hash": attachments.count(), "body": body.count()}
        folders = {"keys": size["number"] + size["hash"], "bands": size["body"] * near_dup.BANDS, "sketches": size["body"], "words": size["body"] * 20, "owners": size["body"], "seen": 0, "parents": 0}
        folders = {t: max(1, -(-n // folder_rows)) for t, n in folders.items()} | {t: max(1, -(-sum(size.values()) // folder_rows)) for t in ("seen", "parents")}
        index = cls(spark, path, {"version": 0, "folders": folders, "segments": [], "parents": [], "size": size, "patterns": {}})
        name = index._write({"keys": keys, **_tables_of(body, body.select("entity", "fp")), "seen": spark.createDataFrame([], _TABLES["seen"][1])})
        index._commit(segments=[{"name": name, "level": -1}])
        unstage(body)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LinkageIndex:
        """The index as its last commit left it."""
        versions = [n for n in list_names(spark, f"{path}/manifests") if n.endswith(".json")]
        if not versions:
            raise FileNotFoundError(path)
        return cls(spark, path, json.loads(read_text(spark, f"{path}/manifests/{versions[-1]}")))

    def _commit(self, **changes) -> None:
        state = self.state | changes | {"version": self.state["version"] + 1}
        write_text(self.spark, f"{self.path}/manifests/{state['version']:08d}.json", json.dumps(state))
        self.state = state

    def _folder(self, name: str, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.state["folders"][name])).cast("int")

    def _write(self, tables: dict[str, DataFrame]) -> str:
        name = f"{self.state['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"

        def write(t: str) -> None:
            rows = tables[t].withColumn("folder", self._folder(t, F.col(_TABLES[t][0])))
            rows.repartition("folder").write.option("compression", "zstd").partitionBy("folder").parquet(f"{self.path}/{t}/segment={name}")

        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(write, tables))
        return name

    def table(self, name: str, touched: list[int] | None = None) -> DataFrame:
        """A table over all segments, or its given folders."""
        segments = self.state["parents"] if name == "parents" else [s["name"] for s in self.state["segments"]]
        schema = _TABLES[name][1] + ", segment string, folder int"
        if not segments:
            return self.spark.createDataFrame([], schema).drop("segment", "folder")
        root = f"{self.path}/{name}"
        df = self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/segment={s}" for s in segments])
        if touched is not None and len(touched) < self.state["folders"][name]:
            df = df.where(F.col("folder").isin(touched))
        return df.drop("segment", "folder")

    def _touched(self, name: str, df: DataFrame, key: str) -> tuple[int, list[int]]:
        """How many rows of df look something up, and in which folders of a table."""
        r = df.agg(F.count("*").alias("n"), F.collect_set(self._folder(name, F.col(key))).alias("folders")).first()
        return r["n"], sorted(r["folders"])

    def _look_up(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """df joined with a table on its key, from the folders that df needs."""
        n, touched = self._touched(name, df, key)
        return self.table(name, touched).withColumnRenamed(_TABLES[name][0], key).join(_few(df, n), key)

    def compact(self) -> None:
        """Merge segments: FAN_IN of one level become one of the next; the history's stays."""
        segments = self.state["segments"]
        for level in sorted({s["level"] for s in segments} - {-1}):
            same = [s for s in segments if s["level"] == level]
            if len(same) < FAN_IN:
                continue
            part = LinkageIndex(self.spark, self.path, self.state | {"segments": same})
            name = self._write({t: part.table(t) for t in _TABLES if t != "parents"})
            segments = [s for s in segments if s not in same] + [{"name": name, "level": level + 1}]
            self._commit(segments=segments)

    def vacuum(self) -> None:
        """Remove what no manifest but the last names; for a time when no other application reads."""
        live = {s["name"] for s in self.state["segments"]} | set(self.state["parents"])
        for t in _TABLES:
            drop_staged(self.spark, *[f"{self.path}/{t}/{n}" for n in list_names(self.spark, f"{self.path}/{t}") if n.removeprefix("segment=") not in live])

    # --- a batch

    def weights(self) -> Weights:
        """What the candidates so far teach."""
        size = self.state["size"]
        return learned_weights({tuple(map(int, k)): n for k, n in self.state["patterns"].items()}, {f: 1 / max(2, size[f]) for f in FIELDS})

    def process(self, records: DataFrame, weights: Weights | None = None) -> tuple[DataFrame, DataFrame]:
        """(decisions: incoming_id, repeat; links: incoming_id, field, entity); accepted records join the index.

        The links are not computed before they are read, so a caller that wants the decisions does not pay for them.
        """
        one = records.groupBy("incoming_id").agg(*[F.first(c).alias(c) for c in ("batch_no", "thread_id", "board_post_id", "body", "sha256_hash")])
        rec = stage(
            one.where("incoming_id is not null").select(
                (F.col("incoming_id") * 2 + 1).alias("entity"),
                F.struct("batch_no", "incoming_id").alias("ord"),
                "thread_id",
                "body",
                _key("number", F.col("thread_id"), number_of(F.col("board_post_id"))).alias("number"),
                _key("hash", hash_of(F.col("sha256_hash"))).alias("hash"),
            ),
            "link-records",
        )
        before = stage(self._look_up("seen", rec.select("entity"), "entity").select("entity", "repeat"), "link-seen")
        new = rec.join(before.select("entity"), "entity", "left_anti")
        body = stage(_bodies(new.select("entity", "thread_id", "body")), "link-bodies")
        fps = body.select("entity", "fp")
        kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key")) for f in ("number", "hash")])
        exact = new.select("entity", "ord", F.explode(kinds).alias("k")).select("entity", "ord", "k.field", "k.key").where("key is not null")
        fields = exact.unionByName(fps.join(new.select("entity", "ord"), "entity").select("entity", "ord", F.lit("body").alias("field"), _body_key("fp").alias("key")))
        fields = stage(fields, "link-fields")
        exact = fields.where("field <> 'body'")

        # 1. candidates among what was accepted before, compared field by field
        near = stage(self._near(body), "link-near")
        weights, found = self._scored(exact, fps, near, weights)
        old = stage(found.select("entity").distinct(), "link-old")

        # 2. among the records that are left, in their order
        pairs = near_dup.class_links(body).select(_body_key("fp_a").alias("a"), _body_key("fp_b").alias("b"))
        pairs = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "link-pairs")
        left = fields.join(old, "entity", "left_anti")
        new_repeats = _decide(_deciding(left, pairs, weights), pairs)

        repeats = old.unionByName(new_repeats).withColumn("repeat", F.lit(True))
        decided = new.select("entity").join(repeats, "entity", "left").select("entity", F.coalesce("repeat", F.lit(False)).alias("repeat"))
        decided = stage(decided, "link-decisions")
        links = self._links(decided, fields, fps, pairs, near)

        # 3. a new segment of what was accepted
        accepted = decided.where("not repeat").select("entity")
        # words stand at the first record of each word set in its task, which need not be an accepted one
        owners = stage(fps.join(accepted, "entity", "left_semi"), "link-owners")
        sets = body.where("words is not null").dropDuplicates(["fp"]).join(owners.select("fp"), "fp", "left_semi")
        keys = exact.join(accepted, "entity", "left_semi").select("key", "entity")
        name = self._write({"keys": keys, **_tables_of(sets, owners), "seen": decided})
        added = {r["field"]: r["n"] for r in fields.join(accepted, "entity", "left_semi").groupBy("field").agg(F.count("*").alias("n")).collect()}
        self._commit(segments=[*self.state["segments"], {"name": name, "level": 0}], size={f: n + added.get(f, 0) for f, n in self.state["size"].items()}, patterns=self._patterns)
        self.compact()
        return decided.unionByName(before).select(_record(F.col("entity")).alias("incoming_id"), "repeat"), links

    def _near(self, body: DataFrame) -> DataFrame:
        """(fp_a of the batch, fp_b of the index, agree) of the pairs that share a band and are not far apart by their sketches."""
        mine = body.where("words is not null").select(F.col("fp").alias("fp_a"), F.col("words").alias("words_a"), F.col("sketch").alias("sketch_a"), F.col("sketch2").alias("sketch2_a"), "bands")
        met = self._look_up("bands", mine.select("fp_a", F.explode("bands").alias("band")), "band").select("fp_a", F.col("fp").alias("fp_b")).distinct()
        met = stage(met, "link-met")
        close = self._look_up("sketches", met, "fp_b").join(mine.select("fp_a", "sketch_a", "sketch2_a"), "fp_a")
        close = stage(close.where(F.expr("bit_count(sketch_a ^ sketch) + bit_count(sketch2_a ^ sketch2)") <= near_dup.SKETCH_APART).select("fp_a", "fp_b").distinct(), "link-close")
        same = close.where("fp_a = fp_b").select("fp_a", "fp_b", F.lit(True).alias("agree"))
        apart = self._look_up("words", close.where("fp_a <> fp_b"), "fp_b").dropDuplicates(["fp_a", "fp_b"]).join(mine.select("fp_a", "words_a").dropDuplicates(["fp_a"]), "fp_a")
        return same.unionByName(apart.select("fp_a", "fp_b", near_dup.overlap_at_least(near_dup.SIMILARITY)("words_a", "words").alias("agree")))

    def _scored(self, exact: DataFrame, fps: DataFrame, near: DataFrame, given: Weights | None) -> tuple[Weights, DataFrame]:
        """The weights, and (entity, other) of the batch's records and candidates of the index that reach the threshold.

        One candidate a key, the least entity that has it, stands for all, unless a field does not decide alone.
        """

        def candidates(all_: bool) -> DataFrame:
            by_key = self._look_up("keys", exact.select(F.col("entity").alias("record"), "field", "key"), "key").select("record", "field", "entity")
            of_body = self._look_up("owners", near.where("agree"), "fp_b").join(fps.select(F.col("entity").alias("record"), F.col("fp").alias("fp_a")), "fp_a")
            rows = by_key.unionByName(of_body.select("record", F.lit("body").alias("field"), "entity"))
            return rows.distinct() if all_ else rows.groupBy("record", "field").agg(F.min("entity").alias("entity"))

        def compared(rows: DataFrame) -> DataFrame:
            return rows.groupBy("record", "entity").agg(*[F.max((F.col("field") == f).cast("int")).alias(f) for f in FIELDS])

        pairs = stage(compared(candidates(given is not None and len(given.alone) < len(FIELDS))), "link-candidates")
        counts = {"".join(str(r[f]) for f in FIELDS): r["n"] for r in pairs.groupBy(*FIELDS).agg(F.count("*").alias("n")).collect()}
        counts["000"] = near.where("not agree").count()
        self._patterns = {k: self.state["patterns"].get(k, 0) + counts.get(k, 0) for k in {*self.state["patterns"], *counts}}
        size = self.state["size"]
        weights = given or learned_weights({tuple(map(int, k)): n for k, n in self._patterns.items()}, {f: 1 / max(2, size[f]) for f in FIELDS})
        return weights, pairs.where(score(weights) >= weights.threshold).select(F.col("record").alias("entity"), F.col("entity").alias("other"))

    def _links(self, decided: DataFrame, fields: DataFrame, fps: DataFrame, pairs: DataFrame, near: DataFrame) -> DataFrame:
        """(incoming_id, field, entity) from each repeat to every entity accepted before it, in every field that agrees."""
        of = lambda df, repeat: df.join(decided.where(F.col("repeat") == repeat).select("entity"), "entity", "left_semi")
        mine = of(fields, True)
        theirs = of(fields, False).select("key", F.col("entity").alias("other"), F.col("ord").alias("before"))
        found = [d.where("before < ord").select("entity", "field", "other") for d in (mine.join(theirs, "key"), mine.join(pairs, F.col("key") == F.col("a")).drop("key").join(theirs, F.col("b") == F.col("key")))]
        # the segments of the index as they are now, without this batch
        found.append(mine.join(self.table("keys").withColumnRenamed("entity", "other"), "key").select("entity", "field", "other"))
        owners = self.table("owners").select(F.col("fp").alias("fp_b"), F.col("entity").alias("other"))
        found.append(of(fps, True).join(near.where("agree"), F.col("fp") == F.col("fp_a")).join(owners, "fp_b").select("entity", F.lit("body").alias("field"), "other"))
        return reduce(DataFrame.unionByName, found).distinct().select(_record(F.col("entity")).alias("incoming_id"), "field", F.col("other").alias("entity"))

    # --- clusters

    def _find(self, nodes: DataFrame) -> DataFrame:
        """(node, root) of each node (node), by following the forest until nothing changes; a node it does not know is its own root."""
        at = stage(nodes.select("node", F.col("node").alias("root")), "link-find")
        while True:
            n, touched = self._touched("parents", at, "root")
            up = self.table("parents", touched).select(F.col("node").alias("root"), F.col("root").alias("up"))
            found = stage(up.join(_few(at.select("root").distinct(), n), "root"), "link-find")
            if found.isEmpty():
                return at
            at = stage(at.join(found, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "link-find")

    def merge(self, links: DataFrame) -> None:
        """Add links to the clusters: only the representatives that change get a new parent."""
        edges = stage(links.select((F.col("incoming_id") * 2 + 1).alias("u"), node_of(F.col("entity")).alias("v")).distinct(), "link-edges")
        roots = self._find(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct())
        for end in ("u", "v"):
            edges = edges.join(roots.select(F.col("node").alias(end), "root"), end).withColumn(end, F.col("root")).drop("root")
        moved = near_dup.components(edges.distinct(), "u", "v")
        if not moved.isEmpty():
            self._commit(parents=[*self.state["parents"], self._write({"parents": moved})])

    def clusters(self) -> DataFrame:
        """(node, root) of every node that is not its own root, with paths compressed; nodes as of node_of()."""
        return self._find(self.table("parents").select("node"))


def node_of(entity: Column) -> Column:
    """The entity as a node of clusters: posts come before records, so the representative is the cluster's first post where it has one."""
    return F.when(entity % 2 == 0, entity - (1 << 62)).otherwise(entity)


def score(weights: Weights) -> Column:
    """The gains of the fields that agree (columns of FIELDS, 0 or 1)."""
    return reduce(lambda a, b: a + b, [F.col(f).cast("double") * weights.gains[f] for f in FIELDS])


def _bodies(df: DataFrame) -> DataFrame:
    return near_dup.features(df, "entity", "body", group_col="thread_id").drop("thread_id")


def _body_key(c: str) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.lit("body"), F.col(c).cast("string"))))


def _tables_of(body: DataFrame, owners: DataFrame) -> dict[str, DataFrame]:
    sets = body.where("words is not null")
    return {"bands": sets.select(F.explode("bands").alias("band"), "fp"), "sketches": sets.select("fp", "sketch", "sketch2"), "words": sets.select("fp", "words"), "owners": owners.select("fp", "entity")}


def _deciding(fields: DataFrame, pairs: DataFrame, weights: Weights) -> DataFrame:
    """(entity, ord, key): records of a batch that have a key in common reach the threshold together.

    Fields that decide alone are keys as they are. Pairs of records that only reach it by several others
    get a key of their own; without such weights (any that are learned) there are none.
    """
    keys = fields.where(F.col("field").isin(weights.alone)).select("entity", "ord", "key")
    rest = [f for f in FIELDS if f not in weights.alone]
    if sum(weights.gains[f] for f in rest) < weights.threshold:
        return keys
    some = fields.where(F.col("field").isin(rest))
    a, b = (some.select(F.col("entity").alias(f"e_{s}"), F.col("ord").alias(f"o_{s}"), F.col("key").alias(f"k_{s}"), "field") for s in "ab")
    met = a.join(b.drop("field"), F.col("k_a") == F.col("k_b")).unionByName(a.join(pairs, F.col("k_a") == F.col("a")).drop("a").join(b.drop("field"), F.col("b") == F.col("k_b")).drop("b"))
    met = met.where("e_a < e_b").groupBy("e_a", "e_b", "o_a", "o_b").agg(*[F.max((F.col("field") == f).cast("int")).alias(f) for f in FIELDS]).where(score(weights) >= weights.threshold)
    own = met.withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.lit("pair"), "e_a", "e_b"))))
    return keys.unionByName(own.select(F.col("e_a").alias("entity"), F.col("o_a").alias("ord"), "key")).unionByName(own.select(F.col("e_b").alias("entity"), F.col("o_b").alias("ord"), "key"))


def _decide(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity) of the repeats among records (entity, ord, key) none of which agrees with the index."""
    # keys of one record only, and without a linked body, decide nothing
    shared = fields.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").unionByName(pairs.select(F.col("a").alias("key"))).distinct()
    open_ = stage(fields.join(shared, "key", "left_semi"), "link-open")
    found = []
    while not open_.isEmpty():
        first = stage(open_.groupBy("key").agg(F.min("ord").alias("first"), F.min_by("entity", "ord").alias("owner")), "link-first")
        near = pairs.join(first.select(F.col("key").alias("b"), "first"), "b").groupBy(F.col("a").alias("key")).agg(F.min("first").alias("near"))
        state = open_.join(first, "key").join(near, "key", "left")
        blocked = F.max((F.col("first") < F.col("ord")) | F.coalesce(F.col("near") < F.col("ord"), F.lit(False)))
        accepted = stage(state.groupBy("entity").agg(blocked.alias("blocked")).where("not blocked").select("entity"), "link-accepted")
        won = first.join(accepted.withColumnRenamed("entity", "owner"), "owner", "left_semi").select("key")
        killed = won.unionByName(won.join(pairs, F.col("key") == F.col("a")).select(F.col("b").alias("key"))).distinct()
        repeats = stage(open_.join(accepted, "entity", "left_anti").join(killed, "key", "left_semi").select("entity").distinct(), "link-repeats")
        found.append(repeats)
        after = stage(open_.join(accepted.unionByName(repeats), "entity", "left_anti"), "link-open")
        unstage(open_, first, accepted)
        open_ = after
    return reduce(DataFrame.unionByName, found) if found else fields.select("entity").where("false")


def _calls(spark: SparkSession, sf_dir: str):
    """An index of the history, and its (decisions, links) of the waiting batches in turn.

    A call takes a batch and those after it as long as they have CALL_ROWS records together: the outcome is the same,
    and what any call costs besides its records is shared.
    """
    posts, files, incoming = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("posts", "attachments", "incoming_posts"))
    index = LinkageIndex.create(spark, new_path(spark, "linkage"), posts, files)
    sizes = {r["batch_no"]: r["n"] for r in incoming.groupBy("batch_no").agg(F.count("*").alias("n")).collect()}
    calls: list[list] = []
    for b in sorted(sizes, key=lambda b: (b is not None, b or 0)):
        if not calls or sum(sizes[x] for x in calls[-1]) + sizes[b] > CALL_ROWS:
            calls.append([])
        calls[-1].append(b)
    takes = lambda call: reduce(lambda x, y: x | y, [F.col("batch_no").eqNullSafe(F.lit(b)) for b in call])
    return index, (index.process(incoming.where(takes(call))) for call in calls)


def _all(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incoming_id of the records that repeat an accepted one: the waiting batches are probed against the index in their order."""
    _, calls = _calls(spark, sf_dir)
    return _all(spark, [decisions.where("repeat").select("incoming_id") for decisions, _ in calls], "incoming_id long")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incoming_id, kind and id of what it repeats, by_number, by_hash, by_body, score: the learned gains of what agrees."""
    index, calls = _calls(spark, sf_dir)
    links = _all(spark, [stage(links, "link-links") for _, links in calls], "incoming_id long, field string, entity long")
    pattern = links.groupBy("incoming_id", "entity").agg(*[F.max((F.col("field") == f).cast("int")).alias(f) for f in FIELDS])
    kind = F.when(F.col("entity") % 2 == 0, "post").otherwise("incoming").alias("kind")
    return pattern.select("incoming_id", kind, F.floor(F.col("entity") / 2).alias("id"), *[(F.col(f) == 1).alias(f"by_{f}") for f in FIELDS], F.round(score(index.weights()), 3).alias("score"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incoming_id, kind and id of the representative of its cluster, for each record that repeats another."""
    index, calls = _calls(spark, sf_dir)
    repeats = []
    for decisions, links in calls:
        index.merge(links)
        repeats.append(decisions.where("repeat").select("incoming_id"))
    roots = index.clusters().where("node > 0")
    root = F.when(F.col("root") < 0, F.col("root") + (1 << 62)).otherwise(F.col("root"))
    roots = roots.select(F.floor(F.col("node") / 2).alias("incoming_id"), F.when(F.col("root") < 0, "post").otherwise("incoming").alias("kind"), F.floor(root / 2).alias("id"))
    return roots.join(_all(spark, repeats, "incoming_id long"), "incoming_id", "left_semi")

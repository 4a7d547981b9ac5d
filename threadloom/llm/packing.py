"""Problem 7: filling containers of fixed capacity, planned on the histogram of lengths.

The plan needs only how many pieces there are of each length (at most `capacity` numbers), so best-fit
decreasing runs over counts on the driver at any corpus size. It gives slots: for a range of ranks
within a length, the containers and the places in them. Each piece then takes the slot of its rank by
an equi-join on (length, rank). Ranks are made in salted parts, so a length that a third of all
pieces share is not ranked in one task.

Defined results: a text longer than the capacity is cut into full containers and one rest; no other
text is cut. Null and empty texts (0 tokens) have one row with n_tokens 0 and a null container.
Equal rows (same id and text twice) are separate items; ties are broken by id, then by piece.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.common import stage
from threadloom.llm.tokens import TOKENIZER_DIR, encode_ids

CAPACITY = 2048
#: Pieces that one part of a length's ranking holds on average, at most.
RANK_PART = 200_000
#: Slots that one task unfolds from a planned range, at most.
SLOT_PART = 100_000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns ranges (length, first rank, ranks, per container, first container, place in the container).
    Each group of containers with the same contents is one entry, split when only a part of it takes
    the next length; so the work follows the number of different lengths and not of pieces.
    """
    groups: dict[int, list[list]] = {}  # room left -> [[count, first container, items]]
    rooms: list[int] = []
    made = 0

    def put(room: int, group: list) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append(group)

    def items_after(items: list, p: int) -> list:
        return [(length, start + p * k, k, place) for length, start, k, place in items]

    done: list[tuple[int, list]] = []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 1
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                group = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
                count, first, items = group
                k = min(room // length, max(1, left // count))
                p = min(count, left // k)
                if p < count:
                    put(room, [count - p, first + p, items_after(items, p)])
                put(room - k * length, [p, first, [*items, (length, rank, k, capacity - room)]])
                left, rank = left - p * k, rank + p * k
            else:
                k = min(capacity // length, left)
                p = left // k
                put(capacity - k * length, [p, made, [(length, rank, k, 0)]])
                made, left, rank = made + p, left - p * k, rank + p * k
    for room in rooms:
        done += [(g[0], g) for g in groups[room]]
    return [(length, start, p * k, k, first, place) for p, (_, first, items) in done for length, start, k, place in items]


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, from_token, n_tokens, container, place) of all items; sizes is read several times, so give a staged table."""
    spark = sizes.sparkSession
    size = F.col(size_col).cast("long")
    pieces = sizes.select(F.col(id_col).alias("_id"), size.alias("_size")).where(F.col("_size") > 0)
    pieces = pieces.select("_id", F.explode(F.sequence(F.lit(0), ((F.col("_size") - 1) / capacity).cast("long"))).alias("piece"), "_size")
    pieces = pieces.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("_size") - F.col("piece") * capacity))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = plan(histogram, capacity)
    parts = max(8, -(-sum(histogram.values()) // RANK_PART))

    part = F.pmod(F.xxhash64("_id", "piece"), F.lit(parts)).alias("part")
    parted = pieces.select("_id", "piece", "length", part)
    before = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("_id", "piece"))
    ranked = parted.withColumn("within", within).join(before, ["length", "part"]).select("_id", "piece", "length", (F.col("before") + F.col("within")).alias("rank"))

    slots = spark.createDataFrame(ranges or [(0, 0, 0, 1, 0, 0)], "length long, first long, ranks long, per long, container0 long, place0 long")
    slots = slots.where("ranks > 0").select("*", F.explode(F.expr(f"sequence(0L, (ranks - 1) div {SLOT_PART})")).alias("block"))
    slots = slots.repartition(F.col("length"), F.col("first"), F.col("block"))
    slots = slots.select("*", F.explode(F.expr(f"sequence(block * {SLOT_PART}, least((block + 1) * {SLOT_PART}, ranks) - 1)")).alias("i"))
    slots = slots.select("length", (F.col("first") + F.col("i")).alias("rank"), (F.col("container0") + F.expr("i div per")).alias("container"), (F.col("place0") + F.expr("i % per") * F.col("length")).alias("place"))

    placed = ranked.join(slots, ["length", "rank"]).select(
        F.col("_id").alias(id_col), F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("from_token"), F.col("length").cast("int").alias("n_tokens"), "container", F.col("place").cast("int").alias("place")
    )
    empty = sizes.where(size.isNull() | (size <= 0)).select(
        F.col(id_col), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("from_token"), F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place")
    )
    return placed.unionByName(empty)


def p7_containers(spark: SparkSession, sf_dir: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """All documents, measured in byte_bpe_50k ids, in containers of 2,048."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stage(encode_ids(docs, tokenizer_dir=tokenizer_dir, counts_only=True), "p7-sizes")
    return pack(sizes, "doc_id", "n_tokens")


def p7_check(spark: SparkSession, sf_dir: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """One row on p7_containers: its documents, texts without a place, containers too full, places that overlap, documents whose tokens are not all placed once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stage(encode_ids(docs, tokenizer_dir=tokenizer_dir, counts_only=True), "p7-sizes")
    placed = stage(pack(sizes, "doc_id", "n_tokens"), "p7-placed")
    inside = placed.where("container is not null")
    order = Window.partitionBy("container").orderBy("place")
    boxes = inside.withColumn("free", F.col("place") - F.coalesce(F.lag(F.col("place") + F.col("n_tokens")).over(order), F.lit(0))).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.min("free").alias("free"))
    boxes = boxes.agg(F.count_if(F.col("n") > CAPACITY).alias("too_full"), F.count_if(F.col("free") < 0).alias("overlapping"))
    whole = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("from_token").alias("last"))
    lost = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("want")).join(whole, "doc_id", "left")
    lost = lost.agg(F.count("*").alias("documents"), F.count_if(F.col("want") == 0).alias("without_place"), F.count_if(~F.col("want").eqNullSafe(F.col("n")) | (F.col("last") != (F.col("pieces") - 1) * CAPACITY)).alias("not_whole"))
    return lost.join(boxes, F.lit(True)).select("documents", "without_place", "not_whole", "too_full", "overlapping")


SQL = {"p7_check": "SELECT count(*) AS documents, count(*) FILTER (coalesce(text, '') = '') AS without_place, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS overlapping FROM documents"}

"""Arrow batches in parts of bounded text, so that memory follows neither the number nor the length of texts; sides of joins in which a group may be large."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group that one task joins with the rest of it.
GROUP_PART = 1_000


def parts(batch: pa.RecordBatch, text_columns: list[int], rows: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of at most `rows` rows and about `size` bytes of text; a longer text is a part of its own."""
    if not batch.num_rows:
        yield batch
        return
    total = np.zeros(batch.num_rows, np.int64)
    for c in text_columns:
        total += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(total)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(start, end - start)
        start = end


def salted(members: DataFrame, group: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two sides (group, salt, columns with _a and _b) of members with themselves: joined on (group, salt) every pair of a group meets once each way.

    A group of n members is cut into n / GROUP_PART parts on one side and repeated as often on the other, so
    no task joins more than a part with the group, whatever its size.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / GROUP_PART).cast("int").alias("_parts"))
    m = members.join(sizes, group)
    a = m.select(group, F.pmod(F.xxhash64(*columns), F.col("_parts")).cast("int").alias("salt"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = m.select(group, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a, b

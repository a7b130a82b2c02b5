"""Running numbers and shares over a whole frame without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweft.session import materialize

_WITHIN = (1 << 33) - 1


def running_index(df: DataFrame, order: list[Column | str], name: str = "index", start: int = 0) -> DataFrame:
    """Number all rows in the given total order.

    The frame is range-partitioned and sorted within partitions, then written to the checkpoint
    folder.  The rank inside a partition comes from the row id, the offset from the
    partition sizes, which are as few rows as there are partitions.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()), "running-index")
    part = F.shiftright("_id", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_offset")
    # one row per partition of the sorted frame, so the broadcast side is bounded by the task count
    numbered = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    rank = F.col("_offset") + F.col("_id").bitwiseAND(F.lit(_WITHIN)) + start
    return numbered.withColumn(name, rank.cast("bigint")).drop("_id", "_part", "_offset")


def mark_by_hash(df: DataFrame, group: str, quota: DataFrame, hex_hash: str, name: str, prefix: int = 3) -> DataFrame:
    """A column ``name``: whether a row is among those with the smallest hashes of its group, as many as ``quota(group, k)`` says.

    Rows of one hash, such as repeated keys, are told apart by a hash of the whole row; equal rows are as good as one another.

    Hashes are first counted by their leading hex digits.  Prefixes below the one where the quota is
    reached are taken whole; only rows with exactly that prefix are ranked.  A group that holds most of the
    rows is therefore never sorted as a whole.
    """
    tie = F.xxhash64(*df.columns)
    df = df.withColumn("_prefix", F.substring(hex_hash, 1, prefix))
    w = Window.partitionBy(group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    plan = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .join(quota, group)
        .withColumn("_left", F.col("k") - F.col("_before"))
        .filter(F.col("_left") > 0)
        .withColumn("_whole", F.col("_n") <= F.col("_left"))
        .select(group, "_prefix", "_left", "_whole")
    )
    planned = df.join(plan, [group, "_prefix"], "left")
    rank = F.row_number().over(Window.partitionBy(group, "_prefix").orderBy(hex_hash, tie))
    settled = F.coalesce("_whole", F.lit(True))
    plain = planned.filter(settled).withColumn(name, F.coalesce("_whole", F.lit(False)))
    edge = planned.filter(~settled).withColumn("_rank", rank).withColumn(name, F.col("_rank") <= F.col("_left")).drop("_rank")
    return plain.unionByName(edge).drop("_prefix", "_left", "_whole")

"""A bit filter of fixed size over hashes: what it refuses is absent for certain, what it passes may be present."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
"""8 MB, whatever the data.  A fuller filter passes more and loses nothing."""


def build(hashes: DataFrame, bits: int = BITS) -> Broadcast:
    """Filter over the single column of longs of ``hashes``.  At most ``bits / 32`` words are made, by an aggregate."""
    (name,) = hashes.columns
    places = hashes.select(F.pmod(F.col(name), F.lit(bits)).alias("bit"))
    words = places.groupBy(F.expr("bit div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 32 as int)))").alias("bits"))
    table = np.zeros(bits // 32, np.uint32)
    for batch in words.toArrow().to_batches():
        table[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint32)
    return hashes.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For signed 64-bit hashes."""
    bit = hashes.view(np.int64) % (len(table) * 32)
    return (table[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1


def may_hold(filter: Broadcast, hash_: Column) -> Column:
    @F.arrow_udf("boolean")
    def held(values: pa.Array) -> pa.Array:
        return pa.array(passes(filter.value, values.to_numpy(zero_copy_only=False).astype(np.int64)))

    return held(hash_)

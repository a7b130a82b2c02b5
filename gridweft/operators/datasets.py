"""Combine data sets: concatenate, repeat, mix by ratio, select splits."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.operators.ordering import mark_by_hash, running_index


def concat_datasets(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of all parts with a column ``dataset``."""
    named = [df.withColumn("dataset", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def repeat_dataset(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, with the number of the repetition."""
    return df.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(times))))


def mix_by_ratio(
    df: DataFrame, source: str, key: str, ratios: Mapping[str, float], seed: int = 0, mode: int = 0
) -> DataFrame:
    """Mix sources so that their shares follow ``ratios``, whose sum has to be 1.

    Rows are taken in the order of a seeded hash.  ``mode`` says which source sets the amount: 0 the
    first one, 1 the last one, among those that have rows (each is used up, a source that is too small contributes
    all its rows); 2 is 0 with a column ``used`` and the unused rows kept; -1 connects all rows without ratios.
    A source without a ratio has a share of nothing: its rows are left out in modes 0 and 1 and unused in mode 2.
    """
    if abs(sum(ratios.values()) - 1.0) > 1e-9:
        raise ValueError("ratios have to sum to 1")
    if mode not in (-1, 0, 1, 2):
        raise ValueError(f"unknown mode {mode}")
    if mode == -1:
        return df
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    ratio = F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv])
    sizes = hashed.filter(F.col(source).isin(*ratios)).groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    place = F.array_position(F.array(*map(F.lit, ratios)), F.col(source))
    leads = sizes.filter(F.element_at(ratio, F.col(source)) > 0)
    first = F.min_by if mode != 1 else F.max_by
    lead = leads.agg(first(F.col("_n") / F.element_at(ratio, F.col(source)), place).alias("_total"))
    quota = sizes.join(F.broadcast(lead)).select(
        source, F.floor(F.element_at(ratio, F.col(source)) * F.col("_total") + 1e-9).cast("bigint").alias("k")
    )
    marked = mark_by_hash(hashed, source, quota, "_hash", "used").drop("_hash")
    return marked if mode == 2 else marked.filter("used").drop("used")


def batches_by_ratio(df: DataFrame, source: str, key: str, ratios: Mapping[str, float], size: int, seed: int = 0, mode: int = 0) -> DataFrame:
    """``mix_by_ratio`` (mode 0 or 1) with a column ``batch``: each batch of ``size`` rows has the shares of ``ratios``, to the next whole row.

    Rows of a source are numbered in the order of its hashes and spread evenly: row r of a source with the share s stands at
    (r + 1/2) / s of the mixture, and batches are stretches of it.  When a source is used up, the batches after it go on without it.
    Sources are numbered by one running index, so no source has to fit in one task.
    """
    if mode not in (0, 1):
        raise ValueError(f"no batches in mode {mode}")
    if size < 1:
        raise ValueError("a batch has at least one row")
    mixed = mix_by_ratio(df, source, key, ratios, seed, mode)
    order = {"_hash": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), "_row": F.xxhash64(*mixed.columns)}
    numbered = running_index(mixed.withColumns(order), [source, "_hash", "_row"], "_index")
    firsts = numbered.groupBy(source).agg(F.min("_index").alias("_first"))  # a row for each source of ``ratios`` at most
    share = F.element_at(F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv]), F.col(source))
    placed = (F.col("_index") - F.col("_first") + 0.5) / (share * size)
    return numbered.join(F.broadcast(firsts), source).select(*mixed.columns, F.floor(placed).cast("bigint").alias("batch"))


def select_split(df: DataFrame, split: str, known: tuple[str, ...] = ("training", "validation", "test")) -> DataFrame:
    """Rows of one split; an unknown name is refused."""
    if split not in known:
        raise ValueError(f"unknown split {split}; known: {', '.join(known)}")
    return df.filter(F.col("split") == split)

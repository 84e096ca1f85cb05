"""Leak-free splits by bag keys: hold out a share of the keys, by hash order, and all their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alias
from ..runtime import durable, hash_unit
from .joins import without_holdout


def hashed(seed: int, key: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def holdout_size(n: int, share: float) -> int:
    """At least one key and not all; halves go to the even number."""
    return min(max(1, round(n * share)), n - 1) if n > 1 else 0


def held_out_keys(keys: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """The (key) rows that come first in hash order; ``keys`` are distinct."""
    last = last_held_hash(keys, share, seed)
    return keys.select("key").filter(hashed(seed, F.col("key")) <= F.lit(last)) if last else keys.select("key").limit(0)


def last_held_hash(keys: DataFrame, share: float, seed: int = 42) -> str | None:
    """The hash of the last key that is held out, None where none is; ``keys`` are distinct.

    It is found by the count per 4-digit hash prefix (65,536 rows at most), then a top-k within one prefix, so no
    single task orders all keys. A row's own hash then tells whether its key is held out, without a join.
    """
    h = keys.select("key", hashed(seed, F.col("key")).alias("h"))
    need = holdout_size(h.count(), share)
    if need == 0:
        return None
    cum, at = 0, "ffff"
    for row in h.groupBy(F.substring("h", 1, 4).alias("p")).count().orderBy("p").collect():
        if cum + row["count"] >= need:
            at = row["p"]
            break
        cum += row["count"]
    return h.filter(F.substring("h", 1, 4) == at).orderBy("h").limit(need - cum).agg(F.max("h")).first()[0]


def split_rows(rows: DataFrame, strategy: str = "prompt_bag", share: float = 0.05, seed: int = 42, holdout: DataFrame | None = None, row_key: str = "row_id") -> DataFrame:
    """``rows`` with ``part`` 'train' or 'validation'. Rows of the holdout table are taken out first.

    strategy 'random', or at most one distinct key, splits by the row's own hash instead.
    """
    if holdout is not None:
        rows = without_holdout(rows, holdout)
    if strategy != "random":
        keyed = rows.withColumn("_key", alias.split_key(rows, strategy))
        keys = durable(keyed.select(F.col("_key").alias("key")).distinct())
        if keys.limit(2).count() == 2:
            held = hashed(seed, F.col("_key")) <= F.lit(last_held_hash(keys, share, seed))
            return keyed.withColumn("part", F.when(held, "validation").otherwise("train")).drop("_key")
    unit = hash_unit(str(seed), F.col(row_key))
    return rows.withColumn("part", F.when(unit < share, "validation").otherwise("train"))


def partition_rows(rows: DataFrame, partition: str, strategy: str = "prompt_bag", share: float = 0.1, seed: int = 42, row_key: str = "row_id", legacy_random: bool = False) -> DataFrame:
    """Only the rows of one evaluation partition: all, train or validation.

    With at most one key every row is returned. 'random' honours the partition unless ``legacy_random``.
    """
    if partition == "all" or (strategy == "random" and legacy_random):
        return rows
    if partition not in ("train", "validation"):
        raise ValueError(f"unknown partition {partition!r}: use all, train or validation")
    if strategy != "random" and rows.select(alias.split_key(rows, strategy).alias("k")).distinct().limit(2).count() < 2:
        return rows
    return split_rows(rows, strategy, share, seed, row_key=row_key).filter(F.col("part") == partition).drop("part")

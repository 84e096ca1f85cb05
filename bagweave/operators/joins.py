"""Joins with the semantics of keyed lookups: last row wins, missing kept, and anti joins on fingerprints and task keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alias


def last_per_key(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """One row per key: the last in ``order``. A pre-aggregated max, no window over the key."""
    key = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*key, *[F.col("_last")[c].alias(c) for c in rest])


def with_predictions(benchmark: DataFrame, predictions: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """Every benchmark row with its last prediction; a missing one is an empty string, ``missing`` tells."""
    text = alias.first_present(predictions, alias.PREDICTION)
    key = [key] if isinstance(key, str) else key
    last = last_per_key(predictions.select(*key, order, text.alias("prediction")), key, order).drop(order)
    joined = benchmark.join(last.withColumn("_there", F.lit(True)), key, "left")
    return joined.withColumn("missing", F.col("_there").isNull()).withColumn("prediction", F.coalesce("prediction", F.lit(""))).drop("_there")


def without_holdout(rows: DataFrame, holdout: DataFrame, fields=alias.FINGERPRINT) -> DataFrame:
    """Rows whose fingerprint no holdout row has."""
    kept = rows.withColumn("_fp", alias.fingerprint(rows, fields))
    return kept.join(holdout.select(alias.fingerprint(holdout, fields).alias("_fp")).distinct(), "_fp", "left_anti").drop("_fp")


def remaining_tasks(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Tasks whose whole key isn't among the done ones; null parts of a key are equal to null."""
    cond = None
    d = done.select(*[F.col(k).alias(f"_d_{k}") for k in key]).distinct()
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_d_{k}"))
        cond = c if cond is None else cond & c
    return tasks.join(d, cond, "left_anti")

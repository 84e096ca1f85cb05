"""Iterative reverse steps of a masked sequence, with predictions supplied by a Column function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import noise
from ..runtime import Rounds, hash_unit


def denoised(rows: DataFrame, key: str, predict: Callable[[Column], Column], steps: int, mask_id: int, seed: int = 42, kind: str = "loglinear") -> DataFrame:
    """(key, ids, asked): ``rows`` (key, ids) after ``steps`` reverse steps from time 1 to 0.

    ``predict`` gives, for ids, an array of probabilities over the vocabulary for each position. It is asked anew only
    where the ids have changed since; ``asked`` counts how often. Unmasked positions stay. Draws go by hash of seed,
    key, step, position and token. Each round is written to the shared folder, so a lost executor costs one step.
    """
    rounds = Rounds(rows.sparkSession)
    state = rounds.keep(rows.select(key, "ids", F.lit(None).cast("array<array<double>>").alias("_p"), F.lit(True).alias("_new"), F.lit(0).alias("asked")))
    for step in range(steps):
        t, s = F.lit(1.0 - step / steps), F.lit(1.0 - (step + 1) / steps)
        at, before = (noise.move_chance(noise.schedule(kind, x)[0]) for x in (t, s))
        asked = state.withColumn("_p", F.when(F.col("_new"), predict(F.col("ids"))).otherwise(F.col("_p"))).withColumn("asked", F.col("asked") + F.col("_new").cast("int"))

        def draw(x: Column, i: Column) -> Column:
            q = noise.reverse_step(F.col("_p")[i], at, before, mask_id)
            units = F.transform(q, lambda _, v: hash_unit(f"{seed}:{step}", F.col(key), i, v))
            return F.when(x == mask_id, noise.drawn(q, units)).otherwise(x)

        moved = asked.withColumn("_next", F.transform("ids", draw))
        state = rounds.keep(moved.select(key, F.col("_next").alias("ids"), "_p", (F.col("_next") != F.col("ids")).alias("_new"), "asked"))
        rounds.next()
    return state.select(key, "ids", "asked")

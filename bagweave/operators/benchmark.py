"""A benchmark from a source table: its held-out rows with every reference that their prompt has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alias
from ..functions.tokens import emoji_text
from . import corpus, split


def materialized(rows: DataFrame, order: str, prefix: str, strategy: str = "prompt_bag", share: float = 0.05, seed: int = 42) -> DataFrame:
    """(benchmark_id, source_index, source_sha1, topic, instruction, prompt_emoji, target_emoji, references).

    References are the distinct non-empty emoji replies of all rows of the same topic and prompt text, as they first
    came; the row's own target is always among them. ``order`` is the row's ordinal.
    """
    named = rows.withColumns({
        "_topic": alias.first_truthy(rows, ("topic",)), "_prompt": F.coalesce(emoji_text(alias.first_truthy(rows, ("input", "prompt_emoji"))), F.lit("")),
        "_target": F.coalesce(emoji_text(alias.first_truthy(rows, ("output", "target_emoji", "emoji"))), F.lit("")), "_sha1": alias.fingerprint(rows, alias.FINGERPRINT_BUILDER),
    })
    refs = corpus.references(named, ["_topic", "_prompt"], "_target", order)
    held = split.split_rows(named, strategy, share, seed, row_key=order).filter("part = 'validation'")
    joined = held.join(refs, ["_topic", "_prompt"], "left")
    own = F.when(F.col("_target") == "", F.array().cast("array<string>")).otherwise(F.array("_target"))
    all_refs = F.array_union(F.coalesce("references", F.array().cast("array<string>")), own)
    ident = F.format_string(f"{prefix}_%05d_%s", F.col(order), F.substring("_sha1", 1, 8))
    return joined.select(
        ident.alias("benchmark_id"), F.col(order).alias("source_index"), F.col("_sha1").alias("source_sha1"), F.col("_topic").alias("topic"), alias.first_truthy(rows, ("instruction", "text")).alias("instruction"),
        F.col("_prompt").alias("prompt_emoji"), F.col("_target").alias("target_emoji"), all_refs.alias("references"),
    )

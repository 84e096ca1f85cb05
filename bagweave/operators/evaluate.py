"""Evaluations composed of the single operators: infill items, pass and power curves, order effects, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alias, bags
from ..functions import sequences as sq
from ..functions import tokens as tk
from ..runtime import durable, lookup_skewed
from . import corpus, joins, score, split, stability

PATTERNS = ("prefix", "suffix", "scattered")
#: The order in which patterns are reported; others come behind, by name.
PATTERN_ORDER = ("all", *PATTERNS)


def pattern_rank(pattern: Column) -> Column:
    """The place of a pattern in reports."""
    rank = F.lit(len(PATTERN_ORDER))
    for k, name in reversed(list(enumerate(PATTERN_ORDER))):
        rank = F.when(pattern == name, k).otherwise(rank)
    return rank


def infill_examples(rows: DataFrame, holdout: DataFrame | None, order: str, prefix: str, partition: str = "all", strategy: str = "prompt_bag", share: float = 0.05, seed: int = 42) -> DataFrame:
    """(example_id, source_index, instruction, prompt_emoji, tokens, topic) of the rows that can be infilled.

    Holdout rows are taken out first, then one partition of the keyed split is kept; the prompt must have an emoji and
    the reply two. ``order`` is the row's ordinal.
    """
    kept = rows if holdout is None else joins.without_holdout(rows, holdout)
    kept = split.partition_rows(kept, partition, strategy, share, seed, row_key=order)
    prompt = tk.emoji_text(alias.first_truthy(kept, ("input", "prompt_emoji")))
    reply = tk.emoji_tokens(alias.first_truthy(kept, ("output", "target_emoji", "response_emoji", "emoji")))
    ident = F.format_string(f"{prefix}_%05d_%s", F.col(order), F.substring(alias.fingerprint(kept), 1, 8))
    made = kept.select(
        ident.alias("example_id"), F.col(order).alias("source_index"), alias.first_truthy(kept, ("instruction", "text")).alias("instruction"), prompt.alias("prompt_emoji"),
        reply.alias("tokens"), alias.first_truthy(kept, ("topic",)).alias("topic"),
    )
    return made.filter((F.col("prompt_emoji") != "") & (F.size("tokens") >= 2))


def infill_items(examples: DataFrame, patterns: tuple[str, ...] = PATTERNS, samples: int = 1, seed: int = 42) -> DataFrame:
    """One row per example, pattern and sample: what is shown, what is masked, and the truth.

    Half of the reply is shown, one token at least; the scattered places go by hash of seed and example.
    """
    n, k = F.size("tokens"), sq.reveal_count(F.size("tokens"))
    unit = F.concat_ws(":", F.lit(str(seed)), "example_id")
    each = F.array(*[F.struct(F.lit(p).alias("pattern"), sq.reveal_positions(n, k, p, unit).alias("shown")) for p in patterns])
    items = examples.select("*", n.alias("reply_len"), k.alias("revealed_k"), F.explode(each).alias("_p")).select("*", "_p.*").drop("_p")
    items = items.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    shown, places = F.col("shown"), F.sequence(F.lit(0), F.col("reply_len") - 1)
    slots, hidden = sq.visible_slots(F.col("tokens"), shown), sq.masked_tokens(F.col("tokens"), shown)
    return items.select(
        "example_id", "source_index", "instruction", "prompt_emoji", F.array_join("tokens", "").alias("reply"), "topic", "pattern", "sample_idx", "reply_len", "revealed_k",
        shown.alias("revealed_positions"), F.filter(places, lambda i: ~F.array_contains(shown, i)).alias("masked_positions"), F.size(hidden).alias("masked_count"),
        F.array_join(hidden, "").alias("masked_truth"), slots.alias("visible_slots"), F.array_join(slots, " ").alias("visible_reply"),
    )


def pass_power(rows: DataFrame, model: str, pattern: str, problem: list[str], order: list[str], max_k: int) -> DataFrame:
    """Pass and power at k per model and pattern, and over all patterns, where a problem keeps its own pattern.

    ``rows`` hold the metrics; with a semantic_target_cosine the distances that are missing are made from it, and the
    semantic powers and passes come out too. Missing values count as 0 for the cosine, 1 and 2 for the distances.
    """
    named = rows.withColumn("_own", F.coalesce(F.col(pattern), F.lit("unknown")))
    named = score.with_semantic_distances(score.with_all_bucket(named, pattern))
    best = {f"power_at_k_{m}": m for m in ("benchmark_score", "bag_f1", "bag_jaccard")}
    passes, least = {}, {}
    if "semantic_target_cosine" in rows.columns:
        worst = {"semantic_target_cosine": 0.0, "semantic_geodesic_distance": 1.0, "semantic_embedding_distance": 2.0}
        named = named.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in worst.items()})
        best["power_at_k_semantic_cosine"] = "semantic_target_cosine"
        least = {"power_at_k_semantic_distance": "semantic_geodesic_distance", "power_at_k_embedding_distance": "semantic_embedding_distance"}
        named = named.withColumns({f"_less_{c}": -F.col(c) for c in least.values()})
        best |= {n: f"_less_{c}" for n, c in least.items()}
        passes = {f"pass_at_k_{n}": c for n, c in zip(("semantic", "semantic_distance", "embedding_distance"), score.semantic_passes().values())}
    out = score.curves(named, [model, pattern], [*problem, "_own"], order, best, passes, max_k)
    out = out.withColumns({n: -F.col(n) for n in least})
    counts = named.groupBy(model, pattern).agg(F.count("*").alias("samples"))
    return out.join(F.broadcast(counts), [model, pattern])  # joined to curves: a row per model and pattern


def best_of_references(rows: DataFrame, references: DataFrame, key: str, by: str) -> DataFrame:
    """(key, best): the largest bag Jaccard of each row's ``p`` to the references that share its ``by``; null without any.

    ``references`` (by, r) may hold any number of rows. Equal bags under one key are one class on both sides, so a hot
    prompt's copies are compared once.
    """
    mine = durable(rows.select(key, by, F.array_sort("p").alias("_a")))
    theirs = durable(references.select(by, F.array_sort("r").alias("_b")).distinct())
    asked = mine.groupBy(by, "_a").agg(F.count("*").alias("_n"))
    sizes = durable(asked.groupBy(by).agg(F.count("*").alias("_size")).join(theirs.groupBy(by).agg(F.ceil(F.count("*") / 1000).cast("int").alias("_parts")), by))
    left = lookup_skewed(asked, sizes, [by], "_size").select(by, "_a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    right = theirs.join(sizes, by).select(by, "_b", F.pmod(F.xxhash64("_b"), F.col("_parts")).cast("int").alias("_part"))
    best = left.join(right, [by, "_part"]).groupBy(by, "_a").agg(F.max(bags.bag_jaccard(F.col("_a"), F.col("_b"))).alias("best"))
    counted = durable(asked.join(best, [by, "_a"]))
    return lookup_skewed(mine, counted, [by, "_a"], "_n", "left").select(key, "best")


def order_effects(permuted: DataFrame, resampled: DataFrame, references: DataFrame, model: str, group: str, key: str, by: str) -> DataFrame:
    """Per model: stability over permutations and over resamples, their difference, and alignment with the target.

    ``permuted`` (model, group, key, by, p, t) and ``resampled`` (model, group, p) hold the replies. Only groups of two
    replies or more count for a stability. target_best_jaccard takes the best of the references of the row's ``by``,
    or the target where it has none. Means are over groups, alignments over rows; each side stands without the other.
    """
    keys = [model, group]
    steady = [stability.group_stability(x, keys).filter("members >= 2").groupBy(model).agg(F.avg("stability").alias(n)) for x, n in ((permuted, "perm_stability"), (resampled, "resample_stability"))]
    own = permuted.withColumn("_own", bags.bag_jaccard(F.col("p"), F.col("t")))
    told = own.join(best_of_references(permuted, references, key, by), key)
    near = told.groupBy(model).agg(F.avg("_own").alias("target_bag_jaccard"), F.avg(F.coalesce("best", "_own")).alias("target_best_jaccard"))
    out = near.join(steady[0], model, "full").join(steady[1], model, "full")
    return out.withColumn("order_effect", F.col("resample_stability") - F.col("perm_stability"))


def stability_summary(rows: DataFrame, model: str, group: list[str]) -> DataFrame:
    """Per model the means over its groups of the permutation stability and of the alignment with the target.

    ``rows`` (model, group, p, t) hold the replies; a group of one reply is wholly stable.
    """
    keys = [model, *group]
    steady = stability.group_stability(rows, keys)
    metrics = {"target_benchmark_score": "benchmark_score", "target_bag_f1": "bag_f1", "target_bag_jaccard": "bag_jaccard"}
    per = score.scored_pairs(rows).groupBy(*keys).agg(*[F.avg(c).alias(n) for n, c in metrics.items()])
    both = steady.join(per, keys).groupBy(model)
    return both.agg(F.count("*").alias("groups"), F.avg("stability").alias("mean_permutation_stability"), *[F.avg(n).alias(f"mean_{n}") for n in metrics])


def permutation_groups(rows: DataFrame, order: str, count: int, seed: int = 1, partition: str = "all", strategy: str = "random", share: float = 0.05) -> DataFrame:
    """(group_id, topic, instruction, variant_idx, prompt_emoji, response_emoji): orders of the prompts of replies.

    Prompts need two tokens and replies one; groups that come to a single order are left out.
    """
    kept = split.partition_rows(rows, partition, strategy, share, row_key=order)
    prompt = tk.emoji_tokens(alias.first_truthy(kept, ("input", "prompt_emoji", "emoji")))
    reply = tk.emoji_text(alias.first_truthy(kept, ("output", "response_emoji", "emoji")))
    topic = alias.first_truthy(kept, ("topic",))
    ident = F.format_string("reply_%05d_%s", F.col(order), F.coalesce(F.nullif(topic, F.lit("")), F.lit("untagged")))
    made = kept.select(ident.alias("group_id"), topic.alias("topic"), alias.first_truthy(kept, ("instruction",)).alias("instruction"), prompt.alias("tokens"), reply.alias("response_emoji"))
    made = made.filter(alias.eligible(F.col("tokens"), F.col("tokens"), 2, 2) & (F.col("response_emoji") != "") & (F.size(F.array_distinct("tokens")) > 1))
    variants = corpus.permutations(made, "group_id", count, seed)
    return made.drop("tokens").join(variants.withColumnRenamed("variant", "prompt_emoji"), "group_id")


def prediction_summary(scored: DataFrame, group: list[str]) -> DataFrame:
    """Means of the metrics of scored predictions; missing ones are there with their scores and are counted."""
    names = ("benchmark_score", "bag_f1", "bag_jaccard", "set_jaccard", "length_score", "exact_bag_match", "exact_sequence_match")
    return scored.groupBy(*group).agg(F.count("*").alias("problems"), F.count(F.when(F.col("missing"), 1)).alias("missing"), *[score.mean0(n).alias(n) for n in names])

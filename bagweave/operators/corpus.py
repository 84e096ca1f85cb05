"""Corpus operators: vocabularies, packing, sharding, repeats, tail slices, hash orders, permutations, references."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..runtime import broadcast_if_small, durable, hash_unit, is_small, lookup_skewed

#: Ids below are special tokens.
FIRST_ID = 5


def with_global_index(df: DataFrame, order: list[str], name: str = "idx", start: int = 0) -> DataFrame:
    """``df`` with a dense global index in ``order``, without one task that sorts everything.

    Rows are range-partitioned and sorted, numbered within partitions, and moved by the partitions' offsets (one row
    per partition). The order must be total for the result to be reproducible.
    """
    ranged = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    per = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_least"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # as many rows as partitions
    base = per.select("_p", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = ranged.join(F.broadcast(base), "_p")
    return out.withColumn(name, F.col("_m") - F.col("_least") + F.col("_base") + start).drop("_p", "_m", "_least", "_base")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, token_id) of the distinct tokens of (tokens) rows, ids by code point order from FIRST_ID."""
    distinct = tokens.select(F.explode("tokens").alias("token")).distinct()
    return with_global_index(distinct, ["token"], "token_id", FIRST_ID).select("token", F.col("token_id").cast("int").alias("token_id"))


def encode(rows: DataFrame, vocab: DataFrame, key: str, unknown: int) -> DataFrame:
    """(key, ids) of (key, tokens); unknown tokens get ``unknown``; null tokens give no ids.

    A vocabulary that is counted small goes along with an Arrow function, and no token is shuffled; a larger one is
    joined token by token. ``key`` is unique.
    """
    if is_small(vocab):
        known = vocab.filter("token IS NOT NULL").select("token", "token_id").collect()
        return rows.select(key, _ids_by(known, unknown)(F.col("tokens")).alias("ids"))
    flat = rows.select(key, F.posexplode("tokens").alias("pos", "token"))
    ids = flat.join(broadcast_if_small(vocab), "token", "left").select(key, F.struct("pos", F.coalesce("token_id", F.lit(unknown)).alias("id")).alias("s"))
    made = ids.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["id"]).alias("ids"))
    return rows.select(key).join(made, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def _ids_by(known: list, unknown: int):
    """An Arrow function from arrays of tokens to arrays of their ids."""
    tokens, ids = [r[0] for r in known], [r[1] for r in known] + [unknown]

    @F.arrow_udf("array<int>")
    def look_up(lists: pa.Array) -> pa.Array:
        lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(tokens, pa.string())), len(tokens))
        ends = np.cumsum(np.r_[0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()).take(at))

    return look_up


def packed(rows: DataFrame, partition: list[str], order: list[str], block: int, bos: int, eos: int) -> DataFrame:
    """(partition, block_id, input_ids): the ids of (partition, order, ids) rows in order, as full blocks BOS ... EOS.

    Each partition key is packed by itself and its remainder dropped. Offsets come from running sums of row sizes,
    in two levels: over ranges of ``order`` first, then within a range, so a key with a third of all rows
    is not one window. A row gives one piece to each block it touches, not one per id.
    """
    if block <= 2:
        raise ValueError("a block needs room beyond its two end marks")
    inner = block - 2
    sized = rows.select(*partition, *order, "ids", F.size("ids").alias("_size"))
    ranged = durable(sized.repartitionByRange(*partition, *order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy(*partition, "_p").agg(F.sum("_size").alias("_s"))
    base = sums.select(*partition, "_p", F.coalesce(F.sum("_s").over(W.partitionBy(*partition).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = W.partitionBy(*partition, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    at = ranged.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(broadcast_if_small(base), [*partition, "_p"])
    at = at.filter("_size > 0").select(*partition, "ids", "_size", (F.col("_base") + F.col("_in")).alias("_o"))
    touched = F.sequence(F.floor(F.col("_o") / inner), F.floor((F.col("_o") + F.col("_size") - 1) / inner))
    pieces = at.select("*", F.explode(touched).alias("block_id")).withColumn("_a", F.greatest(F.col("_o"), F.col("block_id") * inner))
    piece = F.slice("ids", (F.col("_a") - F.col("_o") + 1).cast("int"), F.least(F.lit(inner), (F.col("block_id") + 1) * inner - F.col("_a")).cast("int"))
    pieces = pieces.select(*partition, "block_id", F.struct(F.col("_a").alias("o"), piece.alias("i")).alias("_c"))
    blocks = pieces.groupBy(*partition, "block_id").agg(F.collect_list("_c").alias("_l"))
    blocks = blocks.withColumn("_ids", F.flatten(F.transform(F.array_sort("_l"), lambda c: c["i"]))).filter(F.size("_ids") == inner)
    ids = F.col("_ids")
    return blocks.select(*partition, "block_id", F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos))).alias("input_ids"))


def hash_order(seed: str, *key: Column) -> Column:
    return F.sha1(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key]))


def shard(rows: DataFrame, order: list[str], replicas: int, rank: int, drop_last: bool = False) -> DataFrame:
    """Every ``replicas``-th row in order, from ``rank``. Shards are equal: padded from the head, or the tail dropped."""
    indexed = with_global_index(rows, order, "idx")
    n = indexed.count()
    if drop_last:
        return indexed.filter(F.col("idx") < n // replicas * replicas).filter(F.col("idx") % replicas == rank)
    total = -(-n // replicas) * replicas
    extra = indexed.filter(F.col("idx") < total - n).withColumn("idx", F.col("idx") + n)
    return indexed.unionByName(extra).filter(F.col("idx") % replicas == rank)


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int, start: int = 0) -> DataFrame:
    """(key, idx) in the epoch's hash order from position ``start``: a run resumes where its counter stood."""
    mixed = rows.select(key).withColumn("_h", hash_order(f"{seed}:{epoch}", F.col(key)))
    return with_global_index(mixed, ["_h", key], "idx").filter(F.col("idx") >= start).select(key, "idx")


def repeated(rows: DataFrame, n: int) -> DataFrame:
    """Each row ``n`` times, numbered from 1."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else rows.withColumn("copy", F.lit(0)).limit(0)


def union_sources(parts: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """Labelled tables, each repeated, in one; missing columns are null."""
    out = None
    for label, df, n in parts:
        one = repeated(df, n).withColumn("label", F.lit(label))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def tail_slice(rows: DataFrame, order: list[str], last: int) -> tuple[DataFrame, DataFrame]:
    """(all but the last ``last`` rows in order, those rows)."""
    indexed = with_global_index(rows, order, "idx")
    cut = max(0, indexed.count() - last)
    return indexed.filter(F.col("idx") < cut), indexed.filter(F.col("idx") >= cut)


def reference_rows(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, value, first): one row for each distinct non-empty value of a group, with the order it first came in.

    The form for groups without a bound: nothing is gathered, copies are counted away per task.
    """
    return rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*by, value).agg(F.min(order).alias("first"))


def references(rows: DataFrame, by: list[str], value: str, order: str, most: int | None = None) -> DataFrame:
    """(by, references): the distinct non-empty values of a group in the order they first came.

    A group's values become one array; for groups without a bound there is ``reference_rows``, or ``most`` of the
    first are kept, found in two levels.
    """
    first = reference_rows(rows, by, value, order).withColumnRenamed("first", "_o")
    if most is not None:
        first = top_per_group(first, by, [F.col("_o"), F.col(value)], most).drop("rn")
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v")))), lambda s: s["v"]).alias("references"))


def permutations(rows: DataFrame, key: str, count: int, seed: int = 42, attempts: int = 128) -> DataFrame:
    """(key, variant_idx, variant): distinct orders of (key, tokens); the given order is variant 0.

    Further ones come from a generator seeded by the row's key, at most ``attempts`` draws; tokens with few orders
    can so end with fewer than ``count`` variants, each of them once. Null tokens are one empty variant.
    """

    def shuffles(tokens, rng):
        while True:
            mixed = list(tokens)
            rng.shuffle(mixed)
            yield "".join(mixed)

    def draw(batches):
        import hashlib
        import random
        from itertools import islice

        for pdf in batches:
            out = []
            for k, toks in zip(pdf[key], pdf["tokens"]):
                given = [] if toks is None else list(toks)
                rng = random.Random(int(hashlib.sha1(f"{seed}:{k}".encode()).hexdigest()[:12], 16))
                draws = islice(shuffles(given, rng), attempts) if len(given) > 1 else ()
                distinct = dict.fromkeys(["".join(given)])
                for text in draws if count > 1 else ():
                    distinct[text] = None
                    if len(distinct) == count:
                        break
                out += [(k, i, v) for i, v in enumerate(distinct)]
            yield pd.DataFrame(out, columns=[key, "variant_idx", "variant"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "tokens").mapInPandas(draw, f"`{key}` {kind}, variant_idx int, variant string")


#: Parts that a group is cut into before its top rows are found.
SALTS = 64


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, with ``rn`` from 1.

    In two levels: first of each of SALTS parts of a group, then of what is left, SALTS * k rows of a group at most,
    so a group with a third of all rows is spread over tasks.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    some = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*group, part).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")
    return some.withColumn("rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rn") <= k)


def sample_per_group(rows: DataFrame, group: list[str], key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows of each group, the first in hash order."""
    return top_per_group(rows, group, [hash_order(str(seed), F.col(key)), F.col(key)], k).drop("rn")


# First words that stay as they are behind a prefix.
PRONOUNS = ("I", "I'm", "I've", "I'll", "I'd")
#: Draws per reply that is wanted, before a pool counts as used up.
ATTEMPTS = 40


def generated_pairs(topics: DataFrame, per_message: int, least: int = 1, most: int = 3, prefixes: tuple[str, ...] = ("",), seed: int = 42) -> DataFrame:
    """(topic, instruction, prompt_emoji, input, output): synthetic pairs from (topic, messages, pool).

    Each message gets one prefix and ``per_message`` different replies, each with a prompt, of ``least`` to ``most``
    different tokens of the sorted pool, or as many as ATTEMPTS draws a reply find. All choices go by hash or by a
    generator seeded by topic and message, so they do not depend on partitions. Behind a prefix a message starts in
    lower case, pronouns apart; the whole starts in upper case. Equal (instruction, output) pairs count once. input is
    empty.
    """

    def unit(*parts: Column) -> Column:
        return hash_unit(str(seed), *parts)

    m = topics.select("topic", "pool", F.explode("messages").alias("message"))
    prefix = F.element_at(F.array(*map(F.lit, prefixes)), F.floor(unit(F.lit("prefix"), F.col("topic"), F.col("message")) * len(prefixes)).cast("int") + 1)
    lowered = F.concat(F.lower(F.substring("message", 1, 1)), F.expr("substring(message, 2)"))
    body = F.when((prefix == "") | F.split("message", " ")[0].isin(*PRONOUNS), F.col("message")).otherwise(lowered)
    whole = F.trim(F.concat(prefix, body))
    m = m.withColumn("instruction", F.concat(F.upper(F.substring(whole, 1, 1)), F.substring(whole, F.lit(2), F.char_length(whole))))

    def draw(batches):
        import hashlib
        import random

        def combinations(pool, count, rng):
            found = {}
            for _ in range(count * ATTEMPTS):
                if len(found) >= count:
                    break
                k = min(rng.randint(least, most), len(pool))
                found["".join(rng.sample(pool, k))] = True
            return list(found)

        for pdf in batches:
            out = []
            for topic, message, instruction, pool in zip(pdf["topic"], pdf["message"], pdf["instruction"], pdf["pool"]):
                pool = [] if pool is None else sorted(pool)
                rng = random.Random(int(hashlib.sha1(f"{seed}:{topic}:{message}".encode()).hexdigest()[:12], 16))
                for reply in combinations(pool, per_message, rng):
                    out.append((topic, instruction, combinations(pool, 1, rng)[0], "", reply))
            yield pd.DataFrame(out, columns=["topic", "instruction", "prompt_emoji", "input", "output"])

    kind = dict(topics.dtypes)["topic"]
    made = m.select("topic", "message", "instruction", "pool").mapInPandas(draw, f"topic {kind}, instruction string, prompt_emoji string, input string, output string")
    first = made.groupBy("instruction", "output").agg(F.min(F.struct("topic", "prompt_emoji", "input")).alias("r"))
    return first.select("r.topic", "instruction", "r.prompt_emoji", "r.input", "output")


def ema(rows: DataFrame, group: list[str], order: str, value: str, decay: float = 0.9999, warm: bool = True) -> DataFrame:
    """(group, ema): the moving average over ordered updates; the n-th decays by min(decay, (1+n)/(10+n)) if ``warm``.

    The first value starts the average. The fold is a weighted sum whose weights depend on a value's place and the
    group's length only (the warm decays telescope), so long series are summed in parts, never gathered.
    """
    placed = with_global_index(rows.select(*group, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")), [*group, "_o"], "_i")
    ends = placed.groupBy(*group).agg(F.min("_i").alias("_first"), (F.max("_i") - F.min("_i")).alias("_last"), F.count("*").alias("_size"))
    at = lookup_skewed(placed, durable(ends), group, "_size").withColumn("_n", F.col("_i") - F.col("_first"))
    n, last = F.col("_n").cast("double"), F.col("_last").cast("double")
    turn = max(0.0, math.ceil((10 * decay - 1) / (1 - decay))) if warm and decay < 1 else 0.0  # from here on decay itself
    warm_to = F.least(last, F.lit(turn - 1))
    later = F.lit(1.0)
    for k in range(2, 11):
        later = later * (n + k) / (F.greatest(warm_to, n) + k)
    later = (later if turn else F.lit(1.0)) * F.pow(F.lit(decay), F.greatest(F.lit(0.0), last - F.greatest(n, F.lit(turn - 1) if turn else n)))
    own = F.when((n < turn) if turn else F.lit(False), (1 + n) / (10 + n)).otherwise(F.lit(decay))
    weight = F.when(n == 0, 1.0).otherwise(1 - own) * later
    return at.groupBy(*group).agg(F.sum(weight * F.col("_v")).alias("ema"))


def prompt_text(mode: str, variant: Column, instruction: Column, prompt: Column, given: Column) -> Column:
    """The prompt of a task in one of four modes."""
    # The prompt templates.
    templates = {
        "emoji_only": ("", ""),
        "emoji_constrained": ("Prompt emojis: ", "\nReply with only 2 to 5 emojis. Match the meaning. Do not use words."),
        "emoji_no_copy_reply": ("Emoji message: ", "\nWrite a NEW emoji-only reply, not a copy of the input.\nUse 2 to 5 emojis.\nDo not reuse any input emoji unless absolutely necessary.\nReply:"),
    }
    if mode == "text_assisted":
        return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit("Message: "), F.coalesce(instruction, F.lit("")), F.lit("\nPrompt emojis: "), F.coalesce(prompt, F.lit(""))))
    before, after = templates[mode]
    return F.concat(F.lit(before), variant, F.lit(after))


def emoji_columns(df: DataFrame, **named: str) -> DataFrame:
    """``df`` with token arrays of text columns: name=column."""
    return df.withColumns({n: tk.emoji_tokens(F.col(c)) for n, c in named.items()})

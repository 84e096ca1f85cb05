"""Pairwise stability of replies to reordered prompts, and the order effect."""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import bags
from ..runtime import durable, lookup_skewed
from .joins import last_per_key

#: Classes of equal bags in a part of a group, about; a task compares two parts.
GROUP_PART = 20_000
#: Tokens of a bag up to which it is compared by its sub-bags; a larger one is compared with each bag of its task.
SUBSETS_OF = 10
#: Rows that a worker takes together, about, if the groups are smaller.
TOGETHER = 20_000


@cache
def _subsets(size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the k-subsets of ``size`` places in order: the number of each one's first k - 1 places, and its last place."""
    before = {c: n for n, c in enumerate(combinations(range(size), k - 1))}
    chosen = list(combinations(range(size), k))
    return np.array([before[c[:-1]] for c in chosen]), np.array([c[-1] for c in chosen])


def pair_sums(task: np.ndarray, across: np.ndarray, side: np.ndarray, n: np.ndarray, tokens: pa.ListArray) -> np.ndarray:
    """Per task the sum of the bag Jaccard over pairs of its rows, each pair weighted by both counts ``n``.

    ``task`` numbers the rows from 0 on, ``across`` tells of each task whether only pairs of both sides (0, 1) count.
    ``tokens`` are distinct sorted bags of a task. With o tokens in common and t in both bags together, the Jaccard
    o / (t - o) is the sum over k of C(o, k) / C(t - 1, k): so each set of k tokens adds the product of the counts of
    the bags that hold it, and no pair of bags is formed. This takes 2^size steps a bag; larger bags meet every other.
    """
    out = np.zeros(len(across))
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    words = pc.dictionary_encode(tokens.flatten()).indices
    said = words.is_valid().to_numpy(zero_copy_only=False)  # a null token is like none
    row, word = row[said], words.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(row):
        return out
    # the second copy of a token is a token of its own, and so on: bags become sets
    at = np.arange(len(row))
    copy = at - np.maximum.accumulate(np.where(np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])], at, 0))
    item, named = pd.factorize((task[row] * (word.max() + 1) + word) * (copy.max() + 1) + copy)
    held = np.bincount(row, minlength=len(sizes))
    first = np.r_[0, np.cumsum(held)]

    kept = np.unique(sizes[(held > 0) & (held <= SUBSETS_OF)])
    groups = []  # rows of as many items each: their items in order, and their sub-bags found so far
    for h in np.unique(held[(held > 0) & (held <= SUBSETS_OF)]):
        rows = np.flatnonzero(held == h)
        groups.append((int(h), rows, np.sort(item[first[rows][:, None] + np.arange(h)], axis=1), np.zeros((len(rows), 1), np.int64)))
    k = 0
    while groups:
        k += 1
        keys, owners, places = [], [], []
        for h, rows, items, found in groups:
            before, last = _subsets(h, k)
            live = found[:, before] >= 0
            keys.append((found[:, before] * len(named) + items[:, last])[live])
            owners.append(np.broadcast_to(rows[:, None], live.shape)[live])
            places.append(live)
        code, distinct = pd.factorize(np.concatenate(keys))
        owner = np.concatenate(owners)
        # a sub-bag of one row makes no pair, nor do those that hold it
        shared = np.bincount(code, minlength=len(distinct)) > 1
        number = np.where(shared, np.cumsum(shared) - 1, -1)[code]
        more, start = [], 0
        for (h, rows, items, _), live in zip(groups, places):
            found = np.full(live.shape, -1, np.int64)
            count = np.count_nonzero(live)
            found[live] = number[start : start + count]
            start += count
            if h > k and (found >= 0).any():
                more.append((h, rows, items, found))
        groups = more
        owner, number = owner[number >= 0], number[number >= 0]
        if not len(owner):
            break
        many, width = int(shared.sum()), len(kept)
        of = np.zeros(many, np.int64)
        of[number] = task[owner]
        share = np.array([[1.0 / comb(int(a + b - 1), k) if k < a + b else 0.0 for b in kept] for a in kept])
        place = number * width + np.searchsorted(kept, sizes[owner])
        weight = n[owner]
        left = side[owner] == 0
        one = np.bincount(place[left], weight[left], many * width).reshape(many, width)
        squares = np.bincount(place[left], weight[left] ** 2, many * width).reshape(many, width)
        sums = (((one @ share) * one).sum(1) - squares @ np.diag(share)) / 2
        if across.any():
            two = np.bincount(place[~left], weight[~left], many * width).reshape(many, width)
            sums = np.where(across[of], ((one @ share) * two).sum(1), sums)
        out += np.bincount(of, sums, len(out))

    for b in np.flatnonzero(held > SUBSETS_OF):
        lo, hi = np.searchsorted(task, [task[b], task[b] + 1])
        mine = np.zeros(len(named), bool)
        mine[item[first[b] : first[b + 1]]] = True
        both = np.bincount(row[first[lo] : first[hi]] - lo, mine[item[first[lo] : first[hi]]], hi - lo)
        weight = np.where(held[lo:hi] > SUBSETS_OF, 0.5, 1.0) * n[lo:hi] * n[b]  # two large ones meet twice
        if across[task[b]]:
            weight[side[lo:hi] == side[b]] = 0.0
        weight[b - lo] = 0.0
        out[task[b]] += (weight * both / (sizes[b] + sizes[lo:hi] - both)).sum()
    return out


def _paired(keys: list[str], schema: pa.Schema):
    """The Arrow function from rows sorted by ``keys`` to (keys, _s), a row per task; tasks are never cut."""

    def finish(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        task = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
        column = lambda c: rows.column(c).to_numpy()
        across = (column("_i") != column("_j"))[starts]
        side = ((column("_own") != column("_i")) & across[task]).astype(np.int64)
        sums = pair_sums(task, across, side, column("_n"), rows.column("_a").combine_chunks())
        out = rows.select(keys).take(starts).append_column("_s", pa.array(sums))
        return out.cast(schema).combine_chunks().to_batches()[0]

    def starts_of(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in keys:
            a = rows.column(c).combine_chunks()
            x, y = a[1:], a[:-1]
            new[1:] |= pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False) | pc.not_equal(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def run(batches):
        waiting, count, wanted = [], 0, TOGETHER
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= wanted:
                rows = pa.Table.from_batches(waiting)
                starts = starts_of(rows)
                end = int(starts[-1])
                if end:
                    yield finish(rows.slice(0, end), starts[:-1])
                # only the last task may go on; one that is long is looked at anew when it has doubled
                waiting, count = rows.slice(end).to_batches(), rows.num_rows - end
                wanted = max(TOGETHER, 2 * count)
        if count:
            rows = pa.Table.from_batches(waiting)
            yield finish(rows, starts_of(rows))

    return run


def group_stability(rows: DataFrame, group: list[str], tokens: str = "p") -> DataFrame:
    """(group, stability, members): the mean bag Jaccard over unordered pairs of a group; 1.0 for a single member.

    Equal bags are one class, weighted by its size. The classes of a group are cut into parts of GROUP_PART, about, and
    each task has one part or a pair of them, so a group with a third of all rows is many tasks. A task's pairs are
    summed by the sub-bags that they share (``pair_sums``): its time grows with its rows, not with their pairs.
    """
    c = durable(rows.groupBy(*group, F.array_sort(F.coalesce(F.col(tokens), F.array().cast("array<string>"))).alias("_a")).agg(F.count("*").cast("double").alias("_n")))
    total = c.groupBy(*group).agg(F.sum("_n").alias("members"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2).alias("_same"))
    parts = c.groupBy(*group).agg(F.ceil(F.count("*") / GROUP_PART).cast("int").alias("_parts"), F.count("*").alias("_size"))
    if (parts.agg(F.max("_parts")).first()[0] or 1) == 1:  # no group needs more than one task
        cut = c.withColumns({"_own": F.lit(0), "_parts": F.lit(1)})
    else:
        cut = lookup_skewed(c, durable(parts), group, "_size").withColumn("_own", F.pmod(F.xxhash64("_a"), F.col("_parts")).cast("int"))
    other = cut.select(*group, "_a", "_n", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    keys = [*group, "_i", "_j"]
    meet = other.select(*group, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_a", "_n")
    spark = rows.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    near = meet.repartition(count, *keys).sortWithinPartitions(*keys)
    told = meet.select(*keys, F.lit(0.0).alias("_s")).schema
    pairs = near.mapInArrow(_paired(keys, to_arrow_schema(told)), told).groupBy(*group).agg(F.sum("_s").alias("_s"))
    mean = F.try_divide(F.col("_same") + F.coalesce("_s", F.lit(0.0)), F.col("members") * (F.col("members") - 1) / 2)
    out = total.join(pairs, group, "left")
    return out.select(*group, F.coalesce(mean, F.lit(1.0)).alias("stability"), F.col("members").cast("bigint").alias("members"))


def variant_stability(rows: DataFrame, problem: list[str], sample: str, variant: str, order: str) -> DataFrame:
    """(problem, stability, pairs) pooled over the samples' variant pairs; a repeated variant counts by its last row.

    Problems without a pair have no row: their stability is not applicable.
    """
    key = [*problem, sample, variant]
    one = last_per_key(rows.select(F.struct(*key).alias("_k"), order, "p"), "_k", order).select("_k.*", "p")
    a = one.select(*problem, sample, F.col(variant).alias("_i"), F.col("p").alias("_a"))
    b = one.select(*problem, sample, F.col(variant).alias("_j"), F.col("p").alias("_b"))
    return a.join(b, [*problem, sample]).filter("_i < _j").groupBy(*problem).agg(F.avg(bags.bag_jaccard(F.col("_a"), F.col("_b"))).alias("stability"), F.count("*").alias("pairs"))


def order_effect(permuted: DataFrame, resampled: DataFrame, group: list[str]) -> DataFrame:
    """Per group: stability over permutations, over resamples, and how much less stable permuting is."""
    p = group_stability(permuted, group).select(*group, F.col("stability").alias("perm_stability"))
    r = group_stability(resampled, group).select(*group, F.col("stability").alias("resample_stability"))
    return p.join(r, group).withColumn("order_effect", F.col("resample_stability") - F.col("perm_stability"))


def target_alignment(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, alignment): the mean bag Jaccard to the target."""
    return rows.groupBy(*group).agg(F.coalesce(F.avg(bags.bag_jaccard(F.col("p"), F.col("t"))), F.lit(0.0)).alias("alignment"))

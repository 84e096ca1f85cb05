"""Items that appear together (problem 7).

Method: a blocked Gram matrix. Items are numbered in code point order. Each block of records is a binary sparse matrix
(row offsets and sorted item numbers); its columns are cut into item blocks, ranges of item numbers, of which there
are the more, the more cells the record block's Gram matrix has. For each pair of item blocks the transpose-product
X_I' X_J is formed and summed, so a task holds a bounded number of cells however long a basket is; the sums of all
record blocks are added by a shuffle of already summed cells and normalised by the items' marginals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, lookup_skewed

#: Cells of a transpose-product that are held at once; bounds a task's memory, not the result.
BLOCK_CELLS = 4_000_000
#: Items up to which a task keeps the sums of its record blocks in one dense matrix.
DENSE_ITEMS = 1500
#: Items, and bytes of them, up to which their numbers travel with the function; more are joined.
DICTIONARY_ITEMS, DICTIONARY_BYTES = 200_000, 16 << 20


def products(rows: np.ndarray, items: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells above the diagonal of X'X, one array pair (item, item) for each part of a product of two item blocks.

    ``rows`` and ``items`` are the entries of X, sorted by both, without repeats; items are below ``count``.
    """
    if not len(rows):
        return
    size = np.bincount(rows).astype(np.float64)
    blocks = max(1, int(np.ceil(np.sqrt((size * (size - 1) / 2).sum() / BLOCK_CELLS))))
    width = min(max(1, -(-count // blocks)), BLOCK_CELLS)
    block = items // width
    at = [np.flatnonzero(block == k) for k in range(int(block.max()) + 1)]
    for i, own in enumerate(at):
        for j in range(i, len(at)):
            if not len(own) or not len(at[j]):
                continue
            other = rows[at[j]]
            first, last = (np.searchsorted(other, rows[own], side) for side in ("left", "right"))
            if i == j:  # above the diagonal: the entries of the same record behind this one
                first = np.arange(1, len(own) + 1)
            n = last - first
            upto = np.cumsum(n)
            a = 0
            while a < len(own):  # entries of the left block, as many as their cells allow
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK_CELLS, "right")))
                part = n[a:b]
                if part.any():
                    ends = np.cumsum(part)
                    ramp = np.arange(ends[-1]) - np.repeat(ends - part, part)
                    yield np.repeat(items[own[a:b]], part), items[at[j][np.repeat(first[a:b], part) + ramp]]
                a = b


def _gram(batches: Iterator[pa.RecordBatch], dictionary: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """Sums of the transpose-products of this task's record blocks, by pairs of item numbers.

    With a dictionary the column holds the items themselves, and those outside it count nowhere; without, numbers.
    """
    known = len(dictionary) if dictionary is not None else 0
    dense = np.zeros(known * known, np.int64) if 0 < known <= DENSE_ITEMS else None

    def out(a, b, n):
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "together"])

    for batch in batches:
        lists = batch.column(0)
        rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        values = lists.flatten()
        if dictionary is not None:
            code = pc.fill_null(pc.index_in(values, value_set=dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, code, names = rows[code >= 0], code[code >= 0], None
            count = known
        else:
            names, code = np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True)
            count = len(names)
        order = np.argsort(rows * max(1, count) + code, kind="stable")
        for a, b in products(rows[order], code[order], count):
            cell = a * count + b
            if dense is None:
                cell, n = np.unique(cell, return_counts=True)
                a, b = cell // count, cell % count
                yield out(a if names is None else names[a], b if names is None else names[b], n)
            elif 2 * len(cell) > len(dense):
                dense += np.bincount(cell, minlength=len(dense))
            else:
                np.add.at(dense, cell, 1)
    if dense is not None:
        cell = np.flatnonzero(dense)
        yield out(cell // known, cell % known, dense[cell])


def _numbered(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Baskets as arrays of item numbers, for more items than travel with a function; a hot item never is one task."""
    flat = sets.select("basket", F.explode("items").alias("item"))
    return lookup_skewed(flat, items, ["item"], "records").groupBy("basket").agg(F.collect_list("code").alias("items"))


def item_pairs(baskets: DataFrame, least: int = 1, share: int | None = None, lift: int | None = None) -> tuple[DataFrame, int]:
    """(item_a, item_b, together, records_a, records_b, lift) of every pair of different items that share a basket.

    ``baskets`` has one array column ``items``; repeats and nulls within a basket count once or not at all, null and
    empty baskets count nowhere. item_a is before item_b by code points. lift = together * n / (records_a *
    records_b) with n, also returned, the number of baskets that hold anything.

    With bounds (as ``frequent_pairs`` has them) items whose marginal alone rules out that any pair of theirs passes are
    left out of the product: an item in too few records, or one in more than 1/``lift`` of them, since a pair is in no
    more records than either of its items. Pairs that pass are all there, with the same counts.
    """
    there = F.array_compact(F.array_distinct("items"))
    sets = durable(baskets.select(F.monotonically_increasing_id().alias("basket"), there.alias("items")).filter("size(items) > 0"))
    n = sets.count()
    alone = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("records")).filter(F.col("records") >= least)
    if share:
        alone = alone.filter(F.col("records") * share >= n)
    if lift:
        alone = alone.filter(F.col("records") * lift <= n)
    numbered = alone.repartitionByRange("item").sortWithinPartitions("item")
    items = durable(numbered.withColumn("code", F.monotonically_increasing_id()))  # in code point order, with gaps
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("bytes")).first()
    schema = "a bigint, b bigint, together bigint"
    small = size.n <= DICTIONARY_ITEMS and size.bytes <= DICTIONARY_BYTES
    if small:
        rows = sorted((tuple(r) for r in items.select("code", "item", "records").collect()))
        cells = sets.select("items").mapInArrow(partial(_gram, dictionary=pa.array([r[1] for r in rows], pa.string())), schema)
        named = items.sparkSession.createDataFrame([(k, r[1], r[2]) for k, r in enumerate(rows)], "code bigint, item string, records bigint")
    else:
        cells = _numbered(sets, items).select("items").mapInArrow(partial(_gram, dictionary=None), schema)
        named = items
    gram = cells.groupBy("a", "b").agg(F.sum("together").alias("together"))
    for k in "ab":
        side = named.select(F.col("code").alias(k), F.col("item").alias(f"item_{k}"), F.col("records").alias(f"records_{k}"))
        if small:
            gram = gram.join(F.broadcast(side), k)
        else:  # an item may pair with every other: its partners are counted, hot ones split
            gram = durable(gram)
            partners = gram.groupBy(k).agg(F.count("*").alias("_pairs"))
            gram = lookup_skewed(gram, durable(side.join(partners, k)), [k], "_pairs").drop("_pairs")
    above = F.col("together").cast("double") * n / (F.col("records_a").cast("double") * F.col("records_b"))
    return gram.select("item_a", "item_b", "together", "records_a", "records_b", above.alias("lift")), n


def frequent_pairs(pairs: DataFrame, n: int, least: int = 8, share: int = 1000, lift: int = 20) -> DataFrame:
    """The pairs together in at least ``least`` baskets and 1/``share`` of all, at ``lift`` times chance or more; exact integers."""
    above = F.col("together").cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)") >= F.lit(lift).cast("decimal(4,0)") * (
        F.col("records_a").cast("decimal(16,0)") * F.col("records_b").cast("decimal(16,0)")
    ).cast("decimal(33,0)")
    return pairs.filter((F.col("together") >= least) & (F.col("together") * share >= F.lit(n)) & above)

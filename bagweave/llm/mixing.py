"""Mixing sources to target weights (problem 9).

Method: each source is a permuted stream of its distinct texts, repeated up to its cap, cut into blocks of equal
token length. A multivariate-hypergeometric splitting tree parts the exact block quotas of the sources among the
output shards; each shard then draws disjoint blocks of the permuted streams and shuffles its rows locally. Shards grow
in number with the tokens, not in size: the driver parts the tree down to SUBTREES nodes, tasks part those further.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, durable, hash_unit
from .encode import TOKENIZERS, VOCABULARY, token_count

#: Tokens a block aims at, and blocks per shard, about.
BLOCK_TOKENS = 20_000
SHARD_BLOCKS = 16
#: Nodes of the splitting tree that the driver makes at most.
SUBTREES = 4096
#: Buckets of a source's permuted stream for the two-level running sum.
BUCKETS = 4096
#: Rows of the target table at most; it is read by the driver.
MAX_SOURCES = 10_000


def _parted(a: int, b: int, have: np.ndarray, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """The two halves of a node of the tree: shards a to b with blocks ``have`` of each source."""
    mid = (a + b) // 2
    size = int(have.sum()) * (mid - a) // (b - a)
    left = np.random.default_rng((seed, a, b)).multivariate_hypergeometric(have, size, method="marginals") if size else np.zeros_like(have)
    return [(a, mid, left), (mid, b, have - left)]


def split_quotas(counts: np.ndarray, shards: int, seed: int, first: int = 0, width: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """(shard, shard behind, blocks of each source) from ``first`` on, in order, parted down to ``width`` shards or fewer.

    Blocks sum to ``counts``; shards differ by one block or so. A node depends on its own quotas alone, so any
    subtree can be parted elsewhere.
    """
    out, todo = [], [(first, first + shards, np.asarray(counts, np.int64))]
    while todo:
        node = todo.pop()
        if node[1] - node[0] <= width:
            out.append(node)
        else:
            todo += reversed(_parted(*node, seed))
    return out


def _shard_ranges(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Subtrees (a, b, have, base) to (k, shard, start, blocks): the blocks of source k that a shard draws, by permuted number."""
    for batch in batches:
        for row in batch.to_pylist():
            start = np.array(row["base"], np.int64)
            columns = {"k": [], "shard": [], "start": [], "blocks": []}
            for shard, _, have in split_quotas(np.array(row["have"], np.int64), row["b"] - row["a"], seed, row["a"]):
                for k in np.flatnonzero(have):
                    for name, v in zip(columns, (int(k), shard, int(start[k]), int(have[k]))):
                        columns[name].append(v)
                start += have
            yield pa.record_batch([pa.array(v, pa.int64()) for v in columns.values()], names=list(columns))


def distinct_texts(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens): one row per distinct text of a target source, of the smallest doc_id.

    A text that stands in several sources belongs to the source of its smallest doc_id, so that no cap is passed by
    using it twice. Empty and null texts and sources without a target are left out.
    """
    there = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").filter("text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL")
    counted = there.select(F.sha2("text", 256).alias("k"), "doc_id", "source", token_count(F.col("text"), vocabulary, folder).cast("bigint").alias("tokens"))
    first = counted.groupBy("k").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d"))  # no text is shuffled
    return first.select("d.doc_id", "d.source", "d.tokens").filter("tokens > 0")


class Mixture:
    """The plan of a mixture; ``rows`` and ``shares`` are lazily made from it."""

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 42, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS):
        spark = documents.sparkSession
        self.spark, self.seed = spark, seed
        listed = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
        if len(listed) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.units = durable(distinct_texts(documents, targets, vocabulary, folder))
        have = {r.source: r for r in self.units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts")).collect()}
        # a source without any text can have no share: the others are scaled up, and the report shows it with 0
        self.listed = {r.source: (float(r.target_share), int(r.max_repeats)) for r in listed}
        usable = {s: v for s, v in self.listed.items() if s in have}
        whole = sum(v[0] for v in usable.values())
        self.tokens = {s: int(have[s].tokens) for s in usable}
        self.total = min((self.tokens[s] * cap * whole / share for s, (share, cap) in usable.items()), default=0.0)
        self.quota = {s: self.total * share / whole for s, (share, _) in usable.items()}
        self.sources = sorted(usable)
        self.blocks = {s: max(1, round(self.quota[s] / BLOCK_TOKENS)) for s in self.sources}
        self.rows = self._rows() if self.sources else spark.createDataFrame([], "shard bigint, position bigint, doc_id bigint, source string, repeat int, tokens bigint")

    def _stream(self) -> DataFrame:
        """Each text with the token offset at which it begins in its source's permuted stream; two-level running sums."""
        u = hash_unit(str(self.seed), F.col("doc_id"))
        placed = self.units.withColumn("u", u).withColumn("bucket", F.floor(F.col("u") * BUCKETS).cast("int"))
        sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
        before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        bases = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # BUCKETS rows a source
        within = W.partitionBy("source", "bucket").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, -1)
        offset = placed.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        return offset.join(bases, ["source", "bucket"]).select("doc_id", "source", "tokens", "u", (F.col("base") + F.col("inner")).alias("start"))

    def _rows(self) -> DataFrame:
        steps = [self._step(k) for k in range(len(self.sources))]
        plan = [(k, s, self.tokens[s], float(self.quota[s]), self.blocks[s], self.listed[s][1], *steps[k]) for k, s in enumerate(self.sources)]
        plans = F.broadcast(self.spark.createDataFrame(plan, "k bigint, source string, stream bigint, quota double, blocks bigint, cap int, step bigint, shift bigint"))
        # a text is used in round k if its middle lies before the quota; rounds never exceed the cap
        middle = F.col("start") + F.col("tokens") / 2
        uses = F.least(F.col("cap").cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("quota") - middle) / F.col("stream"))))
        used = self._stream().join(plans, "source").withColumn("uses", uses).filter("uses > 0")
        drawn = used.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
        at = (F.col("start") + (F.col("repeat") - 1) * F.col("stream")) / (F.col("quota") / F.col("blocks"))
        block = F.least(F.floor(at).cast("bigint"), F.col("blocks") - 1)
        drawn = drawn.withColumn("block", F.pmod(block * F.col("step") + F.col("shift"), F.col("blocks")))
        ordered = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed), "doc_id", "repeat"), "doc_id", "repeat")
        placed = drawn.join(broadcast_if_small(self._shards()), ["k", "block"])
        return placed.select("shard", F.row_number().over(ordered).cast("bigint").alias("position"), "doc_id", "source", "repeat", "tokens")

    def _step(self, k: int) -> tuple[int, int]:
        """(step, shift): block b of source k gets the permuted number (b * step + shift) mod blocks, a bijection."""
        n = self.blocks[self.sources[k]]
        rng = np.random.default_rng((self.seed, k))
        step = int(rng.integers(1, max(2, min(n, (1 << 62) // n))))
        while math.gcd(step, n) != 1:
            step += 1
        return step, int(rng.integers(0, n))

    def _shards(self) -> DataFrame:
        """(k, block, shard): the shard of each permuted block of source k, quotas by the splitting tree."""
        counts = np.array([self.blocks[s] for s in self.sources])
        shards = max(1, math.ceil(int(counts.sum()) / SHARD_BLOCKS))
        base, rows = np.zeros(len(counts), np.int64), []
        for a, b, have in split_quotas(counts, shards, self.seed, width=-(-shards // (SUBTREES // 2))):
            rows.append((a, b, have.tolist(), base.tolist()))
            base = base + have
        trees = self.spark.createDataFrame(rows, "a bigint, b bigint, have array<bigint>, base array<bigint>")
        ranges = trees.mapInArrow(partial(_shard_ranges, seed=self.seed), "k bigint, shard bigint, start bigint, blocks bigint")
        return ranges.select("k", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1)).alias("block"), "shard")

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, texts, uses, most_repeats) of every listed source.

        A source's tokens differ from its quota by half of its longest text at most."""
        per = self.rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"), F.count("*").alias("uses"), F.max("repeat").alias("most_repeats"))
        total = per.agg(F.sum("tokens").alias("all"))
        listed = self.spark.createDataFrame([(s, v[0]) for s, v in self.listed.items()] or [], "source string, target_share double")
        joined = listed.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        share = F.coalesce(F.try_divide(F.col("tokens"), F.col("all")), F.lit(0.0)).alias("actual_share")
        return joined.select("source", "target_share", share, zero("tokens"), zero("texts"), zero("uses"), zero("most_repeats"))

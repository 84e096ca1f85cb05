"""Vector operators: nearest neighbours, label means, and embeddings of tokens and token texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..runtime import durable

#: Rows of a block of the all-pairs product.
BLOCK = 2048


def nearest(table: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, neighbour, similarity, rank): the k most similar others of each row, exact, by cosine; ties by key.

    Queries and candidates are cut into blocks; a task multiplies one pair of blocks and keeps k per query, and the
    partial lists are merged. Work is n^2 by nature; each pair of blocks is an own, bounded task unit.
    """
    unit = durable(table.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), v.normalized(F.col(vector)).alias("x")))
    n = max(1, unit.count())
    blocks = -(-n // BLOCK)
    numbered = unit.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = durable(numbered.groupBy("b").agg(F.collect_list(F.struct("id", "x")).alias("rows")))  # BLOCK rows, about
    left = packed.select(F.col("b").alias("qb"), F.col("rows").alias("q")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = left.join(packed.select(F.col("b").alias("cb"), F.col("rows").alias("c")), "cb").select("q", "c")
    return _best(pairs, k).withColumnRenamed("id", key)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar of each query over block pairs (q, c) of arrays of (id, x)."""
    found = pairs.select("q", "c").mapInArrow(partial(_multiply, k=k), "id bigint, neighbour bigint, similarity double")
    best = W.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _multiply(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for q, c in zip(batch.column("q"), batch.column("c")):
            (qi, qx), (ci, cx) = (_unpack(x) for x in (q, c))
            sim = qx @ cx.T
            sim[qi[:, None] == ci[None, :]] = -np.inf
            m = min(k, sim.shape[1])
            if m < sim.shape[1]:  # the k-th value decides; all ties at it stay, the merge orders them
                kth = -np.partition(-sim, m - 1, axis=1)[:, m - 1 : m]
            else:
                kth = np.full((len(qi), 1), -np.inf)
            r, col = np.nonzero((sim >= kth) & (sim > -np.inf))
            yield pa.record_batch([pa.array(qi[r]), pa.array(ci[col]), pa.array(sim[r, col])], names=["id", "neighbour", "similarity"])


#: Vectors that cells are fitted on at most, cells at most, rounds of the fit, and cells a query looks into.
FIT_VECTORS, MAX_CELLS, FIT_ROUNDS, PROBES = 20_000, 4096, 8, 16


def cell_centres(unit: DataFrame, n: int, cells: int | None = None, sample: int = FIT_VECTORS) -> np.ndarray:
    """Centres of about sqrt(n) cells of unit vectors (id, x), by spherical k-means on a bounded, hashed sample.

    All vectors are then indexed; only the places of the centres come from the sample.
    """
    share = min(1.0, 2.0 * sample / max(1, n))
    some = unit.filter(F.pmod(F.xxhash64(F.lit("cells"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = some.orderBy(F.xxhash64(F.lit("cells"), "id"), "id").limit(sample).collect()
    x = np.array([r.x for r in rows], np.float64)
    count = min(len(x), cells or min(MAX_CELLS, max(1, round(n**0.5))))
    centres = x[:count]
    for _ in range(FIT_ROUNDS if count else 0):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def nearest_approximate(table: DataFrame, queries: DataFrame, key: str, vector: str, k: int, probes: int = PROBES, cells: int | None = None) -> DataFrame:
    """(key, neighbour, similarity, rank) for (key, vector) ``queries`` against the whole ``table``: by inverted cells.

    Every vector goes to its nearest centre's cell, and a query is compared with the rows of its ``probes`` nearest
    cells: n * probes / cells comparisons instead of n. A cell is cut into blocks of BLOCK rows, about, so one that
    holds a third of all rows is many tasks. Similarities are exact; a neighbour in a cell that isn't looked into is
    missed. Null vectors have no neighbours and are none.
    """
    unit = durable(table.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), v.normalized(F.col(vector)).alias("x")))
    n = unit.count()
    centres = cell_centres(unit, n, cells)
    if not len(centres):
        return table.select(F.col(key), F.lit(0).cast("bigint").alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    placed = durable(_in_cells(unit, centres, 1))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # a row per centre
    blocks = placed.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("b")).agg(F.collect_list(F.struct("id", "x")).alias("c"))
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), v.normalized(F.col(vector)).alias("x"))
    asked = _in_cells(asked, centres, min(probes, len(centres)))
    of_cell = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    packed = asked.join(F.broadcast(of_cell), "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("qb")).agg(F.collect_list(F.struct("id", "x")).alias("q"))
    return _best(packed.join(blocks, "cell"), k).withColumnRenamed("id", key)


def _in_cells(unit: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, x, cell), one row for each of the ``probes`` nearest cells of a vector."""
    shared = unit.sparkSession.sparkContext.broadcast(centres)  # MAX_CELLS vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            near = np.argsort(-(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) @ shared.value.T), axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(len(lists)), near.shape[1])
            yield pa.record_batch([batch.column("id").take(pa.array(rows)), lists.take(pa.array(rows)), pa.array(near.ravel().astype(np.int32))], names=["id", "x", "cell"])

    return unit.select("id", "x").mapInArrow(place, "id bigint, x array<double>, cell int")


def _unpack(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    s = rows.values
    x = s.field("x")
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return s.field("id").to_numpy(zero_copy_only=False), flat.reshape(len(s), -1)


def mean_vectors(rows: DataFrame, group: list[str], vector: str) -> DataFrame:
    """(group, mean): the mean by dimension, pre-aggregated; vectors have one width, null ones are left out.

    One aggregate with a column per dimension: vectors are not taken apart into rows.
    """
    there = rows.filter(F.col(vector).isNotNull())
    first = there.select(F.size(vector).alias("n")).limit(1).collect()
    if not first or first[0].n == 0:
        return there.select(*group, F.array().cast("array<double>").alias("mean")).distinct()
    flat = there.select(*group, v.doubles(F.col(vector)).alias("_x"))
    dims = [f"_m{d}" for d in range(first[0].n)]
    return flat.groupBy(*group).agg(*[F.avg(F.get("_x", F.lit(d))).alias(n) for d, n in enumerate(dims)]).select(*group, F.array(*dims).alias("mean"))


def token_embeddings(rows: DataFrame) -> DataFrame:
    """(token, embedding) from (tokens, vector): the mean over rows that hold the token, normalised, centred, normalised."""
    held = rows.select(F.explode(F.array_distinct("tokens")).alias("token"), "vector")
    unit = durable(mean_vectors(held, ["token"], "vector").select("token", v.normalized(F.col("mean")).alias("u")))
    centre = mean_vectors(unit.withColumn("all", F.lit(1)), ["all"], "u").select(F.col("mean").alias("centre"))
    centred = unit.crossJoin(F.broadcast(centre))  # one row
    return centred.select("token", v.normalized(F.zip_with("u", "centre", lambda a, b: a - b)).alias("embedding"))


def text_embeddings(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, embedding) of (key, tokens): the normalised mean of known tokens, with repeats; null if none is known."""
    flat = rows.select(key, F.explode("tokens").alias("token")).join(table, "token")
    made = mean_vectors(flat, [key], "embedding").select(key, v.normalized(F.col("mean")).alias("embedding"))
    return rows.select(key).join(made, key, "left")


def encoded_texts(rows: DataFrame, key: str, text: str, make) -> DataFrame:
    """(key, embedding) by any encoder: ``make`` builds a function from a list of texts to vectors, once per task."""

    def run(batches):
        f = make()
        for pdf in batches:
            yield pdf[[key]].assign(embedding=[list(map(float, x)) for x in f(pdf[text].fillna("").tolist())])

    return rows.select(key, text).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, embedding array<float>")

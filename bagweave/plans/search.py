"""Queries of the vector search: every vector whose id divides by 20 against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import semantic
from ..runtime import table
from .queries import _UNIT, query, r6

_EXACT = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, neighbour) AS rank FROM
    (SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.u, b.u) AS similarity FROM {_UNIT} a JOIN {_UNIT} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 5)"""


def _asked(spark, d):
    return table(spark, d, "embeddings").filter(F.col("vec_id") % 20 == 0)


@query()
def knn_search(spark, d):
    """Approximate neighbours by inverted cells; its recall is gated by knn_search_recall."""
    return semantic.nearest_approximate(table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "embedding", 5).select("vec_id", "neighbour", *r6("similarity"), "rank")


@query(f"SELECT count(*) AS wanted, true AS recall_reached FROM {_EXACT}")
def knn_search_recall(spark, d):
    """Whether the approximate search finds 0.9 of the exact neighbours of all queries or more."""
    every = table(spark, d, "embeddings")
    exact = semantic.nearest(every, "vec_id", "embedding", 5).filter(F.col("vec_id") % 20 == 0)
    found = semantic.nearest_approximate(every, _asked(spark, d), "vec_id", "embedding", 5).select("vec_id", "neighbour", F.lit(1).alias("there"))
    both = exact.join(found, ["vec_id", "neighbour"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.count("there") >= 0.9 * F.count("*")).alias("recall_reached"))

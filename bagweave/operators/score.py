"""Scored samples to summaries and curves. Tokens are made once; metrics take the arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bags, vectors
from .corpus import top_per_group


def mean0(c: Column | str) -> Column:
    """The mean with missing values as 0; NaN over no rows."""
    return F.coalesce(F.avg(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))), F.lit(float("nan")))


def mean_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def scored_pairs(pairs: DataFrame, prediction: str = "p", target: str = "t") -> DataFrame:
    """``pairs`` with every metric of two token-array columns.

    In steps, each of which names what the next one uses: the overlap is found once a row and the rest stays in
    generated code, which the one-expression form ``bags.bag_metrics`` can't.
    """
    p, t, both = F.col(prediction), F.col(target), F.col("_both")
    base = pairs.withColumn("_both", bags.overlap(p, t))
    base = base.withColumns({
        "bag_precision": bags.precision(p, t, both), "bag_recall": bags.recall(p, t, both), "bag_jaccard": bags.bag_jaccard(p, t, both), "set_jaccard": bags.set_jaccard(p, t),
        "length_score": bags.length_score(p, t), "exact_bag_match": bags.exact_bag(p, t), "exact_sequence_match": bags.exact_sequence(p, t),
        "prediction_len": F.coalesce(F.size(p), F.lit(0)), "target_len": F.coalesce(F.size(t), F.lit(0)),
    })
    base = base.withColumn("bag_f1", bags.f1(F.col("bag_precision"), F.col("bag_recall")))
    return base.withColumn("benchmark_score", bags.benchmark_score(*map(F.col, ("bag_f1", "bag_jaccard", "set_jaccard", "length_score")))).drop("_both")


METRICS = ("benchmark_score", "bag_f1", "bag_precision", "bag_recall", "bag_jaccard", "set_jaccard", "length_score", "exact_bag_match", "exact_sequence_match", "prediction_len", "target_len")


def scored_references(pairs: DataFrame, key: str, prediction: str = "p", references: str = "refs") -> DataFrame:
    """(key, metrics, reference): the metrics against the best of each row's references, and its 0-based index.

    The rule is that of ``bags.best_reference``. References become rows, as their metrics then run in generated code;
    all rows of a key come from one row, so the best is found before the shuffle.
    """
    refs = F.filter(F.transform(references, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda x: F.size(x["r"]) > 0)
    rows = pairs.select(key, prediction, F.explode_outer(refs).alias("_x"))
    rows = rows.select(key, prediction, F.coalesce(F.col("_x.i"), F.lit(-1)).alias("reference"), F.coalesce(F.col("_x.r"), F.array().cast("array<string>")).alias("_t"))
    scored = scored_pairs(rows, prediction, "_t")
    rank = F.struct("benchmark_score", "bag_f1", "bag_jaccard", -F.col("reference"))
    best = scored.groupBy(key).agg(F.max_by(F.struct("reference", *METRICS), rank).alias("_m"))
    return best.select(key, "_m.*")


def with_all_bucket(rows: DataFrame, column: str) -> DataFrame:
    """Every row once under its own bucket and once under 'all'."""
    return rows.withColumn(column, F.explode(F.array(F.coalesce(F.col(column), F.lit("unknown")), F.lit("all"))))


def curves(rows: DataFrame, group: list[str], problem: list[str], order: list[str], best: dict[str, str], passes: dict[str, Column], max_k: int) -> DataFrame:
    """Per group and k: the mean over problems of the running best of the first k samples.

    ``best``: output name to metric (its largest); ``passes``: output name to condition (any). A problem with fewer
    than k samples counts with all it has. k runs to the largest problem of the group, ``max_k`` at most. Only the
    first ``max_k`` samples of a problem matter, and they are found in two levels, so a hot problem is no hot task.
    """
    keys = [*group, *problem]
    values = [F.coalesce(F.col(m), F.lit(0.0)).alias(n) for n, m in best.items()] + [F.coalesce(c, F.lit(False)).cast("double").alias(n) for n, c in passes.items()]
    first = top_per_group(rows.select(*keys, *order, *values), keys, [F.col(o) for o in order], max_k)
    w = W.partitionBy(*keys)
    run = w.orderBy("rn").rowsBetween(W.unboundedPreceding, W.currentRow)
    names = [*best, *passes]
    r = first.select(*keys, "rn", F.count("*").over(w).alias("n"), *[F.max(n).over(run).alias(n) for n in names])
    ends = r.withColumn("k", F.explode(F.when(F.col("rn") < F.col("n"), F.array("rn")).otherwise(F.sequence(F.col("rn"), F.greatest(F.col("rn"), F.lit(max_k))))))
    out = ends.groupBy(*group, "k").agg(*[F.avg(n).alias(n) for n in names], F.max("n").alias("_n"), F.count("*").alias("problems"))
    return out.withColumn("_n", F.max("_n").over(W.partitionBy(*group))).filter(F.col("k") <= F.col("_n")).drop("_n")


def first_and_best(rows: DataFrame, problem: list[str], order: str, score: str) -> DataFrame:
    """One row per problem: struct ``first`` (lowest order) and ``best`` (highest score, the first of equals).

    Both are pre-aggregated min/max of structs, so no window is needed.
    """
    body = F.struct(*[c for c in rows.columns if c not in problem])
    return rows.groupBy(*problem).agg(
        F.min_by(body, F.col(order)).alias("first"),
        F.max_by(body, F.struct(F.col(score), -F.col(order))).alias("best"),
        F.count("*").alias("samples"),
    )


#: Limits under which a reply passes by meaning.
COSINE_PASS, GEODESIC_PASS, L2_PASS = 0.65, 0.28, 0.84


def with_semantic_distances(rows: DataFrame, cosine: str = "semantic_target_cosine", geodesic: str = "semantic_geodesic_distance", l2: str = "semantic_embedding_distance") -> DataFrame:
    """Missing distances made from the cosine; those that are there stay. A missing cosine makes none."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    if cosine not in rows.columns:
        return rows
    return rows.withColumn(geodesic, F.coalesce(have(geodesic), vectors.geodesic(F.col(cosine)))).withColumn(l2, F.coalesce(have(l2), vectors.l2_of_cosine(F.col(cosine))))


def semantic_passes(cosine: str = "semantic_target_cosine", geodesic: str = "semantic_geodesic_distance", l2: str = "semantic_embedding_distance") -> dict[str, Column]:
    """Conditions for ``curves``: near enough by cosine, by angle and by distance."""
    return {"pass_semantic": F.col(cosine) >= COSINE_PASS, "pass_geodesic": F.col(geodesic) <= GEODESIC_PASS, "pass_l2": F.col(l2) <= L2_PASS}


def sample_summary(rows: DataFrame, group: list[str], problem: str, order: str, stability: DataFrame) -> DataFrame:
    """Per group: first and best sample means, copy rates, the share of problems with an exact bag, stability.

    ``rows`` hold the metrics, copy_rate and invalid_text_ratio; ``stability`` is (group, problem, stability) of the
    problems it applies to. Without any, the mean is NaN, the count 0 and the status 'not_applicable'. ``best_all_*``
    take all samples of a problem, however many.
    """
    kept = [*group, problem, order, "benchmark_score", "bag_f1", "bag_jaccard", "exact_bag_match", "copy_rate"]
    per = first_and_best(rows.select(*kept), [*group, problem], order, "benchmark_score")
    exact = rows.groupBy(*group, problem).agg(F.max("exact_bag_match").alias("any_exact"), F.sum("copy_rate").alias("copied"), F.sum("invalid_text_ratio").alias("invalid"))
    joined = per.join(exact, [*group, problem]).join(stability, [*group, problem], "left")
    means = {"first_benchmark_score": "first.benchmark_score", "first_bag_f1": "first.bag_f1", "first_bag_jaccard": "first.bag_jaccard", "first_exact_bag_match": "first.exact_bag_match", "first_copy_rate": "first.copy_rate"}
    means |= {"best_all_benchmark_score": "best.benchmark_score", "best_all_bag_f1": "best.bag_f1", "best_all_bag_jaccard": "best.bag_jaccard", "best_all_copy_rate": "best.copy_rate", "pass_all_exact_bag": "any_exact"}
    n = F.count("stability")
    return joined.groupBy(*group).agg(
        F.count("*").alias("problems"), F.sum("samples").alias("samples"), *[F.avg(c).alias(k) for k, c in means.items()],
        (F.sum("copied") / F.sum("samples")).alias("mean_copy_rate"), (F.sum("invalid") / F.sum("samples")).alias("invalid_text_ratio"),
        F.coalesce(F.avg("stability"), F.lit(float("nan"))).alias("permutation_stability"), n.alias("permutation_stability_n"), F.when(n > 0, "ok").otherwise("not_applicable").alias("permutation_stability_status"),
    )

"""The text kernels run once over every row: no plan has one twice, and none below a repartition."""

import pytest
from pyspark.sql import functions as F

from bagweave.llm import duplicates
from bagweave.llm.columns import changed, emoji_of, term_counts

VOCAB = ("❤️", "😀")


@pytest.mark.parametrize("kernel", ["changed", "emoji_of", "term_counts", "digest"])
def test_a_kernel_runs_once_and_above_the_repartition(spark, kernel):
    rows = spark.createDataFrame([(k, "😀 a", "b ❤") for k in range(20)], "row_id bigint, input string, output string").repartition(3)
    made = {
        "changed": lambda: changed(VOCAB, F.col("output")), "emoji_of": lambda: emoji_of(VOCAB, F.col("input"), F.col("output")),
        "term_counts": lambda: term_counts(VOCAB, F.col("input"), F.col("output")), "digest": lambda: duplicates.record_digest(VOCAB, F.col("input"), F.col("output")),
    }[kernel]()
    df = rows.select("row_id", made.alias("x")).filter("x IS NOT NULL")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Exchange RoundRobin")
    assert df.count() == 20


def test_distinct_values_of_a_batch_are_mapped_alike(spark):
    rows = spark.createDataFrame([(k, [None, "", "❤", "a ❤", "❤️"][k % 5]) for k in range(400)], "k int, s string").coalesce(1)
    got = {r.k: r.f for r in rows.select("k", changed(VOCAB, F.col("s")).alias("f")).collect()}
    assert got == {k: [None, None, "❤️", "a ❤️", None][k % 5] for k in range(400)}

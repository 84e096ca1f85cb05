"""Incremental patterns on Structured Streaming: metric state, append logs with resume, resumable order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import remaining_tasks
from ..runtime import shared_folder


def metric_states(stream: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """Running (weighted_sum, weight) per key: the state of a weighted mean, mergeable and resettable per epoch."""
    return stream.groupBy(*key).agg(F.sum(F.col(value) * F.col(weight)).alias("weighted_sum"), F.sum(weight).alias("weight"))


def finished(states: DataFrame) -> DataFrame:
    """Mean, bits per dimension and perplexity of metric states."""
    mean = F.try_divide("weighted_sum", "weight")
    return states.withColumns({"nll": mean, "bpd": mean / F.log(F.lit(2.0)), "ppl": F.exp(mean)})


def metric_state_from_files(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """The metric state of an event file, run through a stream to its end: sums of value per event type."""
    schema = spark.read.parquet(path).schema
    source, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(source)
    states = metric_states(stream.withColumn("one", F.lit(1.0)), ["event_type"], "value", "one")
    out = folder or _shared(spark)

    def keep(batch: DataFrame, number: int) -> None:  # each batch has its own table: a failed one leaves the last whole
        batch.write.mode("overwrite").parquet(f"{out}/state/{number:012d}")

    run = states.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return finished(spark.read.schema(f"{_types(states)}").parquet(latest_state(spark, f"{out}/state")))


def _types(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def latest_state(spark: SparkSession, folder: str) -> str:
    """The newest table of ``folder`` that was written to its end."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [str(s.getPath()) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(whole)


def _shared(spark: SparkSession) -> str:
    """A fresh folder under the session's shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def append_missing(tasks: DataFrame, log_path: str, key: list[str], work) -> DataFrame:
    """Run ``work`` on the tasks that the append log doesn't hold yet and append the results; returns the log."""
    spark = tasks.sparkSession
    try:
        done = spark.read.parquet(log_path)
        todo = remaining_tasks(tasks, done, key)
    except Exception as e:  # noqa: BLE001 - the log doesn't exist before the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = tasks
    work(todo).write.mode("append").parquet(log_path)
    return spark.read.parquet(log_path)


def score_stream(stream: DataFrame, score, sink: str, checkpoint: str, trigger: dict | None = None):
    """Score a stream of samples by ``score`` (a DataFrame function) and append to ``sink``, exactly once by batch."""
    return score(stream).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

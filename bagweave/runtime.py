"""Session-level helpers: table access, durable checkpoints, size-checked broadcasts, skew-proof lookups."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast; beyond either, joins shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: A key holding at least 1/HOT_SHARE of all rows is hot; so at most HOT_SHARE keys are hot, whatever the data.
HOT_SHARE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset in a local session (tests) a
    temporary one is used. Lost executors don't matter: the files are on shared storage.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data: the session's setting, or a temporary one where that is unset.

    Off a single machine a temporary folder would be the driver's own disk, so there it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="bagweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Rounds:
    """Tables of an iteration, written to the shared folder: all of a round go once the next one is there.

    Unlike a checkpoint, a table read back carries no constraints of the plan that made it; over the rounds those
    would multiply.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        self.now: list[str] = []
        self.before: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.now.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def next(self) -> None:
        """A new round begins: what the round before the last one wrote is deleted."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.before:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.before, self.now = self.now, []


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row.

    Only an input of fewer partitions than cores (a single small file) is moved; large scans stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is counted to hold at most ``rows`` rows and ``size`` bytes (of its values as JSON).

    This runs the plan of ``df`` once, up to that many rows.
    """
    told = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return told.n <= rows and (told.b or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted small, by rows and by bytes, else unhinted."""
    return F.broadcast(df) if is_small(df, rows) else df


def lookup_skewed(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``keyed`` (unique on ``keys``, ``size`` = rows of that key) without one task per hot key.

    Keys that hold 1/HOT_SHARE of the rows or more are at most HOT_SHARE many: that part of ``keyed`` is
    broadcast and its rows never shuffle. All other keys join by a shuffle whose groups are bounded.
    Null keys match nothing. ``how``: 'inner' or 'left'.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    least = max(2.0, total / HOT_SHARE)
    hot = keyed.filter(F.col(size) >= least)
    cold = keyed.filter(F.col(size) < least)
    if total == 0 or hot.limit(1).count() == 0:
        return rows.join(keyed, keys, how)
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    one = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), keys, "inner")
    two = marked.filter("_hot IS NULL").drop("_hot").join(cold, keys, how)
    return one.unionByName(two)


def hash_unit(*parts: Column | str) -> Column:
    """A uniform double in [0, 1) from the SHA-1 of the parts joined by ':'; the same on every engine."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha1(text), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)

"""Sources: JSON lines with schemas and ordinals, files by extension, corpora by name, labelled inputs, caches."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import alias
from ..operators.corpus import tail_slice, union_sources, with_global_index
from ..runtime import hash_unit


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row per JSON line; blank lines are skipped, missing keys are null."""
    return spark.read.schema(schema).json(path)


def json_lines_with_ordinal(spark: SparkSession, path: str, schema: T.StructType | str, name: str = "source_index") -> DataFrame:
    """As ``json_lines``, with the 0-based physical line number within all files in path order; blank lines count.

    Lines are numbered by file and offset in two levels, not by a single task.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"))
    numbered = with_global_index(lines, ["_file", "_block", "_m"], name)
    return numbered.filter(F.trim("value") != "").select(F.col(name).cast("bigint").alias(name), F.from_json("value", kind).alias("r")).select(name, "r.*")


def by_extension(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """.json and .jsonl as JSON lines, .csv, .tsv and .txt (tab-separated) with a header; else ValueError."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if ext in (".json", ".jsonl"):
        return reader.json(path)
    if ext in (".csv", ".tsv", ".txt"):
        return reader.csv(path, header=True, sep="," if ext == ".csv" else "\t", quote='"', escape='"', multiLine=False)
    if ext == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"can't tell how to read {path!r}: use .json, .jsonl, .csv, .tsv, .txt or .parquet")


def harvested_strings(df: DataFrame, names=alias.HARVEST) -> DataFrame:
    """(field, text): every non-null value of any of the aliases, one row each."""
    there = [n for n in names if n in df.columns]
    if not there:
        return df.sparkSession.createDataFrame([], "field string, text string")
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("text")) for n in there])
    return df.select(F.explode(each).alias("x")).select("x.*").filter("text IS NOT NULL")


def harvested_file(spark: SparkSession, path: str, names=alias.HARVEST) -> DataFrame:
    """(field, text) of every string in a file: JSON lines, one JSON document, or plain lines.

    Rows of JSON are objects, of which the aliases are taken, or plain values (field null). A document is a list of
    rows, or an object with the rows under 'data' or 'rows', else as its values; it is one value by nature and is
    parsed in one task. Blank lines of other files are left out, others are stripped. Null values give nothing.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in (".json", ".jsonl"):
        lines = spark.read.text(path).select(F.lit(None).cast("string").alias("field"), F.trim("value").alias("text"))
        return lines.filter("text <> ''")

    def rows_of(payload):
        if isinstance(payload, dict):
            payload = payload.get("data", payload.get("rows", payload))
            payload = list(payload.values()) if isinstance(payload, dict) else payload
        return payload if isinstance(payload, list) else [payload]

    def parse(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                loaded = json.loads(content)
                for row in [loaded] if ext == ".jsonl" else rows_of(loaded):
                    pairs = [(n, row[n]) for n in names if n in row] if isinstance(row, dict) else [(None, row)]
                    out += [(n, str(v)) for n, v in pairs if v is not None]
            yield pd.DataFrame(out, columns=["field", "text"])

    if ext == ".jsonl":
        content = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("content"))
    else:
        content = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("content"))
    return content.mapInPandas(parse, "field string, text string")


class Corpora:
    """A registry of named corpora: each name is a loader from (spark, root) to its splits."""

    def __init__(self):
        self._loaders: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {}

    def register(self, name: str, load: Callable[[SparkSession, str], dict[str, DataFrame]]) -> None:
        self._loaders[name] = load

    def files(self, name: str, **splits: str) -> None:
        """A corpus whose splits are files under the root."""
        self.register(name, lambda spark, root: {s: by_extension(spark, f"{root}/{p}") for s, p in splits.items()})

    def load(self, spark: SparkSession, name: str, root: str) -> dict[str, DataFrame]:
        """The splits of a corpus; an unknown name is a folder of splits, or a parquet table, of that name."""
        if name in self._loaders:
            return self._loaders[name](spark, root)
        splits = {n: f"{root}/{name}/{n}.jsonl" for n in ("train", "validation", "test")}
        there = {n: spark.read.json(path) for n, path in splits.items() if exists(spark, path)}
        return there or {"train": spark.read.parquet(f"{root}/{name}.parquet")}


#: Registered names of public corpora; their files are looked for under the root that is given.
CORPORA = Corpora()
for _name in ("wikitext2", "wikitext103", "ptb", "ag_news", "scientific_papers_arxiv", "scientific_papers_pubmed"):
    CORPORA.files(_name, train=f"{_name}/train.jsonl", validation=f"{_name}/validation.jsonl", test=f"{_name}/test.jsonl")
CORPORA.files("lambada", test="lambada/test.jsonl")
for _name in ("openwebtext", "text2emoji", "emoji_reply"):
    CORPORA.files(_name, train=f"{_name}/train.jsonl")


#: Rows at the end of openwebtext that are its validation part, the validation share of text2emoji, and text8's sizes.
WEB_TAIL, EMOJI_SHARE, TEXT8_SIZES = 100_000, 0.01, (90_000_000, 5_000_000)


def _web(part: int):
    def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
        rows = json_lines_with_ordinal(spark, f"{root}/openwebtext/train.jsonl", "text string")
        return {("train", "validation")[part]: tail_slice(rows, ["source_index"], WEB_TAIL)[part].drop("idx")}

    return load


def _text2emoji(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    rows = json_lines_with_ordinal(spark, f"{root}/text2emoji/train.jsonl", "text string, emoji string, topic string")
    held = hash_unit("42", F.col("source_index")) < EMOJI_SHARE
    return {"train": rows.filter(~held), "validation": rows.filter(held)}


def _text8(chunk: int):
    def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
        parts = zipped_text(spark, f"{root}/text8/text8.zip", TEXT8_SIZES, chunk)
        return {n: parts.filter(F.col("split") == k).drop("split") for k, n in enumerate(("train", "validation", "test"))}

    return load


CORPORA.register("openwebtext-train", _web(0))
CORPORA.register("openwebtext-valid", _web(1))
CORPORA.register("text2emoji", _text2emoji)
CORPORA.register("text8", _text8(256))
CORPORA.register("text8-crop", _text8(512))  # double length: a window of each is drawn later (``noise.cropped``)


def with_challenge(rows: DataFrame, challenge: DataFrame, repeat: int = 1) -> DataFrame:
    """Training rows and a challenge set ``repeat`` times, once at least; missing columns are null."""
    return union_sources([("rows", rows, 1), ("challenge", challenge, max(1, repeat))]).drop("copy", "label")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def zipped_text(spark: SparkSession, path: str, sizes: tuple[int, ...], chunk: int, drop_last: bool = True) -> DataFrame:
    """(split, chunk, text) of a zip archive with one text file, split by code point counts and cut into chunks.

    ``sizes`` are the lengths of all splits but the last. The archive is one object by nature and is opened in one
    task; its chunks are spread from there.
    """

    def unzip(batches):
        import io
        import zipfile

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    text = z.read(z.namelist()[0]).decode("utf-8")
                start, bounds = 0, []
                for n in (*sizes, len(text)):
                    bounds.append((start, min(len(text), start + n)))
                    start = bounds[-1][1]
                rows = []
                for k, (a, b) in enumerate(bounds):
                    for i, at in enumerate(range(a, b, chunk)):
                        piece = text[at : min(b, at + chunk)]
                        if len(piece) == chunk or not drop_last:
                            rows.append((k, i, piece))
                yield pd.DataFrame(rows, columns=["split", "chunk", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "split int, chunk int, text string")


def labelled(spark: SparkSession, inputs: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """'label=path' inputs in one table with a ``model`` column; without a label the file's stem is taken."""
    out = None
    for item in inputs:
        label, _, path = item.rpartition("=")
        label = label or os.path.splitext(os.path.basename(path))[0]
        one = by_extension(spark, path, schema).withColumn("model", F.lit(label))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out


def path_fingerprint(path: str) -> str:
    """The first 12 hex digits of the path's SHA-1."""
    return hashlib.sha1(path.encode()).hexdigest()[:12]


def resolved(path: str, root: str) -> str:
    """``path``, taken from ``root`` unless absolute or a URL."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(root, path)


def cache_name(options: dict) -> str:
    """A name that is the same for the same options, whatever their order."""
    text = ";".join(f"{k}={options[k]!r}" for k in sorted(options))
    return f"{options.get('name', 'data')}-{hashlib.sha1(text.encode()).hexdigest()[:12]}"


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written there first if it isn't complete."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

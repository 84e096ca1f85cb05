"""Model inputs from a corpus: detokenize, tokenize, pack or pad, keep the model's columns, cache by the options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.detokenize import DETOKENIZERS
from ..functions.tokens import with_specials
from ..runtime import broadcast_if_small, is_small
from ..sources.readers import cache_name, cached
from . import corpus

#: Columns that a model reads; all others are left out.
MODEL_COLUMNS = ("input_ids", "attention_mask", "cond_mask")


@dataclass(frozen=True)
class Build:
    """How a corpus becomes model inputs; equal builds share one cache."""

    name: str
    text: str = "text"
    detokenizer: str | None = None
    wrap: bool = True
    block: int = 128
    bos: int = 1
    eos: int = 2
    pad: int = 0


def model_columns(df: DataFrame) -> DataFrame:
    """Only the columns that a model reads."""
    return df.select(*[c for c in df.columns if c in MODEL_COLUMNS])


def token_rows(rows: DataFrame, build: Build, encode: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``ids``: the text, detokenized if asked, by ``encode``. Null texts have no ids."""
    text = F.col(build.text)
    text = DETOKENIZERS[build.detokenizer](text) if build.detokenizer else text
    return rows.withColumn("ids", F.coalesce(encode(text), F.array().cast("array<int>")))


def wrapped(rows: DataFrame, build: Build, partition: list[str], order: list[str]) -> DataFrame:
    """Full blocks of the running ids of each partition key, an EOS behind each row; the remainder is dropped."""
    ended = rows.withColumn("ids", F.concat("ids", F.array(F.lit(build.eos))))
    return corpus.packed(ended, partition, order, build.block, build.bos, build.eos)


def filled(rows: DataFrame, build: Build) -> DataFrame:
    """``rows`` with input_ids and attention_mask of one block each: BOS, ids cut to fit, EOS, pads."""
    p = sq.padded(with_specials(F.slice("ids", 1, build.block - 2), build.bos, build.eos), build.block, build.pad)
    return rows.select("*", p["input_ids"].alias("input_ids"), p["attention_mask"].alias("attention_mask")).drop("ids")


def built(spark: SparkSession, build: Build, rows: Callable[[], DataFrame], encode: Callable[[Column], Column], folder: str, partition: list[str], order: list[str]) -> DataFrame:
    """The model inputs of ``rows``, from the cache under ``folder`` where this build is there already.

    Wrapped builds keep the partition key and block_id beside the model's columns, which give the order.
    """

    def make() -> DataFrame:
        tokens = token_rows(rows(), build, encode)
        return wrapped(tokens, build, partition, order) if build.wrap else filled(tokens, build).select(*partition, *order, "input_ids", "attention_mask")

    return cached(spark, f"{folder}/{cache_name(asdict(build))}", make)


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (total): a top-n of each task, then of these."""
    return rows.orderBy(*order).limit(n)


def first_tokens(tokens: Column, n: int) -> Column:
    """At most the first ``n`` tokens; null gives none."""
    return F.slice(F.coalesce(tokens, F.array().cast("array<string>")), 1, n)


def known_rows(rows: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """The (key, tokens) rows whose tokens are all in the vocabulary; rows without tokens are known."""
    flat = rows.select(key, F.explode(F.array_distinct("tokens")).alias("token"))
    known = vocab.select("token").filter("token IS NOT NULL").distinct()
    unknown = flat.join(F.broadcast(known) if is_small(known) else known, "token", "left_anti").select(key).distinct()
    return rows.join(broadcast_if_small(unknown), key, "left_anti")


def constant_table(spark: SparkSession, entries: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(topic, messages, pool) of topics given inline: messages and tokens of each."""
    return spark.createDataFrame([(t, list(m), list(p)) for t, (m, p) in entries.items()], "topic string, messages array<string>, pool array<string>")


def allowed(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose ``column`` is one of a few values given inline."""
    return rows.filter(F.col(column).isin(*values))

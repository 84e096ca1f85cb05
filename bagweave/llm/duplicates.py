"""Duplicates hidden by formatting (problem 1).

Method: a canonical digest per record; saturating Bloom filters (once seen, repeatedly seen) per partition, merged
segment by segment; only records whose bits are all repeatedly seen are shuffled and grouped exactly, all others
are emitted as singletons without a shuffle. Where one merged filter would pass the bound of what is sent to every
task, digests (no texts) are parted once by ranges of their hash, and the task that owns a range builds and probes its
filter; the number of jobs is the same however many ranges there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.emoji import EMOJI_CHAR
from ..runtime import durable, lookup_skewed
from . import bloom
from .columns import forms, per_value
from .forms import CLUSTER, unstable

#: Digests of one range, about, where ranges are needed: what a task holds in memory (24 bytes each).
RANGE_DIGESTS = 2_000_000

# The labels of labelled fields in a prompt.
LABELS = ("mood", "time", "place", "tone", "weather", "emoji")
_LABEL = regex.compile(rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(LABELS)})\s*[:=：＝]")
# Symbols of plain text that are punctuation in use though Unicode files them under symbols.
PUNCTUATION_SYMBOLS = "`´^~|<>=¨¯¸"
_DROP = regex.compile(rf"[\s\p{{P}}\p{{Z}}\p{{C}}{regex.escape(PUNCTUATION_SYMBOLS)}]")


def bare(text: str) -> str:
    """A text in consistent form without case, white space and punctuation; emoji stay, each set apart.

    Signs of currency, arithmetic and the like are no punctuation: C++ isn't C, nor £5 5.
    """
    if text.isascii():
        return _DROP.sub("", text).casefold()
    out, done = [], 0
    for m in unstable().finditer(text):
        out.append(_DROP.sub("", text[done : m.start()]).casefold())
        for c in CLUSTER.findall(m[0]):
            out.append(f"\x02{c}\x02" if EMOJI_CHAR.search(c) else _DROP.sub("", c).casefold())
        done = m.end()
    return "".join([*out, _DROP.sub("", text[done:]).casefold()])


def field_key(text: str) -> str:
    """The canonical form of one field: labelled parts sorted by label and value, order within a part kept."""
    marks = list(_LABEL.finditer(text))
    if not marks:
        return bare(text)
    ends = [m.start() for m in marks[1:]] + [len(text)]
    parts = sorted(m[1].casefold() + bare(text[m.end() : e]) for m, e in zip(marks, ends))
    head = bare(text[: marks[0].start()])
    return "\x1f".join([head, *parts] if head else parts)


def record_digest(vocabulary: tuple[str, ...], *fields: Column) -> Column:
    """128 bits of the canonical form of the fields together; null if any of them is blank."""

    def make():
        f = forms(vocabulary).consistent

        def one(*values):
            if any(v is None or not v.strip() for v in values):
                return None
            d = blake2b("\x1e".join(field_key(f(v)) for v in values).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            return {"hi": int.from_bytes(d[:8], "big", signed=True), "lo": int.from_bytes(d[8:], "big", signed=True)}

        return one

    return per_value("struct<hi:bigint,lo:bigint>", make)(*fields)


_MARKED = "row_id bigint, hi bigint, lo bigint, maybe boolean"


def _probe(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("maybe", pa.array(bloom.probe(shared.value, *bloom.halves(batch))))


def _probe_own_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds the filter of the digests of this task, then probes them; they are numbers, RANGE_DIGESTS of them about."""
    held = list(batches)
    own = bloom.Saturating(min(bloom.bits_for(sum(b.num_rows for b in held)), bloom.MAX_BITS))
    for batch in held:
        own.add(*bloom.halves(batch))
    for batch in held:
        yield batch.append_column("maybe", pa.array(own.repeated(*bloom.halves(batch))))


def mark_possible_repeats(digests: DataFrame) -> DataFrame:
    """``digests`` (row_id, hi, lo; none null) with ``maybe``: false only if no other record has the digest."""
    n = digests.count()
    digests = digests.select("row_id", "hi", "lo")
    if bloom.bits_for(n) > bloom.MAX_BITS:
        return _by_ranges(digests, -(-n // RANGE_DIGESTS))
    shared = bloom.merged(digests, bloom.bits_for(n), repeated=True)
    return digests.mapInArrow(partial(_probe, shared=shared), _MARKED)


def _own_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks digests that repeat within a batch, and adds one row without row_id for each of them, unmarked."""
    kept = pa.schema([("row_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("maybe", pa.bool_())])
    for batch in batches:
        hi, lo = bloom.halves(batch)
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        first = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])][: len(order)]
        n = np.diff(np.r_[np.flatnonzero(first), len(order)])
        single = np.empty(len(order), bool)
        single[order] = np.repeat(n, n) == 1
        yield pa.record_batch([*batch.columns, pa.array(np.ones(len(order), bool), mask=single)], schema=kept)
        for_all = batch.take(pa.array(order[first][n > 1]))
        none = pa.nulls(for_all.num_rows)
        yield pa.record_batch([none.cast(pa.int64()), *for_all.columns[1:], none.cast(pa.bool_())], schema=kept)


def _by_ranges(digests: DataFrame, ranges: int) -> DataFrame:
    """As mark_possible_repeats, each range of digests marked by the task that owns it.

    A range is a hash of the digest, so equal digests meet. Those that repeat within a batch are marked where they lie,
    and one row stands for all of them in their range: a digest that a third of all rows share fills no task.
    """
    told = digests.mapInArrow(_own_repeats, _MARKED)
    owned = told.filter("maybe IS NULL").drop("maybe").repartition(ranges, F.xxhash64("hi", "lo"))
    return owned.mapInArrow(_probe_own_range, _MARKED).filter("row_id IS NOT NULL").unionByName(told.filter("maybe"))


def hidden_duplicates(records: DataFrame, vocabulary: tuple[str, ...], blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records (row_id, input, output) that are the same apart from formatting.

    Returns (copies: first_id, copy_id), one row for every record but the smallest row_id of each set, and
    (collapsed: row_id, copies), one row per set, singletons included. Records with a blank field are in no set; they
    are in neither result, or, with ``blank``, singletons of ``collapsed``. An empty table gives empty results.
    Grouping is exact on 128-bit digests.
    """
    d = records.select("row_id", record_digest(vocabulary, F.col("input"), F.col("output")).alias("d")).filter("row_id IS NOT NULL")
    d = durable((d if blank else d.filter("d IS NOT NULL")).select("row_id", "d.hi", "d.lo"))
    digests = d.filter("hi IS NOT NULL")
    marked = mark_possible_repeats(digests)
    maybe = durable(marked.filter("maybe").drop("maybe"))
    groups = maybe.groupBy("hi", "lo").agg(F.min("row_id").alias("first_id"), F.count("*").alias("copies"))
    sets = groups.filter("copies > 1")
    copies = lookup_skewed(maybe, durable(sets), ["hi", "lo"], "copies").filter("row_id <> first_id")
    single = marked.filter("NOT maybe").select("row_id", F.lit(1).cast("bigint").alias("copies"))
    collapsed = groups.select(F.col("first_id").alias("row_id"), "copies").unionByName(single)
    if blank:
        collapsed = collapsed.unionByName(d.filter("hi IS NULL").select("row_id", F.lit(1).cast("bigint").alias("copies")))
    return copies.select("first_id", F.col("row_id").alias("copy_id")), collapsed

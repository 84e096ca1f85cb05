"""Same or near-same records across splits (problem 6).

Method: the evaluation side's item n-gram hashes are gathered in a Bloom filter that is broadcast (or, where it would
pass its bound, left out, and both sides are partitioned by hash alone); training is scanned for hits, and only n-grams
that hit are shuffled. A bag has no order and one edit may lie anywhere, so its n-grams are unordered: all its items
(n = size), and all but one (n = size - 1). The largest n-gram of an evaluation bag that a training bag shares gives
the containment, n / size. Short n-grams of fixed length can't give the result: every bag holds some that are common
to a large part of all records, so they exclude nothing and would pair whole groups of rows.

Equal bags are one class, by the hash of the whole bag; copies are counted per task before anything is shuffled and
never meet pair by pair. A hash is shared by no more classes than there are items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, lookup_skewed
from . import bloom

#: Members of a class that meet members of another in one task when classes are expanded to pairs.
MEMBER_BLOCK = 1000

_items: dict[str, tuple[int, int]] = {}


def _hash(tagged: str) -> tuple[int, int]:
    h = _items.get(tagged)
    if h is None:
        if len(_items) > 500_000:
            _items.clear()
        d = blake2b(tagged.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        h = _items[tagged] = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big")
    return h


class _Bags:
    """The bags of a batch: entries (record, item hash, field) in sorted order, and the hash of each whole bag.

    A hash is two sums modulo 2**64 of the hashes of the items, so leaving an item out is a subtraction.
    """

    def __init__(self, batch: pa.RecordBatch):
        row, hashes, field, again = [], [], [], []
        for k in (0, 1):
            lists = batch.column(batch.schema.get_field_index(f"bag_{k}"))
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            d = pc.dictionary_encode(lists.flatten())
            code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.array([_hash(f"{k}{t}") for t in d.dictionary.to_pylist()], np.uint64).reshape(-1, 2)
            r = np.repeat(np.arange(len(lists)), n)
            row.append(r)
            hashes.append(of[code])
            field.append(np.full(len(code), k, np.int32))
            again.append(np.r_[False, (r[1:] == r[:-1]) & (code[1:] == code[:-1])][: len(code)])
        self.row, self.hash, self.field, self.again = (np.concatenate(x) for x in (row, hashes, field, again))
        self.size = np.bincount(self.row, minlength=batch.num_rows)
        self.whole = np.zeros((batch.num_rows, 2), np.uint64)
        for h in (0, 1):
            order = np.argsort(self.row, kind="stable")
            sums = np.r_[np.uint64(0), np.cumsum(self.hash[order, h], dtype=np.uint64)]
            ends = np.cumsum(self.size)
            self.whole[:, h] = sums[ends] - sums[ends - self.size]


def _grams(batches: Iterator[pa.RecordBatch], near_from: int, shared) -> Iterator[pa.RecordBatch]:
    """One row per n-gram of each bag, with the bag's class and the field an item was left out of (-1: none).

    With a filter only n-grams that may hit; n-grams all but one item are made of bags of ``near_from`` items or more.
    """
    for batch in batches:
        b = _Bags(batch)
        out = np.flatnonzero(~b.again & (b.size[b.row] >= near_from))
        row = np.concatenate([np.arange(batch.num_rows), b.row[out]])
        gram = np.concatenate([b.whole, b.whole[b.row[out]] - b.hash[out]]).view(np.int64)
        gone = np.concatenate([np.full(batch.num_rows, -1, np.int32), b.field[out]])
        hi, lo = np.ascontiguousarray(gram[:, 0]), np.ascontiguousarray(gram[:, 1])
        if shared is not None:
            hit = bloom.probe(shared.value, hi, lo)
            row, hi, lo, gone = row[hit], hi[hit], lo[hit], gone[hit]
        whole, size = b.whole.view(np.int64)[row], b.size[row].astype(np.int32)
        columns = {"c_hi": whole[:, 0], "c_lo": whole[:, 1], "size": size, "hi": hi, "lo": lo, "n": size - (gone >= 0).astype(np.int32), "gone": gone}
        yield pa.record_batch([pa.array(np.ascontiguousarray(v)) for v in columns.values()], names=list(columns))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = _Bags(batch).whole.view(np.int64)
        yield pa.record_batch([batch.column(batch.schema.get_field_index("row_id")), *(pa.array(np.ascontiguousarray(whole[:, h])) for h in (0, 1))], names=["row_id", "c_hi", "c_lo"])


def row_classes(bags: DataFrame) -> DataFrame:
    """(row_id, c_hi, c_lo): the class of each row, which is the hash of its whole bag."""
    return bags.select("row_id", "bag_0", "bag_1").mapInArrow(_classes, "row_id bigint, c_hi bigint, c_lo bigint")


def ngrams(bags: DataFrame, near_from: int, shared=None) -> DataFrame:
    """(c_hi, c_lo, size, hi, lo, n, gone, members): the n-grams of each class of equal bags, with its number of rows."""
    schema = "c_hi bigint, c_lo bigint, size int, hi bigint, lo bigint, n int, gone int"
    rows = bags.select("bag_0", "bag_1").mapInArrow(partial(_grams, near_from=near_from, shared=shared), schema)
    return rows.groupBy("c_hi", "c_lo", "size", "hi", "lo", "n", "gone").agg(F.count("*").alias("members"))


def near_classes(evaluation: DataFrame, training: DataFrame, near_from: int) -> DataFrame:
    """Class pairs that are equal or, if the larger has ``near_from`` items, one edit within one field apart.

    (e_hi, e_lo, t_hi, t_lo, containment, eval_rows, training_rows); containment is the share of the evaluation bag's
    items that the training bag holds: the items of the largest n-gram they share, by those of the bag.
    """
    grams = evaluation.agg(F.sum(F.size("bag_0") + F.size("bag_1") + 1)).first()[0] or 0  # at most
    shared = None
    if bloom.bits_for(grams) <= bloom.MAX_BITS:
        schema = "c_hi bigint, c_lo bigint, size int, hi bigint, lo bigint, n int, gone int"
        keys = evaluation.select("bag_0", "bag_1").mapInArrow(partial(_grams, near_from=near_from, shared=None), schema)
        shared = bloom.merged(keys, bloom.bits_for(grams), repeated=False)
    e, t = ngrams(evaluation, near_from), ngrams(training, near_from, shared)
    e = e.select("hi", "lo", "n", "size", F.col("c_hi").alias("e_hi"), F.col("c_lo").alias("e_lo"), F.col("gone").alias("e_gone"), F.col("members").alias("eval_rows"))
    t = t.select("hi", "lo", F.col("c_hi").alias("t_hi"), F.col("c_lo").alias("t_lo"), F.col("gone").alias("t_gone"), F.col("members").alias("training_rows"))
    hits = e.join(t, ["hi", "lo"]).filter("e_gone = -1 OR t_gone = -1 OR e_gone = t_gone")
    kept = F.max(F.col("n") / F.col("size")).alias("containment")
    return hits.groupBy("e_hi", "e_lo", "t_hi", "t_lo").agg(kept, F.max("eval_rows").alias("eval_rows"), F.max("training_rows").alias("training_rows"))


class Overlap:
    """The overlap of an evaluation table with a training table of bags (row_id, bag_0, bag_1).

    Bags are sorted arrays without nulls; an empty bag equals an empty bag, so callers leave out rows that hold
    nothing. Repeated row_ids give a pair each; an empty table gives no pairs. Other columns are ignored.
    """

    def __init__(self, evaluation: DataFrame, training: DataFrame, near_from: int):
        self.evaluation, self.training = evaluation, training
        self.pairs = durable(near_classes(evaluation, training, near_from))

    def rows(self) -> DataFrame:
        """(eval_id, train_id) of every overlapping pair of rows; large classes in blocks of members, so no task
        holds a whole pair of them, and a hot class's rows are found without one task for the class."""
        p = self.pairs
        for side, rows in (("e", "eval_rows"), ("t", "training_rows")):
            blocks = F.ceil(F.col(rows) / MEMBER_BLOCK).cast("int")
            p = p.withColumn(f"{side}_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        out = p.select("e_hi", "e_lo", "e_block", "t_hi", "t_lo", "t_block")
        for side, bags, size, name in (("e", self.evaluation, "eval_rows", "eval_id"), ("t", self.training, "training_rows", "train_id")):
            hi, lo = f"{side}_hi", f"{side}_lo"
            sizes = self.pairs.groupBy(hi, lo).agg(F.max(size).alias("members"))
            rows = row_classes(bags).select(F.col("row_id").alias(name), F.col("c_hi").alias(hi), F.col("c_lo").alias(lo))
            there = lookup_skewed(rows, durable(sizes), [hi, lo], "members")
            block = F.pmod(F.xxhash64(name), F.ceil(F.col("members") / MEMBER_BLOCK)).cast("int")
            out = out.join(there.select(name, hi, lo, block.alias(f"{side}_block")), [hi, lo, f"{side}_block"])
        return out.select("eval_id", "train_id")

    def links(self) -> DataFrame:
        """(row_id, class_id, links, containment): every evaluation row with its class of equal bags, that is its
        smallest row_id, the training rows that the row overlaps, and the largest containment (null without any)."""
        per = self.pairs.groupBy(F.col("e_hi").alias("c_hi"), F.col("e_lo").alias("c_lo")).agg(F.sum("training_rows").alias("links"), F.max("containment").alias("containment"))
        rows = row_classes(self.evaluation)
        classes = rows.groupBy("c_hi", "c_lo").agg(F.min("row_id").alias("class_id"), F.count("*").alias("members"))
        told = durable(classes.join(per, ["c_hi", "c_lo"], "left"))
        return lookup_skewed(rows, told, ["c_hi", "c_lo"], "members").select("row_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "containment")

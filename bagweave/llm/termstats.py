"""Frequency of every distinct term (problem 2).

Method: (term, record) pairs, pre-counted within each record, are sorted externally by range of both; one scan over
runs counts occurrences and distinct records. Ranges split a hot term between tasks; its partial runs are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable

#: A term in at most so many records is rare; one in more than this share of the non-empty records is common.
RARE_RECORDS = 5
COMMON_SHARE = (1, 20)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (term, id, n) rows to (term, occurrences, records), one row per run within a batch.

    A pair that goes on from the batch before is counted as a record only once.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = pc.dictionary_encode(batch.column("term"))
        term, terms = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
        ids, n = batch.column("id").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
        new_term = np.r_[True, term[1:] != term[:-1]]
        new_pair = new_term | np.r_[True, ids[1:] != ids[:-1]]
        if last == (terms[int(term[0])].as_py(), int(ids[0])):
            new_pair[0] = False
        starts = np.flatnonzero(new_term)
        yield pa.record_batch(
            [terms.take(pa.array(term[starts])), pa.array(np.add.reduceat(n.astype(np.int64), starts)), pa.array(np.add.reduceat(new_pair.astype(np.int64), starts))],
            names=["term", "occurrences", "records"],
        )
        last = (terms[int(term[-1])].as_py(), int(ids[-1]))


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """(term, occurrences, records) of pairs (term, id, n); null terms, ids or counts are left out.

    Repeated pairs add their counts and are one record. An empty table gives an empty result.
    """
    there = pairs.filter("term IS NOT NULL AND id IS NOT NULL AND n IS NOT NULL").select("term", "id", F.col("n").cast("bigint").alias("n"))
    runs = there.repartitionByRange("term", "id").sortWithinPartitions("term", "id").mapInArrow(_runs, "term string, occurrences bigint, records bigint")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(records: DataFrame, counted) -> DataFrame:
    """(term, occurrences, records, mark) of the terms in ``records``; ``counted`` gives array<struct<term, n>>.

    mark is 'rare' (at most RARE_RECORDS records), else 'common' (more than COMMON_SHARE of the records that hold
    any term), else null.
    """
    pairs = durable(records.select(F.col("row_id").alias("id"), F.posexplode(counted)).select("id", "pos", "col.term", "col.n"))
    total = pairs.filter("pos = 0").count()
    a, b = COMMON_SHARE
    mark = F.when(F.col("records") <= RARE_RECORDS, "rare").when(F.col("records") * b > a * total, "common")
    return term_frequencies(pairs).withColumn("mark", mark)

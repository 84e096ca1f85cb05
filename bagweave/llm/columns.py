"""Arrow column functions over the text kernels; vocabularies travel with the function, their size checked."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forms import Forms

#: An emoji vocabulary is a fixed table; a larger one is refused rather than broadcast.
MAX_VOCABULARY = 100_000
#: Keys that a task counts before it passes their counts on.
TALLIED = 200_000

_forms: dict[int, Forms] = {}


def load_vocabulary(vocab: DataFrame) -> tuple[str, ...]:
    """The distinct non-null tokens of an emoji vocabulary, at most MAX_VOCABULARY of them."""
    rows = vocab.select("token").filter("token IS NOT NULL").distinct().limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"the emoji vocabulary has more than {MAX_VOCABULARY} tokens")
    return tuple(sorted(r[0] for r in rows))


def forms(vocabulary: tuple[str, ...]) -> Forms:
    """The kernel of this worker for a vocabulary."""
    key = hash(vocabulary)
    if key not in _forms:
        _forms[key] = Forms(list(vocabulary))
    return _forms[key]


def per_value(kind: str, make: Callable[[], Callable]) -> Callable[..., Column]:
    """An Arrow UDF that maps values one by one; ``make`` builds the function once per batch on the worker.

    A single column is mapped once per distinct value of a batch. The functions are deterministic, but are declared not
    to be: else Catalyst would push a filter on their result below a repartition and run them twice over every row.
    """

    @F.arrow_udf(kind)
    def udf(*columns: pa.Array) -> pa.Array:
        f = make()
        if len(columns) > 1 or pa.types.is_nested(columns[0].type):
            return pa.array(map(f, *(c.to_pylist() for c in columns)), type=_arrow_type(kind))
        distinct = pc.dictionary_encode(columns[0], null_encoding="encode")
        if 2 * len(distinct.dictionary) > len(distinct):
            return pa.array(map(f, columns[0].to_pylist()), type=_arrow_type(kind))
        return pa.array([f(v) for v in distinct.dictionary.to_pylist()], type=_arrow_type(kind)).take(distinct.indices)

    return udf.asNondeterministic()


def _arrow_type(kind: str) -> pa.DataType:
    named = {
        "string": pa.string(),
        "boolean": pa.bool_(),
        "array<string>": pa.list_(pa.string()),
        "array<int>": pa.list_(pa.int32()),
        "struct<hi:bigint,lo:bigint>": pa.struct([("hi", pa.int64()), ("lo", pa.int64())]),
        "array<struct<term:string,n:int>>": pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())])),
        "array<struct<a:int,b:int>>": pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])),
    }
    return named[kind]


def consistent(vocabulary: tuple[str, ...], text: Column) -> Column:
    """``text`` in consistent form; null for null."""

    def make():
        f = forms(vocabulary).consistent
        return lambda s: None if s is None else f(s)

    return per_value("string", make)(text)


def changed(vocabulary: tuple[str, ...], text: Column) -> Column:
    """The consistent form where it differs from ``text``, else null: only spliced texts travel back."""

    def make():
        f = forms(vocabulary).consistent

        def one(s):
            if s is None:
                return None
            t = f(s)
            return None if t == s else t

        return one

    return per_value("string", make)(text)


def emoji_of(vocabulary: tuple[str, ...], *texts: Column, order: bool = False) -> Column:
    """The emoji of the texts' consistent forms together, sorted unless ``order``; an empty array for none."""

    def make():
        k = forms(vocabulary)

        def one(*values):
            out = [e for s in values if s for e in k.emoji_in(s)]
            return out if order else sorted(out)

        return one

    return per_value("array<string>", make)(*texts)


def term_counts(vocabulary: tuple[str, ...], *texts: Column) -> Column:
    """Each distinct emoji of the texts with its count in this record."""

    def make():
        k = forms(vocabulary)

        def one(*values):
            n = Counter(e for s in values if s for e in k.emoji_in(s))
            return [{"term": t, "n": c} for t, c in n.items()]

        return one

    return per_value("array<struct<term:string,n:int>>", make)(*texts)


def tally(rows: DataFrame, make: Callable[[], Callable], keys: list[str]) -> DataFrame:
    """(keys, n): the sums over all rows of what they count; keys are strings.

    ``make`` builds, once per task, the function from a row's values to its pairs of key tuples and the number that each
    of them counts. A task adds up what it counts and passes it on from TALLIED keys on; the sums are made by a shuffle.
    """
    types = [pa.string()] * len(keys) + [pa.int64()]

    def run(batches):
        count, found = make(), Counter()

        def told():
            columns = [*zip(*found), found.values()] if found else [()] * len(types)
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=[*keys, "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for them, n in count(*row):
                    if n == 1:
                        found.update(them)
                    else:
                        for key in them:
                            found[key] += n
            if len(found) >= TALLIED:
                yield told()
                found.clear()
        yield told()

    counted = rows.mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", n bigint")
    return counted.groupBy(*keys).agg(F.sum("n").alias("n"))

"""Order-insensitive similarity of token bags. All take token arrays, never text, and treat null as an empty bag.

Both empty counts as equal (1.0); one empty as 0.0. Overlap keeps multiplicity. The array forms suit replies;
``bag_overlap_rows`` does the same by rows for texts of many thousand tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import strip


def _bag(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def _count(a: Column, key: Column) -> Column:
    return F.size(F.filter(a, lambda x: x == key))


def overlap(p: Column, t: Column) -> Column:
    """The number of tokens both hold, with multiplicity."""
    p, t = _bag(p), _bag(t)
    return F.aggregate(F.array_intersect(p, t), F.lit(0), lambda n, k: n + F.least(_count(p, k), _count(t, k)))


def _ratio(part: Column, whole: Column, other: Column) -> Column:
    """part / whole; where whole is 0, whether other is 0 too."""
    return F.when(whole == 0, (other == 0).cast("double")).otherwise(F.try_divide(part.cast("double"), whole.cast("double")))


def bag_jaccard(p: Column, t: Column, both: Column | None = None) -> Column:
    p, t = _bag(p), _bag(t)
    both = overlap(p, t) if both is None else both
    union = F.size(p) + F.size(t) - both
    return F.when(union == 0, 1.0).otherwise(F.try_divide(both.cast("double"), union.cast("double")))


def set_jaccard(p: Column, t: Column) -> Column:
    p, t = _bag(p), _bag(t)
    union = F.size(F.array_union(p, t))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(p, t)).cast("double"), union.cast("double")))


def precision(p: Column, t: Column, both: Column | None = None) -> Column:
    p, t = _bag(p), _bag(t)
    return _ratio(overlap(p, t) if both is None else both, F.size(p), F.size(t))


def recall(p: Column, t: Column, both: Column | None = None) -> Column:
    return precision(t, p, both)


def f1(prec: Column, rec: Column) -> Column:
    return F.when(prec + rec == 0, 0.0).otherwise(F.try_divide(2 * prec * rec, prec + rec))


def length_score(p: Column, t: Column) -> Column:
    a, b = F.size(_bag(p)), F.size(_bag(t))
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double")))


def exact_bag(p: Column, t: Column) -> Column:
    return (F.array_sort(_bag(p)) == F.array_sort(_bag(t))).cast("double")


def exact_sequence(p: Column, t: Column) -> Column:
    return (_bag(p) == _bag(t)).cast("double")


def invalid_text_ratio(raw: Column, emoji: Column) -> Column:
    """The share of code points of the stripped text that belong to no emoji."""
    bare = strip(F.coalesce(raw, F.lit("")))
    kept = F.char_length(F.array_join(emoji, ""))
    return F.greatest(F.lit(0), F.char_length(bare) - kept).cast("double") / F.greatest(F.lit(1), F.char_length(bare))


def copy_rate(p: Column, prompt: Column) -> Column:
    """The share of tokens, with multiplicity, that the prompt holds; 0 for none."""
    p, prompt = _bag(p), _bag(prompt)
    return F.when(F.size(p) == 0, 0.0).otherwise(F.try_divide(F.size(F.filter(p, lambda x: F.array_contains(prompt, x))).cast("double"), F.size(p).cast("double")))


# The weights of the benchmark score.
F1_WEIGHT, BAG_WEIGHT, SET_WEIGHT, LENGTH_WEIGHT = 0.50, 0.25, 0.15, 0.10


def benchmark_score(f: Column, bag: Column, sets: Column, length: Column) -> Column:
    """The weighted score of four metrics."""
    return F1_WEIGHT * f + BAG_WEIGHT * bag + SET_WEIGHT * sets + LENGTH_WEIGHT * length


def bag_metrics(p: Column, t: Column) -> Column:
    """All metrics of a pair as one struct; the overlap is taken once."""

    def finish(both: Column) -> Column:
        prec, rec, jac = precision(p, t, both), recall(p, t, both), bag_jaccard(p, t, both)
        score = benchmark_score(f1(prec, rec), jac, set_jaccard(p, t), length_score(p, t))
        return F.struct(
            score.alias("benchmark_score"), f1(prec, rec).alias("bag_f1"), prec.alias("bag_precision"), rec.alias("bag_recall"),
            jac.alias("bag_jaccard"), set_jaccard(p, t).alias("set_jaccard"), length_score(p, t).alias("length_score"),
            exact_bag(p, t).alias("exact_bag_match"), exact_sequence(p, t).alias("exact_sequence_match"),
            F.size(_bag(p)).alias("prediction_len"), F.size(_bag(t)).alias("target_len"),
        )

    return F.transform(F.array(overlap(p, t)), finish)[0]


def best_reference(p: Column, references: Column) -> Column:
    """The metrics against the best of token-array references, with its 0-based index ``reference``.

    References without tokens are dropped; with none left the empty bag is the reference (index -1). Best by score,
    then F1, then Jaccard; the first of equals.
    """
    numbered = F.filter(F.transform(references, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda x: F.size(x["r"]) > 0)
    none = F.array(F.struct(F.lit(-1).alias("i"), F.array().cast("array<string>").alias("r")))
    usable = F.when(F.coalesce(F.size(numbered), F.lit(0)) > 0, numbered).otherwise(none)

    def scored(x: Column) -> Column:
        m = bag_metrics(p, x["r"])
        return F.struct(m["benchmark_score"].alias("s"), m["bag_f1"].alias("f"), m["bag_jaccard"].alias("j"), (-x["i"]).alias("o"), m.alias("m"))

    best = F.array_max(F.transform(usable, scored))
    return best["m"].withField("reference", -best["o"])


def best_jaccard(p: Column, references: Column) -> Column:
    """The largest bag Jaccard over references; 0 without any."""
    return F.coalesce(F.array_max(F.transform(references, lambda r: bag_jaccard(p, r))), F.lit(0.0))


def counts(tokens: Column) -> Column:
    """The bag as a map of token to count."""
    return F.map_from_entries(F.transform(F.array_distinct(_bag(tokens)), lambda k: F.struct(k, _count(_bag(tokens), k))))


def bag_overlap_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, overlap, size_left, size_right) of two tables (key, tokens): counted by rows, linear in the tokens."""

    def counted(df, n):
        return df.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias(n))

    both = counted(left, "n_left").join(counted(right, "n_right"), [key, "token"], "full")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.groupBy(key).agg(zero(F.least("n_left", "n_right") * F.when(F.col("n_left").isNotNull() & F.col("n_right").isNotNull(), 1).otherwise(0)).alias("overlap"), zero("n_left").alias("size_left"), zero("n_right").alias("size_right"))

"""The registered queries of this subpackage: each runs its operator over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sql
from ..runtime import durable, spread, table
from . import cooccur, defects, duplicates, encode, mixing, overlap, sentences, splits, termstats
from .columns import changed, consistent, emoji_of, load_vocabulary, term_counts


def _vocab(spark: SparkSession, d: str) -> tuple[str, ...]:
    return load_vocabulary(table(spark, d, "emoji_vocab"))


def _heldout(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "heldout_validation").select("row_id", *columns))


# Problem 1


def p1_found(spark, d):
    return duplicates.hidden_duplicates(_heldout(spark, d, "input", "output"), _vocab(spark, d))[0]


def p1_records(spark, d):
    return duplicates.hidden_duplicates(_heldout(spark, d, "input", "output"), _vocab(spark, d), blank=True)[1]


# Problem 2


def _terms(spark, d):
    records = _heldout(spark, d, "input", "output")
    return termstats.marked_terms(records, term_counts(_vocab(spark, d), F.col("input"), F.col("output")))


def p2_found(spark, d):
    return _terms(spark, d).filter("mark IS NOT NULL").select("term", "mark")


def p2_terms(spark, d):
    return _terms(spark, d)


# Problem 3


def _groups(spark, d):
    vocab = _vocab(spark, d)
    bag = F.nullif(F.array_join(emoji_of(vocab, F.col("input")), " "), F.lit(""))
    topic = F.nullif(F.lower(F.regexp_replace(consistent(vocab, F.col("topic")), r"(?U)^\s+|\s+$", "")), F.lit(""))
    records = _heldout(spark, d, "input", "topic").select("row_id", bag.alias("bag"), topic.alias("topic"))
    return splits.related_groups(records, ["bag", "topic"])


def p3_found(spark, d):
    return _groups(spark, d).filter("group_rows >= 2").select("row_id", "group_id")


def p3_splits(spark, d):
    return splits.split_of_group(_groups(spark, d))


def p3_shares(spark, d):
    """The shares of the rows that p3_splits reaches."""
    return splits.split_shares(p3_splits(spark, d))


# Problem 4


_FORM_FIELDS = (("heldout_validation", "output", "row_id"), ("raw_sample", "generated_emoji", "sample_id"), ("reply_benchmark", "target_emoji", "source_index"))


def p4_values(spark, d):
    """Every value that isn't in consistent form, with the form it takes; all other values are so already."""
    vocab, out = _vocab(spark, d), None
    for name, column, key in _FORM_FIELDS:
        rows = spread(table(spark, d, name).select(F.col(key).alias("row_key"), F.col(column).alias("value")).filter("value IS NOT NULL"))
        part = rows.select(F.lit(f"{name}.{column}").alias("field"), F.col("row_key").cast("bigint").alias("row_key"), changed(vocab, F.col("value")).alias("form")).filter("form IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark, d):
    return p4_values(spark, d).select("field", "row_key")


# Problem 5


def p5_found(spark, d):
    samples = spread(table(spark, d, "raw_sample").select("sample_id", "benchmark_id", "raw_prediction"))
    return defects.defects(samples, table(spark, d, "reply_benchmark"), _vocab(spark, d))


def p5_counts(spark, d):
    return p5_found(spark, d).groupBy("defect").agg(F.count("*").alias("samples"))


# Problem 6


def _overlaps(spark, d):
    """The overlap of validation and test with train by both fields, and of curated prompts with train inputs."""
    vocab = _vocab(spark, d)
    text = lambda c: F.array_join(emoji_of(vocab, F.col(c)), " ").alias(c)  # noqa: E731  no emoji holds a blank
    bag = lambda c: F.split(c, " ")
    none = F.array().cast("array<string>")
    rows = _heldout(spark, d, "split", "source", "input", "output").filter("split IN ('train', 'validation', 'test')")
    bags = durable(rows.select("row_id", "split", "source", text("input"), text("output")).filter("input <> ''"))
    both = bags.filter("output <> ''").select("row_id", "split", bag("input").alias("bag_0"), bag("output").alias("bag_1"))
    held = overlap.Overlap(both.filter("split <> 'train'"), both.filter("split = 'train'"), near_from=6)
    prompts = durable(table(spark, d, "curated_permutation").select("row_id", text("prompt_emoji")).filter("prompt_emoji <> ''"))
    prompts = prompts.select("row_id", bag("prompt_emoji").alias("bag_0"), none.alias("bag_1"))
    inputs = bags.filter("split = 'train'").select("row_id", bag("input").alias("bag_0"), none.alias("bag_1"))
    return bags, held, overlap.Overlap(prompts, inputs, near_from=5)


def p6_found(spark, d):
    _, held, curated = _overlaps(spark, d)
    pairs = held.rows().unionByName(curated.rows())
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"))


def p6_links(spark, d):
    """Every evaluation record with its class of equal bags and its number of training records; nothing is expanded."""
    _, held, curated = _overlaps(spark, d)
    return held.links().unionByName(curated.links())


def p6_report(spark, d):
    """Per split and source: records with an overlap, those wholly contained, and the training rows they meet."""
    bags, held, curated = _overlaps(spark, d)
    one = held.links().filter("links > 0").join(bags.select("row_id", "split", "source"), "row_id")
    two = curated.links().filter("links > 0").withColumns({"split": F.lit("curated_permutation"), "source": F.lit(None).cast("string")})
    per = one.unionByName(two).groupBy("split", "source")
    return per.agg(F.count("*").alias("records"), F.count(F.when(F.col("containment") == 1, 1)).alias("contained"), F.sum("links").alias("training_rows"))


# Problem 7


#: Bounds of a frequent pair: records together, 1/share of all records, times chance.
PAIR_BOUNDS = {"least": 8, "share": 1000, "lift": 20}


def _pairs(spark, d, **bounds):
    records = _heldout(spark, d, "input", "output")
    return cooccur.item_pairs(records.select(emoji_of(_vocab(spark, d), F.col("input"), F.col("output")).alias("items")), **bounds)


def p7_found(spark, d):
    pairs, n = _pairs(spark, d, **PAIR_BOUNDS)
    return cooccur.frequent_pairs(pairs, n, **PAIR_BOUNDS).select("item_a", "item_b")


def p7_pairs(spark, d):
    return _pairs(spark, d)[0].withColumn("lift", F.round("lift", 6))


# Problem 8


def p8_ids(spark, d):
    documents = spread(table(spark, d, "documents").select("doc_id", "text"))
    return documents.select("doc_id", encode.token_ids(F.col("text")).alias("ids"))


# Problem 9


def _mixture(spark, d):
    documents = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    return mixing.Mixture(documents, table(spark, d, "mix_target"))


def p9_mix(spark, d):
    return _mixture(spark, d).rows


def p9_shares(spark, d):
    return _mixture(spark, d).shares()


def p9_kept(spark, d):
    """Per listed source: whether its tokens are its quota to within its longest text, and no text passes its cap."""
    m = _mixture(spark, d)
    longest = m.units.groupBy("source").agg(F.max("tokens").alias("longest"))
    quota = spark.createDataFrame([(s, float(q)) for s, q in m.quota.items()], "source string, quota double")
    caps = spark.createDataFrame([(s, v[1]) for s, v in m.listed.items()], "source string, cap int")
    told = m.shares().join(caps, "source").join(quota, "source", "left").join(longest, "source", "left")
    share = F.coalesce(F.abs(F.col("tokens") - F.col("quota")) <= F.col("longest"), F.col("tokens") == 0)
    return told.select("source", "target_share", share.alias("share_kept"), (F.col("most_repeats") <= F.col("cap")).alias("cap_kept"))


# Problem 10


def p10_found(spark, d):
    return sentences.sentences(spread(table(spark, d, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name; pN_found comes first of each problem."""
    named = (
        p1_found, p1_records, p2_found, p2_terms, p3_found, p3_splits, p3_shares, p4_found, p4_values, p5_found, p5_counts,
        p6_found, p6_links, p6_report, p7_found, p7_pairs, p8_ids, p9_mix, p9_shares, p9_kept, p10_found,
    )
    return {f.__name__: f for f in named}


# The emoji of heldout_validation in the spelling of emoji_vocab, found by what is left without variation selectors,
# invisible characters and joiners at the ends, digits at normal width.
_BARE = "regexp_replace(regexp_replace(translate({}, '０１２３４５６７８９', '0123456789'), '[\\x{{FE0E}}\\x{{FE0F}}\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{180E}}\\x{{200B}}\\x{{200C}}\\x{{200E}}\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '^\\x{{200D}}+|\\x{{200D}}+$', '', 'g')"
_KNOWN = f"(SELECT {_BARE.format('token')} AS k, any_value(token) AS token FROM emoji_vocab WHERE token IS NOT NULL GROUP BY 1)"


def _tokens_sql(table: str, *columns: str) -> str:
    """(row_id, field, term), one row per emoji of the columns."""
    each = " UNION ALL ".join(f"SELECT row_id, {k} AS field, unnest({sql.emoji(c)}) AS g FROM {table}" for k, c in enumerate(columns))
    return f"(SELECT row_id, field, coalesce(v.token, g.g) AS term FROM ({each}) g LEFT JOIN {_KNOWN} v ON v.k = {_BARE.format('g.g')})"


_TOKENS = _tokens_sql("heldout_validation", "input", "output")
_TERMS = f"""SELECT term, occurrences, records, CASE WHEN records <= 5 THEN 'rare' WHEN records * 20 > n THEN 'common' END AS mark
    FROM (SELECT term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM {_TOKENS} GROUP BY term), (SELECT count(DISTINCT row_id) AS n FROM {_TOKENS})"""
_PAIRED = f"""WITH t AS (SELECT DISTINCT row_id, term FROM {_TOKENS}), m AS (SELECT term, count(*) AS records FROM t GROUP BY term), n AS (SELECT count(DISTINCT row_id) AS n FROM t),
    p AS (SELECT a.term AS item_a, b.term AS item_b, count(*) AS together FROM t a JOIN t b ON a.row_id = b.row_id AND a.term < b.term GROUP BY ALL)
    SELECT item_a, item_b, together, x.records AS records_a, y.records AS records_b, together::DOUBLE * n / (x.records::DOUBLE * y.records) AS lift, n FROM p JOIN m x ON x.term = item_a JOIN m y ON y.term = item_b, n"""


def _near_sql(bags: str, least: int) -> str:
    """(row_id, key, gone): the whole bag and, from ``least`` items on, the bag without one of them, as text."""
    text = "array_to_string({}, ' ') || '#' || array_to_string({}, ' ')"
    without = "list_concat({0}[1:p - 1], {0}[p + 1:])"
    out = [f"SELECT row_id, {text.format('a', 'b')} AS key, -1 AS gone FROM {bags}"]
    for k, c in enumerate("ab"):
        sides = [without.format(c) if x == c else x for x in "ab"]
        out.append(f"SELECT row_id, {text.format(*sides)}, {k} FROM (SELECT *, unnest(range(1, len({c}) + 1)) AS p FROM {bags} WHERE len(a) + len(b) >= {least})")
    return "(" + " UNION ".join(out) + ")"


_BAGS = f"""SELECT row_id, coalesce(list_sort(list(term) FILTER (field = 0)), []) AS a, coalesce(list_sort(list(term) FILTER (field = 1)), []) AS b FROM {_TOKENS} GROUP BY row_id"""
_OVERLAPS = f"""WITH h AS MATERIALIZED (SELECT g.*, split FROM ({_BAGS}) g JOIN heldout_validation USING (row_id)),
    e AS (SELECT * FROM h WHERE split IN ('validation', 'test') AND len(a) > 0 AND len(b) > 0), t AS (SELECT * FROM h WHERE split = 'train' AND len(a) > 0 AND len(b) > 0),
    c AS (SELECT row_id, list_sort(list(term)) AS a, []::VARCHAR[] AS b FROM {_tokens_sql("curated_permutation", "prompt_emoji")} GROUP BY row_id), i AS (SELECT row_id, a, []::VARCHAR[] AS b FROM h WHERE split = 'train' AND len(a) > 0)
    SELECT DISTINCT least(x.row_id, y.row_id) AS id_a, greatest(x.row_id, y.row_id) AS id_b FROM {_near_sql("e", 6)} x JOIN {_near_sql("t", 6)} y ON x.key = y.key AND (x.gone = -1 OR y.gone = -1 OR x.gone = y.gone)
    UNION SELECT least(x.row_id, y.row_id), greatest(x.row_id, y.row_id) FROM {_near_sql("c", 5)} x JOIN {_near_sql("i", 5)} y ON x.key = y.key AND (x.gone = -1 OR y.gone = -1 OR x.gone = y.gone)"""


def oracle_sql() -> dict[str, str]:
    """What SQL can gate. The other operators rest on Unicode kernels, models and iteration, and are tested against brute force."""
    return {
        "p2_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
        "p2_terms": _TERMS,
        "p6_found": _OVERLAPS,
        "p7_found": f"SELECT item_a, item_b FROM ({_PAIRED}) WHERE together >= 8 AND together * 1000 >= n AND together * n >= 20 * records_a * records_b",
        "p7_pairs": f"SELECT * EXCLUDE (n) REPLACE (round(lift, 6) AS lift) FROM ({_PAIRED})",
        "p9_kept": "SELECT source, target_share, true AS share_kept, true AS cap_kept FROM mix_target WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0",
    }

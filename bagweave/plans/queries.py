"""The registered queries of the core, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alias, bags, detokenize, noise, vectors
from ..functions import sequences as sq
from ..functions import tokens as tk
from ..operators import benchmark, corpus, joins, score, semantic, split, stability
from ..runtime import broadcast_if_small, durable, hash_unit, lookup_skewed, spread, table
from ..streaming import incremental
from . import sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if text:
            _SQL[f.__name__] = text
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# -- shared inputs ---------------------------------------------------------


def _samples(spark, d):
    """Samples of known benchmarks with token arrays of reply, target and prompt."""
    bench = table(spark, d, "reply_benchmark").select("benchmark_id", "topic", tk.emoji_tokens(F.col("target_emoji")).alias("t"), tk.emoji_tokens(F.col("prompt_emoji")).alias("pr"))
    rows = spread(table(spark, d, "raw_sample").select("sample_id", "model", "benchmark_id", "prompt_mode", "prompt_variant_idx", "sample_idx", "error", "raw_prediction", "generated_emoji"))
    rows = rows.select("sample_id", "model", "benchmark_id", F.coalesce("prompt_mode", F.lit("unknown")).alias("prompt_mode"), F.coalesce("prompt_variant_idx", F.lit(0)).alias("variant"), "sample_idx", "error", "raw_prediction", tk.emoji_tokens(F.col("generated_emoji")).alias("p"))
    return rows.join(broadcast_if_small(bench, 50_000), "benchmark_id")


def _scored(spark, d):
    return score.scored_pairs(_samples(spark, d))


_SAMPLES = f"""SELECT sample_id, model, s.benchmark_id, coalesce(prompt_mode, 'unknown') AS prompt_mode, coalesce(prompt_variant_idx, 0) AS variant,
  sample_idx, error, raw_prediction, b.topic, {sql.emoji("s.generated_emoji")} AS p, {sql.emoji("b.target_emoji")} AS t, {sql.emoji("b.prompt_emoji")} AS pr
  FROM raw_sample s JOIN reply_benchmark b ON s.benchmark_id = b.benchmark_id"""
_SCORED = sql.metrics(_SAMPLES)


# -- bag metrics -----------------------------------------------------------


@query(f"SELECT sample_id, {s6('bag_jaccard')} FROM ({_SCORED})")
def bag_jaccard_pairs(spark, d):
    return _samples(spark, d).select("sample_id", bags.bag_jaccard(F.col("p"), F.col("t")).alias("bag_jaccard")).select("sample_id", *r6("bag_jaccard"))


@query(f"SELECT sample_id, {s6('bag_precision', 'bag_recall', 'bag_f1')} FROM ({_SCORED})")
def bag_prf_pairs(spark, d):
    return _scored(spark, d).select("sample_id", *r6("bag_precision", "bag_recall", "bag_f1"))


@query(f"SELECT sample_id, {s6('set_jaccard')} FROM ({_SCORED})")
def set_jaccard_pairs(spark, d):
    return _scored(spark, d).select("sample_id", *r6("set_jaccard"))


@query(f"SELECT sample_id, {s6('length_score')}, np AS prediction_len, nt AS target_len FROM ({_SCORED})")
def length_score(spark, d):
    return _scored(spark, d).select("sample_id", *r6("length_score"), F.col("prediction_len").cast("bigint"), F.col("target_len").cast("bigint"))


@query(f"SELECT sample_id, exact_bag_match, exact_sequence_match FROM ({_SCORED})")
def exact_match(spark, d):
    return _scored(spark, d).select("sample_id", "exact_bag_match", "exact_sequence_match")


@query(f"SELECT sample_id, {s6('benchmark_score')} FROM ({_SCORED})")
def benchmark_score_pairs(spark, d):
    return _scored(spark, d).select("sample_id", *r6("benchmark_score"))


_REFS = f"""SELECT s.sample_id, s.p, r.i - 1 AS reference, {sql.emoji("b.reference_replies[r.i]")} AS t FROM ({_SAMPLES}) s
  JOIN reply_benchmark b ON s.benchmark_id = b.benchmark_id, LATERAL (SELECT unnest(range(1, len(b.reference_replies) + 1)) AS i) r"""


@query(
    f"""WITH m AS ({sql.metrics(f"SELECT * FROM ({_REFS}) WHERE len(t) > 0")}),
    best AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY benchmark_score DESC, bag_f1 DESC, bag_jaccard DESC, reference) AS rn FROM m),
    none AS ({sql.metrics(f"SELECT sample_id, p, []::VARCHAR[] AS t FROM ({_SAMPLES}) WHERE sample_id NOT IN (SELECT sample_id FROM m)")})
    SELECT sample_id, reference, {s6("benchmark_score", "bag_f1")} FROM best WHERE rn = 1
    UNION ALL SELECT sample_id, -1, {s6("benchmark_score", "bag_f1")} FROM none"""
)
def best_reference(spark, d):
    refs = table(spark, d, "reply_benchmark").select("benchmark_id", F.transform("reference_replies", tk.emoji_tokens).alias("refs"))
    rows = _samples(spark, d).select("sample_id", "benchmark_id", "p").join(broadcast_if_small(refs, 50_000), "benchmark_id")
    return score.scored_references(rows, "sample_id").select("sample_id", F.col("reference").cast("bigint").alias("reference"), *r6("benchmark_score", "bag_f1"))


@query(f"SELECT sample_id, round(CASE WHEN len(p) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(p, lambda x: list_contains(pr, x)))::DOUBLE / len(p) END, 6) AS copy_rate FROM ({_SAMPLES})")
def copy_rate(spark, d):
    return _samples(spark, d).select("sample_id", F.round(bags.copy_rate(F.col("p"), F.col("pr")), 6).alias("copy_rate"))


@query(
    f"""SELECT sample_id, round(greatest(0, length(x) - length(array_to_string(e, '')))::DOUBLE / greatest(1, length(x)), 6) AS invalid_text_ratio
    FROM (SELECT sample_id, {sql.strip("coalesce(raw_prediction, '')")} AS x, {sql.emoji("coalesce(raw_prediction, '')")} AS e FROM raw_sample)"""
)
def invalid_text_ratio(spark, d):
    rows = table(spark, d, "raw_sample")
    return rows.select("sample_id", F.round(bags.invalid_text_ratio(F.col("raw_prediction"), tk.emoji_tokens(F.col("raw_prediction"))), 6).alias("invalid_text_ratio"))


@query(f"""SELECT a.row_id, k AS token, len(list_filter(p, lambda y: y = k))::BIGINT AS n FROM (SELECT row_id, {sql.emoji("output")} AS p FROM heldout_validation) a, LATERAL (SELECT unnest(list_distinct(p)) AS k)""")
def bag_counts(spark, d):
    rows = table(spark, d, "heldout_validation").select("row_id", F.explode(tk.emoji_tokens(F.col("output"))).alias("token"))
    return rows.groupBy("row_id", "token").agg(F.count("*").alias("n"))


_HALVES = f"(SELECT row_id AS id, {sql.emoji('input')} AS p, {sql.emoji('output')} AS t FROM heldout_validation)"


@query(f"SELECT id, {sql.overlap('p', 't')}::BIGINT AS overlap, len(p)::BIGINT AS size_left, len(t)::BIGINT AS size_right FROM {_HALVES} WHERE len(p) + len(t) > 0")
def bag_overlap_relational(spark, d):
    rows = table(spark, d, "heldout_validation")
    left, right = (rows.select(F.col("row_id").alias("id"), tk.emoji_tokens(F.col(c)).alias("tokens")) for c in ("input", "output"))
    out = bags.bag_overlap_rows(left, right, "id")
    return out.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("overlap", "size_left", "size_right")])


# -- joins -----------------------------------------------------------------


_MODELS = "(SELECT DISTINCT model FROM raw_sample WHERE model IS NOT NULL)"


def _of_models(spark, d, rows: DataFrame) -> DataFrame:
    """``rows`` for every model of the samples."""
    models = table(spark, d, "raw_sample").filter("model IS NOT NULL").select("model").distinct()
    return rows.crossJoin(broadcast_if_small(models))


@query(
    f"""WITH last AS (SELECT model, benchmark_id, arg_max(coalesce(generated_emoji, '\x01'), sample_id) AS v FROM raw_sample GROUP BY 1, 2),
    j AS (SELECT k.model, b.benchmark_id, l.benchmark_id IS NULL AS missing, coalesce(nullif(l.v, '\x01'), '') AS pred, b.target_emoji FROM reply_benchmark b CROSS JOIN {_MODELS} k LEFT JOIN last l ON b.benchmark_id = l.benchmark_id AND k.model = l.model),
    m AS ({sql.metrics(f"SELECT model, benchmark_id, missing, {sql.emoji('pred')} AS p, {sql.emoji('target_emoji')} AS t FROM j")})
    SELECT model, benchmark_id, missing, {s6("benchmark_score")} FROM m"""
)
def left_join_missing(spark, d):
    preds = table(spark, d, "raw_sample").select("model", "benchmark_id", "sample_id", "generated_emoji")
    asked = _of_models(spark, d, table(spark, d, "reply_benchmark").select("benchmark_id", "target_emoji"))
    joined = joins.with_predictions(asked, preds, ["model", "benchmark_id"], "sample_id")
    rows = joined.select("model", "benchmark_id", "missing", tk.emoji_tokens(F.col("prediction")).alias("p"), tk.emoji_tokens(F.col("target_emoji")).alias("t"))
    return score.scored_pairs(rows).select("model", "benchmark_id", "missing", *r6("benchmark_score"))


@query(f"SELECT model, count(*) AS samples, count(DISTINCT benchmark_id) AS problems, round(avg(benchmark_score), 6) AS benchmark_score FROM ({_SCORED}) GROUP BY model")
def benchmark_summary(spark, d):
    return _scored(spark, d).groupBy("model").agg(F.count("*").alias("samples"), F.countDistinct("benchmark_id").alias("problems"), F.round(F.avg("benchmark_score"), 6).alias("benchmark_score"))


_FP_HELD = sql.fingerprint(sql.first_truthy("instruction"), sql.first_truthy("input"), sql.first_truthy("output"), sql.first_truthy("topic"))
_FP_BENCH = sql.fingerprint(sql.first_truthy("instruction"), sql.first_truthy("input", "prompt_emoji"), sql.first_truthy("output", "target_emoji"), sql.first_truthy("topic"))
_FP_CURATED = sql.fingerprint(sql.first_truthy("instruction"), sql.first_truthy("input", "prompt_emoji"), sql.first_truthy("output", "response_emoji"), sql.first_truthy("topic"))


@query(f"SELECT row_id, {_FP_HELD} AS fp FROM heldout_validation")
def fingerprint(spark, d):
    rows = table(spark, d, "heldout_validation")
    return rows.select("row_id", alias.fingerprint(rows).alias("fp"))


@query(f"SELECT row_id, {_FP_CURATED} AS fp FROM curated_permutation")
def fingerprint_builder(spark, d):
    rows = table(spark, d, "curated_permutation")
    return rows.select("row_id", alias.fingerprint(rows, alias.FINGERPRINT_BUILDER).alias("fp"))


@query(f"SELECT row_id FROM heldout_validation WHERE {_FP_HELD} NOT IN (SELECT {_FP_BENCH} FROM reply_benchmark)")
def holdout_anti(spark, d):
    return joins.without_holdout(table(spark, d, "heldout_validation"), table(spark, d, "reply_benchmark")).select("row_id")


_TASKS = "(SELECT b.benchmark_id, v.v::INT AS variant, s.s::INT AS sample_idx FROM reply_benchmark b, range(3) v(v), range(4) s(s))"


@query(
    f"""SELECT model, benchmark_id, variant, sample_idx FROM {_TASKS} t CROSS JOIN {_MODELS} k WHERE NOT EXISTS (SELECT 1 FROM raw_sample r WHERE r.model = k.model
    AND r.benchmark_id = t.benchmark_id AND r.prompt_variant_idx IS NOT DISTINCT FROM t.variant AND r.sample_idx IS NOT DISTINCT FROM t.sample_idx)"""
)
def resume_anti(spark, d):
    ids = _of_models(spark, d, table(spark, d, "reply_benchmark").select("benchmark_id"))
    tasks = ids.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    done = table(spark, d, "raw_sample").select("model", "benchmark_id", F.col("prompt_variant_idx").alias("variant"), "sample_idx")
    return joins.remaining_tasks(tasks, done, ["model", "benchmark_id", "variant", "sample_idx"])


@query("SELECT sample_id FROM raw_sample WHERE benchmark_id IN (SELECT benchmark_id FROM reply_benchmark)")
def semi_known(spark, d):
    known = table(spark, d, "reply_benchmark").select("benchmark_id")
    return table(spark, d, "raw_sample").join(broadcast_if_small(known), "benchmark_id", "left_semi").select("sample_id")


@query(
    """SELECT topic, instruction, array_to_string(list(output ORDER BY o), '|') AS refs, count(*) AS n FROM (SELECT topic, instruction, output, min(row_id) AS o
    FROM heldout_validation WHERE coalesce(output, '') <> '' GROUP BY ALL) GROUP BY topic, instruction"""
)
def ref_collect(spark, d):
    refs = corpus.references(table(spark, d, "heldout_validation"), ["topic", "instruction"], "output", "row_id")
    return refs.select("topic", "instruction", F.array_join("references", "|").alias("refs"), F.size("references").cast("bigint").alias("n"))


@query(
    """SELECT s.sample_id, r.row_id FROM raw_sample s JOIN reply_benchmark b USING (benchmark_id)
    JOIN (SELECT input, min(row_id) AS row_id FROM heldout_validation GROUP BY input) r ON r.input = b.prompt_emoji"""
)
def reference_lookup(spark, d):
    by = table(spark, d, "heldout_validation").groupBy("input").agg(F.min("row_id").alias("row_id"))
    rows = table(spark, d, "raw_sample").select("sample_id", "benchmark_id").join(broadcast_if_small(table(spark, d, "reply_benchmark").select("benchmark_id", "prompt_emoji"), 50_000), "benchmark_id")
    asked = rows.groupBy("prompt_emoji").agg(F.count("*").alias("n"))  # a hot prompt is no hot task
    keyed = durable(by.withColumnRenamed("input", "prompt_emoji").join(asked, "prompt_emoji"))
    return lookup_skewed(rows, keyed, ["prompt_emoji"], "n").select("sample_id", "row_id")


# -- vocabulary and encoding -----------------------------------------------


@query(f"SELECT token, (row_number() OVER (ORDER BY token) + 4)::INT AS token_id FROM (SELECT DISTINCT unnest({sql.emoji('output')}) AS token FROM heldout_validation)")
def vocab_build(spark, d):
    return corpus.vocabulary(table(spark, d, "heldout_validation").select(tk.emoji_tokens(F.col("output")).alias("tokens")))


_CURATED_IDS = f"""(SELECT row_id, coalesce(list(coalesce(v.token_id, 4) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids FROM
  (SELECT c.row_id, u.pos, tok[u.pos] AS token FROM (SELECT row_id, {sql.emoji("prompt_emoji")} AS tok FROM curated_permutation) c LEFT JOIN LATERAL (SELECT unnest(range(1, len(tok) + 1)) AS pos) u ON true)
  LEFT JOIN emoji_vocab v USING (token) GROUP BY row_id)"""


def _curated_ids(spark, d):
    rows = table(spark, d, "curated_permutation").select("row_id", tk.emoji_tokens(F.col("prompt_emoji")).alias("tokens"))
    return corpus.encode(rows, table(spark, d, "emoji_vocab"), "row_id", 4)


@query(f"SELECT row_id, array_to_string(ids, ' ') AS ids FROM {_CURATED_IDS}")
def encode_ids(spark, d):
    return _curated_ids(spark, d).select("row_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"SELECT row_id, {sql.key(sql.emoji('input'))} AS bag FROM heldout_validation")
def canonical_bag(spark, d):
    return table(spark, d, "heldout_validation").select("row_id", tk.bag_key(tk.emoji_tokens(F.col("input"))).alias("bag"))


@query(f"SELECT row_id, length_grapheme(output)::BIGINT AS graphemes, array_to_string({sql.emoji('output')}, '|') AS emoji FROM heldout_validation WHERE output IS NOT NULL")
def grapheme_tokens(spark, d):
    rows = table(spark, d, "heldout_validation").filter("output IS NOT NULL")
    return rows.select("row_id", F.size(tk.graphemes(F.col("output"))).cast("bigint").alias("graphemes"), F.array_join(tk.emoji_tokens(F.col("output")), "|").alias("emoji"))


@query(
    f"""SELECT doc_id, md5(array_to_string(list_transform(string_split(lower(text), ''), lambda c: CASE WHEN c BETWEEN 'a' AND 'z' AND length(c) = 1 AND ascii(c) < 128 THEN ascii(c) - 89 WHEN c = ' ' THEN 34 ELSE 7 END), ' ')) AS ids
    FROM documents WHERE text <> ''"""
)
def char_encode(spark, d):
    rows = table(spark, d, "documents").filter("text <> ''")
    return rows.select("doc_id", F.md5(F.array_join(tk.character_ids(F.col("text")).cast("array<string>"), " ")).alias("ids"))


@query("SELECT word, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) GROUP BY word")
def word_counts(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(tk.words(F.col("text"))).alias("word"))
    per = words.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


# -- splits ----------------------------------------------------------------

_SPLIT = f"""WITH rows AS (SELECT row_id, {sql.key(f"CASE WHEN len({sql.emoji('input')}) > 0 THEN {sql.emoji('input')} ELSE {sql.emoji('instruction')} END")} AS k
    FROM heldout_validation WHERE {_FP_HELD} NOT IN (SELECT {_FP_BENCH} FROM reply_benchmark)),
  keys AS (SELECT k, row_number() OVER (ORDER BY sha1('42:' || k)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM rows)),
  held AS (SELECT k FROM keys WHERE rn <= least(greatest(1, round_even(n * 0.05, 0)), n - 1)),
  parts AS (SELECT row_id, CASE WHEN k IN (SELECT k FROM held) THEN 'validation' ELSE 'train' END AS part FROM rows)"""


def _split(spark, d):
    return split.split_rows(spread(table(spark, d, "heldout_validation")), "prompt_bag", 0.05, 42, holdout=table(spark, d, "reply_benchmark"))


@query(f"{_SPLIT} SELECT row_id, part FROM parts")
def hash_split(spark, d):
    return _split(spark, d).select("row_id", "part")


@query(f"{_SPLIT} SELECT part, count(*) AS n FROM parts GROUP BY part")
def hash_split_summary(spark, d):
    return _split(spark, d).groupBy("part").agg(F.count("*").alias("n"))


@query(
    f"""WITH rows AS (SELECT row_id, {sql.key(sql.emoji("output"))} AS k FROM heldout_validation),
    keys AS (SELECT k, row_number() OVER (ORDER BY sha1('42:' || k)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM rows))
    SELECT row_id FROM rows WHERE k IN (SELECT k FROM keys WHERE rn <= least(greatest(1, round_even(n * 0.1, 0)), n - 1))"""
)
def partition_validation(spark, d):
    return split.partition_rows(spread(table(spark, d, "heldout_validation")), "validation", "response_bag", 0.1).select("row_id")


@query(f"SELECT row_id, CASE WHEN {sql.unit("'7:' || row_id::VARCHAR")} < 0.05 THEN 'validation' ELSE 'train' END AS part FROM heldout_validation")
def random_split(spark, d):
    return split.split_rows(table(spark, d, "heldout_validation"), "random", 0.05, 7).select("row_id", "part")


@query(
    f"""WITH r AS (SELECT row_id, coalesce(topic, '') AS topic, array_to_string({sql.emoji("coalesce(input, '')")}, '') AS prompt_emoji, array_to_string({sql.emoji("coalesce(output, '')")}, '') AS target_emoji, {_FP_HELD} AS fp,
      {sql.key(f"CASE WHEN len({sql.emoji('input')}) > 0 THEN {sql.emoji('input')} ELSE {sql.emoji('instruction')} END")} AS k FROM heldout_validation),
    keys AS (SELECT k, row_number() OVER (ORDER BY sha1('42:' || k)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM r)),
    f AS (SELECT topic, prompt_emoji, array_to_string(list(target_emoji ORDER BY o), '|') AS refs FROM (SELECT topic, prompt_emoji, target_emoji, min(row_id) AS o FROM r WHERE target_emoji <> '' GROUP BY ALL) GROUP BY ALL)
    SELECT 'bench_' || row_id::VARCHAR || '_' || substr(fp, 1, 8) AS benchmark_id, r.topic, r.prompt_emoji, target_emoji, coalesce(refs, '') AS refs FROM r LEFT JOIN f USING (topic, prompt_emoji)
    WHERE k IN (SELECT k FROM keys WHERE rn <= least(greatest(1, round_even(n * 0.05, 0)), n - 1))"""
)
def benchmark_build(spark, d):
    rows = benchmark.materialized(spread(table(spark, d, "heldout_validation")), "row_id", "bench")
    return rows.select("benchmark_id", "topic", "prompt_emoji", "target_emoji", F.array_join("references", "|").alias("refs"))


# -- aggregates and curves -------------------------------------------------


@query(f"SELECT model, round(avg(m), 6) AS macro FROM (SELECT model, benchmark_id, avg(benchmark_score) AS m FROM ({_SCORED}) GROUP BY ALL) GROUP BY model")
def macro_mean(spark, d):
    per = _scored(spark, d).groupBy("model", "benchmark_id").agg(F.avg("benchmark_score").alias("m"))
    return per.groupBy("model").agg(F.round(F.avg("m"), 6).alias("macro"))


@query(
    f"""SELECT model, coalesce(prompt_mode, 'all') AS prompt_mode, count(*) AS samples, count(DISTINCT benchmark_id) AS problems, round(avg(bag_f1), 6) AS bag_f1,
    round(avg((coalesce(error, '') <> '')::INT), 6) AS error_rate FROM ({_SCORED}) GROUP BY GROUPING SETS ((model, prompt_mode), (model))"""
)
def all_bucket(spark, d):
    rows = score.with_all_bucket(_scored(spark, d), "prompt_mode")
    error = F.avg((F.coalesce("error", F.lit("")) != "").cast("int"))
    return rows.groupBy("model", "prompt_mode").agg(F.count("*").alias("samples"), F.countDistinct("benchmark_id").alias("problems"), F.round(F.avg("bag_f1"), 6).alias("bag_f1"), F.round(error, 6).alias("error_rate"))


@query(
    f"""WITH s AS ({_SCORED}), f AS (SELECT model, benchmark_id, arg_min(benchmark_score, sample_id) AS first_score, arg_min(bag_f1, sample_id) AS first_f1, max(benchmark_score) AS best_score,
    arg_max(bag_f1, (benchmark_score, -sample_id)) AS best_f1, max(exact_bag_match) AS any_exact FROM s GROUP BY ALL)
    SELECT model, count(*) AS problems, round(avg(first_score), 6) AS first_score, round(avg(first_f1), 6) AS first_f1, round(avg(best_score), 6) AS best_score,
    round(avg(best_f1), 6) AS best_f1, round(avg(any_exact), 6) AS pass_all FROM f GROUP BY model"""
)
def first_best(spark, d):
    rows = _scored(spark, d).select("model", "benchmark_id", "sample_id", "benchmark_score", "bag_f1", "exact_bag_match")
    per = score.first_and_best(rows, ["model", "benchmark_id"], "sample_id", "benchmark_score")
    exact = rows.groupBy("model", "benchmark_id").agg(F.max("exact_bag_match").alias("any_exact"))
    means = {"first_score": "first.benchmark_score", "first_f1": "first.bag_f1", "best_score": "best.benchmark_score", "best_f1": "best.bag_f1", "pass_all": "any_exact"}
    return per.join(exact, ["model", "benchmark_id"]).groupBy("model").agg(F.count("*").alias("problems"), *[F.round(F.avg(c), 6).alias(n) for n, c in means.items()])


def _curve_sql(columns: str, passes: str = "") -> str:
    return f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY model, benchmark_id ORDER BY sample_id) AS rn FROM ({_SCORED})),
    ks AS (SELECT model, unnest(range(1, least(7, max(rn)) + 1)) AS k FROM s GROUP BY model),
    g AS (SELECT s.model, k, benchmark_id, max(benchmark_score) AS score, max(bag_f1) AS f1, max(bag_jaccard) AS jac, max(exact_bag_match) AS bag, max(exact_sequence_match) AS seq,
      max((bag_jaccard >= 0.65)::INT) AS close FROM s JOIN ks ON s.model = ks.model AND rn <= k GROUP BY s.model, k, benchmark_id)
    SELECT model, k::INT AS k, count(*) AS problems, {columns} FROM g GROUP BY model, k"""


def _curves(spark, d, best, passes):
    return score.curves(_scored(spark, d), ["model"], ["benchmark_id"], ["sample_id"], best, passes, 7)


@query(_curve_sql("round(avg(bag), 6) AS pass_bag, round(avg(seq), 6) AS pass_sequence, round(avg(close), 6) AS pass_close"))
def pass_at_k(spark, d):
    passes = {"pass_bag": F.col("exact_bag_match") >= 1, "pass_sequence": F.col("exact_sequence_match") >= 1, "pass_close": F.col("bag_jaccard") >= 0.65}
    return _curves(spark, d, {}, passes).select("model", "k", "problems", *r6(*passes))


@query(_curve_sql("round(avg(score), 6) AS power_score, round(avg(f1), 6) AS power_f1, round(avg(jac), 6) AS power_jaccard"))
def power_at_k(spark, d):
    best = {"power_score": "benchmark_score", "power_f1": "bag_f1", "power_jaccard": "bag_jaccard"}
    return _curves(spark, d, best, {}).select("model", "k", "problems", *r6(*best))


_SLOT = f"""(SELECT model, benchmark_id, sample_idx, variant, arg_max(p, sample_id) AS p FROM ({_SAMPLES}) GROUP BY ALL)"""


def _pair_sql(member: str, extra: str, where: str) -> str:
    source = f"SELECT a.model, a.benchmark_id, a.p, b.p AS t FROM {_SLOT} a JOIN {_SLOT} b ON a.model = b.model AND a.benchmark_id = b.benchmark_id {extra} AND a.{member} < b.{member} {where}"
    return f"SELECT model, benchmark_id, avg(bag_jaccard) AS s, count(*) AS n FROM ({sql.metrics(source)}) GROUP BY ALL"


@query(f"""SELECT model, count(*) AS problems, round(avg(s), 6) AS stability, sum(n)::BIGINT AS pairs FROM ({_pair_sql("variant", "AND a.sample_idx IS NOT DISTINCT FROM b.sample_idx AND a.sample_idx IS NOT NULL", "")}) GROUP BY model""")
def variant_stability(spark, d):
    per = stability.variant_stability(_samples(spark, d), ["model", "benchmark_id"], "sample_idx", "variant", "sample_id")
    return per.groupBy("model").agg(F.count("*").alias("problems"), F.round(F.avg("stability"), 6).alias("stability"), F.sum("pairs").alias("pairs"))


def _effect_sql() -> str:
    perm, res = _pair_sql("variant", "", "AND a.sample_idx = 0 AND b.sample_idx = 0"), _pair_sql("sample_idx", "", "AND a.variant = 0 AND b.variant = 0")
    sizes = lambda c: f"SELECT DISTINCT model, benchmark_id FROM {_SLOT} WHERE {c} = 0"
    return f"""SELECT model, round(avg(ps), 6) AS perm_stability, round(avg(rs), 6) AS resample_stability, round(avg(rs - ps), 6) AS order_effect, count(*) AS problems FROM
    (SELECT g.model, g.benchmark_id, coalesce(p.s, 1.0) AS ps, coalesce(r.s, 1.0) AS rs FROM ({sizes("sample_idx")} INTERSECT {sizes("variant")}) g
    LEFT JOIN ({perm}) p USING (model, benchmark_id) LEFT JOIN ({res}) r USING (model, benchmark_id)) GROUP BY model"""


@query(_effect_sql())
def order_effect(spark, d):
    key = ["model", "benchmark_id", "sample_idx", "variant"]
    slots = durable(_samples(spark, d).filter("sample_idx = 0 OR variant = 0").groupBy(*key).agg(F.max_by("p", "sample_id").alias("p")))
    group = ["model", "benchmark_id"]
    per = stability.order_effect(slots.filter("sample_idx = 0"), slots.filter("variant = 0"), group)
    return per.groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("perm_stability", "resample_stability", "order_effect")], F.count("*").alias("problems"))


@query(
    f"""WITH r AS (SELECT coalesce(canonical_id, topic, 'ungrouped') AS g, row_id, {sql.emoji("response_emoji")} AS p FROM curated_permutation),
    m AS ({sql.metrics("SELECT a.g, a.p, b.p AS t FROM r a JOIN r b ON a.g = b.g AND a.row_id < b.row_id")})
    SELECT n.g AS group_id, n.members, round(coalesce(s.s, 1.0), 6) AS stability FROM (SELECT g, count(*) AS members FROM r GROUP BY g) n LEFT JOIN (SELECT g, avg(bag_jaccard) AS s FROM m GROUP BY g) s USING (g)"""
)
def pairwise_stability(spark, d):
    rows = table(spark, d, "curated_permutation").select(F.coalesce("canonical_id", "topic", F.lit("ungrouped")).alias("group_id"), "row_id", tk.emoji_tokens(F.col("response_emoji")).alias("p"))
    return stability.group_stability(rows, ["group_id"]).select("group_id", "members", *r6("stability"))


_INVALID = f"""SELECT model, round(avg(greatest(0, length(x) - length(array_to_string(e, '')))::DOUBLE / greatest(1, length(x))), 6) AS r
    FROM (SELECT model, {sql.strip("coalesce(raw_prediction, '')")} AS x, {sql.emoji("coalesce(raw_prediction, '')")} AS e FROM ({_SAMPLES})) GROUP BY model"""
_RICH = sql.metrics(f"SELECT *, CASE WHEN len(p) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(p, lambda x: list_contains(pr, x)))::DOUBLE / len(p) END AS copy_rate FROM ({_SAMPLES})")


@query(
    f"""WITH s AS ({_RICH}), f AS (SELECT model, benchmark_id, count(*) AS n, arg_min(benchmark_score, sample_id) AS fs, arg_min(copy_rate, sample_id) AS fc, max(benchmark_score) AS bs,
    arg_max(copy_rate, (benchmark_score, -sample_id)) AS bc, max(exact_bag_match) AS ex, sum(copy_rate) AS c FROM s GROUP BY ALL),
    v AS ({_pair_sql("variant", "AND a.sample_idx IS NOT DISTINCT FROM b.sample_idx AND a.sample_idx IS NOT NULL", "")})
    SELECT f.model, count(*) AS problems, sum(f.n)::BIGINT AS samples, round(avg(fs), 6) AS first_benchmark_score, round(avg(bs), 6) AS best_all_benchmark_score, round(avg(fc), 6) AS first_copy_rate,
    round(avg(bc), 6) AS best_all_copy_rate, round(avg(ex), 6) AS pass_all_exact_bag, round(sum(c) / sum(f.n), 6) AS mean_copy_rate, round(avg(v.s), 6) AS permutation_stability, count(v.s) AS permutation_stability_n,
    CASE WHEN count(v.s) > 0 THEN 'ok' ELSE 'not_applicable' END AS permutation_stability_status, any_value(x.r) AS invalid_text_ratio
    FROM f LEFT JOIN v USING (model, benchmark_id) JOIN ({_INVALID}) x ON x.model = f.model GROUP BY f.model"""
)
def sample_summary(spark, d):
    rounded = ("first_benchmark_score", "best_all_benchmark_score", "first_copy_rate", "best_all_copy_rate", "pass_all_exact_bag", "mean_copy_rate", "permutation_stability")
    return _summary(spark, d).select("model", "problems", "samples", *r6(*rounded), "permutation_stability_n", "permutation_stability_status", *r6("invalid_text_ratio"))


def _summary(spark, d):
    invalid = bags.invalid_text_ratio(F.col("raw_prediction"), tk.emoji_tokens(F.col("raw_prediction")))
    rows = _scored(spark, d).withColumn("copy_rate", bags.copy_rate(F.col("p"), F.col("pr"))).withColumn("invalid_text_ratio", invalid)
    stable = stability.variant_stability(_samples(spark, d), ["model", "benchmark_id"], "sample_idx", "variant", "sample_id").select("model", "benchmark_id", "stability")
    return score.sample_summary(rows, ["model"], "benchmark_id", "sample_id", stable)


@query(f"SELECT model, round(sum(benchmark_score * nt) / sum(nt), 6) AS nll, round(sum(benchmark_score * nt) / sum(nt) / ln(2), 6) AS bpd, round(exp(sum(benchmark_score * nt) / sum(nt)), 6) AS ppl FROM ({_SCORED}) GROUP BY model")
def weighted_ppl(spark, d):
    rows = _scored(spark, d).groupBy("model").agg((F.sum(F.col("benchmark_score") * F.col("target_len")) / F.sum("target_len")).alias("nll"))
    return rows.select("model", *r6("nll"), F.round(F.col("nll") / F.log(F.lit(2.0)), 6).alias("bpd"), F.round(F.exp("nll"), 6).alias("ppl"))


@query("SELECT DISTINCT topic FROM reply_benchmark WHERE topic IS NOT NULL")
def topic_list(spark, d):
    return table(spark, d, "reply_benchmark").select("topic").filter("topic IS NOT NULL").distinct()


@query("SELECT DISTINCT model_id, replace(replace(replace(replace(model_id, '/', '_'), ':', '_'), '.', '_'), '-', '_') AS label FROM raw_sample WHERE model_id IS NOT NULL")
def model_labels(spark, d):
    ids = table(spark, d, "raw_sample").select("model_id").filter("model_id IS NOT NULL").distinct()
    return ids.select("model_id", tk.model_label(F.col("model_id")).alias("label"))


# -- vectors ---------------------------------------------------------------

_UNIT = "(SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u, e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"


@query(
    f"""SELECT vec_id, neighbour, round(similarity, 6) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, neighbour) AS rank FROM
    (SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.u, b.u) AS similarity FROM {_UNIT} a JOIN {_UNIT} b ON a.vec_id <> b.vec_id)) WHERE rank <= 5"""
)
def knn_pairs(spark, d):
    return semantic.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("vec_id", "neighbour", *r6("similarity"), "rank")


_DIM = "(SELECT vec_id, label, i AS d, e[i] AS x FROM {src}, range(1, 65) r(i))".format(src=_UNIT)


@query(
    f"""WITH c AS (SELECT label, d, avg(x) AS m FROM {_DIM} GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY label),
    v AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM {_DIM} GROUP BY vec_id)
    SELECT t.label, round(avg(t.s / (v.n * n.n)), 6) AS cosine, count(*) AS vectors FROM (SELECT a.vec_id, a.label, sum(a.x * c.m) AS s FROM {_DIM} a JOIN c USING (label, d) GROUP BY ALL) t JOIN v USING (vec_id) JOIN n ON n.label = t.label GROUP BY t.label"""
)
def cosine_label_mean(spark, d):
    rows = table(spark, d, "embeddings")
    means = semantic.mean_vectors(rows, ["label"], "embedding")
    cos = vectors.cosine(vectors.normalized(F.col("embedding")), vectors.normalized(F.col("mean")))
    return rows.join(broadcast_if_small(means, 10_000), "label").groupBy("label").agg(F.round(F.avg(cos), 6).alias("cosine"), F.count("*").alias("vectors"))


@query(
    f"""WITH h AS (SELECT DISTINCT row_id, unnest({sql.emoji("prompt_emoji")}) AS token FROM curated_permutation),
    m AS (SELECT token, d, avg(x) AS m FROM h JOIN {_DIM} e ON h.row_id % 1200 = e.vec_id % 1200 GROUP BY ALL),
    u AS (SELECT token, d, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY token)), 1e-12) AS u FROM m),
    c AS (SELECT token, d, u - avg(u) OVER (PARTITION BY d) AS c FROM u),
    z AS (SELECT token, d, c / greatest(sqrt(sum(c * c) OVER (PARTITION BY token)), 1e-12) AS z FROM c)
    SELECT token, round(max(z) FILTER (d = 1), 6) AS d1, round(max(z) FILTER (d = 64), 6) AS d64 FROM z GROUP BY token"""
)
def token_embedding_centered(spark, d):
    """Every vector belongs to the row of the same number modulo the 1,200 rows of the table."""
    rows = table(spark, d, "curated_permutation").select(F.pmod("row_id", F.lit(1200)).alias("k"), tk.emoji_tokens(F.col("prompt_emoji")).alias("tokens"))
    held = rows.join(table(spark, d, "embeddings").withColumn("k", F.pmod("vec_id", F.lit(1200))), "k").select("tokens", F.col("embedding").alias("vector"))
    return semantic.token_embeddings(held).select("token", F.round(F.col("embedding")[0], 6).alias("d1"), F.round(F.col("embedding")[63], 6).alias("d64"))


@query(
    f"""SELECT vec_id, round(c, 6) AS cosine, round(acos(greatest(-1, least(1, c))) / pi(), 6) AS geodesic, round(sqrt(greatest(0, 2 - 2 * c)), 6) AS l2_cosine, round(l, 6) AS l2 FROM
    (SELECT a.vec_id, list_dot_product(a.u, b.u) AS c, list_distance(a.e, b.e) AS l FROM {_UNIT} a JOIN {_UNIT} b ON b.vec_id = a.vec_id + 1)"""
)
def semantic_distances(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = rows.join(nxt, "vec_id").withColumn("c", vectors.cosine(vectors.normalized(F.col("embedding")), vectors.normalized(F.col("other"))))
    c = F.col("c")
    return pairs.select("vec_id", F.round(c, 6).alias("cosine"), F.round(vectors.geodesic(c), 6).alias("geodesic"), F.round(vectors.l2_of_cosine(c), 6).alias("l2_cosine"), F.round(vectors.l2(F.col("embedding"), F.col("other")), 6).alias("l2"))


# -- sequences -------------------------------------------------------------

_BOS, _EOS, _SEP, _PAD, _MASK = 1, 2, 3, 0, 4


def _joined(c):
    return F.array_join(c.cast("array<string>"), " ")


_HELD_FLAT = f"""(SELECT row_id, coalesce(source, '') AS source, coalesce(v.token_id, 4) AS id, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY row_id, pos) - 1 AS o FROM
  (SELECT row_id, source, u.pos, tok[u.pos] AS token FROM (SELECT row_id, source, {sql.emoji("input")} AS tok FROM heldout_validation) h, LATERAL (SELECT unnest(range(1, len(tok) + 1)) AS pos) u) LEFT JOIN emoji_vocab v USING (token))"""


@query(f"SELECT source, (o // 30)::BIGINT AS block_id, '1 ' || array_to_string(list(id ORDER BY o), ' ') || ' 2' AS ids FROM {_HELD_FLAT} GROUP BY source, o // 30 HAVING count(*) = 30")
def pack_blocks(spark, d):
    rows = table(spark, d, "heldout_validation").select("row_id", F.coalesce("source", F.lit("")).alias("source"), tk.emoji_tokens(F.col("input")).alias("tokens"))
    ids = rows.select("row_id", "source").join(corpus.encode(rows, table(spark, d, "emoji_vocab"), "row_id", 4), "row_id")
    return corpus.packed(ids, ["source"], ["row_id"], 32, _BOS, _EOS).select("source", "block_id", _joined(F.col("input_ids")).alias("ids"))


@query(f"SELECT row_id, array_to_string(list_concat(ids[:6], list_resize([]::INT[], greatest(0, 6 - len(ids)), 0)), ' ') AS ids, greatest(0, least(6, len(ids)))::BIGINT AS attended FROM {_CURATED_IDS}")
def pad_truncate(spark, d):
    p = sq.padded(F.col("ids"), 6, _PAD)
    attended = F.aggregate(p["attention_mask"], F.lit(0), lambda a, x: a + x).cast("bigint")
    return _curated_ids(spark, d).select("row_id", _joined(p["input_ids"]).alias("ids"), attended.alias("attended"))


def _fill(n: str, value: int) -> str:
    return f"list_transform(range(0, greatest(0, {n})), lambda z: {value})"


@query(
    f"""WITH a AS (SELECT c.row_id, ids AS l, list_transform(range(0, len({sql.emoji("response_emoji")})), lambda i: 100 + i) AS r FROM {_CURATED_IDS} i JOIN curated_permutation c USING (row_id)),
    b AS (SELECT row_id, r[:least(4, 7)] AS r, (l[:8])[:greatest(0, 12 - 3 - 2 - len(r[:least(4, 7)]))] AS l FROM a),
    c AS (SELECT row_id, len(l) + 2 AS given, list_concat([1], list_concat(l, list_concat([3], list_concat(r, [2, 0, 0])))) AS s FROM b)
    SELECT row_id, array_to_string(list_concat(s, {_fill("12 - len(s)", 0)}), ' ') AS ids, array_to_string(list_concat({_fill("given", 1)}, {_fill("12 - given", 0)}), '') AS cond,
    array_to_string(list_concat({_fill("len(s)", 1)}, {_fill("12 - len(s)", 0)}), '') AS attention FROM c"""
)
def paired_sequence(spark, d):
    n = F.size(tk.emoji_tokens(F.col("response_emoji")))
    right = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i + 100))
    rows = _curated_ids(spark, d).join(table(spark, d, "curated_permutation").select("row_id", right.alias("right")), "row_id")
    p = sq.paired(F.col("ids"), F.col("right"), 12, _BOS, _SEP, _EOS, _PAD, 8, 4, 2)
    bits = lambda c: F.array_join(p[c].cast("array<string>"), "")
    return rows.select("row_id", _joined(p["input_ids"]).alias("ids"), bits("cond_mask").alias("cond"), bits("attention_mask").alias("attention"))


@query("SELECT doc_id, i AS chunk, substring(text, (i * 100 + 1)::BIGINT, 100) AS piece FROM documents, LATERAL (SELECT unnest(range(0, length(text) // 100)) AS i)")
def chunk_text(spark, d):
    rows = table(spark, d, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.posexplode(sq.chunks(F.col("text"), 100)).alias("chunk", "piece")).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), "piece")


def _detok(name):
    def run(spark, d):
        return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(detokenize.DETOKENIZERS[name](F.col("text"))).alias("text"))

    run.__name__ = f"detok_{name}"
    query(f"SELECT doc_id, md5({sql.DETOKENIZED[name]('text')}) AS text FROM documents" if name in sql.DETOKENIZED else None)(run)


for _name in ("ptb", "lm1b", "wikitext"):
    _detok(_name)


@query(f"""SELECT doc_id, md5(chr(10) || {sql.strip("replace(replace(text, '“', chr(34)), '”', chr(34))")}) AS text FROM documents""")
def detok_lambada(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(detokenize.lambada(F.col("text"))).alias("text"))


@query(f"SELECT doc_id, md5({sql.DETOKENIZED['lm1b'](sql.DETOKENIZED['wikitext']('text'))}) AS text FROM documents")
def detok_scientific_papers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(detokenize.scientific_papers(F.col("text"))).alias("text"))


_ITEMS = f"(SELECT benchmark_id, {sql.emoji('target_emoji')} AS t FROM reply_benchmark)"


@query(
    f"""SELECT benchmark_id || ':' || pattern AS example_id, pattern, k::INT AS revealed_k, array_to_string(list_transform(range(0, len(t)), lambda i: CASE WHEN i BETWEEN a AND b THEN t[i + 1] ELSE '[MASK]' END), ' ') AS visible,
    array_to_string(list_transform(list_filter(range(0, len(t)), lambda i: i NOT BETWEEN a AND b), lambda i: t[i + 1]), '') AS masked_truth FROM
    (SELECT *, CASE pattern WHEN 'prefix' THEN 0 ELSE len(t) - k END AS a, CASE pattern WHEN 'prefix' THEN k - 1 ELSE len(t) - 1 END AS b FROM
    (SELECT *, greatest(1, len(t) // 2) AS k FROM {_ITEMS}, (VALUES ('prefix'), ('suffix')) p(pattern) WHERE len(t) >= 2))"""
)
def infill_items(spark, d):
    rows = table(spark, d, "reply_benchmark").select("benchmark_id", tk.emoji_tokens(F.col("target_emoji")).alias("t")).filter(F.size("t") >= 2)
    k = sq.reveal_count(F.size("t"))
    one = lambda p: F.struct(F.lit(p).alias("pattern"), sq.reveal_positions(F.size("t"), k, p).alias("shown"))
    items = rows.withColumn("k", k).select("*", F.explode(F.array(one("prefix"), one("suffix"))).alias("s")).select("*", "s.*")
    shown = F.col("shown")
    return items.select(F.concat_ws(":", "benchmark_id", "pattern").alias("example_id"), "pattern", F.col("k").alias("revealed_k"), F.array_join(sq.visible_slots(F.col("t"), shown), " ").alias("visible"), F.array_join(sq.masked_tokens(F.col("t"), shown), "").alias("masked_truth"))


@query(
    f"""WITH i AS (SELECT benchmark_id, t, greatest(1, len(t) // 2) AS k FROM {_ITEMS} WHERE len(t) >= 2),
    o AS (SELECT benchmark_id, t, k, p.p AS p, row_number() OVER (PARTITION BY benchmark_id ORDER BY sha1('42:' || benchmark_id || ':' || p.p::VARCHAR), p.p) AS rn FROM i, LATERAL (SELECT unnest(range(0, len(t))) AS p) p)
    SELECT benchmark_id, array_to_string(list(p ORDER BY p), ' ') AS shown FROM o WHERE rn <= k GROUP BY benchmark_id"""
)
def reveal_scattered(spark, d):
    rows = table(spark, d, "reply_benchmark").select("benchmark_id", tk.emoji_tokens(F.col("target_emoji")).alias("t")).filter(F.size("t") >= 2)
    shown = sq.reveal_positions(F.size("t"), sq.reveal_count(F.size("t")), "scattered", F.concat(F.lit("42:"), "benchmark_id"))
    return rows.select("benchmark_id", _joined(shown).alias("shown"))


@query(f"SELECT row_id, array_to_string(list_transform(range(0, len(ids)), lambda i: CASE WHEN {sql.unit("'1:' || row_id::VARCHAR || ':' || i::VARCHAR")} < 0.5 AND i > 0 THEN 4 ELSE ids[i + 1] END), ' ') AS ids FROM {_CURATED_IDS}")
def masking_qxt(spark, d):
    rows = _curated_ids(spark, d)
    units = F.transform("ids", lambda _, i: hash_unit("1", F.col("row_id"), i))
    cond = F.transform("ids", lambda _, i: (i == 0).cast("int"))
    return rows.select("row_id", _joined(noise.masked(F.col("ids"), units, F.lit(0.5), cond, _MASK)).alias("ids"))


@query(f"SELECT row_id, coalesce(list_position(ids, 200), 0)::BIGINT - 1 AS first_at, (CASE WHEN list_position(ids, 200) > 0 THEN list_position(ids, 200) ELSE len(ids) END)::BIGINT AS kept FROM {_CURATED_IDS}")
def eos_prefix(spark, d):
    kept = F.aggregate(sq.first_end_mask(F.col("ids"), 200), F.lit(0), lambda a, x: a + x).cast("bigint")
    return _curated_ids(spark, d).select("row_id", F.coalesce(sq.first_offset(F.col("ids"), 200), F.lit(-1)).alias("first_at"), kept.alias("kept"))


# -- noise -----------------------------------------------------------------

_E = "0.001::DOUBLE"


def _noise_sql(t: str) -> str:
    return f"""WITH t AS ({t})
    SELECT vec_id, round(-ln(1 - (1 - {_E}) * t), 6) AS loglinear, round((1 - {_E}) / (1 - (1 - {_E}) * t), 6) AS loglinear_rate, round(-ln({_E} + (1 - {_E}) * cos(t * pi() / 2)), 6) AS cosine,
    round(pi() / 2 * (1 - {_E}) * sin(t * pi() / 2) / ((1 - {_E}) * cos(t * pi() / 2) + {_E}), 6) AS cosine_rate, round(-ln({_E} + (1 - {_E}) * power(cos(t * pi() / 2), 2)), 6) AS cosine2,
    round(10 * t, 6) AS linear, round(power(0.001::DOUBLE, 1 - t), 6) AS geometric, round((1 - {_E}) * t, 6) AS move_chance FROM t"""


def _noise_rows(rows: DataFrame, t) -> DataFrame:
    cols = [F.round(noise.schedule(k, t)[0], 6).alias(k) for k in ("loglinear", "cosine", "cosine2", "linear", "geometric")]
    rates = [F.round(noise.schedule(k, t)[1], 6).alias(f"{k}_rate") for k in ("loglinear", "cosine")]
    move = F.round(noise.move_chance(noise.schedule("loglinear", t)[0]), 6).alias("move_chance")
    return rows.select("vec_id", *cols, *rates, move)


@query(_noise_sql(f"SELECT vec_id, {sql.unit("'noise:' || vec_id::VARCHAR")} AS t FROM embeddings"))
def noise_table(spark, d):
    return _noise_rows(table(spark, d, "embeddings"), hash_unit("noise", F.col("vec_id")))


@query(
    f"""WITH t AS (SELECT event_id, event_type, (event_id % 997 + 1) / 1000::DOUBLE AS t, -ln(1 + abs(value)) AS lp FROM events)
    SELECT event_type, round(sum(-lp * ((1 - {_E}) / (1 - (1 - {_E}) * t)) / (exp(-ln(1 - (1 - {_E}) * t)) - 1) * m) / sum(m), 4) AS token_nll FROM (SELECT *, (event_id % 3 <> 0)::INT AS m FROM t) GROUP BY event_type"""
)
def loss_weights(spark, d):
    t = (F.pmod("event_id", F.lit(997)) + 1) / F.lit(1000.0)
    total, rate = noise.schedule("loglinear", t)
    rows = table(spark, d, "events").select("event_type", noise.subs_loss(-F.log(1 + F.abs("value")), total, rate).alias("loss"), (F.pmod("event_id", F.lit(3)) != 0).cast("int").alias("m"))
    return rows.groupBy("event_type").agg(F.round(F.sum(F.col("loss") * F.col("m")) / F.sum("m"), 4).alias("token_nll"))


@query(f"""SELECT vec_id, round(0.999 * ((u / n + vec_id / n) % 1) + 0.001, 6) AS t, round(floor((u) * 50) / 50 + 0.02, 6) AS snapped FROM (SELECT vec_id, {sql.unit("'3:' || vec_id::VARCHAR")} AS u, (SELECT count(*) FROM embeddings)::DOUBLE AS n FROM embeddings)""")
def antithetic_t(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id")
    u = hash_unit("3", F.col("vec_id"))
    t = noise.antithetic_time(u, F.col("vec_id"), F.lit(float(rows.count())))
    return rows.select("vec_id", F.round(t, 6).alias("t"), F.round(noise.snapped_time(u, 50), 6).alias("snapped"))


# -- order, sampling, sets -------------------------------------------------


@query("WITH r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM heldout_validation), p AS (SELECT row_id, i, n FROM r UNION ALL SELECT row_id, i + n, n FROM r WHERE i < (n + 6) // 7 * 7 - n) SELECT row_id, i::BIGINT AS idx FROM p WHERE i % 7 = 3")
def stride_shard(spark, d):
    return corpus.shard(table(spark, d, "heldout_validation").select("row_id"), ["row_id"], 7, 3).select("row_id", F.col("idx").cast("bigint").alias("idx"))


@query(
    """SELECT label, count(*) AS n, count(DISTINCT row_id) AS rows FROM (SELECT 'curated' AS label, row_id FROM curated_permutation, range(3) UNION ALL SELECT 'heldout', row_id FROM heldout_validation, range(2)) GROUP BY label"""
)
def repeat_union(spark, d):
    rows = corpus.union_sources([("curated", table(spark, d, "curated_permutation").select("row_id"), 3), ("heldout", table(spark, d, "heldout_validation").select("row_id", "split"), 2)])
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("rows"))


@query("SELECT row_id, CASE WHEN row_number() OVER (ORDER BY row_id DESC) <= 1000 THEN 'tail' ELSE 'head' END AS part FROM heldout_validation")
def tail_slice(spark, d):
    head, tail = corpus.tail_slice(table(spark, d, "heldout_validation").select("row_id"), ["row_id"], 1000)
    return head.select("row_id", F.lit("head").alias("part")).unionByName(tail.select("row_id", F.lit("tail").alias("part")))


@query("SELECT row_id, (row_number() OVER (ORDER BY sha1('9:2:' || row_id::VARCHAR)) - 1)::BIGINT AS idx FROM heldout_validation QUALIFY idx >= 100")
def epoch_order(spark, d):
    return corpus.epoch_order(table(spark, d, "heldout_validation"), "row_id", 9, 2, 100).select("row_id", F.col("idx").cast("bigint").alias("idx"))


@query("SELECT source, row_id FROM (SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY sha1('5:' || row_id::VARCHAR), row_id) AS rn FROM heldout_validation) WHERE rn <= 20")
def sample_per_source(spark, d):
    return corpus.sample_per_group(table(spark, d, "heldout_validation").select("source", "row_id"), ["source"], "row_id", 20, 5)


@query(
    """SELECT user_id, round(list_reduce(list_transform(list(value ORDER BY ts, event_id), lambda x: {'n': 0, 'e': x::DOUBLE}), lambda a, b: {'n': a.n + 1, 'e': a.e - (1 - least(0.9999::DOUBLE, (2 + a.n) / (11 + a.n)::DOUBLE)) * (a.e - b.e)}).e, 6) AS ema FROM events GROUP BY user_id"""
)
def ema(spark, d):
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "value")
    return corpus.ema(rows, ["user_id"], "o", "value").select("user_id", *r6("ema"))


@query("SELECT format('reply_{:05d}_{}', source_index, substr(source_sha1, 1, 8)) AS example_id, source_index FROM reply_benchmark")
def template_ids(spark, d):
    return table(spark, d, "reply_benchmark").select(F.format_string("reply_%05d_%s", "source_index", F.substring("source_sha1", 1, 8)).alias("example_id"), "source_index")


@query(
    """SELECT benchmark_id, mode, CASE mode WHEN 'emoji_only' THEN prompt_emoji WHEN 'text_assisted' THEN coalesce(nullif(frontier_prompt, ''), 'Message: ' || coalesce(instruction, '') || chr(10) || 'Prompt emojis: ' || coalesce(prompt_emoji, ''))
    WHEN 'emoji_constrained' THEN 'Prompt emojis: ' || prompt_emoji || chr(10) || 'Reply with only 2 to 5 emojis. Match the meaning. Do not use words.'
    ELSE 'Emoji message: ' || prompt_emoji || chr(10) || 'Write a NEW emoji-only reply, not a copy of the input.' || chr(10) || 'Use 2 to 5 emojis.' || chr(10) || 'Do not reuse any input emoji unless absolutely necessary.' || chr(10) || 'Reply:' END AS prompt
    FROM reply_benchmark, (VALUES ('emoji_only'), ('text_assisted'), ('emoji_constrained'), ('emoji_no_copy_reply')) m(mode)"""
)  # fixed values: the prompt templates
def prompt_modes(spark, d):
    rows, out = table(spark, d, "reply_benchmark"), None
    for mode in ("emoji_only", "text_assisted", "emoji_constrained", "emoji_no_copy_reply"):
        text = corpus.prompt_text(mode, F.col("prompt_emoji"), F.col("instruction"), F.col("prompt_emoji"), F.col("frontier_prompt"))
        one = rows.select("benchmark_id", F.lit(mode).alias("mode"), text.alias("prompt"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT m.model, b.benchmark_id, s.s::INT AS sample_idx FROM (SELECT DISTINCT model FROM raw_sample) m, reply_benchmark b, range(2) s(s)")
def task_expansion(spark, d):
    models = table(spark, d, "raw_sample").select("model").distinct()
    ids = table(spark, d, "reply_benchmark").select("benchmark_id")
    return ids.crossJoin(F.broadcast(models.limit(1000))).withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(1)))) if models.limit(1001).count() <= 1000 else ids.join(models).withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(1))))


@query()
def permutation_variants(spark, d):
    rows = table(spark, d, "reply_benchmark").select("benchmark_id", tk.emoji_tokens(F.col("prompt_emoji")).alias("tokens"))
    return corpus.permutations(rows, "benchmark_id", 3)


# The generator's prefixes; a share of the messages has none.
PAIR_PREFIXES = ("", "", "", "omg ", "hey ", "honestly ", "ugh ", "wow ", "guys ", "ok ")


@query()
def generated_pairs(spark, d):
    rows = table(spark, d, "reply_benchmark").filter("topic IS NOT NULL")
    messages = rows.groupBy("topic").agg(F.array_distinct(F.collect_list("instruction")).alias("messages"))
    tokens = rows.select("topic", F.explode(tk.emoji_tokens(F.col("target_emoji"))).alias("token")).distinct()
    pools = tokens.groupBy("topic").agg(F.collect_list("token").alias("pool"))
    return corpus.generated_pairs(messages.join(pools, "topic", "left"), 6, 2, 5, PAIR_PREFIXES)


@query()
def streaming_metric_state(spark, d):
    return incremental.metric_state_from_files(spark, f"{d}/events.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the core by name."""
    from . import composites, kernels, search  # noqa: F401  they register theirs

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can express."""
    queries()
    return dict(_SQL)

"""Queries of the composed operators: infill items, curves, order effects, stability, model inputs, files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import corpus, dataset, evaluate, joins, score, split
from ..runtime import durable, shared_folder, spread, table
from ..sources import readers, sinks
from ..streaming import incremental
from . import sql
from .queries import _FP_HELD, _MODELS, _SAMPLES, _SCORED, _SPLIT, _of_models, _pair_sql, _samples, _scored, query, r6, s6

# -- infill ------------------------------------------------------------------

_EXAMPLES = f"""{_SPLIT}, e AS (SELECT format('ex_{{:05d}}_{{}}', h.row_id, substr({_FP_HELD}, 1, 8)) AS example_id, {sql.emoji("h.output")} AS t FROM heldout_validation h JOIN parts USING (row_id)
    WHERE part = 'validation' AND len({sql.emoji("h.input")}) > 0 AND len({sql.emoji("h.output")}) >= 2),
  k AS (SELECT *, greatest(1, len(t) // 2) AS k, list_transform(range(0, len(t)), lambda i: {{'h': sha1('42:' || example_id || ':' || i::VARCHAR), 'i': i}}) AS o FROM e),
  p AS (SELECT example_id, t, k, 'prefix' AS pattern, range(0, k) AS shown FROM k UNION ALL SELECT example_id, t, k, 'suffix', range(len(t) - k, len(t)) FROM k
    UNION ALL SELECT example_id, t, k, 'scattered', list_transform((list_sort(o))[1:k], lambda x: x.i) FROM k)"""


@query(
    f"""{_EXAMPLES} SELECT example_id, pattern, s.s::INT AS sample_idx, k::INT AS revealed_k, (len(t) - k)::INT AS masked_count,
    array_to_string(list_transform(range(0, len(t)), lambda i: CASE WHEN list_contains(shown, i) THEN t[i + 1] ELSE '[MASK]' END), ' ') AS visible_reply,
    array_to_string(list_transform(list_filter(range(0, len(t)), lambda i: NOT list_contains(shown, i)), lambda i: t[i + 1]), '') AS masked_truth FROM p, range(2) s(s)"""
)
def infill_dataset(spark, d):
    """Held-out rows taken out, the validation partition, all patterns, two samples each."""
    examples = evaluate.infill_examples(spread(table(spark, d, "heldout_validation")), table(spark, d, "reply_benchmark"), "row_id", "ex", "validation")
    items = evaluate.infill_items(examples, samples=2)
    return items.select("example_id", "pattern", "sample_idx", "revealed_k", "masked_count", "visible_reply", "masked_truth")


_POWERS = {
    "power_at_k_benchmark_score": "max(benchmark_score)", "power_at_k_bag_f1": "max(bag_f1)", "power_at_k_bag_jaccard": "max(bag_jaccard)", "power_at_k_semantic_cosine": "max(c)",
    "power_at_k_semantic_distance": "min(g)", "power_at_k_embedding_distance": "min(l)", "pass_at_k_semantic": "max((c >= 0.65)::INT)", "pass_at_k_semantic_distance": "max((g <= 0.28)::INT)",
    "pass_at_k_embedding_distance": "max((l <= 0.84)::INT)",
}


@query(
    f"""WITH s AS (SELECT model, prompt_mode, benchmark_id, benchmark_score, bag_f1, bag_jaccard, set_jaccard AS c, acos(greatest(-1, least(1, set_jaccard))) / pi() AS g, sqrt(greatest(0, 2 - 2 * set_jaccard)) AS l,
      row_number() OVER (PARTITION BY model, prompt_mode, benchmark_id ORDER BY sample_id) AS rn FROM ({_SCORED})),
    u AS (SELECT *, prompt_mode AS pattern FROM s UNION ALL SELECT *, 'all' FROM s), n AS (SELECT model, pattern, count(*) AS samples, max(rn) AS m FROM u GROUP BY ALL),
    ks AS (SELECT model, pattern, samples, unnest(range(1, least(7, m) + 1)) AS k FROM n),
    g AS (SELECT u.model, u.pattern, k, samples, benchmark_id, prompt_mode, {", ".join(f"{e} AS {n}" for n, e in _POWERS.items())} FROM u JOIN ks ON u.model = ks.model AND u.pattern = ks.pattern AND rn <= k GROUP BY ALL)
    SELECT model, pattern, k::INT AS k, count(*) AS problems, samples, {", ".join(f"round(avg({n}), 6) AS {n}" for n in _POWERS)} FROM g GROUP BY model, pattern, k, samples"""
)
def infill_curves(spark, d):
    """Pass and power at k by pattern (the prompt mode here) and over all, with semantic thresholds.

    The set Jaccard stands for the cosine that an encoder would supply.
    """
    rows = _scored(spark, d).select("model", "benchmark_id", "sample_id", "prompt_mode", "benchmark_score", "bag_f1", "bag_jaccard", F.col("set_jaccard").alias("semantic_target_cosine"))
    out = evaluate.pass_power(rows.withColumnRenamed("prompt_mode", "pattern"), "model", "pattern", ["benchmark_id"], ["sample_id"], 7)
    return out.select("model", "pattern", "k", "problems", "samples", *r6(*_POWERS))


@query(
    f"""SELECT pattern, rank, row_number() OVER (ORDER BY rank, pattern)::INT AS place FROM (SELECT DISTINCT prompt_mode AS pattern, 4 AS rank FROM ({_SAMPLES})
    UNION ALL SELECT unnest(['prefix', 'all', 'scattered', 'suffix']), unnest([1, 0, 3, 2]))"""
)
def pattern_order(spark, d):
    """Patterns in the order of reports."""
    modes = _samples(spark, d).select(F.col("prompt_mode").alias("pattern")).distinct()
    named = spark.createDataFrame([(p,) for p in evaluate.PATTERN_ORDER], "pattern string").unionByName(modes)
    ranked = named.withColumn("rank", evaluate.pattern_rank(F.col("pattern")))
    return corpus.with_global_index(ranked, ["rank", "pattern"], "place", 1).select("pattern", "rank", F.col("place").cast("int").alias("place"))


# -- order effect and stability ----------------------------------------------

_SLOTS = f"(SELECT model, benchmark_id, sample_idx, variant, max(sample_id) AS sid, arg_max(p, sample_id) AS p, any_value(t) AS t, array_to_string(any_value(pr), '') AS prompt FROM ({_SAMPLES}) GROUP BY ALL)"
_REFS = f"(SELECT DISTINCT array_to_string({sql.emoji('input')}, '') AS prompt, {sql.emoji('output')} AS r FROM heldout_validation WHERE len({sql.emoji('input')}) > 0 AND coalesce(output, '') <> '')"


@query(
    f"""WITH perm AS ({_pair_sql("variant", "", "AND a.sample_idx = 0 AND b.sample_idx = 0")}), res AS ({_pair_sql("sample_idx", "", "AND a.variant = 0 AND b.variant = 0")}),
    o AS ({sql.metrics(f"SELECT * FROM {_SLOTS} WHERE sample_idx = 0")}), b AS (SELECT sid, max(bag_jaccard) AS best FROM ({sql.metrics(f"SELECT s.sid, s.p, f.r AS t FROM {_SLOTS} s JOIN {_REFS} f USING (prompt) WHERE s.sample_idx = 0")}) GROUP BY sid)
    SELECT n.model, {s6("perm_stability", "resample_stability", "target_bag_jaccard", "target_best_jaccard")}, round(resample_stability - perm_stability, 6) AS order_effect FROM
    (SELECT model, avg(bag_jaccard) AS target_bag_jaccard, avg(coalesce(best, bag_jaccard)) AS target_best_jaccard FROM o LEFT JOIN b USING (sid) GROUP BY model) n
    LEFT JOIN (SELECT model, avg(s) AS perm_stability FROM perm GROUP BY model) p ON p.model = n.model LEFT JOIN (SELECT model, avg(s) AS resample_stability FROM res GROUP BY model) r ON r.model = n.model"""
)
def order_effect_summary(spark, d):
    """Order effect with references looked up by prompt, M12 and M16."""
    key = ["model", "benchmark_id", "sample_idx", "variant"]
    rows = _samples(spark, d).filter("sample_idx = 0 OR variant = 0")
    slots = durable(rows.groupBy(*key).agg(F.max("sample_id").alias("sid"), F.max_by("p", "sample_id").alias("p"), F.first("t").alias("t"), F.array_join(F.first("pr"), "").alias("prompt")))
    held = table(spark, d, "heldout_validation").filter("coalesce(output, '') <> ''")
    refs = held.select(tk.emoji_text(F.col("input")).alias("prompt"), tk.emoji_tokens(F.col("output")).alias("r")).filter("prompt <> ''")
    out = evaluate.order_effects(slots.filter("sample_idx = 0"), slots.filter("variant = 0"), refs, "model", "benchmark_id", "sid", "prompt")
    return out.select("model", *r6("perm_stability", "resample_stability", "target_bag_jaccard", "target_best_jaccard", "order_effect"))


_ALL_PAIRS = sql.metrics(f"SELECT a.model, a.benchmark_id, a.p, b.p AS t FROM ({_SAMPLES}) a JOIN ({_SAMPLES}) b ON a.model = b.model AND a.benchmark_id = b.benchmark_id AND a.sample_id < b.sample_id")


@query(
    f"""WITH s AS (SELECT model, benchmark_id, avg(bag_jaccard) AS s FROM ({_ALL_PAIRS}) GROUP BY ALL),
    t AS (SELECT model, benchmark_id, avg(benchmark_score) AS a, avg(bag_f1) AS b, avg(bag_jaccard) AS c FROM ({_SCORED}) GROUP BY ALL)
    SELECT t.model, count(*) AS groups, round(avg(coalesce(s, 1.0)), 6) AS mean_permutation_stability, round(avg(a), 6) AS mean_target_benchmark_score, round(avg(b), 6) AS mean_target_bag_f1, round(avg(c), 6) AS mean_target_bag_jaccard
    FROM t LEFT JOIN s ON s.model = t.model AND s.benchmark_id = t.benchmark_id GROUP BY t.model"""
)
def stability_summary(spark, d):
    """Stability and target alignment, means over groups."""
    out = evaluate.stability_summary(_samples(spark, d).select("model", "benchmark_id", "p", "t"), "model", ["benchmark_id"])
    return out.select("model", "groups", *r6("mean_permutation_stability", "mean_target_benchmark_score", "mean_target_bag_f1", "mean_target_bag_jaccard"))


@query(
    f"""SELECT format('reply_{{:05d}}_{{}}', row_id, coalesce(nullif(topic, ''), 'untagged')) AS group_id, (CASE WHEN len(p) = 2 THEN 2 ELSE 3 END)::BIGINT AS variants, true AS same_bag, array_to_string(p, '') AS first
    FROM (SELECT row_id, topic, {sql.emoji("coalesce(input, '')")} AS p, {sql.emoji("coalesce(output, '')")} AS r FROM heldout_validation) WHERE len(list_distinct(p)) > 1 AND len(r) > 0"""
)
def permutation_groups(spark, d):
    """Orders of the prompts of replies, three each where there are so many."""
    groups = evaluate.permutation_groups(spread(table(spark, d, "heldout_validation")), "row_id", 3)
    bag = F.md5(tk.bag_key(tk.emoji_tokens(F.col("prompt_emoji"))))
    return groups.groupBy("group_id").agg(F.count("*").alias("variants"), (F.min(bag) == F.max(bag)).alias("same_bag"), F.min_by("prompt_emoji", "variant_idx").alias("first"))


_MEANS = ("benchmark_score", "bag_f1", "bag_jaccard", "set_jaccard", "length_score", "exact_bag_match", "exact_sequence_match")


@query(
    f"""WITH last AS (SELECT model, benchmark_id, arg_max(coalesce(generated_emoji, '\x01'), sample_id) AS v FROM raw_sample GROUP BY 1, 2),
    j AS (SELECT k.model, b.benchmark_id, l.benchmark_id IS NULL AS missing, coalesce(nullif(l.v, '\x01'), '') AS pred, b.target_emoji FROM reply_benchmark b CROSS JOIN {_MODELS} k LEFT JOIN last l ON b.benchmark_id = l.benchmark_id AND k.model = l.model),
    m AS ({sql.metrics(f"SELECT model, benchmark_id, missing, {sql.emoji('pred')} AS p, {sql.emoji('target_emoji')} AS t FROM j")})
    SELECT model, count(*) AS problems, count(*) FILTER (missing) AS missing, {", ".join(f"round(avg({n}), 6) AS {n}" for n in _MEANS)} FROM m GROUP BY model"""
)
def prediction_summary(spark, d):
    """The summary over all benchmarks, missing predictions scored as empty."""
    preds = table(spark, d, "raw_sample").select("model", "benchmark_id", "sample_id", "generated_emoji")
    asked = _of_models(spark, d, table(spark, d, "reply_benchmark").select("benchmark_id", "target_emoji"))
    joined = joins.with_predictions(asked, preds, ["model", "benchmark_id"], "sample_id")
    rows = joined.select("model", "missing", tk.emoji_tokens(F.col("prediction")).alias("p"), tk.emoji_tokens(F.col("target_emoji")).alias("t"))
    return evaluate.prediction_summary(score.scored_pairs(rows), ["model"]).select("model", "problems", "missing", *r6(*_MEANS))


# -- model inputs --------------------------------------------------------------


def _char_sql(text: str) -> str:
    one = "CASE WHEN c BETWEEN 'a' AND 'z' AND length(c) = 1 AND ascii(c) < 128 THEN ascii(c) - 89 WHEN c = ' ' THEN 34 ELSE 7 END"
    return f"CASE WHEN coalesce({text}, '') = '' THEN []::INT[] ELSE list_transform(string_split(lower({text}), ''), lambda c: {one}) END"


def _characters(text):
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<int>")).otherwise(tk.character_ids(text))


def _fresh(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


@query(
    f"""WITH d AS (SELECT coalesce(source, '') AS source, doc_id, list_append({_char_sql("x")}, 2) AS ids FROM (SELECT source, doc_id, {sql.DETOKENIZED["wikitext"]("text")} AS x FROM documents)),
    o AS (SELECT source, ids, coalesce(sum(len(ids)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM d),
    f AS (SELECT source, o + i AS o, ids[i + 1] AS id FROM o, LATERAL (SELECT unnest(range(0, len(ids))) AS i))
    SELECT source, (o // 126)::BIGINT AS block_id, md5('1 ' || array_to_string(list(id ORDER BY o), ' ') || ' 2') AS ids FROM f GROUP BY source, o // 126 HAVING count(*) = 126"""
)
def dataset_packed(spark, d):
    """Detokenized, tokenized and packed model inputs of every source, written to and read from their cache."""
    build = dataset.Build("documents", detokenizer="wikitext", block=128)
    rows = lambda: spread(table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text"))
    out = dataset.built(spark, build, rows, _characters, _fresh(spark), ["source"], ["doc_id"])
    return out.select("source", "block_id", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), " ")).alias("ids"))


@query(
    f"""SELECT doc_id, md5(array_to_string(list_concat(s, list_transform(range(0, 64 - len(s)), lambda z: 0)), ' ')) AS ids, len(s)::BIGINT AS attended
    FROM (SELECT doc_id, list_concat([1], list_concat(({_char_sql("text")})[:62], [2])) AS s FROM documents)"""
)
def dataset_padded(spark, d):
    """D6 without wrapping, PF5, S15: one block per text, with its attention; only the model's columns are kept."""
    build = dataset.Build("documents", wrap=False, block=64)
    rows = dataset.filled(dataset.token_rows(spread(table(spark, d, "documents").select("doc_id", "text")), build, _characters), build)
    kept = dataset.model_columns(rows).columns
    attended = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint")
    return rows.select("doc_id", *kept).select("doc_id", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), " ")).alias("ids"), attended.alias("attended"))


@query(
    f"""SELECT row_id FROM heldout_validation WHERE row_id NOT IN (SELECT row_id FROM (SELECT row_id, unnest({sql.emoji("output")}) AS x FROM heldout_validation)
    WHERE x NOT IN (SELECT token FROM emoji_vocab WHERE token IS NOT NULL))"""
)
def vocabulary_members(spark, d):
    """PF9: rows whose tokens are all known."""
    rows = table(spark, d, "heldout_validation").select("row_id", tk.emoji_tokens(F.col("output")).alias("tokens"))
    return dataset.known_rows(rows, table(spark, d, "emoji_vocab"), "row_id").select("row_id")


@query("SELECT row_id, input FROM heldout_validation ORDER BY row_id LIMIT 250")
def first_rows(spark, d):
    """PF10: a prefix of the table, which is the feature here."""
    return dataset.first_rows(table(spark, d, "heldout_validation").select("row_id", "input"), ["row_id"], 250)


@query(f"SELECT row_id, array_to_string(({sql.emoji('output')})[:3], '') AS first FROM heldout_validation")
def token_cap(spark, d):
    """The first three tokens of each reply."""
    return table(spark, d, "heldout_validation").select("row_id", F.array_join(dataset.first_tokens(tk.emoji_tokens(F.col("output")), 3), "").alias("first"))


_INLINE = {"music": (["new song out", "concert tonight"], ["🎵", "🎤", "🎸"]), "food": (["pizza time"], ["🍕", "🥗"]), "rain": (["wet again", "umbrella day"], ["🌧️", "☔"])}


@query("SELECT topic, len(messages)::INT AS messages, array_to_string(pool, '') AS pool FROM (VALUES ('music', ['new song out', 'concert tonight'], ['🎵', '🎤', '🎸']), ('food', ['pizza time'], ['🍕', '🥗'])) t(topic, messages, pool)")
def inline_topics(spark, d):
    """SRC11: topics given inline, of which an allowlist is kept."""
    rows = dataset.allowed(dataset.constant_table(spark, _INLINE), "topic", ("music", "food"))
    return rows.select("topic", F.size("messages").alias("messages"), F.array_join("pool", "").alias("pool"))


# -- files -----------------------------------------------------------------------


@query("SELECT row_id, input, output, (row_number() OVER (ORDER BY row_id) - 1)::BIGINT AS source_index FROM heldout_validation")
def json_lines_round_trip(spark, d):
    """SNK1, SRC1, SRC2: written as JSON lines in order and read back with their line numbers."""
    out = _fresh(spark)
    sinks.json_lines(table(spark, d, "heldout_validation").select("row_id", "input", "output").repartitionByRange("row_id").sortWithinPartitions("row_id"), out)
    return readers.json_lines_with_ordinal(spark, out, "row_id bigint, input string, output string")


@query("SELECT sample_id, model, benchmark_id FROM raw_sample WHERE model IS NOT NULL AND benchmark_id IS NOT NULL")
def csv_round_trip(spark, d):
    """SNK2, SRC3: written as CSV with a header and read by its extension."""
    out = f"{_fresh(spark)}.csv"
    sinks.csv(table(spark, d, "raw_sample").filter("model IS NOT NULL AND benchmark_id IS NOT NULL"), out, ["sample_id", "model", "benchmark_id"])
    return readers.by_extension(spark, out, "sample_id bigint, model string, benchmark_id string")


@query("SELECT 'one' AS model, row_id FROM curated_permutation UNION ALL SELECT 'two', row_id FROM heldout_validation")
def labelled_union(spark, d):
    """SRC10: labelled inputs in one table, missing columns null."""
    return readers.labelled(spark, [f"one={d}/curated_permutation.parquet", f"two={d}/heldout_validation.parquet"]).select("model", "row_id")


@query("SELECT field, count(*) AS n FROM (SELECT unnest(['output', 'prompt_emoji', 'response_emoji', 'instruction', 'input']) AS field, unnest([output, prompt_emoji, response_emoji, instruction, input]) AS text FROM curated_permutation) WHERE text IS NOT NULL GROUP BY field")
def harvest(spark, d):
    """SRC4: every string under any of the aliases."""
    return readers.harvested_strings(table(spark, d, "curated_permutation")).groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT b.benchmark_id, s.s::INT AS sample_idx, length(b.benchmark_id)::INT AS size FROM reply_benchmark b, range(3) s(s)")
def append_resume(spark, d):
    """ST1, SNK9: tasks run into an append log in two runs; the second does only what the first left."""
    log = _fresh(spark)
    ids = table(spark, d, "reply_benchmark").select("benchmark_id")
    tasks = ids.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(2))))
    work = lambda t: t.withColumn("size", F.char_length("benchmark_id"))
    incremental.append_missing(tasks.filter("sample_idx < 2"), log, ["benchmark_id", "sample_idx"], work)
    return incremental.append_missing(tasks, log, ["benchmark_id", "sample_idx"], work)


@query("SELECT topic, instruction, output, min(row_id) AS first FROM heldout_validation WHERE coalesce(output, '') <> '' GROUP BY ALL")
def reference_rows(spark, d):
    """A10, J8 in row form, for groups without a bound."""
    return corpus.reference_rows(table(spark, d, "heldout_validation"), ["topic", "instruction"], "output", "row_id")


@query(
    f"""SELECT part, count(*) AS n FROM (SELECT 'excluded' AS part FROM heldout_validation WHERE {_FP_HELD} IN (SELECT {sql.fingerprint(sql.first_truthy("instruction"), sql.first_truthy("input", "prompt_emoji"), sql.first_truthy("output", "target_emoji"), sql.first_truthy("topic"))} FROM reply_benchmark)
    UNION ALL ({_SPLIT} SELECT part FROM parts) UNION ALL SELECT 'source' FROM heldout_validation) GROUP BY part"""
)
def stage_counters(spark, d):
    """Rows of each stage of the split: source, excluded as held out, train and validation."""
    rows = spread(table(spark, d, "heldout_validation"))
    parts = split.split_rows(rows, "prompt_bag", 0.05, 42, holdout=table(spark, d, "reply_benchmark")).groupBy("part").agg(F.count("*").alias("n"))
    parts = durable(parts)
    source = rows.agg(F.count("*").alias("n")).select(F.lit("source").alias("part"), "n")
    out = source.crossJoin(F.broadcast(parts.agg(F.sum("n").alias("kept"))))  # one row each
    return source.unionByName(parts).unionByName(out.select(F.lit("excluded").alias("part"), (F.col("n") - F.col("kept")).alias("n"))).filter("n > 0")

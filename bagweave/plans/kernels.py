"""Queries of the Column functions for noise, sequences, vectors and parsed replies, on supplied numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alias, bags, noise, vectors
from ..functions import sequences as sq
from ..functions import tokens as tk
from ..operators import sampling, score, semantic, stability
from ..runtime import broadcast_if_small, hash_unit, table
from . import sql
from .queries import _CURATED_IDS, _SAMPLES, _SCORED, _curated_ids, _joined, _samples, _scored, query, r6

#: The mask among five tokens.
_M = 4


def _five(c, name: str) -> list:
    return [F.round(c[i], 4).alias(f"{name}{i}") for i in range(5)]


def _five_sql(c: str, name: str) -> str:
    return ", ".join(f"round({c}[{i + 1}], 4) AS {name}{i}" for i in range(5))


_LOGITS = f"(SELECT vec_id, (embedding::DOUBLE[])[1:5] AS g, (vec_id % 5)::INT AS cur, (vec_id * 7 % 4)::INT AS tgt, {sql.unit("'t:' || vec_id::VARCHAR")} * 0.9 + 0.05 AS t FROM embeddings)"


def _lse(g: str) -> str:
    return f"(list_max({g}) + ln(list_sum(list_transform({g}, lambda x: exp(x - list_max({g}))))))"


_BARRED = "list_transform(g, lambda x, i: CASE WHEN i = 5 THEN -1000000.0::DOUBLE ELSE x END)"
_LOG_P = f"(SELECT vec_id, g, b, cur, tgt, t, -ln(1 - 0.999::DOUBLE * t) AS sigma, list_transform(b, lambda x: x - l) AS lp FROM (SELECT *, {_lse('b')} AS l FROM (SELECT *, {_BARRED} AS b FROM {_LOGITS})))"


def _logits(spark, d):
    rows = table(spark, d, "embeddings")
    t = hash_unit("t", F.col("vec_id")) * 0.9 + 0.05
    out = rows.select("vec_id", F.slice(vectors.doubles(F.col("embedding")), 1, 5).alias("g"), F.pmod("vec_id", F.lit(5)).cast("int").alias("cur"), F.pmod(F.col("vec_id") * 7, F.lit(4)).cast("int").alias("tgt"), t.alias("t"))
    return out.withColumn("sigma", noise.schedule("loglinear", F.col("t"))[0])


def _log_p(spark, d):
    return _logits(spark, d).withColumn("lp", noise.d3pm_parameterized(F.col("g"), _M))


# -- parameterizations, losses, steps -----------------------------------------


@query(f"SELECT vec_id, {_five_sql('CASE WHEN cur = 4 THEN lp ELSE list_transform(g, lambda x, i: CASE WHEN i = cur + 1 THEN 0.0::DOUBLE ELSE -1000000.0 END) END', 'p')} FROM {_LOG_P}")
def subs_parameterized(spark, d):
    return _logits(spark, d).select("vec_id", *_five(noise.subs_parameterized(F.col("g"), F.col("cur"), _M), "p"))


@query(f"SELECT vec_id, {_five_sql('lp', 'p')}, round({_lse('g')}, 4) AS total FROM {_LOG_P}")
def d3pm_parameterized(spark, d):
    free = F.col("g")[0] - noise.d3pm_parameterized(F.col("g"))[0]
    return _logits(spark, d).select("vec_id", *_five(noise.d3pm_parameterized(F.col("g"), _M), "p"), F.round(free, 4).alias("total"))


@query(f"SELECT vec_id, {_five_sql('list_transform(g, lambda x, i: CASE WHEN i = cur + 1 THEN 0.0::DOUBLE ELSE x - ln(exp(sigma) - 1) - ln(4) END)', 's')} FROM {_LOG_P}")
def sedd_parameterized(spark, d):
    return _logits(spark, d).select("vec_id", *_five(noise.sedd_parameterized(F.col("g"), F.col("cur"), F.col("sigma")), "s"))


_EARLIER = "CASE WHEN t - 0.01 = 0 THEN 0.0 ELSE ln((1 - (t - 0.01)) * pm / (t - 0.01) + 1) END"


@query(
    f"""SELECT vec_id, round(CASE WHEN cur = 4 THEN 100 * (0.01 / t * (ln((1 - t) * pm / t + 1) - q) + (1 - 0.01 / t) * (ln((1 - t) * pm / t + 1) - {_EARLIER})) ELSE 0.0 END, 3) AS loss
    FROM (SELECT vec_id, cur, least(t, 0.9999) AS t, lp[tgt + 1] AS q, exp(g[1]) / 3 AS pm FROM {_LOG_P})"""
)
def d3pm_loss(spark, d):
    rows = _log_p(spark, d).select("vec_id", "cur", "t", F.element_at("lp", F.col("tgt") + 1).alias("q"), (F.exp(F.col("g")[0]) / 3).alias("pm"))
    return rows.select("vec_id", F.round(noise.d3pm_loss(F.col("q"), F.col("pm"), F.col("t"), 100, F.col("cur") == _M), 3).alias("loss"))


@query(
    f"""SELECT vec_id, round(CASE WHEN cur = 4 THEN exp(g[1]) + exp(g[2]) + exp(g[3]) + exp(g[4]) - r * g[tgt + 1] + r * (ln(r) - 1) ELSE 0.0 END, 4) AS loss
    FROM (SELECT *, 1 / (exp(sigma) - 1) AS r FROM {_LOG_P})"""
)
def score_entropy(spark, d):
    return _logits(spark, d).select("vec_id", F.round(noise.score_entropy(F.col("g"), F.col("tgt"), F.col("sigma"), F.col("cur") == _M, _M), 4).alias("loss"))


_STEP = "list_transform(lp, lambda x, i: CASE WHEN i = 5 THEN 0.999::DOUBLE * t * 0.5 ELSE exp(x) * (0.999::DOUBLE * t - 0.999::DOUBLE * t * 0.5) END)"
_KEYS = f"list_transform(q, lambda p, i: p / (0.0000000001::DOUBLE - ln({sql.unit("'g:' || vec_id::VARCHAR || ':' || (i - 1)::VARCHAR")} + 0.0000000001::DOUBLE)))"


@query(f"SELECT vec_id, {_five_sql('q', 'q')}, (list_position(k, list_max(k)) - 1)::INT AS drawn FROM (SELECT vec_id, q, {_KEYS} AS k FROM (SELECT vec_id, {_STEP} AS q FROM {_LOG_P}))")
def reverse_step(spark, d):
    at = noise.move_chance(F.col("sigma"))
    q = noise.reverse_step(F.transform("lp", F.exp), at, at * 0.5, _M)
    rows = _log_p(spark, d).select("vec_id", q.alias("q"))
    units = F.transform("q", lambda _, i: hash_unit("g", F.col("vec_id"), i))
    return rows.select("vec_id", *_five(F.col("q"), "q"), noise.drawn(F.col("q"), units).alias("drawn"))


_SCORE = """CASE WHEN cur = 4 THEN list_transform(lp, lambda x, i: CASE WHEN i = 5 THEN 1.0::DOUBLE ELSE exp(x - ln(exp(sigma) - 1)) END)
    ELSE list_transform(lp, lambda x, i: CASE WHEN i = 5 THEN exp(sigma) - 1 WHEN i = cur + 1 THEN 1.0::DOUBLE ELSE 0.0 END) END"""
_STAG = "list_transform(s, lambda x, i: x * exp(h) + CASE WHEN i = 5 THEN (1 - exp(h)) * list_sum(s) ELSE 0.0::DOUBLE END)"
_TRANS = "list_transform(s, lambda x, i: CASE WHEN i = cur + 1 THEN exp(-h) ELSE 0.0::DOUBLE END + CASE WHEN cur = 4 THEN 1 - exp(-h) ELSE 0.0::DOUBLE END)"


@query(
    f"""SELECT vec_id, {_five_sql('s', 's')}, {_five_sql('list_transform(a, lambda x, i: x * b[i])', 'p')}, round(list_sum(list_transform((list_transform(a, lambda x, i: x * b[i]))[1:4], lambda x: x)), 4) AS final
    FROM (SELECT vec_id, s, {_STAG} AS a, {_TRANS} AS b FROM (SELECT vec_id, cur, sigma / 3 AS h, {_SCORE} AS s FROM {_LOG_P}))"""
)
def analytic_step(spark, d):
    rows = _log_p(spark, d).withColumn("s", noise.subs_score(F.col("lp"), F.col("cur"), F.col("sigma"), _M))
    p, last = (noise.analytic_probs(F.col("s"), F.col("cur"), F.col("sigma") / 3, _M, f) for f in (False, True))
    total = F.aggregate(last, F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", *_five(F.col("s"), "s"), *_five(p, "p"), F.round(total, 4).alias("final"))


@query(
    f"""SELECT vec_id, round((1 - exp(-s1)) / 0.999::DOUBLE, 6) AS loglinear, round(s2 / 10, 6) AS linear FROM (SELECT vec_id,
    -ln(1 - exp(t * ln(1 - exp(-(-ln(1 - 0.999::DOUBLE)))) + (1 - t) * ln(1 - exp(-0.001::DOUBLE)))) AS s1, -ln(1 - exp(t * ln(1 - exp(-10.0::DOUBLE)) + (1 - t) * ln(1 - exp(-0.5::DOUBLE)))) - 0.5 AS s2 FROM {_LOGITS})"""
    .replace("round(s2 / 10, 6)", "round(s2 / 9.5, 6)")
)
def importance_time(spark, d):
    rows, t = _logits(spark, d), F.col("t")
    return rows.select("vec_id", F.round(noise.importance_time("loglinear", t), 6).alias("loglinear"), F.round(noise.importance_time("linear", t, low=0.5, high=10.0), 6).alias("linear"))


@query("SELECT event_id, round(CASE WHEN s < 50 THEN 0.0003::DOUBLE * s / 50 ELSE 0.00001 + 0.5 * (0.0003 - 0.00001) * (1 + cos(pi() * (s - 50) / 450)) END, 9) AS lr FROM (SELECT event_id, event_id % 500 AS s FROM events)")
def cosine_lr(spark, d):
    step = F.pmod("event_id", F.lit(500))
    return table(spark, d, "events").select("event_id", F.round(noise.cosine_lr(step, 50, 500, 3e-4, 1e-5), 9).alias("lr"))


@query()
def denoised(spark, d):
    """Cached reverse steps to the end; the prediction is asked only where the ids changed."""
    rows = table(spark, d, "curated_permutation").select("row_id", F.transform(F.slice(tk.emoji_tokens(F.col("prompt_emoji")), 1, 6), lambda _: F.lit(_M)).alias("ids"))
    predict = lambda ids: F.transform(ids, lambda _, i: F.array(*[F.when(F.pmod(i, F.lit(4)) == v, 0.7).otherwise(0.1) for v in range(4)], F.lit(0.0)))
    return sampling.denoised(rows, "row_id", predict, 8, _M).select("row_id", _joined(F.col("ids")).alias("ids"), "asked")


# -- sequences ------------------------------------------------------------------


@query(f"SELECT row_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i % 2 = 0 THEN x + 1000 ELSE x END), ' ') AS ids FROM {_CURATED_IDS}")
def clamped(spark, d):
    given, cond = F.transform("ids", lambda x: x + 1000), F.transform("ids", lambda _, i: F.pmod(i, F.lit(2)))
    return _curated_ids(spark, d).select("row_id", _joined(sq.clamped(F.col("ids"), given, cond)).alias("ids"))


@query(f"SELECT row_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i = 4 THEN 2 WHEN i > 4 THEN 0 ELSE x END), ' ') AS ids FROM {_CURATED_IDS}")
def decode_cap(spark, d):
    return _curated_ids(spark, d).select("row_id", _joined(sq.capped(F.col("ids"), 1, 2, 2, 0)).alias("ids"))


@query(
    f"""SELECT row_id, array_to_string(list_prepend(1, s[(row_id % 5 + 2):(row_id % 5 + 6)]), ' ') AS crop, array_to_string(ids[1:len(ids) - 1], ' ') AS inputs, array_to_string(ids[2:], ' ') AS targets
    FROM (SELECT row_id, ids, list_concat(ids, list_transform(range(0, 12), lambda i: 100 + i::INT)) AS s FROM {_CURATED_IDS} WHERE len(ids) > 0)"""
)
def crop_and_shift(spark, d):
    rows = _curated_ids(spark, d).filter(F.size("ids") > 0)
    double = F.concat("ids", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i + 100))
    pair = sq.shifted(F.col("ids"))
    return rows.select("row_id", _joined(noise.cropped(double, F.pmod("row_id", F.lit(5)).cast("int"), 6, 1)).alias("crop"), _joined(pair["inputs"]).alias("inputs"), _joined(pair["targets"]).alias("targets"))


@query("SELECT row_id, array_to_string(range(row_id % 10, row_id % 10 + 12), ' ') AS ids FROM curated_permutation")
def stitched(spark, d):
    at = F.pmod("row_id", F.lit(10))
    windows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda w: F.sequence(at + w * 2, at + w * 2 + 5))
    return table(spark, d, "curated_permutation").select("row_id", _joined(sq.stitched(windows, 2)).alias("ids"))


@query(
    f"""SELECT row_id, round(sum(n * m) / sum(m), 6) AS nll, round(exp(sum(n * m) / sum(m)), 4) AS ppl FROM (SELECT row_id, {sql.unit("'nll:' || row_id::VARCHAR || ':' || (i - 1)::VARCHAR")} * 3 AS n,
    (coalesce(list_position(ids, 200), 0) = 0 OR i <= list_position(ids, 200))::INT AS m FROM {_CURATED_IDS}, LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i)) GROUP BY row_id"""
)
def generation_perplexity(spark, d):
    """The loss of a supplied scorer up to the first end."""
    rows = _curated_ids(spark, d).withColumn("m", sq.first_end_mask(F.col("ids"), 200))
    flat = rows.select("row_id", F.posexplode("m").alias("i", "m"))
    nll = F.sum(hash_unit("nll", F.col("row_id"), F.col("i")) * 3 * F.col("m")) / F.sum("m")
    return flat.groupBy("row_id").agg(F.round(nll, 6).alias("nll"), F.round(F.exp(nll), 4).alias("ppl"))


_PAIR = f"(SELECT row_id, list_concat([1], list_concat(ids[:5], list_concat([3], list_concat(list_transform(range(0, row_id % 5), lambda i: 300 + i::INT), [2, 0, 0])))) AS s, least(len(ids), 5) AS left_size, (row_id % 5)::INT AS right_size FROM {_CURATED_IDS})"


def _pairs(spark, d):
    n = F.pmod("row_id", F.lit(5)).cast("int")
    right = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i + 300))
    left = F.slice("ids", 1, 5)
    s = F.concat(F.array(F.lit(1)), left, F.array(F.lit(3)), right, F.array(F.lit(2), F.lit(0), F.lit(0)))
    return _curated_ids(spark, d).select("row_id", s.alias("s"), F.size(left).alias("left_size"), n.alias("right_size"))


@query(f"SELECT row_id, array_to_string(list_transform(range(0, right_size), lambda i: 300 + i), ' ') AS reply, right_size::BIGINT AS eos_rel, (right_size + 1)::BIGINT AS pad_rel, right_size::BIGINT AS decoded_len FROM {_PAIR}")
def reply_part(spark, d):
    """The reply within a paired sequence, and where its decoding stops."""
    stop = sq.stop_statistics(F.slice("s", F.col("left_size") + 3, F.size("s")), 2, 0)
    return _pairs(spark, d).select("row_id", _joined(sq.reply_part(F.col("s"), 3, 2, 0)).alias("reply"), stop["eos_rel"].alias("eos_rel"), stop["pad_rel"].alias("pad_rel"), stop["decoded_len"].alias("decoded_len"))


_MIXED = "list_transform(list_sort(list_transform(range(0, left_size), lambda i: {'h': sha1('8:' || row_id::VARCHAR || ':' || i::VARCHAR), 'x': s[i + 2]})), lambda z: z.x)"


@query(f"SELECT row_id, array_to_string(list_concat(s[1:1], list_concat({_MIXED}, s[left_size + 2:])), ' ') AS ids FROM {_PAIR}")
def training_permutation(spark, d):
    """The prompt span of a training sequence in hash order."""
    mixed = sq.shuffled_span(F.col("s"), F.lit(1), F.col("left_size"), F.concat_ws(":", F.lit("8"), F.col("row_id")))
    return _pairs(spark, d).select("row_id", _joined(mixed).alias("ids"))


@query(
    f"""SELECT row_id, k, array_to_string(list_transform(range(0, len(s)), lambda i: CASE WHEN i < left_size + 2 OR i < left_size + 2 + k THEN 1 ELSE 0 END), '') AS cond
    FROM (SELECT *, least(greatest(1, round_even(right_size * 0.5, 0)), right_size - 1)::INT AS k FROM {_PAIR} WHERE right_size >= 2)"""
)
def training_infill(spark, d):
    """A rounded half of the reply, from its beginning, joins what is given."""
    rows = _pairs(spark, d).filter("right_size >= 2").withColumn("k", sq.reveal_count_training(F.col("right_size"), 0.5))
    start = F.col("left_size") + 2
    cond, attention = F.transform("s", lambda _, i: (i < start).cast("int")), F.transform("s", lambda _: F.lit(1))
    shown = sq.reveal_positions(F.col("right_size"), F.col("k"), "prefix")
    return rows.select("row_id", "k", F.array_join(sq.conditioned(cond, attention, start, shown).cast("array<string>"), "").alias("cond"))


@query(f"SELECT row_id, '1 ' || CASE WHEN len(ids) > 0 THEN array_to_string(ids, ' ') || ' ' ELSE '' END || '2' AS ids, '1' || repeat('0', len(ids)) || '1' AS specials, len(ids)::INT AS decoded FROM {_CURATED_IDS}")
def specials_layout(spark, d):
    """Ids between their marks, which of them are special, and the tokens that decoding leaves."""
    rows = _curated_ids(spark, d).select("row_id", tk.with_specials(F.col("ids"), 1, 2).alias("ids"))
    plain = F.filter("ids", lambda i: ~i.isin(1, 2))
    return rows.select("row_id", _joined(F.col("ids")).alias("ids"), F.array_join(tk.specials_mask(F.col("ids"), [1, 2]).cast("array<string>"), "").alias("specials"), F.size(plain).alias("decoded"))


@query("SELECT row_id, array_to_string(list_transform(range(0, row_id % 4), lambda i: chr((97 + i)::INT)), '') AS text FROM curated_permutation")
def decode_ids(spark, d):
    ids = F.concat(F.array(F.lit(1)), F.transform(F.slice(F.array(*map(F.lit, (10, 11, 12))), F.lit(1), F.pmod("row_id", F.lit(4)).cast("int")), lambda x: x), F.array(F.lit(2), F.lit(99)))
    return table(spark, d, "curated_permutation").select("row_id", tk.decode(ids, {10: "a", 11: "b", 12: "c"}, [1, 2]).alias("text"))


# -- replies --------------------------------------------------------------------


@query("SELECT sample_id, coalesce(generated_emoji, '') AS text, finish_reason FROM raw_sample WHERE finish_reason IS NOT NULL")
def reply_content(spark, d):
    """The content of chat responses, half of them as a list of parts."""
    rows = table(spark, d, "raw_sample").filter("finish_reason IS NOT NULL")
    text = alias.json_quoted(F.coalesce("generated_emoji", F.lit("")))
    parts = F.concat(F.lit('[{"type": "text", "text": '), text, F.lit('}, {"type": "image", "url": "x"}]'))
    content = F.when(F.pmod("sample_id", F.lit(2)) == 0, text).otherwise(parts)
    response = F.concat(F.lit('{"choices": [{"message": {"content": '), content, F.lit('}, "finish_reason": '), alias.json_quoted(F.col("finish_reason")), F.lit("}]}"))
    got = alias.reply_content(response)
    return rows.select("sample_id", got["text"].alias("text"), got["finish_reason"].alias("finish_reason"))


@query("SELECT source_index, coalesce(nullif(benchmark_id, '') || '|', '|') || coalesce(prompt_emoji, '') || '|' AS example_id, 'unknown' AS pattern FROM reply_benchmark")
def problem_keys(spark, d):
    """Problem keys where no example_id is given."""
    rows = table(spark, d, "reply_benchmark").select("source_index", "benchmark_id", "prompt_emoji")
    key = alias.problem_key(rows)
    return rows.select("source_index", key["example_id"].alias("example_id"), key["pattern"].alias("pattern"))


_REF_PAIRS = f"SELECT s.sample_id, s.p, {sql.emoji('b.reference_replies[r.i]')} AS t FROM ({_SAMPLES}) s JOIN reply_benchmark b ON s.benchmark_id = b.benchmark_id, LATERAL (SELECT unnest(range(1, len(b.reference_replies) + 1)) AS i) r"


@query(f"SELECT s.sample_id, round(coalesce(j, 0.0), 6) AS best FROM ({_SAMPLES}) s LEFT JOIN (SELECT sample_id, max(bag_jaccard) AS j FROM ({sql.metrics(_REF_PAIRS)}) GROUP BY sample_id) m ON m.sample_id = s.sample_id")
def best_reference_jaccard(spark, d):
    """The best bag Jaccard over a sample's references."""
    refs = table(spark, d, "reply_benchmark").select("benchmark_id", F.transform("reference_replies", tk.emoji_tokens).alias("refs"))
    rows = _samples(spark, d).select("sample_id", "benchmark_id", "p").join(broadcast_if_small(refs, 50_000), "benchmark_id")
    return rows.select("sample_id", F.round(bags.best_jaccard(F.col("p"), F.col("refs")), 6).alias("best"))


@query(f"SELECT model, benchmark_id, round(avg(bag_jaccard), 6) AS alignment FROM ({_SCORED}) GROUP BY ALL")
def target_alignment(spark, d):
    return stability.target_alignment(_samples(spark, d), ["model", "benchmark_id"]).select("model", "benchmark_id", *r6("alignment"))


@query(f"SELECT model, round(avg(coalesce(v, 0)), 6) AS zero_for_missing, round(coalesce(avg(v), 0), 6) AS over_present FROM (SELECT model, CASE WHEN bag_f1 > 0 THEN bag_f1 END AS v FROM ({_SCORED})) GROUP BY model")
def mean_rules(spark, d):
    """A1, A2: means with missing values as 0, and over those there are."""
    rows = _scored(spark, d).select("model", F.when(F.col("bag_f1") > 0, F.col("bag_f1")).alias("v"))
    return rows.groupBy("model").agg(F.round(score.mean0("v"), 6).alias("zero_for_missing"), F.round(score.mean_or_zero("v"), 6).alias("over_present"))


# -- vectors --------------------------------------------------------------------


@query(
    """SELECT vec_id, round((e[1] + CASE WHEN vec_id % 2 = 1 THEN e[9] ELSE 0 END + e[17]) / (2 + vec_id % 2), 6) AS d1, round((e[8] + CASE WHEN vec_id % 2 = 1 THEN e[16] ELSE 0 END + e[24]) / (2 + vec_id % 2), 6) AS d8
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"""
)
def masked_mean(spark, d):
    """V1: the mean of three vectors of which one may be masked."""
    e = vectors.doubles(F.col("embedding"))
    mean = vectors.masked_mean(F.array(*[F.slice(e, a, 8) for a in (1, 9, 17)]), F.array(F.lit(1), F.pmod("vec_id", F.lit(2)).cast("int"), F.lit(1)))
    rows = table(spark, d, "embeddings").select("vec_id", mean.alias("m"))
    return rows.select("vec_id", F.round(F.col("m")[0], 6).alias("d1"), F.round(F.col("m")[7], 6).alias("d8"))


_KNOWN = "(SELECT v.token, e.embedding::DOUBLE[] AS x FROM emoji_vocab v JOIN embeddings e ON e.vec_id = v.token_id WHERE v.token IS NOT NULL)"


@query(
    f"""WITH f AS (SELECT row_id, unnest({sql.emoji("output")}) AS token FROM heldout_validation), m AS (SELECT row_id, d, avg(x[d]) AS m FROM f JOIN {_KNOWN} USING (token), range(1, 65) r(d) GROUP BY ALL),
    n AS (SELECT row_id, greatest(sqrt(sum(m * m)), 1e-12) AS n, max(m) FILTER (d = 1) AS a, max(m) FILTER (d = 64) AS b FROM m GROUP BY row_id)
    SELECT h.row_id, round(a / n, 6) AS d1, round(b / n, 6) AS d64 FROM heldout_validation h LEFT JOIN n ON n.row_id = h.row_id"""
)
def text_embeddings(spark, d):
    """V5: texts as the normalised mean of their known tokens; null where none is known."""
    vocab = table(spark, d, "emoji_vocab").filter("token IS NOT NULL")
    known = vocab.join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("token_id")).select("token", "embedding")
    rows = table(spark, d, "heldout_validation").select("row_id", tk.emoji_tokens(F.col("output")).alias("tokens"))
    out = semantic.text_embeddings(rows, "row_id", known)
    return out.select("row_id", F.round(F.col("embedding")[0], 6).alias("d1"), F.round(F.col("embedding")[63], 6).alias("d64"))


@query(
    """SELECT vec_id, round(coalesce(g, acos(greatest(-1, least(1, c))) / pi()), 6) AS geodesic, round(sqrt(greatest(0, 2 - 2 * c)), 6) AS l2 FROM
    (SELECT vec_id, embedding[1]::DOUBLE AS c, CASE WHEN vec_id % 3 = 0 THEN 0.125::DOUBLE END AS g FROM embeddings)"""
)
def filled_distances(spark, d):
    """V9: distances made from the cosine where they are missing."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("semantic_target_cosine"), F.when(F.pmod("vec_id", F.lit(3)) == 0, 0.125).alias("semantic_geodesic_distance"))
    out = score.with_semantic_distances(rows)
    return out.select("vec_id", F.round("semantic_geodesic_distance", 6).alias("geodesic"), F.round("semantic_embedding_distance", 6).alias("l2"))

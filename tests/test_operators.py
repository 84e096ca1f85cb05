import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from bagweave.operators import corpus, joins, score, semantic, split, stability
from bagweave.runtime import broadcast_if_small, lookup_skewed
from bagweave.sources import readers, sinks
from bagweave.streaming import incremental


def test_skewed_lookup_of_hot_missing_and_null_keys(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(3000)] + [(f"c{k % 700}", 5000 + k) for k in range(1400)] + [(None, 9000), ("gone", 9001)], "key string, v int")
    keyed = rows.filter("key <> 'gone'").groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    assert lookup_skewed(rows, keyed, ["key"], "n").count() == 4400
    left = lookup_skewed(rows, keyed, ["key"], "n", "left")
    assert left.count() == 4402 and left.filter("m IS NULL").count() == 2
    assert left.filter("key = 'hot' AND m = 2999").count() == 3000
    assert lookup_skewed(rows, keyed.limit(0), ["key"], "n").count() == 0


def test_broadcast_only_when_counted_small(spark):
    assert "broadcast" in str(broadcast_if_small(spark.range(5), 10)._jdf.queryExecution().logical()).lower()
    assert "broadcast" not in str(broadcast_if_small(spark.range(50), 10)._jdf.queryExecution().logical()).lower()


def test_joins(spark):
    bench = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, target string")
    preds = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, None), ("d", 1, "q")], "id string, o int, output string")
    got = {r.id: (r.prediction, r.missing) for r in joins.with_predictions(bench, preds, "id", "o").collect()}
    assert got == {"a": ("new", False), "b": ("", False), "c": ("", True)}
    tasks = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "k string, v int")
    left = joins.remaining_tasks(tasks, spark.createDataFrame([("a", None), ("b", 1)], "k string, v int"), ["k", "v"])
    assert [tuple(r) for r in left.collect()] == [("a", 1)]


def test_split_is_disjoint_exact_and_half_even(spark):
    assert [split.holdout_size(n, 0.5) for n in (1, 2, 3, 5, 7)] == [0, 1, 2, 2, 4] and split.holdout_size(352, 0.1) == 35
    rows = spark.createDataFrame([(k, "😀" * (1 + k % 40), "x") for k in range(400)], "row_id int, input string, output string")
    parts = split.split_rows(rows, "prompt_bag", 0.1, 42).collect()
    held = {r.input for r in parts if r.part == "validation"}
    assert len(held) == 4 and not held & {r.input for r in parts if r.part == "train"} and len(parts) == 400
    assert split.partition_rows(rows, "validation", "prompt_bag", 0.1).count() == 40
    one_key = rows.filter("row_id % 40 = 0")
    assert split.partition_rows(one_key, "validation", "prompt_bag").count() == one_key.count()
    assert set(split.split_rows(one_key.unionByName(one_key), "prompt_bag", 0.5).toPandas()["part"]) <= {"train", "validation"}
    with pytest.raises(ValueError):
        split.partition_rows(rows, "test")


def test_curves_carry_short_problems(spark):
    rows = spark.createDataFrame([("m", "p", 0, 0.1), ("m", "p", 1, 0.5), ("m", "p", 2, 0.3), ("m", "q", 0, 0.2), ("n", "r", 0, None)], "model string, problem string, s int, x double")
    got = {(r.model, r.k): (r.best, r.hit, r.problems) for r in score.curves(rows, ["model"], ["problem"], ["s"], {"best": "x"}, {"hit": F.col("x") >= 0.3}, 7).collect()}
    assert got.keys() == {("m", 1), ("m", 2), ("m", 3), ("n", 1)}
    assert math.isclose(got["m", 3][0], 0.35) and got["m", 2][1] == 0.5 and got["n", 1] == (0.0, 0.0, 1)


def test_first_best_and_all_bucket(spark):
    rows = spark.createDataFrame([("p", 0, 0.5), ("p", 1, 0.9), ("p", 2, 0.9)], "problem string, s int, score double")
    r = score.first_and_best(rows, ["problem"], "s", "score").first()
    assert (r.first.s, r.best.s, r.samples) == (0, 1, 3)
    bucketed = score.with_all_bucket(spark.createDataFrame([("x",), (None,)], "b string"), "b").groupBy("b").count().collect()
    assert {r.b: r["count"] for r in bucketed} == {"x": 1, "unknown": 1, "all": 2}
    assert math.isnan(rows.limit(0).agg(score.mean0("score")).first()[0]) and rows.limit(0).agg(score.mean_or_zero("score")).first()[0] == 0.0


def test_references_as_rows_and_as_expression_agree(spark):
    from bagweave.functions import bags

    rows = spark.createDataFrame([(1, ["a"], [[], ["b"], ["a", "x"], ["x", "a"]]), (2, ["a"], [[]]), (3, [], None), (4, None, [["q"]]), (5, ["a", "b"], [["b", "a"], ["a", "b"]])], "k int, p array<string>, refs array<array<string>>")
    got = {r.k: (r.reference, r.benchmark_score, r.bag_f1) for r in score.scored_references(rows, "k").collect()}
    other = rows.select("k", bags.best_reference(F.col("p"), F.col("refs")).alias("m")).select("k", "m.*").collect()
    assert got == {r.k: (r.reference, r.benchmark_score, r.bag_f1) for r in other} and got[1][0] == 2 and got[3] == (-1, 1.0, 1.0)


def test_stability(spark):
    rows = spark.createDataFrame([("g", 0, ["a"]), ("g", 1, ["a"]), ("g", 2, ["b"]), ("h", 0, [])], "g string, o int, p array<string>")
    got = {r.g: (r.stability, r.members) for r in stability.group_stability(rows, ["g"]).collect()}
    assert math.isclose(got["g"][0], 1 / 3) and got["h"] == (1.0, 1)
    v = spark.createDataFrame([("p", 0, 0, 1, ["a"]), ("p", 0, 1, 2, ["b"]), ("p", 0, 1, 3, ["a"]), ("q", 0, 0, 4, ["a"])], "problem string, s int, v int, o int, p array<string>")
    assert [tuple(r) for r in stability.variant_stability(v, ["problem"], "s", "v", "o").collect()] == [("p", 1.0, 1)]


def test_index_packing_and_shards(spark):
    rnd = random.Random(1)
    rows = [(k, "hot" if k % 3 else "b", [rnd.randrange(100) for _ in range(rnd.randrange(6))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, part string, ids array<int>").repartition(5)
    idx = corpus.with_global_index(df.select("k"), ["k"], "i").collect()
    assert {r.k: r.i for r in idx} == {k: k for k in range(200)}
    got = {(r.part, r.block_id): r.input_ids for r in corpus.packed(df, ["part"], ["k"], 10, -1, -2).collect()}
    for part in ("hot", "b"):
        flat = [i for k, p, ids in rows if p == part for i in ids]
        for b in range(len(flat) // 8):
            assert got.pop((part, b)) == [-1, *flat[b * 8 : b * 8 + 8], -2]
    assert not got
    shards = [sorted(r.k for r in corpus.shard(df.select("k"), ["k"], 7, x).collect()) for x in range(7)]
    assert {len(s) for s in shards} == {29} and set().union(*shards) == set(range(200))
    assert sum(corpus.shard(df.select("k"), ["k"], 7, x, drop_last=True).count() for x in range(7)) == 196
    with pytest.raises(ValueError):
        corpus.packed(df, ["part"], ["k"], 2, 0, 0)


def test_vocabulary_encoding_and_references(spark):
    rows = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, ["zz", "a"])], "id int, tokens array<string>")
    vocab = corpus.vocabulary(rows)
    assert {r.token: r.token_id for r in vocab.collect()} == {"a": 5, "b": 6, "zz": 7}
    assert {r.id: r.ids for r in corpus.encode(rows, vocab.filter("token <> 'zz'"), "id", 4).collect()} == {1: [6, 5], 2: [], 3: [4, 5]}
    refs = corpus.references(spark.createDataFrame([("t", "x", 2), ("t", "y", 1), ("t", "x", 0), ("t", "", 3)], "t string, v string, o int"), ["t"], "v", "o")
    assert refs.first().references == ["x", "y"]


def test_sampling_ema_and_generators(spark):
    perms = corpus.permutations(spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x"]), ("c", [])], "id string, tokens array<string>"), "id", 4).collect()
    by = {i: [r.variant for r in perms if r.id == i] for i in "abc"}
    assert len(set(by["a"])) == 4 and by["a"][0] == "xyz" and by["b"] == ["x"] and by["c"] == [""]
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    e = values[0]
    for n, v in enumerate(values[1:], 1):
        e -= (1 - min(0.9999, (1 + n) / (10 + n))) * (e - v)
    got = corpus.ema(spark.createDataFrame([("g", k, v) for k, v in enumerate(values)], "g string, o int, v double"), ["g"], "o", "v").first().ema
    assert math.isclose(got, e)
    long = [math.sin(k) for k in range(300)]
    for decay, warm in ((0.9, True), (0.9, False)):
        e = long[0]
        for n, v in enumerate(long[1:], 1):
            e -= (1 - (min(decay, (1 + n) / (10 + n)) if warm else decay)) * (e - v)
        df = spark.createDataFrame([("g", k, v) for k, v in enumerate(long)] + [("h", 0, 2.0)], "g string, o int, v double").repartition(5)
        out = {r.g: r.ema for r in corpus.ema(df, ["g"], "o", "v", decay, warm).collect()}
        assert math.isclose(out["g"], e, rel_tol=1e-9) and out["h"] == 2.0
    top = corpus.top_per_group(spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("b")), ["g"], [F.col("id")], 4)
    assert sorted((r.g, r.id, r.rn) for r in top.collect()) == [("b", 1, 1), ("b", 2, 2), ("b", 4, 3), ("b", 5, 4), ("hot", 0, 1), ("hot", 3, 2), ("hot", 6, 3), ("hot", 9, 4)]
    head, tail = corpus.tail_slice(spark.range(10), ["id"], 3)
    assert head.count() == 7 and sorted(r.id for r in tail.collect()) == [7, 8, 9]
    assert corpus.repeated(spark.range(3), 0).count() == 0 and corpus.repeated(spark.range(3), 4).count() == 12
    resumed = corpus.epoch_order(spark.range(20), "id", 1, 0, 5)
    assert resumed.count() == 15


def test_generated_pairs_and_semantic_passes(spark):
    topics = spark.createDataFrame([("t", ["I am late", "Big game"], ["a", "b", "c"])], "topic string, messages array<string>, pool array<string>")
    rows = corpus.generated_pairs(topics, 20, 1, 2, ("Ok ",)).collect()
    assert {r.instruction for r in rows} == {"Ok I am late", "Ok big game"} and len({(r.instruction, r.output) for r in rows}) == len(rows)
    assert all(1 <= len(r.output) <= 2 and len(set(r.output)) == len(r.output) and set(r.prompt_emoji) <= set("abc") for r in rows)
    df = score.with_semantic_distances(spark.createDataFrame([(1.0, None), (0.0, 0.1)], "semantic_target_cosine double, semantic_geodesic_distance double"))
    got = [tuple(r) for r in df.select("semantic_geodesic_distance", F.round("semantic_embedding_distance", 4), *[c.alias(n) for n, c in score.semantic_passes().items()]).collect()]
    assert got == [(0.0, 0.0, True, True, True), (0.1, 1.4142, False, True, False)]


def test_nearest_against_brute_force(spark):
    rnd = random.Random(2)
    vecs = [(k, [rnd.gauss(0, 1) for _ in range(5)]) for k in range(60)] + [(100, None)]
    semantic_block, semantic.BLOCK = semantic.BLOCK, 16
    try:
        got = {(r.id, r["rank"]): r.neighbour for r in semantic.nearest(spark.createDataFrame(vecs, "id bigint, v array<double>"), "id", "v", 3).collect()}
    finally:
        semantic.BLOCK = semantic_block
    unit = {k: [x / math.sqrt(sum(y * y for y in v)) for x in v] for k, v in vecs if v}
    for k in unit:
        order = sorted((o for o in unit if o != k), key=lambda o: -sum(a * b for a, b in zip(unit[k], unit[o])))
        assert [got[k, r] for r in (1, 2, 3)] == order[:3]


def test_token_and_text_embeddings(spark):
    rows = spark.createDataFrame([(["a", "a"], [1.0, 0.0]), (["b"], [0.0, 1.0])], "tokens array<string>, vector array<double>")
    table = semantic.token_embeddings(rows)
    got = {r.token: [round(x, 6) for x in r.embedding] for r in table.collect()}
    assert got == {"a": [0.707107, -0.707107], "b": [-0.707107, 0.707107]}
    texts = semantic.text_embeddings(spark.createDataFrame([(1, ["a", "q"]), (2, ["q"])], "id int, tokens array<string>"), "id", table).collect()
    assert {r.id: r.embedding and round(r.embedding[0], 6) for r in texts} == {1: 0.707107, 2: None}


# -- sources, sinks, streaming -------------------------------------------------


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "s": "é"}\n\n{"x": 2}\n')
    got = readers.json_lines_with_ordinal(spark, str(tmp_path / "a.jsonl"), "x int, s string").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, "é"), (2, 2, None)]
    (tmp_path / "b.tsv").write_text("x\ts\n1\ta,b\n")
    assert readers.by_extension(spark, str(tmp_path / "b.tsv")).first().s == "a,b"
    with pytest.raises(ValueError):
        readers.by_extension(spark, "x.bin")
    both = readers.labelled(spark, [f"m={tmp_path}/a.jsonl", f"{tmp_path}/b.tsv"])
    assert {r.model for r in both.collect()} == {"m", "b"}
    assert sorted(tuple(r) for r in readers.harvested_strings(spark.createDataFrame([("a", None, "b")], "instruction string, input string, output string")).collect()) == [("instruction", "a"), ("output", "b")]
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t", "abcdefghij")
    assert sorted(tuple(r) for r in readers.zipped_text(spark, str(tmp_path / "t.zip"), (5,), 2).collect()) == [(0, 0, "ab"), (0, 1, "cd"), (1, 0, "fg"), (1, 1, "hi")]
    calls = []
    for _ in range(2):
        assert readers.cached(spark, str(tmp_path / "c"), lambda: (calls.append(1), spark.range(3))[1]).count() == 3
    assert calls == [1] and readers.cache_name({"a": 1, "b": 2}) == readers.cache_name({"b": 2, "a": 1})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é|", 1, 0.51234), ("b", 2, 2.0)], "m string, k int, y double")
    sinks.json_lines(df, str(tmp_path / "j"))
    assert "é" in "".join(f.read_text() for f in (tmp_path / "j").glob("part*"))
    sinks.csv(df.coalesce(1), str(tmp_path / "c"), ["k", "m"])
    assert next((tmp_path / "c").glob("part*")).read_text().startswith("k,m\n1,é|")
    assert sinks.markdown_table(df).splitlines()[2] == "| é\\| | 1 | 0.5123 |"
    svg = sinks.svg_lines(df, "k", "y", "m", "T")
    assert svg.count("<polyline") == 2 and "-" not in svg.split('points="')[2].split('"')[0]


def test_streaming(spark, tmp_path):
    src, log = tmp_path / "in", str(tmp_path / "log")
    spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 1.0)], "k string, v double, w double").write.parquet(str(src))
    stream = spark.readStream.schema("k string, v double, w double").parquet(str(src))
    run = incremental.score_stream(stream, lambda d: d.withColumn("s", F.col("v") * F.col("w")), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination()
    assert sorted(r.s for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2.0, 3.0]
    tasks = spark.createDataFrame([(1,), (2,)], "id int")
    work = lambda t: t.withColumn("done", F.lit(True))
    incremental.append_missing(tasks.limit(1), log, ["id"], work)
    assert incremental.append_missing(tasks, log, ["id"], work).count() == 2


def test_streaming_state_of_the_event_table(spark, small):
    got = {r.event_type: r.nll for r in incremental.metric_state_from_files(spark, f"{small}/events.parquet").collect()}
    wanted = {r.event_type: r.m for r in spark.read.parquet(f"{small}/events.parquet").groupBy("event_type").agg(F.avg("value").alias("m")).collect()}
    assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k]) for k in got)


def test_generated_pairs_draw_on_and_use_the_whole_pool(spark, tmp_path):
    from bagweave.plans import queries as Q

    topics = spark.createDataFrame([("t", ["One", "Two", "Three"], ["b", "a"]), ("none", ["Four"], None)], "topic string, messages array<string>, pool array<string>")
    got = {}
    for r in corpus.generated_pairs(topics, 4, 1, 2).collect():
        got.setdefault(r.instruction, []).append(r.output)
    assert {k: sorted(v) for k, v in got.items()} == {"One": ["a", "ab", "b", "ba"], "Two": ["a", "ab", "b", "ba"], "Three": ["a", "ab", "b", "ba"], "Four": [""]}

    emoji = [chr(0x1F400 + k) for k in range(60)]
    rows = [("t", f"message {k}", emoji[k % 60] + emoji[(7 * k + 1) % 60]) for k in range(200)]
    bench = spark.createDataFrame(rows, "topic string, instruction string, target_emoji string")
    pairs = []
    for n in (1, 7):
        bench.repartition(n).write.parquet(f"{tmp_path}/{n}/reply_benchmark.parquet")
        pairs.append(sorted(map(tuple, Q.generated_pairs(spark, f"{tmp_path}/{n}").collect())))
    assert pairs[0] == pairs[1] and len(pairs[0]) == 200 * 6
    assert {c for p in pairs[0] for c in p[4]} == set(emoji) and {len(p[4]) for p in pairs[0]} == {2, 3, 4, 5}


def test_noise_table_of_every_vector(spark, tmp_path):
    from bagweave.plans import queries as Q

    spark.range(700).select(F.col("id").alias("vec_id")).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = Q.noise_table(spark, str(tmp_path)).collect()
    assert {r.vec_id for r in rows} == set(range(700)) and all(0 <= r.linear < 10 and r.loglinear >= 0 for r in rows)


def test_predictions_and_summary_of_every_model(spark, small):
    from bagweave.plans import queries as Q
    from bagweave.runtime import table

    models = {r.model for r in table(spark, small, "raw_sample").select("model").distinct().collect()} - {None}
    benchmarks = table(spark, small, "reply_benchmark").count()
    for q in (Q.left_join_missing, Q.resume_anti):
        assert {r.model for r in q(spark, small).select("model").distinct().collect()} == models and len(models) > 1
    rows = Q.left_join_missing(spark, small)
    assert rows.count() == len(models) * benchmarks and rows.filter("NOT missing").select("model").distinct().count() == len(models)
    assert all(r.invalid_text_ratio > 0 for r in Q.sample_summary(spark, small).collect())

"""Composed operators on small hand-made tables: empty ones, nulls, hot groups, and caches."""

import json
import zipfile
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagweave.functions import tokens as tk
from bagweave.operators import corpus, dataset, evaluate, sampling, semantic, split, stability
from bagweave.runtime import Rounds, broadcast_if_small, is_small
from bagweave.sources import readers, sinks
from bagweave.streaming import incremental


def jaccard(a, b):
    both = sum((Counter(a) & Counter(b)).values())
    return both / (len(a) + len(b) - both) if a or b else 1.0


def test_infill_items_show_half_and_hide_the_rest(spark):
    rows = [(1, "😀", "🎉🔥🎵", "t", "go"), (2, None, "🎉🔥", None, None), (3, "😀", "🎉", "t", "x"), (4, "", "🎉🔥", "", ""), (5, "🎵", "🎵🎵🔥😀", None, "")]
    df = spark.createDataFrame(rows, "row_id int, input string, output string, topic string, instruction string")
    items = evaluate.infill_items(evaluate.infill_examples(df, None, "row_id", "x"), samples=2).collect()
    assert len(items) == 2 * 3 * 2 and {r.source_index for r in items} == {1, 5}
    for r in items:
        assert r.revealed_k == max(1, r.reply_len // 2) == len(r.revealed_positions) and r.masked_count == r.reply_len - r.revealed_k
        assert sorted(r.revealed_positions + r.masked_positions) == list(range(r.reply_len))
        assert [s for s in r.visible_slots if s != "[MASK]"] + list(r.masked_truth) and r.visible_slots.count("[MASK]") == r.masked_count
    assert evaluate.infill_items(evaluate.infill_examples(df.limit(0), None, "row_id", "x")).count() == 0
    held = evaluate.infill_examples(df, df.filter("row_id = 1"), "row_id", "x")
    assert [r.source_index for r in held.collect()] == [5]


def test_pass_power_over_all_keeps_patterns_apart_and_takes_least_distances(spark):
    rows = [("m", "prefix", "a", 0, 0.1, 0.9), ("m", "prefix", "a", 1, 0.5, 0.2), ("m", "suffix", "a", 0, 0.3, None), ("m", None, "b", 0, None, 0.7)]
    df = spark.createDataFrame(rows, "model string, pattern string, id string, s int, benchmark_score double, semantic_target_cosine double").withColumns({"bag_f1": F.lit(0.0), "bag_jaccard": F.lit(0.0)})
    got = {(r.pattern, r.k): r for r in evaluate.pass_power(df, "model", "pattern", ["id"], ["s"], 9).collect()}
    assert set(got) == {("prefix", 1), ("prefix", 2), ("suffix", 1), ("unknown", 1), ("all", 1), ("all", 2)}
    assert got["all", 1].problems == 3 and got["all", 1].samples == 4 and got["prefix", 2].power_at_k_benchmark_score == 0.5
    assert got["prefix", 2].power_at_k_semantic_cosine == 0.9 and got["suffix", 1].power_at_k_semantic_distance == 1.0 and got["suffix", 1].power_at_k_embedding_distance == 2.0
    assert got["prefix", 1].pass_at_k_semantic == 1.0 and got["suffix", 1].pass_at_k_semantic == 0.0
    assert evaluate.pass_power(df.limit(0), "model", "pattern", ["id"], ["s"], 9).count() == 0


def test_order_effects_with_and_without_references(spark):
    perm = [("m", "g", k, "p", t, ["a", "b"]) for k, t in enumerate((["a"], ["a", "b"], []))] + [("m", "h", 9, "q", ["c"], ["c"])]
    permuted = spark.createDataFrame(perm, "model string, grp string, sid int, by string, p array<string>, t array<string>")
    resampled = permuted.filter("grp = 'g'").select("model", "grp", F.array(F.lit("a")).alias("p"))
    refs = spark.createDataFrame([("p", ["a"]), ("p", ["a"]), ("z", ["b"])], "by string, r array<string>")
    r = evaluate.order_effects(permuted, resampled, refs, "model", "grp", "sid", "by").collect()[0]
    pairs = [jaccard(x, y) for x, y in combinations([["a"], ["a", "b"], []], 2)]
    assert abs(r.perm_stability - sum(pairs) / 3) < 1e-9 and r.resample_stability == 1.0
    assert abs(r.target_bag_jaccard - (0.5 + 1 + 0 + 1) / 4) < 1e-9 and abs(r.target_best_jaccard - (1 + 0.5 + 0 + 1) / 4) < 1e-9


def test_hot_group_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(stability, "GROUP_PART", 7)
    bags = [["x"] * (k % 9) + [f"t{k % 40}"] for k in range(150)]
    df = spark.createDataFrame([("hot" if k % 3 else f"g{k}", b) for k, b in enumerate(bags)], "g string, p array<string>")
    got = {r.g: r for r in stability.group_stability(df, ["g"]).collect()}
    hot = [b for k, b in enumerate(bags) if k % 3]
    pairs = [jaccard(a, b) for a, b in combinations(hot, 2)]
    assert got["hot"].members == 100 and abs(got["hot"].stability - sum(pairs) / len(pairs)) < 1e-9
    assert all(r.stability == 1.0 for g, r in got.items() if g != "hot")


def test_pairs_of_a_large_group_are_summed_without_forming_them(spark, monkeypatch):
    """20,000 different bags in a group, 200 million pairs: the sum by shared sub-bags is exact and in time."""
    import time

    bags = [[f"t{k % 50}", f"u{k // 50 % 40}", f"w{k // 2000}"] for k in range(20_000)]
    df = spark.createDataFrame([("g", b) for b in bags], "g string, p array<string>").repartition(4)
    began = time.time()
    (got,) = stability.group_stability(df, ["g"]).collect()
    assert time.time() - began < 60
    # of the others of a bag, 9 + 39 + 49 share two tokens, 39 * 9 + 49 * 9 + 49 * 39 one
    wanted = (97 * 2 / 4 + (39 * 9 + 49 * 9 + 49 * 39) / 5) / 19_999
    assert got.members == 20_000 and abs(got.stability - wanted) < 1e-12
    rng = np.random.default_rng(5)
    mixed = [(f"g{k % 3}", [f"t{x}" for x in rng.integers(0, 12, rng.integers(0, 15))]) for k in range(240)]
    monkeypatch.setattr(stability, "GROUP_PART", 20)
    monkeypatch.setattr(stability, "TOGETHER", 30)
    told = {r.g: r.stability for r in stability.group_stability(spark.createDataFrame(mixed, "g string, p array<string>"), ["g"]).collect()}
    for g in ("g0", "g1", "g2"):
        pairs = [jaccard(a, b) for a, b in combinations([b for h, b in mixed if h == g], 2)]
        assert abs(told[g] - sum(pairs) / len(pairs)) < 1e-12


def test_stability_summary_and_target_alignment(spark):
    rows = spark.createDataFrame([("m", 1, ["a"], ["a"]), ("m", 1, ["b"], ["a"]), ("m", 2, [], ["a"])], "model string, g int, p array<string>, t array<string>")
    r = evaluate.stability_summary(rows, "model", ["g"]).collect()[0]
    assert (r.groups, r.mean_permutation_stability, r.mean_target_bag_jaccard) == (2, 0.5, 0.25)


def test_permutation_groups_leave_out_single_orders(spark):
    rows = [(1, "😀🎉🔥", "🎵", None), (2, "😀", "🎵", "t"), (3, "😀😀", "🎵", "t"), (4, "😀🎉", "no", "t"), (5, "😀🎉", "🎵", "t"), (6, None, None, None)]
    got = evaluate.permutation_groups(spark.createDataFrame(rows, "row_id int, input string, output string, topic string"), "row_id", 3).collect()
    per = Counter(r.group_id for r in got)
    assert per == {"reply_00001_untagged": 3, "reply_00005_t": 2} and len({(r.group_id, r.prompt_emoji) for r in got}) == 5


def test_encode_packs_and_splits_as_before(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", 5), ("b", 6), (None, 7)], "token string, token_id int")
    rows = spark.createDataFrame([(1, ["a", "x", "b", None]), (2, []), (3, None), (4, ["b"] * 40)], "k int, tokens array<string>")
    small = {r.k: r.ids for r in corpus.encode(rows, vocab, "k", 4).collect()}
    assert small == {1: [5, 4, 6, 4], 2: [], 3: [], 4: [6] * 40}
    monkeypatch.setattr(corpus, "is_small", lambda df: False)
    assert {r.k: r.ids for r in corpus.encode(rows, vocab.filter("token IS NOT NULL"), "k", 4).collect()} == small
    ids = spark.createDataFrame([("s", k, list(range(k * 100, k * 100 + k % 37))) for k in range(60)] + [("t", 1, [1])], "src string, k int, ids array<int>")
    got = {(r.src, r.block_id): r.input_ids for r in corpus.packed(ids, ["src"], ["k"], 12, -1, -2).collect()}
    flat = [x for k in range(60) for x in range(k * 100, k * 100 + k % 37)]
    assert got == {("s", b): [-1, *flat[b * 10 : b * 10 + 10], -2] for b in range(len(flat) // 10)}
    keys = spark.createDataFrame([(f"k{k}",) for k in range(200)], "key string")
    held = {r.key for r in split.held_out_keys(keys, 0.1).collect()}
    import hashlib

    assert held == set(sorted((f"k{k}" for k in range(200)), key=lambda k: hashlib.sha1(f"42:{k}".encode()).hexdigest())[:20])


def test_references_with_a_bound_and_as_rows(spark):
    rows = spark.createDataFrame([("g", f"v{k % 30}", k) for k in range(90)] + [("g", None, 0), ("h", "", 1)], "g string, v string, o int")
    assert corpus.references(rows, ["g"], "v", "o", most=4).collect()[0].references == ["v0", "v1", "v2", "v3"]
    assert {(r.v, r.first) for r in corpus.reference_rows(rows, ["g"], "v", "o").collect()} == {(f"v{k}", k) for k in range(30)}


def test_approximate_search_recall_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(semantic, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + rng.normal(scale=0.6, size=(900, 16))
    x[:300] = centres[0] + rng.normal(scale=0.01, size=(300, 16))  # a cell with a third of all rows
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9999, None)], "id bigint, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    queries = df.filter("id % 20 = 0")
    got = {(r.id, r.neighbour) for r in semantic.nearest_approximate(df, queries, "id", "v", 5, probes=6).collect()}
    wanted = set()
    for q in range(0, 900, 20):
        sim = u @ u[q]
        sim[q] = -9
        wanted |= {(q, int(k)) for k in np.argsort(-sim)[:5]}
    assert len(got & wanted) >= 0.9 * len(wanted) and len(got) == len(wanted)
    every = {(r.id, r.neighbour) for r in semantic.nearest_approximate(df, queries, "id", "v", 5, probes=99).collect()}
    assert len(every & wanted) >= 0.99 * len(wanted)  # all cells looked into: exact but for ties
    assert semantic.nearest_approximate(df.limit(0), queries, "id", "v", 5).count() == 0


def test_dataset_is_built_once_and_its_parts(spark, tmp_path):
    calls = []
    rows = lambda: calls.append(1) or spark.createDataFrame([(k, "s", f"text number {k}") for k in range(50)] + [(50, "s", None)], "k int, src string, text string")
    build = dataset.Build("t", block=20)
    one = dataset.built(spark, build, rows, tk.character_ids, str(tmp_path), ["src"], ["k"])
    two = dataset.built(spark, build, rows, tk.character_ids, str(tmp_path), ["src"], ["k"])
    assert len(calls) == 1 and one.count() == two.count() > 0 and all(len(r.input_ids) == 20 for r in two.collect())
    padded = dataset.built(spark, dataset.Build("t", wrap=False, block=8), rows, tk.character_ids, str(tmp_path), ["src"], ["k"])
    assert len(calls) == 2 and all(len(r.input_ids) == len(r.attention_mask) == 8 for r in padded.collect()) and padded.count() == 51
    assert dataset.model_columns(padded).columns == ["input_ids", "attention_mask"]
    vocab = spark.createDataFrame([("a",), (None,)], "token string")
    known = dataset.known_rows(spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, []), (4, None)], "k int, tokens array<string>"), vocab, "k")
    assert sorted(r.k for r in known.collect()) == [1, 3, 4]


def test_denoising_fills_every_mask_and_asks_only_where_ids_changed(spark):
    rows = spark.createDataFrame([(1, [3, 3, 3]), (2, [0, 1, 2]), (3, [])], "k int, ids array<int>")
    predict = lambda ids: F.transform(ids, lambda _, i: F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    got = {r.k: (r.ids, r.asked) for r in sampling.denoised(rows, "k", predict, 6, 3).collect()}
    assert got[1][0] == [1, 1, 1] and got[2] == ([0, 1, 2], 1) and got[3] == ([], 1) and 1 < got[1][1] <= 4


def test_broadcast_needs_few_bytes_too(spark):
    assert is_small(spark.range(10)) and is_small(spark.range(0)) and not is_small(spark.range(11), 10)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("x"))
    assert is_small(wide) and not is_small(wide, size=5000)
    assert broadcast_if_small(spark.range(3)).count() == 3


def test_files_of_all_shapes(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return sorted((r.field or "", r.text) for r in readers.harvested_file(spark, str(tmp_path / name)).collect())

    rows = [{"emoji": "😀", "x": 1}, {"input": None, "output": "b"}]
    wanted = [("emoji", "😀"), ("output", "b")]
    for shape in (rows, {"data": rows}, {"rows": rows}, {"rows": {"k": rows[0], "l": rows[1]}}, dict(enumerate(rows))):
        assert file("a.json", json.dumps(shape)) == wanted
    assert file("b.jsonl", "\n".join(map(json.dumps, rows)) + "\n\n") == wanted
    assert file("c.json", json.dumps(["p", None, 3])) == [("", "3"), ("", "p")]
    assert file("d.txt", " one \n\n two\n") == [("", "one"), ("", "two")]


def test_named_corpora(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "WEB_TAIL", 3)
    (tmp_path / "openwebtext").mkdir()
    (tmp_path / "openwebtext/train.jsonl").write_text("".join(json.dumps({"text": f"t{k}"}) + "\n" for k in range(10)))
    assert readers.CORPORA.load(spark, "openwebtext-train", str(tmp_path))["train"].count() == 7
    assert sorted(r.text for r in readers.CORPORA.load(spark, "openwebtext-valid", str(tmp_path))["validation"].collect()) == ["t7", "t8", "t9"]
    (tmp_path / "text2emoji").mkdir()
    (tmp_path / "text2emoji/train.jsonl").write_text("".join(json.dumps({"text": str(k), "emoji": "e", "topic": "t"}) + "\n" for k in range(500)))
    parts = readers.CORPORA.load(spark, "text2emoji", str(tmp_path))
    assert parts["train"].count() + parts["validation"].count() == 500 and 0 < parts["validation"].count() < 25
    (tmp_path / "text8").mkdir()
    with zipfile.ZipFile(tmp_path / "text8/text8.zip", "w") as z:
        z.writestr("text8", "ab" * 600)
    monkeypatch.setattr(readers, "TEXT8_SIZES", (600, 300))
    for name, size in (("text8", 256), ("text8-crop", 512)):
        readers.CORPORA.register(name, readers._text8(size))
        train = readers.CORPORA.load(spark, name, str(tmp_path))["train"].collect()
        assert len(train) == 600 // size and all(len(r.text) == size for r in train)
    (tmp_path / "other").mkdir()
    (tmp_path / "other/train.jsonl").write_text('{"a": 1}\n')
    assert set(readers.CORPORA.load(spark, "other", str(tmp_path))) == {"train"}
    one = spark.createDataFrame([(1,)], "k int")
    assert readers.with_challenge(one, one.withColumn("z", F.lit(2)), 3).count() == 4


def test_reports_manifest_and_names(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.25, 1)], "model string, stability double, k int")
    sinks.evaluation_report(spark, f"{tmp_path}/e.md", "E", {"seed": 7}, df, df, {"rows": 3})
    text = (tmp_path / "e.md").read_text()
    assert text.startswith("# E\n\n## Setup\n\n- seed: `7`\n- rows: `3`\n") and text.count("| m | 0.2500 | 1 |") == 2
    sinks.stability_report(spark, f"{tmp_path}/s.md", "S", df, df)
    refs = spark.createDataFrame([("t", ["a", "b"]), ("t", ["c"])], "topic string, references array<string>")
    sinks.benchmark_report(spark, f"{tmp_path}/b.md", "B", refs)
    assert "| t | 2 | 3 | 2 |" in (tmp_path / "b.md").read_text() and "Least stable" in (tmp_path / "s.md").read_text()
    sinks.manifest(spark, f"{tmp_path}/m.json", {"b": "é", "a": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1, "b": "é"}
    sinks.vocabulary_file(spark.createDataFrame([("x", 6), ("y", 5)], "token string, token_id int"), f"{tmp_path}/v.json")
    assert list(json.loads((tmp_path / "v.json").read_text())) == ["y", "x"]
    sinks.append_log(df, f"{tmp_path}/log")
    sinks.append_log(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert readers.path_fingerprint("a") == "86f7e437faa5" and readers.resolved("x", "/r") == "/r/x" and readers.resolved("s3://b", "/r") == "s3://b"


def test_latest_whole_state_is_read(spark, tmp_path):
    for k in (1, 2):
        spark.range(k).write.parquet(f"{tmp_path}/{k:012d}")
    (tmp_path / f"{3:012d}").mkdir()  # a batch that failed
    assert incremental.latest_state(spark, str(tmp_path)).endswith(f"{2:012d}")


def test_rounds_keep_tables_until_the_next_round_is_there(spark):
    r = Rounds(spark)
    a = r.keep(spark.range(3))
    r.next()
    b = r.keep(a.filter("id > 0"))
    r.next()
    assert b.count() == 2


@pytest.mark.parametrize("mode", ["prefix", "other", "all"])
def test_pattern_rank(spark, mode):
    wanted = {"all": 0, "prefix": 1, "other": 4}[mode]
    assert spark.range(1).select(evaluate.pattern_rank(F.lit(mode)).alias("r")).first().r == wanted


def test_encoder_and_tokenizer_hooks(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "k bigint, t string")
    got = {r.k: r.embedding for r in semantic.encoded_texts(rows, "k", "t", lambda: lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    ids = {r.k: r.i for r in rows.select("k", tk.with_tokenizer(F.col("t"), lambda: lambda t: [ord(c) for c in t]).alias("i")).collect()}
    assert ids == {1: [97, 98], 2: [], 3: []}


def test_means_of_vectors_with_nulls_and_none(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", None), ("c", [0.0, 1.0])], "g string, x array<double>")
    assert {r.g: r.mean for r in semantic.mean_vectors(rows, ["g"], "x").collect()} == {"a": [2.0, 3.0], "c": [0.0, 1.0]}
    assert semantic.mean_vectors(rows.limit(0), ["g"], "x").count() == 0

from collections import Counter, defaultdict

import numpy as np

from bagweave.llm import mixing
from bagweave.llm import queries as Q
from bagweave.runtime import table


def test_splitting_tree_keeps_quotas():
    counts = np.array([1000, 17, 3, 0, 250])
    out = np.array([have for _, _, have in mixing.split_quotas(counts, 37, 5)])
    assert (out.sum(axis=0) == counts).all() and out.min() >= 0
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 1


def test_subtrees_parted_elsewhere_give_the_same_shards():
    counts = np.array([1000, 17, 3, 0, 250])
    whole = mixing.split_quotas(counts, 37, 5)
    parts = [n for a, b, have in mixing.split_quotas(counts, 37, 5, width=9) for n in mixing.split_quotas(have, b - a, 5, a)]
    assert [(a, b, h.tolist()) for a, b, h in whole] == [(a, b, h.tolist()) for a, b, h in parts]


TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id bigint, text string, source string"


def test_shares_caps_and_copies(spark):
    docs = [(k, f"large number {k} of words {k * k}", "big") for k in range(400)]
    docs += [(1000 + k, f"a small text number {k}", "small") for k in range(30)] + [(2000 + k, "a small text number 1", "small") for k in range(20)]
    docs += [(3000, None, "big"), (3001, "", "small"), (3002, "other", "elsewhere"), (3003, "no source", None), (3004, "large number 7 of words 49", "small")]
    targets = [("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 2)]
    m = mixing.Mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    rows = m.rows.collect()
    uses = Counter(r.doc_id for r in rows)
    cap = {"big": 1, "small": 3}
    assert all(n <= cap[r.source] for r in rows for n in [uses[r.doc_id]])
    text = {d[0]: d[1] for d in docs}
    assert max(Counter(text[r.doc_id] for r in rows if r.source == "small").values()) <= 3
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source] += r.tokens
    total = sum(tokens.values())
    assert abs(tokens["big"] / total - 0.6) < 0.02
    assert min(uses[d] for d in uses if 1000 <= d < 1030) == 3  # the small source is used up to its cap
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by_shard.values())


def test_shards_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 20)
    monkeypatch.setattr(mixing, "SUBTREES", 8)
    docs = [(k, f"number {k} of words {k * k}", "ab"[k % 2]) for k in range(3000)]
    m = mixing.Mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], TARGETS))
    rows = m.rows.collect()
    per = Counter(r.shard for r in rows)
    shards = -(-sum(m.blocks.values()) // mixing.SHARD_BLOCKS)
    assert shards > 60 and set(per) == set(range(shards)) and max(per.values()) < 2 * len(rows) / shards
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.tokens
    assert all(abs(tokens[s] - m.quota[s]) <= 20 for s in "ab") and len({(r.doc_id, r.repeat) for r in rows}) == len(rows)


def test_missing_sources_and_empty_tables(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    m = mixing.Mixture(spark.createDataFrame([(1, "only text of a", "a")], DOCS), targets)
    got = {r.source: (r.actual_share, r.uses) for r in m.shares().collect()}
    assert got == {"a": (1.0, 1), "b": (0.0, 0)}
    empty = mixing.Mixture(spark.createDataFrame([], DOCS), targets)
    assert empty.rows.count() == 0 and empty.shares().count() == 2


def test_query_reaches_the_shares(spark, small):
    shares = Q.p9_shares(spark, small).collect()
    caps = {r.source: r.max_repeats for r in table(spark, small, "mix_target").collect()}
    assert len(shares) == len(caps) and all(r.most_repeats <= caps[r.source] for r in shares)
    assert abs(sum(r.actual_share for r in shares) - 1) < 1e-9
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    for r in shares:
        assert abs(r.actual_share - r.target_share) < 0.05  # a hundred documents: one is several per cent
    per_text = Counter((r.source, texts[r.doc_id]) for r in Q.p9_mix(spark, small).collect())
    assert all(n <= caps[s] for (s, _), n in per_text.items())

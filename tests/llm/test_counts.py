from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from bagweave.llm import cooccur, queries as Q, termstats
from bagweave.llm.columns import forms, load_vocabulary
from bagweave.runtime import table


@pytest.fixture(scope="module")
def held(spark, small):
    k = forms(load_vocabulary(table(spark, small, "emoji_vocab")))
    bag = lambda s: k.emoji(k.consistent(s)) if s else []
    return [(r.row_id, bag(r.input), bag(r.output)) for r in table(spark, small, "heldout_validation").collect()]


def test_term_frequencies_of_split_hot_terms(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = [("hot", k, 2) for k in range(3000)] + [("hot", 5, 1), ("one", 1, 1), (None, 1, 1), ("n", None, 1), ("n", 1, None)]
    got = {r.term: (r.occurrences, r.records) for r in termstats.term_frequencies(spark.createDataFrame(rows, "term string, id bigint, n int").repartition(5)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {"hot": (6001, 3000), "one": (1, 1)}
    assert termstats.term_frequencies(spark.createDataFrame([], "term string, id bigint, n int")).count() == 0


def test_terms_against_brute_force(spark, small, held):
    occ, rec = Counter(), Counter()
    for _, a, b in held:
        occ.update(a + b)
        rec.update(set(a + b))
    n = sum(bool(a or b) for _, a, b in held)
    mark = lambda c: "rare" if c <= 5 else "common" if c * 20 > n else None
    got = {r.term: (r.occurrences, r.records, r.mark) for r in Q.p2_terms(spark, small).collect()}
    assert got == {t: (occ[t], rec[t], mark(rec[t])) for t in occ}
    assert {tuple(r) for r in Q.p2_found(spark, small).collect()} == {(t, m) for t, (_, _, m) in got.items() if m}


def test_pairs_against_brute_force(spark, small, held):
    alone, both, n = Counter(), Counter(), 0
    for _, a, b in held:
        items = sorted(set(a + b))
        n += bool(items)
        alone.update(items)
        both.update(combinations(items, 2))
    pairs = {(r.item_a, r.item_b): (r.together, r.records_a, r.records_b) for r in Q.p7_pairs(spark, small).collect()}
    assert pairs == {p: (c, alone[p[0]], alone[p[1]]) for p, c in both.items()}
    wanted = {p for p, c in both.items() if c >= 8 and c * 1000 >= n and c * n >= 20 * alone[p[0]] * alone[p[1]]}
    assert {tuple(r) for r in Q.p7_found(spark, small).collect()} == wanted


def test_baskets_with_nulls_repeats_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK_CELLS", 10)
    rows = [(["b", "a", "a"],), (["a", None, "b"],), ([],), (None,), (["c"],), ([f"x{k}" for k in range(40)],)]
    pairs, n = cooccur.item_pairs(spark.createDataFrame(rows, "items array<string>"))
    got = {(r.item_a, r.item_b): (r.together, r.records_a, r.records_b) for r in pairs.collect()}
    assert n == 4 and got["a", "b"] == (2, 2, 2) and len(got) == 1 + 40 * 39 // 2
    empty, n = cooccur.item_pairs(spark.createDataFrame([], "items array<string>"))
    assert n == 0 and empty.count() == 0


def brute_pairs(baskets):
    return Counter(p for b in baskets for p in combinations(sorted(set(b)), 2))


def test_item_blocks_of_mixed_baskets_against_brute_force(monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK_CELLS", 10)
    baskets = [[f"i{(3 * k + j) % 47:02}" for j in range(k % 23)] for k in range(60)]
    names = sorted({i for b in baskets for i in b})
    batches = [pa.record_batch([pa.array(part, pa.list_(pa.string()))], names=["items"]) for part in (baskets[:41], baskets[41:43], baskets[43:])]
    for dense in (0, 1500):
        monkeypatch.setattr(cooccur, "DENSE_ITEMS", dense)
        got = Counter()
        for out in cooccur._gram(iter(batches), pa.array(names)):
            for r in out.to_pylist():
                got[names[r["a"]], names[r["b"]]] += r["together"]
        assert got == brute_pairs(baskets)


def test_many_baskets_in_one_partition_against_brute_force(spark):
    """500,000 baskets of 1 to 12 of 900 items in a single task: every count must hold."""
    rng = np.random.default_rng(5)
    size = rng.integers(1, 13, 500_000)
    item = (rng.random(int(size.sum())) ** 2 * 900).astype(np.int64)
    basket = np.repeat(np.arange(len(size)), size)
    lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), pa.array(item).cast(pa.string()))
    df = spark.createDataFrame(pa.table({"items": lists})).coalesce(1)
    pairs, n = cooccur.item_pairs(df)
    got = {(int(r.item_a), int(r.item_b)): (r.together, r.records_a, r.records_b) for r in pairs.collect()}
    key = np.unique(basket * 900 + item)
    x = np.zeros((len(size), 900), np.float32)
    x[key // 900, key % 900] = 1
    gram = np.zeros((900, 900), np.int64)
    for k in range(0, len(size), 50_000):
        gram += np.rint(x[k : k + 50_000].T @ x[k : k + 50_000]).astype(np.int64)
    assert n == 500_000
    names = sorted(range(900), key=str)
    wanted = {(a, b): (gram[a, b], gram[a, a], gram[b, b]) for i, a in enumerate(names) for b in names[i + 1 :] if gram[a, b]}
    assert got == wanted


def test_a_very_long_basket_takes_bounded_memory():
    """20,000 items have 200 million pairs: they come out in parts of at most BLOCK_CELLS."""
    items = np.arange(20_000)
    cells = [len(a) for a, _ in cooccur.products(np.zeros(len(items), np.int64), items, len(items))]
    assert sum(cells) == 20_000 * 19_999 // 2 and max(cells) <= cooccur.BLOCK_CELLS


def test_items_beyond_the_dictionary_are_joined(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "DICTIONARY_ITEMS", 3)
    baskets = [[f"i{(3 * k + j) % 31}" for j in range(k % 9)] + ["hot"] for k in range(200)]
    pairs, n = cooccur.item_pairs(spark.createDataFrame([(b,) for b in baskets], "items array<string>"))
    assert n == 200 and {(r.item_a, r.item_b): r.together for r in pairs.collect()} == dict(brute_pairs(baskets))


def test_bounds_lose_no_pair_that_passes(spark):
    baskets = [[f"i{k % 7}", f"j{k % 7}", f"x{k % 5}", "all"] for k in range(300)]
    df, bounds = spark.createDataFrame([(b,) for b in baskets], "items array<string>"), {"least": 8, "share": 100, "lift": 5}
    whole, n = cooccur.item_pairs(df)
    part, m = cooccur.item_pairs(df, **bounds)
    of = lambda pairs: {tuple(r) for r in cooccur.frequent_pairs(pairs, n, **bounds).collect()}
    assert n == m and of(whole) == of(part) and len(of(whole)) == 7

import random
from collections import Counter

from bagweave.llm import overlap
from bagweave.llm import queries as Q
from bagweave.llm.columns import forms, load_vocabulary
from bagweave.runtime import table

SCHEMA = "row_id bigint, bag_0 array<string>, bag_1 array<string>"


def near(a, b, least):
    """Equal bags in both fields; or the larger of ``least`` items or more and one edit within one field."""
    d = [(sum((Counter(x) - Counter(y)).values()), sum((Counter(y) - Counter(x)).values())) for x, y in zip(a, b)]
    if all(x == (0, 0) for x in d):
        return True
    if max(sum(map(len, a)), sum(map(len, b))) < least:
        return False
    changed = [x for x in d if x != (0, 0)]
    return len(changed) == 1 and max(changed[0]) == 1


def test_pairs_against_brute_force(spark):
    rnd = random.Random(3)

    def bag(n):
        return sorted(rnd.choice("abc") for _ in range(n))

    rows = [(k, bag(rnd.randrange(1, 6)), bag(rnd.randrange(1, 5))) for k in range(240)]
    left, right = rows[:80], rows[80:]
    o = overlap.Overlap(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 6)
    wanted = {(e[0], t[0]) for e in left for t in right if near(e[1:], t[1:], 6)}
    got = [tuple(r) for r in o.rows().collect()]
    assert set(got) == wanted and len(got) == len(wanted)
    told = {r.row_id: r for r in o.links().collect()}
    same = lambda a, b: all(Counter(x) == Counter(y) for x, y in zip(a, b))
    for e in left:
        met = [t for t in right if (e[0], t[0]) in wanted]
        best = max((sum((Counter(e[1]) & Counter(t[1])).values()) + sum((Counter(e[2]) & Counter(t[2])).values()) for t in met), default=None)
        r = told[e[0]]
        assert r.links == len(met) and r.class_id == min(x[0] for x in left if same(x[1:], e[1:]))
        assert (r.containment is None) if best is None else abs(r.containment - best / (len(e[1]) + len(e[2]))) < 1e-9


def test_without_a_filter_the_result_is_the_same(spark, monkeypatch):
    bag = lambda k, n: sorted("abcdef"[(k * j + k) % 6] for j in range(n))
    rows = spark.createDataFrame([(k, bag(k, 4 + k % 4), bag(k + 1, 2)) for k in range(120)], SCHEMA)
    pairs = lambda: sorted(map(tuple, overlap.Overlap(rows.filter("row_id < 40"), rows.filter("row_id >= 40"), 6).rows().collect()))
    whole = pairs()
    monkeypatch.setattr(overlap.bloom, "MAX_BITS", 1 << 4)
    assert pairs() == whole and whole


def test_hot_classes_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(overlap, "MEMBER_BLOCK", 7)
    same = ["a"] * 6
    left = spark.createDataFrame([(k, same, []) for k in range(30)], SCHEMA)
    right = spark.createDataFrame([(100 + k, same[: 5 + k % 2], []) for k in range(40)], SCHEMA)
    o = overlap.Overlap(left, right, 6)
    assert o.rows().distinct().count() == o.rows().count() == 1200
    assert o.pairs.count() == 2
    assert overlap.Overlap(left.limit(0), right, 6).rows().count() == 0


def test_query_against_brute_force(spark, small):
    k = forms(load_vocabulary(table(spark, small, "emoji_vocab")))
    bag = lambda s: tuple(sorted(k.emoji(k.consistent(s)))) if s else ()
    held = [(r.row_id, r.split, bag(r.input), bag(r.output)) for r in table(spark, small, "heldout_validation").collect()]
    train = [h for h in held if h[1] == "train" and h[2]]
    wanted = {tuple(sorted((e[0], t[0]))) for e in held if e[1] in ("validation", "test") and e[2] and e[3] for t in train if t[3] and near(e[2:], t[2:], 6)}
    for r in table(spark, small, "curated_permutation").collect():
        if b := bag(r.prompt_emoji):
            wanted |= {tuple(sorted((r.row_id, t[0]))) for t in train if near((b,), (t[2],), 5)}
    got = [tuple(r) for r in Q.p6_found(spark, small).collect()]
    assert set(got) == wanted and len(got) == len(wanted) and wanted

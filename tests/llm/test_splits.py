import random
from collections import Counter, defaultdict

from bagweave.llm import queries as Q
from bagweave.llm import splits
from bagweave.llm.columns import forms, load_vocabulary
from bagweave.runtime import table


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_noise(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(1, 200)] + [(1000, 1000 + k) for k in range(1, 100)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(180)] + [(5, 5), (7, 6)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in splits.star_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == union(edges, nodes)
    assert splits.star_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute(rows):
    pairs, seen = [], {}
    for r, *entities in rows:
        for k, e in enumerate(entities):
            if e is not None:
                pairs.append((r, seen.setdefault((k, e), r)))
    root = union(pairs, [r[0] for r in rows])
    size = Counter(root.values())
    return {r: (g, size[g]) for r, g in root.items()}


def test_groups_over_two_entities_with_a_hot_one(spark):
    rnd = random.Random(2)
    rows = [(k, "hot" if k % 3 == 0 else rnd.choice([None, f"b{rnd.randrange(300)}"]), rnd.choice([None, f"t{rnd.randrange(400)}"])) for k in range(900)]
    rnd.shuffle(rows)
    got = splits.related_groups(spark.createDataFrame(rows, "row_id bigint, bag string, topic string"), ["bag", "topic"])
    assert {r.row_id: (r.group_id, r.group_rows) for r in got.collect()} == brute(rows)
    assert splits.related_groups(spark.createDataFrame([], "row_id bigint, bag string, topic string"), ["bag", "topic"]).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"b{k // 5}", None) for k in range(6000)]
    groups = splits.related_groups(spark.createDataFrame(rows, "row_id bigint, bag string, topic string"), ["bag", "topic"])
    got = splits.split_of_group(groups, largest_first=True).collect()
    per_group = defaultdict(set)
    for r in got:
        per_group[r.group_id].add(r.split)
    assert len(got) == 6000 and all(len(s) == 1 for s in per_group.values())
    n = Counter(r.split for r in got)
    assert abs(n["train"] / 6000 - 0.8) < 0.03 and abs(n["test"] / 6000 - 0.1) < 0.03


def test_split_of_a_group_stays_when_other_data_arrives(spark):
    schema = "row_id bigint, bag string, topic string"
    some = [(k, f"b{k // 5}", None) for k in range(4000)]
    more = some + [(k, "hot" if k % 2 else f"b{k // 5}", None) for k in range(4000, 9000)]
    before, after = ({r.row_id: r.split for r in splits.split_of_group(splits.related_groups(spark.createDataFrame(rows, schema), ["bag", "topic"])).collect()} for rows in (some, more))
    assert len(after) == 9000 and all(after[r] == s for r, s in before.items())
    n = Counter(before.values())
    assert abs(n["train"] / 4000 - 0.8) < 0.04 and abs(n["test"] / 4000 - 0.1) < 0.04


def test_reported_shares_and_empty_splits(spark):
    placed = spark.createDataFrame([(1, 1, "train"), (2, 1, "train"), (3, 3, "train"), (4, 4, "test")], "row_id bigint, group_id bigint, split string")
    got = {r.split: (r.target_share, r.rows, r.groups, r.actual_share) for r in splits.split_shares(placed).collect()}
    assert got == {"train": (0.8, 3, 2, 0.75), "validation": (0.1, 0, 0, 0.0), "test": (0.1, 1, 1, 0.25)}
    assert [r.rows for r in splits.split_shares(placed.limit(0)).collect()] == [0, 0, 0]


def test_query_against_brute_force(spark, small):
    k = forms(load_vocabulary(table(spark, small, "emoji_vocab")))
    rows = []
    for r in table(spark, small, "heldout_validation").collect():
        bag = " ".join(sorted(k.emoji(k.consistent(r.input)))) if r.input else ""
        topic = k.consistent(r.topic).strip().lower() if r.topic else ""
        rows.append((r.row_id, bag or None, topic or None))
    wanted = {(r, g) for r, (g, n) in brute(rows).items() if n >= 2}
    assert {tuple(r) for r in Q.p3_found(spark, small).collect()} == wanted and wanted

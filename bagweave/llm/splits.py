"""Splits that keep related records together (problem 3).

Method: connected components by alternating large-star and small-star over the entities that records share, then
the component's hash picks a proportional split range, whatever else there is. Edges run between the smallest row_ids of two entities, so
an entity with a third of all rows is a single node, and a component's smallest node is its smallest row_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import HOT_SHARE, Rounds, durable, hash_unit, lookup_skewed

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (u, v); root is the smallest node of its component.

    Loops and repeated edges change nothing; edges with a null end are left out. Each round is written to the shared
    folder and its tables deleted two rounds later, so a lost executor costs at most the round at work.
    """
    rounds = Rounds(edges.sparkSession)
    now = rounds.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = rounds.keep(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
        large = lookup_skewed(both, least, ["u"], "n").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = rounds.keep(large)
        least = rounds.keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        moved = lookup_skewed(large, least, ["u"], "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = rounds.keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
        rounds.next()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def related_groups(records: DataFrame, entities: list[str]) -> DataFrame:
    """(row_id, group_id, group_rows): records related by an equal non-null value in any of ``entities``, closed over.

    group_id is the smallest row_id of the group. A record without entities is a group of its own; rows without a
    row_id are left out; an empty table gives an empty result.
    """
    named = [F.col(e).alias(f"e{k}") for k, e in enumerate(entities)]
    tagged = durable(records.select("row_id", *named).filter("row_id IS NOT NULL"))
    for k in range(len(entities)):
        first = tagged.filter(F.col(f"e{k}").isNotNull()).groupBy(f"e{k}").agg(F.min("row_id").alias(f"n{k}"), F.count("*").alias(f"c{k}"))
        tagged = lookup_skewed(tagged, durable(first), [f"e{k}"], f"c{k}", "left").drop(f"e{k}", f"c{k}")
    nodes = [F.col(f"n{k}") for k in range(len(entities))]
    tagged = durable(tagged.select("row_id", *nodes, F.coalesce(*nodes, "row_id").alias("node")))
    pairs = [tagged.select(nodes[0].alias("u"), n.alias("v")) for n in nodes[1:]]
    pairs += [tagged.select(a.alias("u"), b.alias("v")) for i, a in enumerate(nodes[1:]) for b in nodes[i + 2 :]]
    edges = pairs[0]
    for p in pairs[1:]:
        edges = edges.unionByName(p)
    roots = star_components(edges)
    sizes = durable(tagged.groupBy("node").agg(F.count("*").alias("n")))  # rows of a node, one row per node
    rooted = durable(sizes.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("group_id")))
    totals = rooted.groupBy("group_id").agg(F.sum("n").alias("group_rows"), F.count("*").alias("nodes"))
    per_node = lookup_skewed(rooted, durable(totals), ["group_id"], "nodes").select("node", "n", "group_id", "group_rows")
    return lookup_skewed(tagged.select("row_id", "node"), durable(per_node), ["node"], "n").select("row_id", "group_id", "group_rows")


def split_of_group(groups: DataFrame, splits=SPLITS, seed: int = 42, largest_first: bool = False) -> DataFrame:
    """(row_id, group_id, split): whole groups into splits by the hash of the group_id in ranges of the given shares.

    A group's split depends on its group_id and ``seed`` alone, so it stays when other data arrives; ``split_shares``
    tells what shares the rows reach. With ``largest_first`` the groups of 1/HOT_SHARE of the rows or more (so at most
    HOT_SHARE of them) first go to the split that is furthest below its share, and hash ranges in proportion to what
    each split then lacks take all others: shares come nearer, but a group's split depends on all data.
    """
    u = hash_unit(str(seed), F.col("group_id"))
    if not largest_first:
        return groups.select("row_id", "group_id", _in_range(u, dict(splits)).alias("split"))
    total = groups.count()
    big = groups.filter(F.col("group_rows") * HOT_SHARE >= total).select("group_id", "group_rows").distinct()
    lacks = {name: share * total for name, share in splits}
    placed = {}
    for row in sorted(big.collect(), key=lambda r: (-r.group_rows, r.group_id)):
        name = max(lacks, key=lambda s: lacks[s])
        placed[row.group_id] = name
        lacks[name] -= row.group_rows
    split = _in_range(u, {name: max(0.0, n) for name, n in lacks.items()})
    if placed:
        known = F.create_map(*[F.lit(x) for kv in placed.items() for x in kv])
        split = F.coalesce(F.try_element_at(known, F.col("group_id")), split)
    return groups.select("row_id", "group_id", split.alias("split"))


def _in_range(u: Column, parts: dict[str, float]) -> Column:
    """The part in whose range ``u`` falls; ranges follow each other in proportion to ``parts``."""
    whole, upto, pick = sum(parts.values()) or 1.0, 0.0, None
    for name, n in parts.items():
        upto += n / whole
        pick = F.when(u < upto, name) if pick is None else pick.when(u < upto, name)
    return F.coalesce(pick, F.lit(next(iter(parts))))


def split_shares(placed: DataFrame, splits=SPLITS) -> DataFrame:
    """(split, target_share, rows, groups, actual_share) of placed rows (row_id, group_id, split); 0 for a split without any."""
    per = placed.groupBy("split", "group_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))
    listed = placed.sparkSession.createDataFrame(list(splits), "split string, target_share double")
    told = listed.join(F.broadcast(per), "split", "left").crossJoin(F.broadcast(per.agg(F.sum("rows").alias("all"))))  # a row per split, one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return told.select("split", "target_share", zero("rows"), zero("groups"), F.coalesce(F.try_divide("rows", "all"), F.lit(0.0)).alias("actual_share"))

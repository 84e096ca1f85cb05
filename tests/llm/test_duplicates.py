from collections import defaultdict

from bagweave.llm import duplicates as D
from bagweave.llm import queries as Q
from bagweave.llm.columns import forms, load_vocabulary
from bagweave.runtime import table

VOCAB = ("❤️", "😀", "🎉")
SCHEMA = "row_id bigint, input string, output string, first_id string"


def run(spark, rows):
    copies, collapsed = D.hidden_duplicates(spark.createDataFrame(rows, SCHEMA), VOCAB)
    return sorted(map(tuple, copies.collect())), sorted(map(tuple, collapsed.select("row_id", "copies").collect()))


ROWS = [
    (1, "😀 Big game!", "❤", "x"), (2, "😀  big GAME", "❤️ ", "x"), (3, "«😀biggame»", "❤️", None), (4, "🎉 big game", "❤", ""),
    (5, "mood: calm; emoji: 😀 🎉", "ok", None), (6, "EMOJI=😀🎉\nMood = Calm", "OK!", None), (7, "mood: calm; emoji: 🎉 😀", "ok", None),
    (8, None, "ok", None), (9, "a", "  ", None), (10, "", "b", None), (11, "unique", "one", None), (12, "Straße", "x", None), (13, "STRASSE", "x", None),
]


def test_sets_of_same_records(spark):
    copies, collapsed = run(spark, ROWS)
    assert copies == [(1, 2), (1, 3), (5, 6), (12, 13)]
    assert collapsed == [(1, 3), (4, 1), (5, 2), (7, 1), (11, 1), (12, 2)]


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, ROWS[:0]) == ([], [])
    copies, collapsed = run(spark, [(k, "same", "text", None) for k in range(50)])
    assert copies == [(0, k) for k in range(1, 50)] and collapsed == [(0, 50)]


def test_ranges_beyond_the_filter_bound(spark, monkeypatch):
    """64 ranges give what one filter gives, by as many jobs, and no hot digest fills a task."""
    rows = [(k, f"text {k % 700 if k % 3 else 0}", "reply", None) for k in range(1000)]

    def jobs(group):
        spark.sparkContext.setJobGroup(group, group)
        out = run(spark, rows)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    monkeypatch.setattr(D.bloom, "MAX_BITS", 1 << 12)
    monkeypatch.setattr(D, "RANGE_DIGESTS", 500)
    two, few = jobs("two")
    monkeypatch.setattr(D, "RANGE_DIGESTS", 16)
    many, more = jobs("many")
    monkeypatch.undo()
    whole, _ = jobs("whole")
    assert two == many == whole and few == more
    seen = {}
    for k, text, _, _ in rows:
        seen.setdefault(text, k)
    assert whole[0] == sorted((seen[t], k) for k, t, _, _ in rows if seen[t] != k)


def test_symbols_are_no_punctuation():
    assert D.bare("C++") != D.bare("C") and D.bare("£5") != D.bare("5")
    assert D.bare("Wow… 😀 «OK»!") == D.bare("wow 😀ok") and D.bare("❤️a") == D.bare("❤️ A.")


def test_filter_never_misses_a_repeat(spark):
    digests = spark.range(20000).selectExpr("id AS row_id", "xxhash64(id % 15000) AS hi", "xxhash64(id % 15000, 1) AS lo").repartition(7)
    marked = D.mark_possible_repeats(digests)
    missed = marked.filter("NOT maybe").groupBy("hi", "lo").count().filter("count > 1").count()
    singles = marked.filter("NOT maybe").count()
    assert missed == 0 and marked.filter("NOT maybe AND row_id < 5000").count() == 0
    assert singles > 9000  # of 10,000 true singletons


def test_query_against_brute_force(spark, small):
    vocab = load_vocabulary(table(spark, small, "emoji_vocab"))
    f = forms(vocab).consistent
    groups = defaultdict(list)
    for r in table(spark, small, "heldout_validation").collect():
        if r.input and r.input.strip() and r.output and r.output.strip():
            groups[D.field_key(f(r.input)), D.field_key(f(r.output))].append(r.row_id)
    wanted = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    assert sorted(map(tuple, Q.p1_found(spark, small).collect())) == wanted and wanted


def test_collapsed_table_keeps_records_with_blank_fields(spark, small):
    rows = {r.row_id for r in table(spark, small, "heldout_validation").collect()}
    copies = {r.copy_id for r in Q.p1_found(spark, small).collect()}
    kept = [(r.row_id, r.copies) for r in Q.p1_records(spark, small).collect()]
    assert {k for k, _ in kept} == rows - copies and sum(n for _, n in kept) == len(rows)

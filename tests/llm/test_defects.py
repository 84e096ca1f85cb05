import random

import pytest

from bagweave.llm import defects as D
from bagweave.llm import queries as Q

VOCAB = ("😀", "🎉", "❤️", "👩‍🔬", "🚀", "🇩🇪")
TEXTS = {
    "en": ["Well done, keep going like this.", "What a day! The whole team is cheering for you.", "You earned it, rest well and drink some water."],
    "de": ["Gut gemacht, mach weiter so.", "Was für ein Tag! Das ganze Team drückt dir die Daumen.", "Ich freue mich sehr für dich, genieße den Abend."],
    "ru": ["Отлично сделано, отдохни как следует.", "Вот это день! Я очень рад за тебя.", "Завтра будет лучше."],
}
CLOSING = {"en": "big hug", "de": "drück dich", "ru": "обнимаю"}
ASKED = {"en": "Feeling happy after the night train", "de": "Mein Bruder liebt Kaffee am Abend", "ru": "Снова концерт, и я спокоен"}
SAMPLES = "sample_id bigint, benchmark_id string, raw_prediction string, defect string"
BENCH = "benchmark_id string, instruction string, prompt_emoji string, lang string"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(6)
    bench = [(lang, ASKED[lang], "😀🎉", lang) for lang in TEXTS] + [("dup", "Twice here", "🚀", "en"), ("dup", "Twice here", "🚀", "en"), (None, "x", "y", "en"), ("blank", None, None, None)]
    fill = [(10_000 + k, lang, "🚀 " + rnd.choice(TEXTS[lang]) if k % 4 else "❤️🚀 " + CLOSING[lang], None) for k in range(600) for lang in [rnd.choice(list(TEXTS))]]
    return bench, fill


CASES = [
    (None, "en", "empty"), ("", "en", "empty"), (" \n", "en", "empty"), ("...", "en", "empty"), ("None", "en", "empty"), ("<empty>", "en", "empty"), ("​", "en", "empty"), ("(no response)", None, "empty"),
    ("I'm sorry, but I can't help with that request.", "en", "refusal"), ("🚀 Leider gilt: darauf kann ich nicht antworten.", "de", "refusal"), ("К сожалению, я не могу ответить на этот запрос.", "ru", "refusal"),
    ("🎉😀", "en", "copy"), ("🎉 😀 😀 Well done, keep going like this.", "en", "copy"), ("FEELING HAPPY AFTER THE NIGHT TRAIN! 🚀", "en", "copy"), ("🎉😀", "unknown", None), (ASKED["en"], "unknown", None),
    ("🚀 Well done, keep going li", "en", "truncated"), ("🚀 What a day! You earned it, rest well and", "en", "truncated"), ("🚀 Well done (", "unknown", "truncated"), ("🚀 1. ❤️\n2. 🎉\n3.", "en", "truncated"), ("❤️🚀👩‍", "en", "truncated"), ("❤️🇩", "en", "truncated"),
    ("❤️ big hug", "en", None), ("❤️ I can't wait!", "en", None), ("🚀❤️", "de", None), ("🚀 " + TEXTS["de"][1], "de", None),
    ("🚀 " + TEXTS["ru"][1], "en", "other_language"), ("🚀 " + TEXTS["en"][1], "de", "other_language"), ("🚀 " + TEXTS["en"][1], "unknown", None), ("🚀 " + TEXTS["en"][1], "blank", None), ("🚀", "dup", "copy"),
]


def test_each_defect(spark, tables):
    bench, fill = tables
    rows = [(k, b, raw, None) for k, (raw, b, _) in enumerate(CASES)]
    got = {r.sample_id: r.defect for r in D.defects(spark.createDataFrame(rows + fill, SAMPLES), spark.createDataFrame(bench, BENCH), VOCAB).collect()}
    assert [(CASES[k], got.get(k)) for k in range(len(CASES)) if got.get(k) != CASES[k][2]] == []


def test_empty_tables(spark, tables):
    none, bench = spark.createDataFrame([], SAMPLES), spark.createDataFrame(tables[0], BENCH)
    assert D.defects(none, bench, VOCAB).count() == 0
    some = spark.createDataFrame([(1, "en", "🚀 Well done.", None), (2, None, None, None)], SAMPLES)
    assert {r.sample_id for r in D.defects(some, bench.limit(0), VOCAB).collect()} == {2}


def test_languages_held_out(spark, small):
    """Accuracy on instructions that the model isn't fitted on."""
    from bagweave.runtime import table

    rows = [(r.instruction, r.lang.lower()) for r in table(spark, small, "reply_benchmark").collect() if r.instruction and r.lang]
    random.Random(7).shuffle(rows)
    cut = len(rows) // 2
    model = D.Languages(D.Languages.fit(rows[:cut]))
    right = sum(model.best(t) == lang for t, lang in rows[cut:])
    assert right / (len(rows) - cut) > 0.99


def test_query_gives_one_row_per_sample(spark, small):
    rows = Q.p5_found(spark, small).collect()
    assert rows and len({r.sample_id for r in rows}) == len(rows)
    assert {r.defect for r in rows} <= {"empty", "refusal", "copy", "truncated", "other_language"}


def test_refusals_that_no_list_has_are_found():
    """A phrase taken out of the list is found by what it shares with those that stay in it."""
    openers = ["I'm sorry, but", "Unfortunately,", "As an assistant,", "Apologies,", "To be upfront,", "Hmm,"]
    listed = ["I can't help with that request.", "I won't produce a reply here.", "I am not able to answer this message.", "I have to decline this one."]
    new = "this message gets no words from me."
    rnd = random.Random(3)
    replies = [f"{rnd.choice(openers)} {rnd.choice(listed)}" for _ in range(120)] + [f"{o} {new}" for o in openers * 4]
    others = [rnd.choice(TEXTS["en"]) + " " + rnd.choice(TEXTS["en"]) for _ in range(900)] + ["I can't wait, this one is for me.", "I won't forget this message!"] * 20
    model = D.Refusals(*D.Refusals.fit(replies + others))
    assert D.REFUSALS.search(new) is None
    assert all(model.odds(f"{o} {new}") > D.REFUSAL_ODDS for o in openers)
    assert all(model.odds(t) < D.REFUSAL_ODDS for t in others)


def test_endings_by_smoothed_odds():
    replies = ["big hug"] * 4 + ["Well done, keep going."] * 30 + ["Well done, rest well and"] + ["Well do"] * 2 + ["Big hugs to all."] * 2
    ends = D.Endings(*D.Endings.fit(replies, ["Feeling happy after the train"]))
    assert ends.complete("big hug") and ends.complete("Feeling happy after the train") and ends.odds("big hug") > ends.odds("the train") - 20
    assert not ends.complete("well do") and not ends.complete("rest well and") and ends.odds("zzz") == -float("inf")


def test_hot_benchmark_beyond_broadcast(spark, tables, monkeypatch):
    bench, fill = tables
    rows = [(k, b, raw, None) for k, (raw, b, _) in enumerate(CASES)] + [(50_000 + k, "en", "🎉😀", None) for k in range(400)]
    given = (spark.createDataFrame(rows + fill, SAMPLES), spark.createDataFrame(bench, BENCH), VOCAB)
    small = sorted(map(tuple, D.defects(*given).collect()))
    monkeypatch.setattr(D, "is_small", lambda *a: False)
    assert sorted(map(tuple, D.defects(*given).collect())) == small


def test_models_are_fitted_on_all_samples(spark):
    """The counts are those of all 12,600 replies and all instructions, as a fit on lists in memory gives them."""
    rnd = random.Random(8)
    refusals = ["I'm sorry, but I can't help with that request.", "Sorry, I won't produce a reply to this message.", "Sorry, this message gets no words from me."]
    bench = [(f"{lang}{k}", f"{ASKED[lang]} {k}", "😀🎉", f" {lang.upper()} ") for lang in TEXTS for k in range(30)] + [("none", "Just so", None, None), ("copied", "What a day", None, "en")]
    said, langs = [], {b: lang.strip().lower() for b, _, _, lang in bench if lang}
    for k in range(12_600):
        lang = rnd.choice(list(TEXTS))
        pick = rnd.random()
        text = rnd.choice(refusals) if pick < 0.05 else CLOSING[lang] if pick < 0.3 else "what a day!" if pick < 0.31 else rnd.choice(TEXTS[lang])
        said.append((text[: rnd.randint(2, len(text))] if rnd.random() < 0.2 else text, rnd.choice([f"{lang}{k % 30}", "none", "unknown"])))
    samples = spark.createDataFrame([(k, b, t, None) for k, (t, b) in enumerate(said)], SAMPLES).repartition(3)
    languages, ends, goes_on, (replies, grams) = D.fit(samples, spark.createDataFrame(bench, BENCH), VOCAB)
    said = [(t.strip(), b) for t, b in said if len(t.strip()) > 1 and D.regex.search(r"\p{L}{2}", t)]
    assert sum(replies) == len(said) > 10_000
    asked = [(i, langs[b]) for b, i, _, _ in bench if b in langs]
    first = D.Languages(D.Languages.fit(asked + [(t, langs[b]) for t, b in said if b in langs]))
    assert languages == D.Languages.fit(asked + [(t, first.best(t)) for t, b in said if b in langs])
    whole = D.Refusals.fit([t for t, _ in said])
    assert replies == whole[0] and all(whole[1][g] == n for g, n in grams.items())
    one, other = D.Refusals(*whole), D.Refusals(replies, grams)
    assert one.known == other.known and {t for t, _ in said if one.odds(t) > D.REFUSAL_ODDS} == {t for t, _ in said if other.odds(t) > D.REFUSAL_ODDS}
    copies = {D.bare(i) for _, i, _, _ in bench}
    told = [t for t, _ in said if D.bare(t) not in copies and one.odds(t) <= D.REFUSAL_ODDS]
    assert (ends, goes_on) == D.Endings.fit(told, [i for _, i, _, _ in bench])

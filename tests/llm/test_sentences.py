import pytest

from bagweave.llm import queries as Q
from bagweave.llm import sentences as S
from bagweave.runtime import table

#: Texts with the expected sentences set apart by "¦".
CASES = [
    "Dr. Miller met Prof. Jones at 5 p.m. on Monday. ¦See Fig. 3.5 and Sec. 2, e.g. the file a.old.csv. ¦Done!",
    "He said \"Stop! Go.\" and left. ¦\"Is it enough?\" asked Ann. ¦The end was... well, odd.",
    "A heading\n\n¦- first item (see x.py)\n¦- second item. With more\n\n¦1. one\n¦2. two\n\n¦A line that\nwraps here. ¦Next one.",
    "All good. 🎉😀 ¦Next here 🚀 ¦Then the 😀 reply came.",
    "Am 5. Mai lief es. ¦Im 12. Lauf war 😀 selten, z. B. hier. ¦„Gut. Sehr gut“, sagte Ann. ¦Es waren 13. ¦Ende.",
    "Voir p. 4, p. ex. ici. ¦« Le sac. L'ordre » dit M. Roux. ¦Pourquoi ? ¦Oui !",
    "¿Sirve 😀 para ti? ¦EE. UU. aporta 3. ¦El Sr. Gil vino, etc. ¦La Dra. Paz no.",
    "В 10 г. тест был короче. ¦См. рис. 4 и гл. 2. ¦А. С. Пушкин писал и т. д. по списку. ¦«Да. Нет», — сказал он.",
    "順序は違う。¦「袋は同じ。順序は違う」と言いました！¦なぜ？！¦「😀で十分です。」¦次は良い。😀¦はい。",
    "他说：“不对。没错”，大家同意。¦“好吗？”他问，然后走了。¦😀适合考试吗？¦为什么?¦行……¦好。",
    "अंक 1.36 से 3.31 हो गया। ¦डॉ. राम ने कहा। ¦क्या 😀 ठीक है? ¦हाँ।",
    "เราเก็บชุดทดสอบและลบสำเนา 19 รายการ ¦ใครเขียนไฟล์นี้ ¦คะแนนเพิ่มจาก 0.27 เป็น 0.67 ในรอบนี้😀 ¦จบ",
    "قال د. سامي إن الدرجة 0.5 غريبة. ¦لماذا انخفض؟ ¦انتهى.",
    "An open ( bracket stays. ¦It binds nothing. ¦A \"quote too. ¦Yes.",
    "the first one is done. ¦the second, too! ¦and a third (e.g. this).",
]


@pytest.mark.parametrize("case", CASES)
def test_hand_split(case):
    text = case.replace("¦", "")
    wanted = [s.strip() for s in case.split("¦")]
    assert [text[a:b] for a, b in S.Splitter().spans(text)] == wanted


def test_words_decide_where_case_is_missing():
    fitted = S.fit_starters(["The file is here. We know it. The end 😀 is near.", "We saw the 😀 reply."] * 3)
    text = "the file is here 😀 we know it. the end 😀 is near."
    assert [text[a:b] for a, b in S.Splitter(S.Starters(*fitted)).spans(text)] == ["the file is here 😀", "we know it.", "the end 😀 is near."]


def test_blank_and_long_texts():
    split = S.Splitter().spans
    assert split("") == split("  \n\t ") == []
    assert len(split("One here. " * 20000)) == 20000
    assert split("(" * 3000 + "a. B")


def test_query_covers_all_but_white_space(spark, small):
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    got = {k: [] for k in texts}
    for r in Q.p10_found(spark, small).collect():
        got[r.doc_id].append((r.start_char, r.end_char))
    for k, spans in got.items():
        text, last = texts[k] or "", 0
        for a, b in sorted(spans):
            assert not text[last:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
            last = b
        assert not text[last:].strip()


def test_empty_table(spark):
    assert S.sentences(spark.createDataFrame([], "doc_id bigint, text string, start_char int")).count() == 0


def _split(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in S.sentences(docs).collect():
        got.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start_char : r.end_char])
    return [sorted(got.get(k, ()), key=texts[k].index) for k in range(len(texts))]


@pytest.mark.parametrize("model_words", [200_000, 0])
def test_rare_starting_words_of_a_rare_language_count(spark, monkeypatch, model_words):
    monkeypatch.setattr(S, "MODEL_WORDS", model_words, raising=False)
    rare = [f"{a}{b}" for a in "कखगघच" for b in "टठडढण"]
    hindi = [f"{w} अ आ। {w} इ ई 😀 {w} उ ऊ।" for w in rare]
    # a word that once starts a sentence, but goes on as a rule, starts none
    other = ["ठीक अ।", *["अ ठीक आ 😀 ठीक इ।"] * 20]
    got = _split(spark, [*hindi, *other, *["Plain text here. Next one."] * 13_000])
    assert got[: len(rare)] == [[f"{w} अ आ।", f"{w} इ ई 😀", f"{w} उ ऊ।"] for w in rare]
    assert got[len(rare) : len(rare) + len(other)] == [[t] for t in other]


def test_model_that_is_joined_gives_the_same(spark, small, monkeypatch):
    whole = sorted(map(tuple, Q.p10_found(spark, small).collect()))
    monkeypatch.setattr(S, "MODEL_WORDS", 0)
    assert sorted(map(tuple, Q.p10_found(spark, small).collect())) == whole


def test_going_on_after_an_abbreviation_is_weighed():
    texts = ["We saw tea etc. and so on. And it was."] * 3 + ["It was tea etc. The end. The rest."] * 3 + ["See etc. the cup."]
    words, goes_on = S.fit_starters(texts)
    assert "the" in words and "the" not in goes_on and "and" in goes_on


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Steps:\n- one thing\n- two thing", ["Steps:", "- one thing", "- two thing"]),
        ("Heading line\nThis is text. More text.", ["Heading line", "This is text.", "More text."]),
        ("1. one\n  - inner item\n  - inner two that goes\n    on here\n2. two\n\nEnd.", ["1. one", "- inner item", "- inner two that goes\n    on here", "2. two", "End."]),
        ("- outer\n  - inner\nBack to the text of it all which is long. And more.", ["- outer", "- inner", "Back to the text of it all which is long.", "And more."]),
        ("It is (a thing\nThat is inside) and a very long line that goes on and on. So.", ["It is (a thing\nThat is inside) and a very long line that goes on and on.", "So."]),
        ("A sentence that was wrapped\nat its usual width. Next\none goes on.", ["A sentence that was wrapped\nat its usual width.", "Next\none goes on."]),
        ("Two  blanks in it. Then more.", ["Two  blanks in it.", "Then more."]),
        ("One\u2028\u2028Two", ["One", "Two"]),
    ],
)
def test_levels_of_lists_and_lines_of_their_own(text, wanted):
    assert [text[a:b] for a, b in S.Splitter().spans(text)] == wanted


def test_a_quotation_on_the_next_line_is_no_head():
    assert not S.Splitter._starts_lower("A. \n« b c »") and S.Splitter._starts_lower("a b. c d. e")

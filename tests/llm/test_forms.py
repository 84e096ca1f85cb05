import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bagweave.llm.columns import changed, consistent, emoji_of
from bagweave.functions.emoji import EMOJI_CHAR
from bagweave.llm.forms import CLUSTER, Forms, _splice, one_script, read_confusables
from pyspark.sql import functions as F

VOCAB = ["❤️", "😀", "👩‍🔬", "🏃‍♀️", "9️⃣", "🇩🇪", "👍🏽", "🏔️"]
K = Forms(VOCAB)


@pytest.mark.parametrize(
    ("given_", "wanted"),
    [
        ("", ""), ("plain ascii", "plain ascii"), ("Café", "Café"), ("ｂｉｇ １２", "big 12"), ("ﬁnally", "finally"), ("が", "が"), ("ｶﾞ", "ガ"),
        ("a b　c d", "a b c d"), ("a\tb\nc", "a\tb\nc"), ("so​ go⁠od﻿­", "so good"),
        ("Cafе", "Cafe"), ("привeт", "привет"), ("Ελa", "Ελα"), ("вода", "вода"), ("два foo", "два foo"),
        ("❤", "❤️"), ("😀️", "😀"), ("😀‍", "😀"), ("👩‍🔬️", "👩‍🔬"), ("🏃‍♀", "🏃‍♀️"), ("９️⃣", "9️⃣"), ("9⃣", "9️⃣"), ("😀‍❤", "😀❤️"),
        ("🦄️", "🦄"), ("🦄‍😀", "🦄😀"), ("🇩​🇪", "🇩🇪"), ("№ Ⅳ ㎏", "No IV kg"), ("क़लम", unicodedata.normalize("NFC", "क़लम")), ("สวัสดี", "สวัสดี"),
    ],
)
def test_cases(given_, wanted):
    assert K.consistent(given_) == wanted
    assert K.consistent(wanted) == wanted


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoе́̂ё☺❤️‍​ 👩🔬😀🇩🇪9⃣ｆﬁが゙ カﾞ각각ᄀ\n\t한ー"), max_size=14))
def test_idempotent_and_spliced_like_the_whole(text):
    once = K.consistent(text)
    assert K.consistent(once) == once
    # splicing segments gives what composing the whole mapped text gives
    from bagweave.llm.forms import _char

    assert _splice(text) == unicodedata.normalize("NFC", "".join(map(_char, text)))


def test_words_keep_their_script_if_they_cannot_change():
    assert one_script("webдом") == "webдом"
    assert one_script("OК") in ("OK", "ОК")


def test_long_text_is_handled_whole():
    text = "é" * 50_000 + "😀️" * 10_000
    out = K.consistent(text)
    assert out == "é" * 50_000 + "😀" * 10_000


def test_columns_keep_nulls_and_send_back_only_changes(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ok"), (4, "❤ x"), (5, "😀😀")], "id int, s string")
    v = tuple(VOCAB)
    got = {r.id: (r.a, r.b, r.c) for r in rows.select("id", consistent(v, F.col("s")).alias("a"), changed(v, F.col("s")).alias("b"), emoji_of(v, F.col("s")).alias("c")).collect()}
    assert got == {1: (None, None, []), 2: ("", None, []), 3: ("ok", None, []), 4: ("❤️ x", "❤️ x", ["❤️"]), 5: ("😀😀", None, ["😀", "😀"])}


@pytest.mark.parametrize(
    ("given_", "wanted"),
    [
        ("в\u03bfда", "вода"), ("κ\u0430λ\u043eς", "καλ\u03bfς"), ("да, в\u03bfда foo", "да, вода foo"), ("вода καλός", "вода καλός"),
        ("\u0628\u0651\u064e", "\u0628\u064e\u0651"), ("ש\u05b8\u05c1ל", "ש\u05b8\u05c1ל"), ("กู่ ปุ่ม", "กู่ ปุ่ม"),
    ],
)
def test_mixed_words_without_latin_and_order_of_marks(given_, wanted):
    wanted = unicodedata.normalize("NFC", wanted)
    assert K.consistent(given_) == wanted
    assert K.consistent(wanted) == wanted


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aбכب \u0651\u064e\u0323\u0301\u05c1\u05b8\u0327\u093c\u094d\u0e38\u0e48​é"), max_size=10))
def test_marks_are_spliced_like_the_whole(text):
    from bagweave.llm.forms import _char

    assert _splice(text) == unicodedata.normalize("NFC", "".join(map(_char, text)))


def test_look_alikes_of_further_scripts():
    f = Forms([])
    assert f.consistent("Ꭺpple ꓮpple հello Ꮯat") == "Apple Apple hello Cat"
    for whole in ("ᎠᎵᏍᏓᏴᏗ", "ꓡꓲꓢꓴ", "Հայերեն", "\u043a\u043e\u0442"):
        assert f.consistent(whole) == whole  # words of one script stay
    for text in ("\u043a\u03bf\u0442", "\u043a\u03bf\u0442 and Latin"):  # a Greek omicron, with and without Latin around
        assert f.consistent(text).split()[0] == "\u043a\u043e\u0442"


@given(st.lists(st.sampled_from([*VOCAB, "❤", "👍", "👍🏿", "a", "é", "e", "\u0301", "ｂ", " ", "\u00a0", "\u200d", "\ufe0f", "9", "\u20e3", "🇫", "🇷", "か", "\u3099", "б", "α", "!", "\n", "\u200b", "©"]), max_size=9))
@settings(max_examples=300, deadline=None)
def test_first_check_changes_nothing(parts):
    text = "".join(parts)
    slow = K._slow(text)
    assert K.consistent(text) == slow
    every = [c for c in CLUSTER.findall(slow) if EMOJI_CHAR.search(c)]
    assert K.emoji_in(text) == K.emoji(slow) == every


def test_confusables_file():
    lines = ["\ufeff# comment", "0430 ;\t0061 ;\tMA\t# a", "0251 ;\t0061 ;\tMA", "03B1 ; 0061 ; MA", "FB00 ; 0066 0066 ; MA", "0031 ; 006C ; MA", ""]
    got = read_confusables(lines)
    assert got["Cyrillic", "Latin"] == {"а": "a"} and got["Greek", "Cyrillic"] == {"α": "а"} and ("Latin", "Latin") not in got

"""Sentence boundaries across languages and scripts (problem 10).

Method: a pushdown automaton reads each paragraph's events (sentence marks, quotation marks, brackets, emoji runs, line
breaks that were made on purpose) and keeps a stack of open quotations and brackets, and one of list levels by their
indent: an item is one sentence, with the lines that go on in it, until an item or a line of an outer level. An
abbreviation trie is walked backwards from a full stop, and marks of every script end sentences. It emits offsets.
Where neither letter case nor a mark decides (scripts without case, texts in lower case), the next word does: it
starts a sentence if it does so more often than it goes on after an emoji, by counts over all documents.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, lookup_skewed
from .columns import per_value
from .forms import EMOJI_RUN

# Abbreviations that never end a sentence, and those that may.
NEVER_ENDS = """dr mr mrs ms prof st fig figs sec eq ch vol vs cf e.g i.e approx rev gen col sgt capt jr sr
abb abschn bzw ca z.b z. b d.h d. h u.a u. a hr fr fa nr s.o evtl ggf inkl vgl
m mm mlle mme p.ex p. ex env chap art éd
sra dra dña srta aprox p.ej p. ej pág págs núm ee
рис гл т.е т. е см стр напр им ул тов проф акад т. д-р
डॉ श्री د أ"""
MAY_END = """etc al usw u.s u.k u.s.a p.m a.m inc ltd co corp no. z. usf ff
uu ee. uu т.д т. д т.п т. п др г гг в.в руб тыс млн"""
BEFORE_DIGITS = "no nr núm p pp n art fig vol"
ORDINAL_AFTER = "im am vom zum beim der die das den dem des jeder jeden jedem ab bis seit"

STRONG = "。！？｡؟۔।॥"
MARKS = f".!?…{STRONG}‼⁉"
_WEAK = frozenset((".", "!", "?", "…"))
OPEN, CLOSE = "«„“「『（([{【《〈‹", "»”」』）)]}】》〉›"
PAIR = {"«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "{": "}", "【": "】", "《": "》", "〈": "〉", "‹": "›", '"': '"', "¿": "?"}

def _spans(pattern: str) -> list[tuple[int, int]]:
    """The spans of code points of the basic plane at which a match of ``pattern`` may begin, digits aside."""
    begins, spans = regex.compile(pattern), []
    for k in range(0x3A, 0x10000):
        if not 0xD800 <= k < 0xE000 and begins.match(chr(k)):
            if spans and spans[-1][1] == k - 1:
                spans[-1] = spans[-1][0], k
            else:
                spans.append((k, k))
    return spans


_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
_PARAGRAPH = regex.compile(rf"{_BREAK}(?:[^\S\n\r]*{_BREAK})+")
_LINE = regex.compile(rf"[^\n\r\x0b\x0c\x85\u2028\u2029]+")
_ITEM = regex.compile(r"\s*(?:[-*•·–—‣◦]|\(?\d{1,3}[.)]|\p{L}[)])\s+\S")
_EMOJI = EMOJI_RUN.pattern

_EVENT = regex.compile(rf"(?P<emoji>{_EMOJI}(?:\s*{_EMOJI})*)|(?P<mark>[{regex.escape(MARKS)}]+)|(?P<open>[{regex.escape(OPEN)}¿])|(?P<close>[{regex.escape(CLOSE)}])|(?P<dq>\")")
#: Where an event may begin: a first look by the faster engine.
_MAY_BE = re.compile("[" + re.escape(MARKS + OPEN + CLOSE + '¿"') + "".join(f"{chr(a)}-{chr(b)}" for a, b in _spans(_EMOJI)) + "\U00010000-\U0010ffff]")
#: Events that are no emoji, by the same engine.
_SIGN = re.compile(rf"(?P<mark>[{re.escape(MARKS)}]+)|(?P<open>[{re.escape(OPEN)}¿])|(?P<close>[{re.escape(CLOSE)}])|(?P<dq>\")")
_SIGN_FIRST = frozenset(MARKS + OPEN + CLOSE + '¿"') - set("‼⁉")
_LAST = regex.compile(r"(\p{L}+)$")
_MORE = regex.compile(rf"[{regex.escape(MARKS)}]+")
_HEAD = re.compile(r"[\n.!?](?:(?<=[.!?])|(?<=\n)\s*\n)[\"'«„“(¿¡]*\s+([^\W\d_])")
_FIRST = re.compile(r"[\"'«„“(¿¡\s]*([^\W\d_])")
_TAIL = regex.compile(rf"\s*{_EMOJI}(?:\s*{_EMOJI})*")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_THAI, _LETTER = re.compile("[\u0e01-\u0e3a\u0e40-\u0e5b]"), regex.compile(r"\p{L}")
#: Letters with their marks, and figures; beyond the basic plane the blocks of letters.
_SIGNS = "".join(f"{chr(a)}-{chr(b)}" for a, b in _spans(r"[\p{L}\p{M}]")) + "\U00010000-\U0001cfff\U0001d400-\U0001d7cb\U0001e000-\U0001eeff\U00020000-\U0003ffff"
_FIGURES = "0-9" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _spans(r"\p{N}"))
_WORD = re.compile(rf"[\"'«„“(\[¿¡]*([{_SIGNS}]+(?:['’_-][{_SIGNS}{_FIGURES}]+)*)")
_WORDS = re.compile(rf"[{_SIGNS}]+(?:['’_-][{_SIGNS}{_FIGURES}]+)*")
_ORDINAL = regex.compile(r"([\p{L}]+)\s+\d{1,2}$")
_LETTERS = regex.compile(r"(?:(?<![\p{L}\p{N}_])|(?<=\.))\p{L}$")
_DOTTED = regex.compile(r"(?<![\p{L}\p{N}_.])(?:\p{L}\.)+\p{L}$")
# What goes on after a closing quotation, or after an emoji that opens the next sentence.
_GOES_ON = regex.compile(r"(?:と|っ|が|は|を|に|も|で|の|など|や|、|，|,|；|：|:|—|–|-)|[他她它我你]们?[^，。！？\s]{0,6}?[问说道答喊写]|[^，。！？\s“「]{1,12}?[问说道答喊]")
_NEEDS_SUBJECT = regex.compile(r"は(?!い(?:[。、，！？!?\s]|$))|が(?![んっ])|を|で(?![もはき])|と(?!ても|り|に|き|ころ)|适合|适用于|合适")


def _trie(kinds: Iterable[tuple[str, str]]) -> dict:
    root: dict = {}
    for kind, words in kinds:
        for line in words.splitlines():
            tokens = line.split()
            merged, k = [], 0
            while k < len(tokens):  # "z. b" is one entry of two parts
                if tokens[k].endswith(".") and k + 1 < len(tokens):
                    merged.append(f"{tokens[k]} {tokens[k + 1]}")
                    k += 1
                else:
                    merged.append(tokens[k])
                k += 1
            for word in merged:
                node = root
                for c in reversed(word):
                    node = node.setdefault(c, {})
                node[""] = kind
    return root


_ABBREVIATIONS = _trie([("never", NEVER_ENDS), ("may", MAY_END)])
_DIGIT_WORDS = set(BEFORE_DIGITS.split())
_ORDINAL_WORDS = set(ORDINAL_AFTER.split())


#: What stands before full stops, without blanks, with what it is; and the last parts of abbreviations with a blank,
#: for which the part before has to be read too.
_BEFORE_DOT: dict[str, str] = {}
_LAST_PARTS = tuple({w.split()[-1] for w in ("z. b", "d. h", "u. a", "p. ex", "p. ej", "т. е", "ee. uu", "т. д", "т. п", "т. д-р")})


def abbreviation(text: str, dot: int, low: int) -> str:
    """'never', 'may' or '': what the word before the full stop at ``dot`` is; words met are remembered."""
    word = text[max(low, text.rfind(" ", low, dot) + 1) : dot]
    known = _BEFORE_DOT.get(word)
    if known is None:
        if len(word) > 24 or word.lower().endswith(_LAST_PARTS):
            return _abbreviation(text, dot, low)
        if len(_BEFORE_DOT) > 100_000:
            _BEFORE_DOT.clear()
        known = _BEFORE_DOT[word] = _abbreviation(word, len(word), 0)
    return known


def _abbreviation(text: str, dot: int, low: int) -> str:
    """As ``abbreviation``, read backwards through the trie."""
    node, k, found = _ABBREVIATIONS, dot - 1, ""
    while k >= low:
        c = text[k]
        node = node.get(" " if c.isspace() else c.lower())
        if node is None:
            break
        if "" in node and (k == low or not (text[k - 1].isalnum() or text[k - 1] in "_.")):
            found = node[""]
        k -= 1
    if found:
        return found
    if dot > low and text[dot - 1].isalpha() and not (dot > 1 and text[dot - 2].isalnum()) and _LETTERS.search(text, max(low, dot - 3), dot):
        return "may" if _DOTTED.search(text, max(low, dot - 12), dot) else "never"
    return ""


class Starters:
    """Words that start sentences, and those among them that also go on after an abbreviation; none without a fit."""

    def __init__(self, words: Iterable[str] = (), goes_on: Iterable[str] = ()):
        self.words, self.goes_on = frozenset(words), frozenset(goes_on)

    def __call__(self, text: str, at: int, abbreviated: bool = False) -> bool:
        m = _WORD.match(text, at)
        if not m:
            return text[at : at + 1] in ("¿", "¡")
        w = m[1].lower().split("_")[0]
        return w in self.words and not (abbreviated and w in self.goes_on)


class Splitter:
    """The automaton; one instance per model of starting words."""

    def __init__(self, starters: Starters | None = None):
        self.starters = starters or Starters()
        self._told: tuple[str | None, bool] = None, False

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Code point offsets (start, end) of the sentences of ``text``; none for empty or blank text."""
        out, low = [], self._lower(text)
        for start, end, item, breaks in self.units(text):
            if item:
                self._emit(text, start, end, out)
            else:
                self._text(text, start, end, low, breaks, out)
        return out

    # -- levels -----------------------------------------------------------

    def units(self, text: str) -> Iterator[tuple[int, int, bool, list[int]]]:
        """The list items and the runs of text between them of all paragraphs; see ``_units``."""
        at = 0
        for m in [*_PARAGRAPH.finditer(text), None]:
            end = m.start() if m else len(text)
            if at < end:
                lines = [x.span() for x in _LINE.finditer(text, at, end) if not x[0].isspace()]
                if lines:
                    yield from self._units(text, lines, end)
            at = m.end() if m else end

    def _text(self, text: str, a: int, b: int, low: bool, breaks: list[int], out: list) -> None:
        thai = _THAI.search(text, a, b) and len(_THAI.findall(text, a, b))
        read = self._thai if thai and 2 * thai > len(_LETTER.findall(text, a, b)) else self._cuts
        cuts, stack = read(text, a, b, low, frozenset(), breaks)
        if stack:  # openers that never close bind nothing
            cuts, _ = read(text, a, b, low, frozenset(p for _, p in stack), breaks)
        start = a
        for c in cuts:
            self._emit(text, start, c, out)
            start = c
        self._emit(text, start, b, out)

    def _units(self, text: str, lines: list[tuple[int, int]], b: int) -> list[tuple[int, int, bool, list[int]]]:
        """(start, end, whether an item, breaks made on purpose within) of the items and the runs of text in a paragraph.

        ``levels`` is the stack of the indents of open list items. A line without a marker goes on in the innermost
        item, unless it stands left of a nested one, or the break before it was made on purpose.
        """
        if len(lines) == 1:
            return [(lines[0][0], b, _ITEM.match(text, *lines[0]) is not None, [])]
        longest = max(y - x for x, y in lines)
        units: list[list] = []
        levels: list[int] = []
        before = None
        for x, y in lines:
            item = _ITEM.match(text, x, y) is not None
            own = before is not None and self._on_purpose(text, before, (x, y), longest)
            if item and (before is None or levels or own or text[before[0] : before[1]].rstrip()[-1:] in (":", "：")):
                indent = self._next(text, x, y) - x
                while levels and levels[-1] > indent:
                    levels.pop()
                if not levels or levels[-1] < indent:
                    levels.append(indent)
                units.append([x, True, []])
            elif levels:
                nested = len(levels) > 1 and self._next(text, x, y) - x < levels[-1]
                if own or nested:
                    levels.clear()
                    units.append([x, False, []])
            elif before is None:
                units.append([x, False, []])
            elif own:
                units[-1][2].append(x)
            before = (x, y)
        ends = [u[0] for u in units[1:]] + [b]
        return [(u[0], e, u[1], u[2]) for u, e in zip(units, ends)]

    def _on_purpose(self, text: str, before: tuple[int, int], line: tuple[int, int], longest: int) -> bool:
        """Whether a single line break ends a heading or a line of its own rather than wrapping a sentence.

        The line before it leaves half of the paragraph's width free, begins as a sentence does, and a sentence can
        begin behind it.
        """
        a, b = before[0], before[1]
        head = text[a:b].strip()
        if 2 * len(head) > longest or not head[:1].isalnum() or head[:1].islower() or _CJK.search(text, *line):
            return False
        k = self._next(text, *line)
        return (text[k].isupper() or text[k].isdigit()) or _ITEM.match(text, *line) is not None

    @staticmethod
    def _emit(text: str, a: int, b: int, out: list) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    def _lower(self, text: str) -> bool:
        """Whether sentences of this text start in lower case; the last text's answer is kept."""
        if self._told[0] is not text:
            self._told = text, self._starts_lower(text)
        return self._told[1]

    @staticmethod
    def _starts_lower(text: str) -> bool:
        first = None if _HEAD.match(text) else _FIRST.match(text)
        found = [first] if first else []
        found += _HEAD.finditer(text, first.end() if first else 0)
        heads = [(m.start(), c) for m in found if (c := m[1]).islower() or c.isupper()]
        if not any(c.islower() for _, c in heads):
            return False
        lower = upper = 0
        for k, c in heads:
            if text[k] == "." and abbreviation(text, k, max(0, k - 12)) or text[max(0, k - 1) : k + 1] == "..":
                continue
            if c.islower():
                lower += 1
            else:
                upper += 1
        return 0 < lower >= upper

    # -- the automaton ----------------------------------------------------

    def _cuts(self, text: str, a: int, b: int, low: bool, loose: frozenset, breaks: list[int]) -> tuple[list[int], list]:
        cuts: list[int] = []
        stack: list[tuple[str, int]] = []
        start = pos = a
        breaks = breaks[::-1]
        keycaps = text.find("⃣", a, b) >= 0  # these begin with a plain digit
        while m := _EVENT.search(text, pos, b) if keycaps else self._event(text, pos, b):
            while breaks and breaks[-1] <= m.start():
                if not stack and breaks[-1] > start:
                    start = breaks[-1]
                    cuts.append(start)
                breaks.pop()
            pos, kind, token = m.end(), m.lastgroup, m[0]
            end = None
            if kind == "emoji":
                if not stack and self._emoji_ends(text, start, m, b, low):
                    end = m.end()
            elif kind == "mark":
                if stack and stack[-1][0] == "¿" and "?" in token:
                    stack.pop()
                if not stack:
                    end = self._mark_ends(text, start, m, b, low)
            elif m.start() in loose:
                continue
            else:
                closes = stack and (token in PAIR[stack[-1][0]])
                if kind == "open" and not closes or kind == "dq" and not closes:
                    stack.append((token, m.start()))
                    continue
                if not closes:
                    k = next((i for i in range(len(stack) - 1, -1, -1) if token in PAIR[stack[i][0]]), None)
                    if k is None:
                        continue
                    del stack[k:]
                else:
                    stack.pop()
                if not stack:
                    end = self._close_ends(text, m.start(), m.end(), b, low)
            if end is not None:
                cuts.append(end)
                start = pos = end
        if not stack:
            cuts += [k for k in reversed(breaks) if k > start]
        return cuts, stack

    @staticmethod
    def _event(text: str, pos: int, b: int) -> regex.Match | None:
        """The next event from ``pos`` on."""
        while f := _MAY_BE.search(text, pos, b):
            m = _SIGN.match(text, f.start(), b) if f[0] in _SIGN_FIRST else _EVENT.match(text, f.start(), b)
            if m:
                return m
            pos = f.end()
        return None

    def _with_tail(self, text: str, j: int, b: int) -> int:
        """``j`` moved behind the emoji that belong to the sentence before."""
        t = _TAIL.match(text, j, b)
        if not t or (t.end() < b and _NEEDS_SUBJECT.match(text, t.end(), b)):
            return j
        j = t.end()
        more = _MORE.match(text, j, b)
        return more.end() if more else j

    def _mark_ends(self, text: str, start: int, m: regex.Match, b: int, low: bool) -> int | None:
        token, i, j = m[0], m.start(), m.end()
        strong = token not in _WEAK and any(c in STRONG for c in token)
        while j < b and text[j] in CLOSE + "”’":
            j += 1
        after = text[j] if j < b else ""
        if after and not strong:
            touching = not after.isspace()
            if touching and not EMOJI_RUN.match(text, j, b):
                cjk = _CJK.match(after) or (i and _CJK.match(text[i - 1]))
                if token.strip("!?…‼⁉") or not cjk and not after in OPEN:
                    return None
            if token == ".":
                kind = abbreviation(text, i, start)
                if kind == "never":
                    return None
                k = self._next(text, j, b)
                if k < b and text[k].isdigit():
                    last = _LAST.search(text, max(start, i - 5), i)
                    if last and last[1].lower() in _DIGIT_WORDS:
                        return None
                elif k < b and i and text[i - 1].isdigit() and text[k].isalpha():
                    o = _ORDINAL.search(text, max(start, i - 24), i)
                    if o and o[1].lower() in _ORDINAL_WORDS:
                        return None
                if kind == "may" and k < b and not self._begins(text, k, low, True):
                    return None
        tail = self._with_tail(text, j, b)
        k = self._next(text, tail, b)
        if k >= b or strong or tail > j:
            return tail
        c = text[k]
        if c.islower():
            if not low:
                return None
            if ("…" in token or ".." in token) and not self.starters(text, k):
                return None
        return tail

    def _close_ends(self, text: str, i: int, j: int, b: int, low: bool) -> int | None:
        """Whether a quotation or bracket that closes at i:j, its own end mark inside, ends the sentence around it."""
        k = i
        while k and (text[k - 1] in CLOSE or text[k - 1].isspace()):
            k -= 1
        back = k
        while back and EMOJI_RUN.match(text[back - 1]):
            back -= 1
        if not back or text[back - 1] not in MARKS and not (back < k and text[back - 1].isspace() and text[:back].rstrip()[-1:] in tuple(MARKS)):
            return None
        if j < b and (text[j] in MARKS or _GOES_ON.match(text, j, b)):
            return None
        tail = self._with_tail(text, j, b)
        k = self._next(text, tail, b)
        if k >= b or tail > j:
            return tail
        if k == j:
            return tail if _CJK.match(text[j]) or text[i] in "」』”" else None
        return tail if self._begins(text, k, low) else None

    def _emoji_ends(self, text: str, start: int, m: regex.Match, b: int, low: bool) -> bool:
        if not text[start : m.start()].strip() or m.end() >= b or not text[m.end()].isspace():
            return False
        k = self._next(text, m.end(), b)
        return k < b and self._begins(text, k, low)

    @staticmethod
    def _next(text: str, k: int, b: int) -> int:
        while k < b and text[k].isspace():
            k += 1
        return k

    def _begins(self, text: str, k: int, low: bool, abbreviated: bool = False) -> bool:
        """Whether a sentence can begin at ``k``, going by case or, without it, by the word."""
        c = text[k]
        j = k
        while c in "\"'«„“(¿¡[‹" and j + 1 < len(text):
            if c in "¿¡":
                return True
            j += 1
            c = text[j]
        if c.isspace() or EMOJI_RUN.match(c) and not c.isdigit():
            return j > k
        if c.isupper():
            return True
        if c.islower():
            return (low or j > k) and self.starters(text, k, abbreviated)
        return c.isalpha() and (bool(_CJK.match(c)) or self.starters(text, k)) if not c.isdigit() else False

    def _thai(self, text: str, a: int, b: int, low: bool, loose: frozenset, breaks: list[int]) -> tuple[list[int], list]:
        """Blanks end sentences, unless a figure stands on either side or a quotation or bracket is open."""
        cuts, stack, k = [], [], a
        while k < b:
            c = text[k]
            if stack and c in PAIR[stack[-1][0]]:
                stack.pop()
            elif (c in OPEN or c == '"') and k not in loose:
                stack.append((c, k))
            elif c.isspace() and not stack:
                n = self._next(text, k, b)
                e = _TAIL.match(text, n, b)
                if e:  # emoji after a blank end the sentence before
                    k = e.end()
                    if k < b and not text[k].isspace():
                        cuts.append(k)
                    continue
                figure = (k > a and text[k - 1].isdigit()) or (n < b and text[n].isdigit() and not EMOJI_RUN.match(text, n, b))
                if k > a and n < b and not figure:
                    cuts.append(n)
                k = n
                continue
            k += 1
        return cuts, stack


#: What is counted of a word: sentences it starts where a mark or a blank line ends the one before, sentences it begins
#: (in upper case) and goes on within (in lower case) after emoji, the same two after an abbreviation that may end a
#: sentence, and all its occurrences.
COUNTS = ("starts", "begun", "inside", "anew", "goes_on", "total")


#: Where a lower-case word may stand behind an emoji or a full stop: looked at closer in ``_count``.
_SPOT = re.compile(r"[^\s\w,;:()!?\"'`/\\+*=-]\s+(?=[^\W\d_])")


class _Asked(Starters):
    """No words at all, but remembers whether any was asked for."""

    def __init__(self):
        super().__init__()
        self.any = False

    def __call__(self, text: str, at: int, abbreviated: bool = False) -> bool:
        self.any = True
        return False


class FirstReader:
    """Reads texts by the rules that need no model, counts words for the model, and leaves open what hangs on it."""

    def __init__(self):
        self.asked = _Asked()
        self.plain = Splitter(self.asked)
        self.n: dict[str, Counter] = {c: Counter() for c in COUNTS}

    def read(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, str, bool, list[int]]]]:
        """(spans, open units): an open unit is (offset, its text, whether sentences start in lower case, its breaks)."""
        plain, low = self.plain, self.plain._lower(text)
        every, spans, left = [], [], []
        for start, end, item, breaks in plain.units(text):
            self.asked.any, known = False, len(every)
            if item:
                plain._emit(text, start, end, every)
            else:
                plain._text(text, start, end, low, breaks, every)
            if self.asked.any:
                left.append((start, text[start:end], low, [k - start for k in breaks]))
            else:
                spans += every[known:]
        self._count(text, every, low)
        return spans, left

    def _count(self, text: str, spans: list[tuple[int, int]], low: bool) -> None:
        n, before = self.n, 0
        n["total"].update(_WORDS.findall(text.lower()))  # as they stand; ``_totals`` makes words of them
        for a, b in spans:
            w = _WORD.match(text, a, b)
            if w:
                end = a
                while end > before and text[end - 1].isspace():
                    end -= 1
                last = text[end - 1] if end else ""
                if not last or last in MARKS or "\n\n" in text[end:a]:
                    n["starts"][_plain(w)] += 1
                    if last == "." and abbreviation(text, end - 1, before) == "may":
                        n["anew"][_plain(w)] += 1
                elif EMOJI_RUN.match(last):
                    n["begun"][_plain(w)] += 1
            before = a
        if low:
            return
        starts = [a for a, _ in spans]
        for m in _SPOT.finditer(text):
            if text[m.end()].islower():
                a, b = spans[bisect_right(starts, m.start()) - 1]
                w = m.end() < b and _WORD.match(text, m.end(), b)
                if w and EMOJI_RUN.match(text[m.start()]):
                    n["inside"][_plain(w)] += 1
                elif w and text[m.start()] == "." and abbreviation(text, m.start(), a) == "may":
                    n["goes_on"][_plain(w)] += 1


def words_of(text: str) -> list[str]:
    """The words of ``text`` that a starting word may be looked up by; those of signs without blanks never are."""
    return list(_totals(dict.fromkeys(_WORDS.findall(text.lower()), 1)))


def _totals(found: dict[str, int]) -> Counter:
    """Counts of words from those of what ``_WORDS`` finds."""
    out: Counter = Counter()
    for w, n in found.items():
        if not _CJK.match(w):
            out[w.split("_")[0]] += n
    return out


def _decided(starts, begun, inside, anew, goes_on, total, all_starts, all_total):
    """(starts a sentence, goes on after an abbreviation): of counts, as numbers or as columns. No count is a bound.

    After emoji in texts with case the word itself shows it; without such cases, it starts a sentence if it is commoner
    among the first words of sentences than among all words of its script.
    """
    unseen = begun + inside == 0
    starter = (starts > 0) & ((begun > inside) | (unseen & (starts / all_starts > total / all_total)))
    return starter, goes_on > anew


def _script_of(word: str) -> str:
    return _script_name(word[0])


@cache
def _script_name(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def fit_starters(texts: Iterable[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words that start sentences, and those that go on after an abbreviation, of a few texts; ``fit`` is for tables."""
    reader = FirstReader()
    for text in texts:
        reader.read(text)
    n = reader.n
    n["total"] = _totals(n["total"])
    every = {w: np.array([n[c][w] for c in COUNTS]) for w in set().union(*n.values())}
    of_script: dict[str, np.ndarray] = {}
    for w, k in every.items():
        of_script[_script_of(w)] = of_script.get(_script_of(w), 0) + k
    is_a = {w: _decided(*k, max(1, of_script[_script_of(w)][0]), max(1, of_script[_script_of(w)][-1])) for w, k in every.items()}
    return tuple(sorted(w for w, d in is_a.items() if d[0])), tuple(sorted(w for w, d in is_a.items() if d[1]))


def _plain(m: regex.Match) -> str:
    return m[1].lower().split("_")[0]


#: Distinct words that a task gathers before it sends their counts on; bounds its memory, not the result.
GATHERED_WORDS = 200_000
#: Words of the model up to which it travels with the function; a larger one is joined to the words of the open units.
MODEL_WORDS = 200_000

_UNIT = pa.struct([("at", pa.int32()), ("text", pa.string()), ("low", pa.bool_()), ("breaks", pa.list_(pa.int32()))])
_READ = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.list_(pa.int32())), ("end", pa.list_(pa.int32())), ("units", pa.list_(_UNIT)),
    ("word", pa.string()), ("script", pa.string()), *((c, pa.int64()) for c in COUNTS),
])
_READ_SQL = "doc_id bigint, start array<int>, end array<int>, units array<struct<at:int,text:string,low:boolean,breaks:array<int>>>, word string, script string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over (doc_id, text): rows of documents with what is decided and what is open, and rows of counted words."""
    reader = FirstReader()

    def rows(size, known):
        return pa.record_batch([known[f.name].cast(f.type) if f.name in known else pa.nulls(size, f.type) for f in _READ], schema=_READ)

    def words():
        n = reader.n
        n["total"] = _totals(n["total"])
        every = list(set().union(*n.values()))
        counts = {c: pa.array([n[c][w] for w in every], pa.int64()) for c in COUNTS}
        yield rows(len(every), {"word": pa.array(every, pa.string()), "script": pa.array(map(_script_of, every), pa.string()), **counts})
        for counter in n.values():
            counter.clear()

    for batch in batches:
        spans, left = [], []
        for text in batch.column(1).to_pylist():
            s, u = reader.read(text) if text else ([], [])
            spans.append(s)
            left.append([dict(zip(("at", "text", "low", "breaks"), x)) for x in u])
            if len(reader.n["total"]) >= GATHERED_WORDS:
                yield from words()
        start, end = (pa.array([[x[k] for x in s] for s in spans], pa.list_(pa.int32())) for k in (0, 1))
        yield rows(batch.num_rows, {"doc_id": batch.column(0), "start": start, "end": end, "units": pa.array(left, pa.list_(_UNIT))})
    yield from words()


def read(documents: DataFrame) -> DataFrame:
    """The first pass over ``documents`` (doc_id, text), written: see ``_read``."""
    return durable(documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_read, _READ_SQL))


def fit(first: DataFrame) -> DataFrame:
    """(word, total, goes_on): the words that start sentences, counted over all documents of a first pass."""
    words = durable(first.filter("word IS NOT NULL").groupBy("word", "script").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    scripts = words.groupBy("script").agg(F.greatest(F.sum("starts"), F.lit(1)).alias("all_starts"), F.greatest(F.sum("total"), F.lit(1)).alias("all_total"))
    starter, goes_on = _decided(*map(F.col, (*COUNTS, "all_starts", "all_total")))
    model = words.join(F.broadcast(scripts), "script").select("word", "total", starter.alias("starter"), goes_on.alias("goes_on"))
    return durable(model.filter("starter").drop("starter"))  # a word that starts nothing is never looked up as going on


_splitters: dict[int, Splitter] = {}


def _splitter(model: tuple) -> Splitter:
    key = hash(model)
    if key not in _splitters:
        _splitters[key] = Splitter(Starters(*model))
    return _splitters[key]


def sentence_spans(text: Column, model: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())) -> Column:
    """array<struct<a, b>> of the sentences' offsets; empty for null, empty and blank texts."""

    def make():
        f = _splitter(model).spans
        return lambda s: [{"a": a, "b": b} for a, b in f(s)] if s else []

    return per_value("array<struct<a:int,b:int>>", make)(text)


def _unit_spans(splitter: Splitter, unit: dict) -> list[dict]:
    out: list[tuple[int, int]] = []
    splitter._text(unit["text"], 0, len(unit["text"]), unit["low"], unit["breaks"], out)
    return [{"a": unit["at"] + a, "b": unit["at"] + b} for a, b in out]


def _closed(units: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, spans) of the open units (doc_id, unit), by the words of ``model`` that stand in them."""
    rows = model.limit(MODEL_WORDS + 1).collect()
    kind = "array<struct<a:int,b:int>>"
    if len(rows) <= MODEL_WORDS:
        known = tuple(sorted(r.word for r in rows)), tuple(sorted(r.word for r in rows if r.goes_on))

        def with_all():
            s = _splitter(known)
            return lambda unit: _unit_spans(s, unit)

        return units.select("doc_id", per_value(kind, with_all)(F.col("unit")).alias("spans"))

    def with_own():
        return lambda unit, words, goes_on: _unit_spans(Splitter(Starters(words or (), goes_on or ())), unit)

    keyed = durable(units.withColumn("_key", F.monotonically_increasing_id()))
    asked = keyed.select("_key", F.explode(per_value("array<string>", lambda: lambda s: words_of(s) if s else [])(F.col("unit.text"))).alias("word"))
    own = lookup_skewed(asked, model, ["word"], "total").groupBy("_key").agg(F.collect_list("word").alias("words"), F.collect_list(F.when(F.col("goes_on"), F.col("word"))).alias("on"))
    return keyed.join(own, "_key", "left").select("doc_id", per_value(kind, with_own)(F.col("unit"), F.col("words"), F.col("on")).alias("spans"))


def sentences(documents: DataFrame, model: tuple[tuple[str, ...], tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, start_char, end_char), one row per sentence of every document; blank documents have none.

    Without a model, one pass over the texts decides all that needs none and counts the words that the model is made
    of; only the units of text in which the model is asked are read again.
    """
    if model is not None:
        at = documents.select("doc_id", F.explode(sentence_spans(F.col("text"), model)).alias("s")).select("doc_id", "s.a", "s.b")
    else:
        first = read(documents)
        there = first.filter("word IS NULL")
        at = there.select("doc_id", F.explode(F.arrays_zip("start", "end")).alias("s")).select("doc_id", F.col("s.start").alias("a"), F.col("s.end").alias("b"))
        later = _closed(there.select("doc_id", F.explode("units").alias("unit")), fit(first))
        at = at.unionByName(later.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.a", "s.b"))
    return at.select("doc_id", F.col("a").cast("bigint").alias("start_char"), F.col("b").cast("bigint").alias("end_char"))

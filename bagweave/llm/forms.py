"""Consistent form of text (problem 4), as a Python kernel with normalization quick checks.

A text is in consistent form when accents are composed with their letter, letters and digits have normal width
and are not joined into one sign, each word has letters of one script, every blank but tab and line break is the
plain space, nothing is invisible except inside an emoji of the vocabulary, and every emoji is spelled as there.

Method: a character class built from the Unicode quick-check and decomposition properties isolates unstable
segments; only those, with the stable character before them as boundary context, are mapped and composed, and are
spliced into the otherwise unchanged text. Emoji runs and words of several scripts are separate segment kinds.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import regex

from ..functions.emoji import EMOJI_CHAR

# Letters that look alike across scripts, as in the public confusables data; each pair has a letter of the
# first script and its look-alike of the second.
LATIN_CYRILLIC = "aа cс eе oо pр xх yу iі jј sѕ dԁ hһ qԛ wԝ kк lӏ AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ QԚ WԜ ëё ïї ËЁ ÏЇ"
LATIN_GREEK = "oο aα iι vν pρ uυ kκ xχ yγ AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ óό áά íί"
LATIN_ARMENIAN = "hհ nո oօ uս gց qզ jյ SՏ OՕ UՍ LԼ"
LATIN_CHEROKEE = "DᎠ RᎡ TᎢ iᎥ YᎩ AᎪ JᎫ EᎬ WᎳ MᎷ HᎻ GᏀ hᏂ ZᏃ bᏏ VᏙ SᏚ LᏞ CᏟ PᏢ KᏦ dᏧ BᏴ"
LATIN_LISU = "BꓐPꓑDꓓTꓔGꓖKꓗJꓙCꓚZꓜFꓝMꓟNꓠLꓡSꓢRꓣVꓦHꓧWꓪXꓫYꓬAꓮEꓰIꓲOꓳUꓴ"
CYRILLIC_GREEK = "аα оο рρ кκ хχ АΑ ВΒ ЕΕ НΗ ІΙ КΚ МΜ ОΟ РΡ ТΤ ХΧ"

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Lisu")
ALIKE_SCRIPTS = "".join(rf"\p{{{s}}}" for s in SCRIPTS[1:])
_PAIRS = {
    ("Latin", "Cyrillic"): LATIN_CYRILLIC, ("Latin", "Greek"): LATIN_GREEK, ("Latin", "Armenian"): LATIN_ARMENIAN,
    ("Latin", "Cherokee"): LATIN_CHEROKEE, ("Latin", "Lisu"): LATIN_LISU, ("Cyrillic", "Greek"): CYRILLIC_GREEK,
}
#: (from script, to script) -> {letter: look-alike}
ALIKE: dict[tuple[str, str], dict[str, str]] = {}
for (_a, _b), _text in _PAIRS.items():
    _letters = _text.replace(" ", "")
    for _x, _y in zip(_letters[::2], _letters[1::2]):
        ALIKE.setdefault((_a, _b), {})[_x] = _y
        ALIKE.setdefault((_b, _a), {})[_y] = _x


def read_confusables(lines) -> dict[tuple[str, str], dict[str, str]]:
    """Look-alikes as in ALIKE from lines of the public confusables file ('0430 ; 0061 ; MA # ...').

    Letters of one character that share a prototype look alike; those of the SCRIPTS above are kept. ``ALIKE`` can be
    updated with the result where the file is at hand.
    """
    by_prototype: dict[str, list[str]] = {}
    for line in lines:
        parts = line.split("#")[0].lstrip("\ufeff").split(";")
        if len(parts) > 1:
            source, target = ("".join(chr(int(x, 16)) for x in p.split()) for p in parts[:2])
            if len(source) == len(target) == 1:
                by_prototype.setdefault(target, [target]).append(source)
    out: dict[tuple[str, str], dict[str, str]] = {}
    for alike in by_prototype.values():
        letters = [(c, _script(c)) for c in alike if _script(c) and c.isalpha()]
        for c, s in letters:
            for d, t in letters:
                if s != t:
                    out.setdefault((s, t), {}).setdefault(c, d)
    return out


#: Invisible characters that only an emoji may hold; they are judged with the emoji run around them.
JOINERS = "‍︎️\U000E0020-\U000E007F"
INVISIBLE = regex.compile(
    rf"(?V1)[[\p{{Cf}}\p{{Default_Ignorable_Code_Point}}\p{{Cc}}]--[{JOINERS}\t\n\r\v\f\x85\x1c-\x1f]]"
)
BLANK = regex.compile(r"(?V1)[\p{Zs}--[ ]]")
#: Everything a first look must stop at: not yet composed, or with a compatibility form, blank or invisible.
_SUSPECT = (
    r"[[\p{NFC_QC=N}\p{NFC_QC=M}\p{Zs}\p{Cf}\p{Default_Ignorable_Code_Point}\p{Cc}"
    r"[[\p{L}\p{N}\p{So}]&&[\p{Decomposition_Type=Wide}\p{Decomposition_Type=Narrow}\p{Decomposition_Type=Compat}"
    r"\p{Decomposition_Type=Square}\p{Decomposition_Type=Font}\p{Decomposition_Type=Initial}\p{Decomposition_Type=Medial}"
    rf"\p{{Decomposition_Type=Final}}\p{{Decomposition_Type=Isolated}}]]]--[ \t\n\r{JOINERS}]]"
)
#: ... and marks that may stand in another than the canonical order.
SUSPECTS = regex.compile(rf"(?:{_SUSPECT}\p{{M}}*|[\p{{M}}--\p{{ccc=0}}]{{2,}})+", regex.V1)
_MARK = regex.compile(r"\p{M}")

_RUN = rf"(?:[0-9#*](?=[{JOINERS}]*⃣)|[\p{{Extended_Pictographic}}\p{{RI}}⃣{JOINERS}\U0001F3FB-\U0001F3FF])+"
EMOJI_RUN = regex.compile(_RUN)
CLUSTER = regex.compile(r"\X")
_STRIP = {0xFE0E: None, 0xFE0F: None}

WORD = regex.compile(r"[\p{L}\p{M}]+")
_OTHER = regex.compile(f"[{ALIKE_SCRIPTS}]")
_SCRIPT_OF = [(s, regex.compile(rf"\p{{{s}}}")) for s in SCRIPTS]


@cache
def _char(c: str) -> str:
    """What a suspect character becomes before composition."""
    if BLANK.match(c):
        return " "
    if INVISIBLE.match(c):
        return ""
    d = unicodedata.decomposition(c)
    if d.startswith("<") and not EMOJI_CHAR.match(c):
        kind, n = d[1 : d.index(">")], unicodedata.normalize("NFKC", c)
        flat = all(x.isalnum() or unicodedata.combining(x) for x in n)
        if flat and (kind in ("wide", "narrow", "font", "initial", "medial", "final", "isolated") or len(n) > 1 or c.isnumeric()):
            return n
    return c


def _splice(text: str) -> str:
    """``text`` with its suspect segments mapped and composed, each together with the stable letter before it."""
    out, done = [], 0
    for m in SUSPECTS.finditer(text):
        start = m.start()
        while start > done and (start == m.start() or _MARK.match(text[start])):
            start -= 1
        out.append(text[done:start])
        out.append(unicodedata.normalize("NFC", "".join(map(_char, text[start : m.end()]))))
        done = m.end()
    return "".join(out) + text[done:] if done else text


@cache
def _script(c: str) -> str:
    return next((s for s, r in _SCRIPT_OF if r.match(c)), "")


def one_script(word: str) -> str:
    """``word`` with look-alike letters moved to the script the rest of it has; unchanged if that can't be done.

    The script that needs no impossible change wins, then the one with more letters, then Latin.
    """
    scripts = [_script(c) for c in word]
    there = [s for s in SCRIPTS if s in scripts]
    if len(there) < 2:
        return word
    best = None
    for k, to in enumerate(there):
        bad = sum(1 for c, s in zip(word, scripts) if s and s != to and c not in ALIKE.get((s, to), ()))
        if not bad and (best is None or scripts.count(to) > best[0]):
            best = (scripts.count(to), to)
    if best is None:
        return word
    to = best[1]
    return unicodedata.normalize("NFC", "".join(ALIKE[s, to][c] if s and s != to else c for c, s in zip(word, scripts)))


#: Characters of the basic plane that no rule looks at: stable under the quick checks, no mark, in no emoji run, and of
#: no script with look-alikes.
_STABLE = regex.compile(rf"(?V1)[[\u0020-\uffef]--[\p{{M}}\p{{Cn}}\p{{Cs}}\p{{Co}}{ALIKE_SCRIPTS}{JOINERS}⃣\p{{Extended_Pictographic}}]]")


@cache
def unstable() -> re.Pattern:
    """Runs of other characters; the class is built from the properties, as spans, for the faster engine."""
    every = "".join(c for c in _STABLE.findall("".join(chr(k) for k in range(0x20, 0xFFF0) if not 0xD800 <= k < 0xE000)) if not SUSPECTS.match(c))
    spans, first = [], 0
    for k in range(1, len(every) + 1):
        if k == len(every) or ord(every[k]) != ord(every[k - 1]) + 1:
            spans.append(f"\\u{ord(every[first]):04x}-\\u{ord(every[k - 1]):04x}")
            first = k
    return re.compile(f"[^\\t\\n{''.join(spans)}]+")


class Forms:
    """The kernel for one emoji vocabulary; its caches hold one entry per distinct emoji cluster, up to a bound.

    ``quick`` is the first check: a text made only of stable characters and of emoji that the vocabulary spells so is
    in consistent form. All other texts take the way through the segments.
    """

    #: Distinct clusters kept; beyond, the cache starts anew.
    CACHE = 200_000

    def __init__(self, vocabulary: list[str]):
        self.known = {v.translate(_STRIP): v for v in vocabulary}
        self.clusters: dict[str, str] = {}
        self.plain = frozenset(v for v in self.known.values() if self._stands_alone(v))

    def _stands_alone(self, emoji: str) -> bool:
        """Whether an emoji of the vocabulary is one cluster whatever stable character or emoji is beside it, and its own form."""
        beside = CLUSTER.findall(f"a{emoji}{emoji}")
        return bool(emoji) and beside == ["a", emoji, emoji] and self._slow(emoji) == emoji and EMOJI_CHAR.search(emoji) is not None

    def _cluster(self, c: str) -> str:
        key = c.translate(_STRIP).strip("‍")
        if key not in self.known and (len(key) > 1 and ("‍" in key or EMOJI_CHAR.search(key))):
            # joined emoji outside the vocabulary fall apart; tag characters are invisible outside it
            parts = [regex.sub("[\U000E0020-\U000E007F]", "", p) for p in key.split("‍")]
            out = "".join(self.known.get(p, p) for p in parts)
        else:
            out = self.known.get(key, key)
        if len(self.clusters) >= self.CACHE:
            self.clusters.clear()
        self.clusters[c] = out
        return out

    def _run(self, m: regex.Match) -> str:
        get, make = self.clusters.get, self._cluster
        out = []
        for c in CLUSTER.findall(m[0]):
            known = get(c)
            out.append(make(c) if known is None else known)
        return "".join(out)

    def quick(self, text: str) -> list[str] | None:
        """The emoji of a text that the first check finds to be in consistent form, else None."""
        out: list[str] = []
        for run in unstable().findall(text):
            out += CLUSTER.findall(run)
        return out if self.plain.issuperset(out) else None

    def consistent(self, text: str) -> str:
        """``text`` in consistent form. Idempotent; '' stays ''."""
        return self._slow(text) if self.quick(text) is None else text

    def _slow(self, text: str) -> str:
        if text.isascii():
            if not INVISIBLE.search(text):
                return text
        while True:  # what an invisible character kept apart may compose or join now; rarely twice
            new = EMOJI_RUN.sub(self._run, _splice(text))
            if new == text:
                break
            text = new
        if _OTHER.search(text) and sum(1 for _, r in _SCRIPT_OF if r.search(text)) > 1:
            text = WORD.sub(lambda m: one_script(m[0]), text)
        return text

    def emoji(self, text: str) -> list[str]:
        """The emoji of a text that is in consistent form, in order."""
        if text.isascii():
            return []
        known = self.quick(text)
        if known is not None:
            return known
        if "⃣" in text:
            return [c for c in CLUSTER.findall(text) if EMOJI_CHAR.search(c)]
        return [c for run in unstable().findall(text) for c in CLUSTER.findall(run) if EMOJI_CHAR.search(c)]

    def emoji_in(self, text: str) -> list[str]:
        """The emoji of any text in its consistent form, in order."""
        known = self.quick(text)
        return self.emoji(self._slow(text)) if known is None else known

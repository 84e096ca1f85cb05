"""The emoji predicate and grapheme tokens, as JVM expressions and for Python kernels.

An emoji is an extended grapheme cluster holding an extended pictographic, a regional indicator,
the keycap sign U+20E3 or a tag character.
"""

from __future__ import annotations

from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points searched for pictographics; none exists outside.
_SPAN = range(0xA0, 0x20000)
_OTHERS = "\\x{1F1E6}-\\x{1F1FF}\\x{20E3}\\x{E0020}-\\x{E007F}"


@cache
def emoji_class() -> str:
    """Body of a character class (Java, RE2) of the code points that make a cluster an emoji.

    Built from the Unicode property rather than listed: Java 17 lacks Extended_Pictographic.
    """
    runs = regex.finditer(r"\p{Extended_Pictographic}+", "".join(map(chr, _SPAN)))
    spans = [(ord(m[0][0]), ord(m[0][-1])) for m in runs]
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + _OTHERS


def graphemes(text: Column) -> Column:
    """The extended grapheme clusters of ``text``; null for null."""
    return F.regexp_extract_all(text, F.lit(r"(\X)"), 1)


def is_emoji(token: Column) -> Column:
    """Whether a grapheme cluster is an emoji."""
    return token.rlike(f"[{emoji_class()}]")


def emoji_tokens(text: Column) -> Column:
    """The emoji clusters of ``text`` in order; an empty array for null or none."""
    return F.coalesce(F.filter(graphemes(text), is_emoji), F.array().cast("array<string>"))


#: The same predicate for Python kernels (compiled once per worker).
EMOJI_CHAR = regex.compile(r"[\p{Extended_Pictographic}\p{Regional_Indicator}⃣\U000E0020-\U000E007F]")

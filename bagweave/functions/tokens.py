"""Tokenizers as Column expressions, and encoding of tokens to ids."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .emoji import emoji_tokens, graphemes


# Special tokens, and the ids of the character vocabulary.
SPECIALS = ("[PAD]", "[BOS]", "[EOS]", "[SEP]", "[MASK]")
CHARACTER_SPECIALS = ("[CLS]", "[SEP]", "[BOS]", "[EOS]", "[MASK]", "[PAD]", "[RESERVED]", "[UNK]")
CHARACTERS = "abcdefghijklmnopqrstuvwxyz "
CHARACTER_IDS = {t: k for k, t in enumerate([*CHARACTER_SPECIALS, *CHARACTERS])}

#: White space at either end as Python strips it; Spark's trim takes only spaces.
BLANKS = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANKS}+|{BLANKS}+$", "")


def words(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores in lower case; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), F.array().cast("array<string>"))


def characters(text: Column) -> Column:
    """Single code points in lower case; an empty array for null and ''."""
    split = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    return F.coalesce(split, F.array().cast("array<string>"))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"emoji": emoji_tokens, "grapheme": graphemes, "word": words, "char": characters}


def tokenize(text: Column, kind: str = "emoji") -> Column:
    if kind not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {kind!r}: use one of {sorted(TOKENIZERS)}")
    return TOKENIZERS[kind](text)


def emoji_text(text: Column) -> Column:
    """Only the emoji of ``text``, joined."""
    return F.array_join(emoji_tokens(text), "")


def bag_key(tokens: Column) -> Column:
    """The tokens in code point order, joined by one blank: equal for equal bags."""
    return F.array_join(F.array_sort(tokens), " ")


def character_ids(text: Column) -> Column:
    """Ids of the characters in the fixed vocabulary; others get the id of [UNK]."""
    known = F.create_map(*[F.lit(x) for c in CHARACTERS for x in (c, CHARACTER_IDS[c])])
    return F.transform(characters(text), lambda c: F.coalesce(F.try_element_at(known, c), F.lit(CHARACTER_IDS["[UNK]"])))


def with_specials(ids: Column, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def specials_mask(ids: Column, specials: list[int]) -> Column:
    """1 for special ids, 0 for others."""
    return F.transform(ids, lambda i: i.isin(specials).cast("int"))


def decode(ids: Column, vocabulary: dict[int, str], specials: list[int]) -> Column:
    """The text of ids of a small vocabulary, special and unknown ids dropped."""
    known = F.create_map(*[F.lit(x) for k, t in vocabulary.items() for x in (k, t)])
    return F.array_join(F.transform(F.filter(ids, lambda i: ~i.isin(specials)), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(""))), "")


def with_tokenizer(text: Column, make: Callable[[], Callable[[str], list[int]]]) -> Column:
    """Ids by any tokenizer: ``make`` builds the encode function once per worker batch; null gives an empty array."""

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        f = make()
        return s.map(lambda t: f(t) if t else [])

    return encode(text)


def model_label(name: Column) -> Column:
    """A model id as a label: slashes, colons, dots and hyphens become underscores."""
    return F.translate(name, "/:.-", "____")

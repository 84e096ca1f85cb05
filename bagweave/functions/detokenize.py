"""Detokenizers of well-known corpora, as chains of literal and pattern replacements.

Each is a table of ordered rules (kind, from, to): '=' replaces text, '~' a pattern. The tables are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import strip

# The rules, in the order in which they apply.
WIKITEXT = [
    ("=", "s '", "s'"), ("~", "/' [0-9]/", "/'[0-9]/"), ("=", " @-@ ", "-"), ("=", " @,@ ", ","), ("=", " @.@ ", "."),
    ("=", " : ", ": "), ("=", " ; ", "; "), ("=", " . ", ". "), ("=", " ! ", "! "), ("=", " ? ", "? "), ("=", " , ", ", "),
    ("~", r"\(\s*([^\)]*?)\s*\)", "($1)"), ("~", r"\[\s*([^\]]*?)\s*\]", "[$1]"), ("~", r"\{\s*([^}]*?)\s*\}", r"\{$1\}"),
    ("~", r'"\s*([^"]*?)\s*"', '"$1"'), ("~", r"'\s*([^']*?)\s*'", "'$1'"), ("=", "= = = =", "===="), ("=", "= = =", "==="),
    ("=", "= =", "=="), ("=", " ° ", "°"), ("=", " \n", "\n"), ("=", "\n ", "\n"), ("=", " N ", " 1 "), ("=", " 's", "'s"),
]
PTB = [
    ("=", " 's", "'s"), ("=", "s ' ", "s' "), ("=", " n't", "n't"), ("=", " \n ", "\n"), ("=", "\\/", "/"),
    *[("=", " N ", " 1 ")] * 10, ("=", "$ 1", "$1"), ("=", "# 1", "#1"), ("=", "<unk>", "?"),
]
LM1B = [
    ("=", "http : / / ", "http://"), ("=", "https : / / ", "https://"), ("~", r" '([\p{L}\p{N}_]+)", "'$1"),
    ("~", r" ([\p{L}\p{N}_]+) \. ", " $1. "), ("~", r" ([\p{L}\p{N}_]+) \.$", " $1."), ("=", " ? ", "? "), ("~", r" \?$", "?"), ("=", " ! ", "! "),
    ("~", r" \!$", "!"), ("=", " , ", ", "), ("=", " : ", ": "), ("=", " ; ", "; "), ("=", " / ", "/"),
    ("~", '" ([^"]+) "', '"$1"'), ("~", "' ([^']+) '", "'$1'"), ("~", r"\( ([^\(\)]+) \)", "($1)"), ("~", r"\[ ([^\[\]]+) \]", "[$1]"),
    ("=", "$ ", "$"), ("=", "£ ", "£"),
]


def apply_rules(text: Column, rules) -> Column:
    for kind, a, b in rules:
        text = F.replace(text, F.lit(a), F.lit(b)) if kind == "=" else F.regexp_replace(text, a, b)
    return text


def wikitext(text: Column) -> Column:
    return apply_rules(text, WIKITEXT)


def ptb(text: Column) -> Column:
    return apply_rules(text, PTB)


def lm1b(text: Column) -> Column:
    return apply_rules(text, LM1B)


def lambada(text: Column) -> Column:
    return F.concat(F.lit("\n"), strip(F.translate(text, "“”", '""')))


def scientific_papers(text: Column) -> Column:
    return lm1b(wikitext(text))


DETOKENIZERS = {"wikitext": wikitext, "ptb": ptb, "lm1b": lm1b, "lambada": lambada, "scientific_papers": scientific_papers}

"""Fragments of DuckDB SQL that mirror the Column functions; used for the oracles only."""

from __future__ import annotations

from ..functions.detokenize import LM1B, PTB, WIKITEXT
from ..functions.emoji import emoji_class

CLASS = emoji_class()


def emoji(c: str) -> str:
    every = f"[substring_grapheme({c}, i::INT, 1) for i in range(1, length_grapheme({c}) + 1)]"
    return f"coalesce(list_filter({every}, lambda g: regexp_matches(g, '[{CLASS}]')), [])"


def key(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ' ')"


def overlap(p: str, t: str) -> str:
    each = f"least(len(list_filter({p}, lambda y: y = k)), len(list_filter({t}, lambda y: y = k)))"
    return f"coalesce(list_sum(list_transform(list_distinct({p}), lambda k: {each})), 0)::DOUBLE"


def metrics(source: str, p: str = "p", t: str = "t") -> str:
    """A query that adds all metrics of two token lists to ``source``."""
    return f"""
    SELECT *, 0.50 * bag_f1 + 0.25 * bag_jaccard + 0.15 * set_jaccard + 0.10 * length_score AS benchmark_score FROM (
    SELECT *, CASE WHEN bag_precision + bag_recall = 0 THEN 0.0::DOUBLE ELSE 2 * bag_precision * bag_recall / (bag_precision + bag_recall) END AS bag_f1 FROM (
    SELECT *, CASE WHEN np = 0 THEN (nt = 0)::INT::DOUBLE ELSE ov / np END AS bag_precision,
      CASE WHEN nt = 0 THEN (np = 0)::INT::DOUBLE ELSE ov / nt END AS bag_recall,
      CASE WHEN np + nt - ov = 0 THEN 1.0::DOUBLE ELSE ov / (np + nt - ov) END AS bag_jaccard,
      CASE WHEN np + nt = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({p}, {t}))::DOUBLE / len(list_distinct(list_concat({p}, {t}))) END AS set_jaccard,
      CASE WHEN np = 0 AND nt = 0 THEN 1.0::DOUBLE WHEN np = 0 OR nt = 0 THEN 0.0 ELSE least(np, nt)::DOUBLE / greatest(np, nt) END AS length_score,
      (list_sort({p}) = list_sort({t}))::INT::DOUBLE AS exact_bag_match, ({p} = {t})::INT::DOUBLE AS exact_sequence_match
    FROM (SELECT *, len({p}) AS np, len({t}) AS nt, {overlap(p, t)} AS ov FROM ({source}))))"""


def unit(text: str) -> str:
    return f"(('0x' || substr(sha1({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def strip(c: str) -> str:
    blanks = "[\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}]"
    return f"regexp_replace({c}, '^{blanks}+|{blanks}+$', '', 'g')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rules(c: str, table) -> str:
    for kind, a, b in table:
        if kind == "=":
            c = f"replace({c}, {quoted(a)}, {quoted(b)})"
        else:
            b = b.replace("$1", "\\1").replace("\\{", "{").replace("\\}", "}")
            if a.endswith("$"):
                a, b = a[:-1] + "(\\n?)$", b + ("\\2" if "(" in a else "\\1")
            c = f"regexp_replace({c}, {quoted(a)}, {quoted(b)}, 'g')"
    return c


DETOKENIZED = {"ptb": lambda c: rules(c, PTB), "lm1b": lambda c: rules(c, LM1B), "wikitext": lambda c: rules(c, WIKITEXT)}


def first_truthy(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in columns) + ", '')"


def fingerprint(instruction: str, given: str, output: str, topic: str) -> str:
    parts = (("{\"input\": ", given), (", \"instruction\": ", instruction), (", \"output\": ", output), (", \"topic\": ", topic))
    return "sha1(" + " || ".join(f"'{name}' || to_json({value})::VARCHAR" for name, value in parts) + " || '}')"

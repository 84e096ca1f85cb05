"""Logical fields by ordered aliases, under three different rules, and row fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .emoji import emoji_tokens
from .tokens import bag_key

# Alias orders of the logical fields.
PROMPT = ("prompt_emoji", "source_emoji", "input_emoji", "prompt", "source", "input", "instruction", "text")
RESPONSE = ("response_emoji", "target_emoji", "output_emoji", "response", "target", "output", "emoji")
FINGERPRINT = {"input": ("input", "prompt_emoji", "source_emoji"), "instruction": ("instruction", "text"), "output": ("output", "emoji", "target_emoji", "response_emoji"), "topic": ("topic",)}
FINGERPRINT_BUILDER = {"input": ("input", "prompt_emoji"), "instruction": ("instruction", "text"), "output": ("output", "target_emoji", "response_emoji", "emoji"), "topic": ("topic",)}
PREDICTION = ("generated_emoji", "output", "response", "completion", "text")
HARVEST = ("emoji", "output", "response", "response_emoji", "target", "target_emoji", "prompt", "prompt_emoji", "instruction", "input")
RENAMES = {"instruction": "text", "output": "emoji"}


def _there(df: DataFrame, names) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def first_truthy(df: DataFrame, names) -> Column:
    """The first alias that is neither null nor empty; '' without any."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in _there(df, names)], F.lit(""))


def first_with_tokens(df: DataFrame, names, tokenize=emoji_tokens, default: str | None = None) -> Column:
    """The first alias whose value has a token; ``default`` without any."""
    return F.coalesce(*[F.when(F.size(tokenize(c.cast("string"))) > 0, c.cast("string")) for c in _there(df, names)], F.lit(default))


def first_present(df: DataFrame, names) -> Column:
    """The first alias that isn't null, an empty string included."""
    return F.coalesce(*_there(df, names), F.lit(None).cast("string"))


def rename_free(df: DataFrame, renames: dict[str, str] = RENAMES) -> DataFrame:
    """Columns renamed where the new name is free."""
    return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b not in df.columns})


def json_quoted(text: Column) -> Column:
    """``text`` as a JSON string, non-ASCII kept."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def fingerprint(df: DataFrame, fields: dict[str, tuple] = FINGERPRINT) -> Column:
    """SHA-1 of the row's four logical fields as JSON with sorted keys; two alias orders exist."""
    parts = []
    for k, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if k == 0 else ", ") + f'"{name}": '), json_quoted(first_truthy(df, fields[name]))]
    return F.sha1(F.concat(*parts, F.lit("}")))


def split_key(df: DataFrame, strategy: str = "prompt_bag") -> Column:
    """The bag key that rows of one split share: prompt_bag, response_bag or prompt_response_bag."""
    def bag(names) -> Column:  # of the first alias with tokens: its key is the first that isn't empty
        return F.coalesce(*[F.nullif(bag_key(emoji_tokens(c.cast("string"))), F.lit("")) for c in _there(df, names)], F.lit(""))

    prompt, response = bag(PROMPT), bag(RESPONSE)
    keys = {"prompt_bag": prompt, "response_bag": response, "prompt_response_bag": F.concat(prompt, F.lit("=>"), response)}
    if strategy not in keys:
        raise ValueError(f"unknown split strategy {strategy!r}: use random or one of {sorted(keys)}")
    return keys[strategy]


def reply_content(response: Column) -> Column:
    """struct(text, finish_reason) of the first choice of a chat response in JSON.

    The content is a string, or a list of which plain strings and parts of type 'text' are joined. '' and null
    without a choice, for null and for broken JSON.
    """
    parts = F.from_json(F.get_json_object(response, "$.choices[0].message.content"), "array<string>")
    part = F.transform(parts, lambda p: F.when(F.get_json_object(p, "$.type") == "text", F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).when(F.get_json_object(p, "$.type").isNull() & ~p.startswith("{"), p).otherwise(""))
    whole = F.get_json_object(response, "$.choices[0].message.content")
    text = F.when(whole.startswith("[") & parts.isNotNull(), F.array_join(part, "")).otherwise(F.coalesce(whole, F.lit("")))
    return F.struct(text.alias("text"), F.get_json_object(response, "$.choices[0].finish_reason").alias("finish_reason"))


def problem_key(df: DataFrame) -> Column:
    """struct(example_id, pattern): the example_id, or benchmark_id, prompt and reply joined where that is missing."""

    def named(*names: str) -> Column:
        return first_truthy(df, names)

    made = F.concat_ws("|", named("benchmark_id"), named("prompt", "prompt_emoji"), named("reply"))
    pattern = F.coalesce(F.nullif(named("pattern"), F.lit("")), F.lit("unknown"))
    return F.struct(F.coalesce(F.nullif(named("example_id"), F.lit("")), made).alias("example_id"), pattern.alias("pattern"))


def eligible(prompt: Column, reply: Column, least_prompt: int = 2, least_reply: int = 1) -> Column:
    """Whether a pair of token arrays is long enough to be used."""
    return (F.coalesce(F.size(prompt), F.lit(0)) >= least_prompt) & (F.coalesce(F.size(reply), F.lit(0)) >= least_reply)


def not_both_empty(left: Column, right: Column) -> Column:
    """False only for pairs with neither side."""
    return eligible(left, right, 1, 0) | eligible(left, right, 0, 1)

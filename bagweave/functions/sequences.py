"""Id sequences as arrays: chunking, padding, paired layouts, end marks, reveals and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def repeat(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def chunks(text: Column, size: int, drop_last: bool = True) -> Column:
    """``text`` in pieces of ``size`` code points; a shorter last piece is dropped unless told otherwise."""
    n = F.char_length(text)
    pieces = F.floor(n / size) if drop_last else F.ceil(n / size)
    return F.when(pieces < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)).cast("int") - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    )


def padded(ids: Column, block: int, pad: int) -> Column:
    """struct(input_ids, attention_mask) of exactly ``block`` entries."""
    cut = F.slice(ids, 1, block)
    missing = F.lit(block) - F.size(cut)
    return F.struct(F.concat(cut, repeat(pad, missing)).alias("input_ids"), F.concat(F.transform(cut, lambda _: F.lit(1)), repeat(0, missing)).alias("attention_mask"))


def single(ids: Column, block: int, bos: int, eos: int, pad: int, most: int = 32) -> Column:
    """An unpaired sequence: BOS, the first ``most`` ids, EOS; nothing conditions."""
    p = padded(F.concat(_ints(bos), F.slice(ids, 1, most), _ints(eos)), block, pad)
    return F.struct(p["input_ids"].alias("input_ids"), p["attention_mask"].alias("attention_mask"), F.array_repeat(F.lit(0), block).alias("cond_mask"))


def paired(left: Column, right: Column, block: int, bos: int, sep: int, eos: int, pad: int, most_left: int = 32, most_right: int = 32, supervised: int = 0) -> Column:
    """BOS left SEP right EOS and supervised pads, cut to ``block``: the reply has first claim on room.

    cond_mask is 1 up to SEP; attention is 1 over supervised pads too.
    """
    extra = min(max(0, supervised), max(0, block - 3))
    room = max(0, block - 3 - extra)
    right = F.slice(right, 1, min(most_right, room))
    left = F.slice(F.slice(left, 1, most_left), F.lit(1), F.greatest(F.lit(0), F.lit(block - 3 - extra) - F.size(right)))
    prefix = F.concat(_ints(bos), left, _ints(sep))
    p = padded(F.concat(prefix, right, _ints(eos), repeat(pad, F.lit(extra))), block, pad)
    given = F.least(F.size(prefix), F.lit(block))
    cond = F.concat(repeat(1, given), repeat(0, F.lit(block) - given))
    return F.struct(p["input_ids"].alias("input_ids"), p["attention_mask"].alias("attention_mask"), cond.alias("cond_mask"))


def first_offset(ids: Column, value: int) -> Column:
    """The 0-based offset of the first ``value``; null without any."""
    return F.nullif(F.array_position(ids, value), F.lit(0).cast("bigint")) - 1


def reply_part(ids: Column, sep: int, eos: int, pad: int) -> Column:
    """The ids behind SEP and before the first EOS or PAD."""
    tail = F.slice(ids, F.array_position(ids, sep).cast("int") + 1, F.size(ids))
    end = F.least(*[F.coalesce(first_offset(tail, v), F.size(tail).cast("bigint")) for v in (eos, pad)])
    return F.slice(tail, F.lit(1), end.cast("int"))


def stop_statistics(tail: Column, eos: int, pad: int) -> Column:
    """struct(eos_rel, pad_rel, decoded_len) of a reply span."""
    e, p = first_offset(tail, eos), first_offset(tail, pad)
    n = F.size(tail).cast("bigint")
    return F.struct(e.alias("eos_rel"), p.alias("pad_rel"), F.least(F.coalesce(e, n), F.coalesce(p, n)).alias("decoded_len"))


def first_end_mask(ids: Column, eos: int) -> Column:
    """1 up to and with the first EOS, 0 behind it."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda _, i: ((at == 0) | (i < at)).cast("int"))


def reveal_count(length: Column) -> Column:
    """Positions shown at evaluation: half, at least one."""
    return F.greatest(F.lit(1), F.floor(length / 2)).cast("int")


def reveal_count_training(length: Column, fraction: float) -> Column:
    """Positions shown in training: the rounded share, at least one and not all; halves go to the even number."""
    return F.least(F.greatest(F.lit(1), F.bround(length * F.lit(fraction))), length - 1).cast("int")


def reveal_positions(length: Column, k: Column, pattern: str, unit: Column | None = None) -> Column:
    """Sorted 0-based positions shown: a prefix, a suffix, or those lowest in hash order (``unit`` seeds it)."""
    if pattern == "prefix":
        return F.sequence(F.lit(0), k - 1)
    if pattern == "suffix":
        return F.sequence(length - k, length - 1)
    if pattern != "scattered":
        raise ValueError(f"unknown reveal pattern {pattern!r}: use prefix, suffix or scattered")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(F.sha1(F.concat_ws(":", unit, i.cast("string"))).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(order, F.lit(1), k), lambda x: x["i"]))


def visible_slots(tokens: Column, shown: Column, mask: str = "[MASK]") -> Column:
    return F.transform(tokens, lambda x, i: F.when(F.array_contains(shown, i), x).otherwise(mask))


def masked_tokens(tokens: Column, shown: Column) -> Column:
    return F.filter(tokens, lambda x, i: ~F.array_contains(shown, i))


def conditioned(cond: Column, attention: Column, start: Column, shown: Column) -> Column:
    """cond_mask with the shown reply positions (relative to ``start``) set where attention is on."""
    return F.zip_with(F.transform(cond, lambda c, i: F.when(F.array_contains(shown, (i - start).cast("int")), 1).otherwise(c)), F.zip_with(attention, cond, lambda a, c: F.struct(a.alias("a"), c.alias("c"))), lambda new, old: F.when(old["a"] == 1, new).otherwise(old["c"]))


def shuffled_span(ids: Column, start: Column, length: Column, seed: Column) -> Column:
    """``ids`` with the span (0-based start) in hash order."""
    span = F.slice(ids, start + 1, F.greatest(length, F.lit(0)))
    mixed = F.transform(F.array_sort(F.transform(span, lambda x, i: F.struct(F.sha1(F.concat_ws(":", seed, i.cast("string"))).alias("h"), x.alias("x")))), lambda s: s["x"])
    return F.concat(F.slice(ids, F.lit(1), start), mixed, F.slice(ids, start + F.greatest(length, F.lit(0)) + 1, F.size(ids)))


def capped(ids: Column, prefix: int, cap: int, eos: int, pad: int) -> Column:
    """A decode-time cap: EOS right behind ``cap`` reply ids, PAD behind that."""
    return F.transform(ids, lambda x, i: F.when(i == prefix + cap, eos).when(i > prefix + cap, pad).otherwise(x))


def clamped(ids: Column, given: Column, cond: Column) -> Column:
    """``given`` where cond is 1, else ``ids``."""
    both = F.zip_with(given, cond, lambda g, c: F.struct(g.alias("g"), c.alias("c")))
    return F.zip_with(ids, both, lambda x, b: F.when(b["c"] == 1, b["g"]).otherwise(x))


def stitched(windows: Column, stride: int) -> Column:
    """One sequence of overlapping windows: the first whole, of each later one what lies behind the overlap."""
    return F.flatten(F.transform(windows, lambda w, i: F.when(i == 0, w).otherwise(F.slice(w, F.size(w) - stride + 1, F.lit(stride)))))


def shifted(ids: Column) -> Column:
    """struct(inputs, targets) of next-token prediction."""
    return F.struct(F.slice(ids, F.lit(1), F.size(ids) - 1).alias("inputs"), F.slice(ids, F.lit(2), F.size(ids) - 1).alias("targets"))

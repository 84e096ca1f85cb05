"""Noise schedules, masking and loss weights of masked-diffusion training, as row arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-3
#: The log probability of what can't be.
FORBIDDEN = -1_000_000.0


def schedule(kind: str, t: Column, eps: float = EPS, low: float | None = None, high: float | None = None) -> tuple[Column, Column]:
    """(total noise, rate of noise) at time ``t`` in [0, 1]."""
    half = F.pi() / 2
    if kind == "loglinear":
        return -F.log1p(-(1 - eps) * t), (1 - eps) / (1 - (1 - eps) * t)
    if kind == "cosine":
        c, s = F.cos(t * half), F.sin(t * half)
        return -F.log(eps + (1 - eps) * c), half * (1 - eps) * s / ((1 - eps) * c + eps)
    if kind == "cosine2":
        c, s = F.pow(F.cos(t * half), 2.0), F.sin(t * F.pi())
        return -F.log(eps + (1 - eps) * c), half * (1 - eps) * s / ((1 - eps) * c + eps)
    if kind == "linear":
        low, high = 0.0 if low is None else low, 10.0 if high is None else high
        return low + t * (high - low), F.lit(high - low)
    if kind == "geometric":
        low, high = 1e-3 if low is None else low, 1.0 if high is None else high
        total = F.pow(F.lit(low), 1 - t) * F.pow(F.lit(high), t)
        return total, total * (math.log(high) - math.log(low))
    raise ValueError(f"unknown noise {kind!r}: use loglinear, cosine, cosine2, linear or geometric")


def importance_time(kind: str, t: Column, eps: float = EPS, low: float = 0.0, high: float = 10.0) -> Column:
    """The time at which the importance-sampled noise level of ``t`` is reached; linear and loglinear only."""
    if kind == "loglinear":
        high, low = -math.log1p(-(1 - eps)), eps
    elif kind != "linear":
        raise ValueError(f"no importance sampling for {kind!r}")
    f1 = math.log1p(-math.exp(-high))
    f0 = math.log1p(-math.exp(-low)) if low > 0 else float("-inf")
    mixed = t * f1 + (1 - t) * f0 if f0 > float("-inf") else F.when(t == 1, f1).otherwise(float("-inf"))
    sigma = -F.log1p(-F.exp(mixed))
    return -F.expm1(-sigma) / (1 - eps) if kind == "loglinear" else (sigma - low) / (high - low)


def move_chance(sigma: Column) -> Column:
    return 1 - F.exp(-sigma)


def masked(ids: Column, units: Column, chance: Column, cond: Column, mask_id: int) -> Column:
    """``ids`` with the mask where the position's uniform is under the chance and nothing conditions it."""
    both = F.zip_with(units, cond, lambda u, c: F.struct(u.alias("u"), c.alias("c")))
    return F.zip_with(ids, both, lambda x, b: F.when((b["u"] < chance) & (b["c"] == 0), mask_id).otherwise(x))


def antithetic_time(unit: Column, index: Column, n: Column, eps: float = EPS) -> Column:
    """Stratified times: each row falls into its own n-th of [eps, 1)."""
    return (1 - eps) * F.pmod(unit / n + index / n, F.lit(1.0)) + eps


def snapped_time(t: Column, steps: int) -> Column:
    return F.floor(t * steps).cast("double") / steps + 1.0 / steps


def subs_loss(log_p: Column, sigma: Column, rate: Column) -> Column:
    """The continuous-time loss of a position from its log probability."""
    return -log_p * rate / F.expm1(sigma)


def d3pm_loss(log_p: Column, p_mask: Column, t: Column, steps: int, is_masked: Column) -> Column:
    """The discrete-time variational loss of a position, from its log probability and the mask's probability.

    The term that the first step multiplies by zero counts as zero there.
    """
    dt = 1.0 / steps
    t = F.least(t, F.lit(1.0 - 1e-4))
    before = t - dt
    kept = F.log((1 - t) * p_mask / t + 1)
    earlier = F.log(F.coalesce(F.try_divide((1 - before) * p_mask, F.nullif(before, F.lit(0.0))), F.lit(0.0)) + 1)
    whole = dt / t * (kept - log_p) + (1 - dt / t) * (kept - earlier)
    return F.when(is_masked, steps * whole).otherwise(0.0)


def score_entropy(log_scores: Column, target: Column, sigma: Column, is_masked: Column, mask_id: int) -> Column:
    """The score entropy of one position from its log scores over the vocabulary; 0 where nothing is masked."""
    ratio = 1 / F.expm1(sigma)
    positive = F.aggregate(F.filter(log_scores, lambda _, i: i != mask_id), F.lit(0.0), lambda s, x: s + F.exp(x))
    return F.when(is_masked, positive - ratio * F.element_at(log_scores, target + 1) + ratio * (F.log(ratio) - 1)).otherwise(0.0)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(logits, lambda x: x - top - F.log(total))


def subs_parameterized(logits: Column, current: Column, mask_id: int) -> Column:
    """Log probabilities with the mask forbidden; at an unmasked position all mass on what is there."""
    barred = F.transform(logits, lambda x, i: F.when(i == mask_id, FORBIDDEN).otherwise(x))
    return F.when(current == mask_id, log_softmax(barred)).otherwise(F.transform(logits, lambda x, i: F.when(i == current, 0.0).otherwise(FORBIDDEN)))


def reverse_step(probs: Column, chance_t: Column, chance_s: Column, mask_id: int) -> Column:
    """Unnormalised probabilities of the step from t to s: p * (a_t - a_s), the mask keeps a_s."""
    return F.transform(probs, lambda p, i: F.when(i == mask_id, chance_s).otherwise(p * (chance_t - chance_s)))


def gumbel_key(p: Column, u: Column) -> Column:
    """The position with the largest key is a draw from ``p``."""
    return p / (1e-10 - F.log(u + 1e-10))


def drawn(p: Column, units: Column) -> Column:
    """The 0-based position drawn from unnormalised probabilities by one uniform per position; the first of equals."""
    keys = F.zip_with(p, units, gumbel_key)
    return F.array_position(keys, F.array_max(keys)).cast("int") - 1


def cropped(ids: Column, start: Column, length: int, bos: int) -> Column:
    """A window of a double-length sequence; its first id becomes BOS."""
    return F.concat(F.array(F.lit(bos)), F.slice(ids, start + 2, F.lit(length - 1)))


def d3pm_parameterized(logits: Column, mask_id: int | None = None) -> Column:
    """Log probabilities; the mask is forbidden if it is named."""
    return log_softmax(logits if mask_id is None else F.transform(logits, lambda x, i: F.when(i == mask_id, FORBIDDEN).otherwise(x)))


def sedd_parameterized(logits: Column, current: Column, sigma: Column) -> Column:
    """Log scores: logits less log(expm1(sigma)) and log(size - 1), zero at what is there."""
    shift = F.log(F.expm1(sigma)) + F.log(F.size(logits) - 1)
    return F.transform(logits, lambda x, i: F.when(i == current, 0.0).otherwise(x - shift))


def subs_score(log_p: Column, current: Column, sigma: Column, mask_id: int) -> Column:
    """Scores p(y)/p(x) of all tokens at one position from SUBS log probabilities."""
    log_k = -F.log(F.expm1(sigma))
    at_mask = F.transform(log_p, lambda x, i: F.when(i == mask_id, 1.0).otherwise(F.exp(x + log_k)))
    elsewhere = F.transform(log_p, lambda _, i: F.when(i == mask_id, F.exp(-log_k)).when(i == current, 1.0).otherwise(0.0))
    return F.when(current == mask_id, at_mask).otherwise(elsewhere)


def staggered_score(score: Column, change: Column, mask_id: int) -> Column:
    """Scores moved to an earlier noise level; the mask gains what keeps the total."""
    total = F.aggregate(score, F.lit(0.0), lambda s, x: s + x)
    return F.transform(score, lambda x, i: x * F.exp(change) + F.when(i == mask_id, (1 - F.exp(change)) * total).otherwise(0.0))


def transition(current: Column, change: Column, size: Column, mask_id: int) -> Column:
    """How likely each token led to ``current`` over a change of noise: itself by exp(-change), a mask from any."""
    fresh = F.when(current == mask_id, 1 - F.exp(-change)).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == current, F.exp(-change)).otherwise(0.0) + fresh)


def analytic_probs(score: Column, current: Column, change: Column, mask_id: int, final: bool = False) -> Column:
    """Unnormalised probabilities of an analytic step; the final (denoising) one forbids the mask."""
    both = F.zip_with(staggered_score(score, change, mask_id), transition(current, change, F.size(score), mask_id), lambda a, b: a * b)
    return F.transform(both, lambda x, i: F.when(i == mask_id, 0.0).otherwise(x)) if final else both


def cosine_lr(step: Column, warmup: int, total: int, base: float, least: float = 0.0, initial: float = 0.0) -> Column:
    """Linear warm-up, then a half cosine down to ``least``."""
    up = initial + (base - initial) * step / max(1, warmup)
    down = least + 0.5 * (base - least) * (1 + F.cos(F.pi() * (step - warmup) / max(1, total - warmup)))
    return F.when(step < warmup, up).otherwise(down)

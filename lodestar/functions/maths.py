"""Numbers, time and vectors: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """``lo`` to ``hi``; NaN counts as ``lo``."""
    return F.when(F.isnan(x), F.lit(lo)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def half_up(x: Column) -> Column:
    """The nearest integer, halves upwards, as a long."""
    return F.floor(x + 0.5).cast("long")


def gaussian(d: Column, sigma: float) -> Column:
    return F.exp(-(d * d) / (2 * sigma * sigma))


def round4(x: Column) -> Column:
    return F.floor(x * 10_000 + 0.5) / 10_000


def days_between(then: Column, now: Column) -> Column:
    return (micros(now) - micros(then)) / (DAY * 1e6)


def half_life(then: Column, now: Column, days: float = 30.0, least: float = 0.05) -> Column:
    """Halves every ``days``, not below ``least``; 1 for the future, ``least`` without a time."""
    age = days_between(then, now)
    return F.when(then.isNull(), F.lit(least)).when(age <= 0, 1.0).otherwise(F.greatest(F.lit(least), F.pow(F.lit(0.5), age / days)))


def decay_to_half(w: Column, then: Column, now: Column, days: float = 30.0, floor: float = 0.35) -> Column:
    """A weight that tends to 0.5, not below ``floor``; untouched within a day or for changes up to 0.001."""
    age = days_between(then, now)
    new = F.greatest(F.lit(floor), F.lit(0.5) + (w - 0.5) * F.pow(F.lit(0.5), age / days))
    return F.when(then.isNull() | (age < 1) | (F.abs(new - w) <= 0.001), w).otherwise(clamp(new, 0, 1))


def blend_weight(started: Column, now: Column, finalized: Column, days: float = 15.0) -> Column:
    """Share of the old index: 1 less the share of ``days`` that have gone; 0 when finalized or not started."""
    return F.when(started.isNull() | finalized, 0.0).otherwise(1 - clamp(days_between(started, now) / days, 0.0, 1.0))


def last_used_boost(then: Column, now: Column) -> Column:
    age = days_between(then, now)
    return F.when(then.isNull(), 0).when(age < 1, 28).when(age < 3, 18).when(age < 7, 10).when(age < 30, 4).otherwise(0)


def temporal_boost(hourly: Column, total: Column) -> Column:
    return F.least(F.lit(90), F.coalesce(hourly, F.lit(0)) * 18 + F.coalesce(total, F.lit(0)) * 4)


def weight_boost(w: Column) -> Column:
    return F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 0).otherwise(F.greatest(F.lit(0), half_up((clamp(w, 0, 1) - 0.5) * 220)))


def launch_boost(uses: Column) -> Column:
    return F.least(F.lit(80), F.coalesce(uses, F.lit(0)) * 2)


def installed_boost(installed: Column) -> Column:
    return F.when(installed, 60).otherwise(0)


def mode_boost(count: Column, total: Column) -> Column:
    """From five uses on, up to 40 for a kind of match that makes over a fifth of them."""
    p = count / total
    return F.when((total >= 5) & (p > 0.2), F.least(F.lit(40), half_up((p - 0.2) * 100))).otherwise(0)


def rule_boost(rules: list[tuple[Column, float]]) -> Column:
    """Sum of the points of the rules that hold; a null condition doesn't."""
    return sum((F.when(c, F.lit(float(p))).otherwise(0.0) for c, p in rules), F.lit(0.0))


def usage_weight(score: Column, w: Column, cap: int = 1200) -> Column:
    """A score raised by 1.5 % per use, up to a hundred, cut to whole points; null without a score."""
    return F.when(score.isNotNull(), F.least(F.lit(cap), F.floor(score * (1 + 0.015 * F.least(F.coalesce(w, F.lit(0)), F.lit(100)))))).cast("long")


def day_part(ts: Column, scheme: str = "six_hours") -> Column:
    """morning from 6, afternoon from 12, evening from 18, night from 0 ("six_hours") or from 22 ("late_night")."""
    h, late = F.hour(ts), 24 if scheme == "six_hours" else 22
    return F.when((h >= 6) & (h < 12), "morning").when((h >= 12) & (h < 18), "afternoon").when((h >= 18) & (h < late), "evening").otherwise("night")


def day_index(ts: Column, now: Column) -> Column:
    """Whole days before ``now``."""
    return F.floor(days_between(ts, now)).cast("long")


def heat_level(n: Column) -> Column:
    return F.when(n <= 0, 0).when(n <= 1, 1).when(n <= 3, 2).when(n <= 6, 3).when(n <= 10, 4).otherwise(5)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def fit_dims(a: Column, dims: int) -> Column:
    """Cut or padded with zeros to ``dims``."""
    x = F.slice(a, 1, dims)
    return F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), F.lit(dims) - F.size(x)))


def nearest_rank(values: Column, p: float) -> Column:
    """Element floor(p n), counted from 0, of the sorted array, the last one at most."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), F.when(n > 0, F.least(n, F.floor(p * n).cast("int") + 1)))


def rounded_median(values: Column) -> Column:
    """Middle of the sorted array, of an even one the mean of both rounded half up."""
    n, s = F.size(values), F.sort_array(values)
    half = (n / 2).cast("int")
    return F.when(n == 0, 0.0).when(n % 2 == 1, F.element_at(s, F.when(n > 0, half + 1))).otherwise(F.floor((F.element_at(s, F.when(n > 1, half)) + F.element_at(s, F.when(n > 0, half + 1))) / 2 + 0.5)).cast("double")


def ema(values: Column, alpha: float, start: float) -> Column:
    """Exponential moving average of an ordered array."""
    return F.aggregate(values, F.lit(float(start)), lambda v, x: v * (1 - alpha) + x * alpha)


def click_multiplier(avg: Column, n: Column) -> Column:
    """Confidence by the average delay of a click in ms, from three samples on."""
    return F.when(n < 3, 1.0).when(avg < 400, 1.5).when(avg < 800, 1.25).when(avg > 3000, 0.4).when(avg > 1500, 0.6).otherwise(1.0)


def preference_update(vector: Column, dims: Column, step: float = 0.05) -> Column:
    """``vector`` with the entries at ``dims`` (from 0) raised by ``step``, 1 at most."""
    return F.transform(vector, lambda x, i: F.when(F.array_contains(dims, i), F.least(F.lit(1.0), x + step)).otherwise(x))


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    """To 0..1 by the extremes; 0.5 where they are equal."""
    return F.when(hi == lo, 0.5).otherwise((x - lo) / (hi - lo))

"""Column functions over score arrays: calibrated probabilities, energies, priors, argmax, bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.settings import EDGES, WILSON_Z


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once: a lambda would compute what it takes from outside at every element."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of logits over a temperature above 0."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    t = F.lit(float(temperature))
    powers = _let(F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp((z - top) / t)))
    return _let(powers, lambda ps: _let(_sum(ps), lambda total: F.transform(ps, lambda p: p / total)))


def energy(logits: Column, temperature: float = 1.0) -> Column:
    """-T log sum exp(z / T): high for inputs unlike the training data."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    t = F.lit(float(temperature))
    return _let(F.array_max(logits), lambda top: -t * (top / t + F.ln(_sum(F.transform(logits, lambda z: F.exp((z - top) / t))))))


def log_prior(weights: list[float | None], max_ratio: float = 0.0) -> list[float]:
    """log of the class shares behind inverse-frequency weights; a label without weight has the smallest, and counts as such.

    ``max_ratio`` above 0 bounds every share by so many times the smallest before shares are taken anew.
    """
    import math

    inverse = [1.0 / w if w else None for w in weights]
    least = min((x for x in inverse if x), default=1.0)
    shares = [x or least for x in inverse]
    if max_ratio > 0:
        shares = [min(x, least * max_ratio) for x in shares]
    total = sum(shares) or 1.0
    return [math.log(x / total) for x in shares]


def loss_weights(weights: dict[str, float], labels: list[str], mode: str = "inverse", cap: float = 10.0) -> list[float]:
    """Weights of a head's labels in order: as they are, their square roots (sqrt-inverse) or ones (none), within 1 / cap and cap."""
    import math

    change = {"sqrt-inverse": lambda w: math.sqrt(max(w, 1e-6)), "none": lambda w: 1.0}.get(mode, lambda w: w)
    return [min(max(change(weights.get(x, 1.0)), 1.0 / cap), cap) for x in labels]


def adjusted(logits: Column, prior: list[float], tau: float) -> Column:
    """logits + tau * prior over the common prefix."""
    n = len(prior)
    head = F.zip_with(F.slice(logits, 1, n), F.slice(F.array(*[F.lit(float(p)) for p in prior]), 1, F.least(F.size(logits), F.lit(n))), lambda z, p: z + F.lit(float(tau)) * p)
    return F.concat(head, F.slice(logits, n + 1, F.greatest(F.size(logits) - n, F.lit(0))))


def argmax(scores: Column, width: int | None = None) -> Column:
    """Place (from 0) of the greatest of the first ``width`` scores; the lowest place of ties."""
    part = F.slice(scores, 1, width) if width else scores
    return (F.array_position(part, F.array_max(part)) - 1).cast("int")


def finite(x: Column) -> Column:
    """x as a finite double, else null."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def wilson_lower(hits: Column, n: Column, z: float = WILSON_Z) -> Column:
    """Wilson lower bound of a share; 0 without rows."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = hits / m
    bound = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return F.greatest(F.lit(0.0), F.coalesce(bound, F.lit(0.0)))


def bin_of(x: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """Place of the bin [low, high) that holds x; the last bin is closed; null outside."""
    out = F.when((x >= edges[-2]) & (x <= edges[-1]), len(edges) - 2)
    for k in range(len(edges) - 2):
        out = out.when((x >= edges[k]) & (x < edges[k + 1]), k)
    return out

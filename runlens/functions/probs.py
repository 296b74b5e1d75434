"""Probability-vector helpers.

Vectors are short fixed-length ``ARRAY<DOUBLE>`` columns. Helpers work on single elements. Where an
intermediate is used many times it is bound once with ``let``: the optimizer copies a column's
expression into every place that reads it (filters most of all), which grows exponentially
when such helpers are stacked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.numeric import add_all
from runlens.vocab import CLASSES, labels_array


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def items(p: Column, n: int) -> list[Column]:
    return [F.get(p, F.lit(i)) for i in range(n)]


def softmax(scores: list[Column]) -> Column:
    n = len(scores)

    def scaled(a: Column) -> Column:
        top = F.array_max(a)
        return let(F.transform(a, lambda x: F.exp(x - top)), lambda e: F.transform(e, lambda x: x / add_all(items(e, n))))

    return let(F.array(*scores), scaled)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def normalise(values: list[Column]) -> Column:
    """Clamp at zero and divide by the sum; an all-zero row becomes uniform (decided per row)."""
    n = len(values)

    def scaled(a: Column) -> Column:
        pos = items(a, n)
        return let(add_all(pos), lambda s: F.array(*[F.when(s <= 0, F.lit(1.0 / n)).otherwise(F.try_divide(p, s)) for p in pos]))

    return let(F.array(*[F.greatest(v, F.lit(0.0)) for v in values]), scaled)


def top_label(p: Column, labels=CLASSES) -> Column:
    """Label of the first maximum."""
    return let(p, lambda a: F.get(labels_array(labels), (F.array_position(a, F.array_max(a)) - 1).cast("int")))


def top_value(p: Column) -> Column:
    return F.array_max(p)


def alternatives(p: Column, exclude: Column, k: int, labels=CLASSES) -> Column:
    """Top-k (label, p) structs by descending p, class order on ties, without ``exclude``."""
    def ranked(a: Column) -> Column:
        entries = F.array(
            *[
                F.struct((-F.get(a, F.lit(i))).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("label"))
                for i, c in enumerate(labels)
            ]
        )
        return F.slice(F.array_sort(F.filter(entries, lambda e: e["label"] != exclude)), 1, k)

    return F.transform(let(p, ranked), lambda e: F.struct(e["label"].alias("label"), (-e["neg"]).alias("p")))


def blend(a: Column, b: Column, alpha: float, n: int = len(CLASSES)) -> Column:
    return F.array(*[x * F.lit(alpha) + y * F.lit(1.0 - alpha) for x, y in zip(items(a, n), items(b, n))])


def kl_divergence(p: Column, q: Column, n: int = len(CLASSES), eps: float = 1e-9) -> Column:
    terms = []
    for a, b in zip(items(p, n), items(q, n)):
        x = F.least(F.greatest(a, F.lit(eps)), F.lit(1.0))
        y = F.least(F.greatest(b, F.lit(eps)), F.lit(1.0))
        terms.append(x * (F.log(x) - F.log(y)))
    return add_all(terms)


def prob_of(p: Column, label: Column, labels=CLASSES) -> Column:
    """Probability given to ``label``; null for a label outside the vocabulary."""
    pos = F.array_position(labels_array(labels), label)
    return F.when(pos > 0, F.get(p, (pos - 1).cast("int")))


def soft_label(label: Column, confidence: Column, labels=CLASSES) -> Column:
    """``confidence`` on ``label`` and the remainder spread evenly over the other classes."""
    conf = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    rest = (F.lit(1.0) - conf) / F.lit(float(max(1, len(labels) - 1)))
    return F.array(*[F.when(label == c, conf).otherwise(rest) for c in labels])


def sums_to_one(p: Column, n: int = len(CLASSES), atol: float = 1e-3) -> Column:
    vals = items(p, n)
    ok = F.abs(add_all(vals) - 1.0) <= atol
    for v in vals:
        ok = ok & v.isNotNull() & ~F.isnan(v)
    return F.coalesce(ok, F.lit(False))

"""Numeric Column functions over logit vectors and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(z) -> Column:
    """O2: 0-based index of the first maximum."""
    z = _col(z)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row, not once per use inside ``fn``'s lambdas."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(z) -> Column:
    """stable softmax ``exp(z - max) / sum``, linear in the number of classes."""
    z = _col(z)
    return _bind(F.struct(z.alias("z"), F.array_max(z).alias("m")), lambda s: _bind(
        F.transform(s["z"], lambda x: F.exp(x - s["m"])), lambda e: _bind(
            F.struct(e.alias("e"), _total(e).alias("t")), lambda u: F.transform(u["e"], lambda x: x / u["t"]))))


def entropy(p) -> Column:
    """F16: Shannon entropy, natural log, with ``0 log 0 = 0``."""
    return -F.aggregate(_col(p), F.lit(0.0),
                        lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))


def top1(p) -> Column:
    """O3: the largest probability."""
    return F.array_max(_col(p))


def logsumexp(z) -> Column:
    z = _col(z)
    return _bind(F.struct(z.alias("z"), F.array_max(z).alias("m")), lambda s: s["m"] + F.log(
        F.aggregate(s["z"], F.lit(0.0), lambda a, x: a + F.exp(x - s["m"]))))


def cross_entropy(z, y) -> Column:
    """Per-row cross-entropy ``logsumexp(z) - z[y]`` (``y`` 0-based)."""
    return logsumexp(z) - F.element_at(_col(z), (_col(y) + 1).cast("int"))


def run_stamp() -> Column:
    """``yyyyMMdd_HHmmss`` of the query's start time."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")

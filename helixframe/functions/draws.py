"""Deterministic, partition-independent random draws.

A draw is a pure function of ``(seed, row_id, iteration, position)``, so the
same row mutates the same way on 1 or 1000 executors, on a retried task, in
DuckDB and in numpy. Inputs are reduced modulo the prime before they are
multiplied, so every step stays below 2**63 for any row id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647  # 2**31 - 1
# The mixing constants of the draw.
K_ROW, K_ITER, K_POS = 7919, 104729, 1299709
K_ADD1, K_MUL1, K_ADD2, K_MUL2 = 12345, 48271, 7, 69621


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def draw(row_id, iteration, position, seed=0) -> Column:
    """The hash draw as a bigint Column in ``[0, 2**31 - 1)``."""
    p = F.lit(PRIME).cast("bigint")
    x = (_c(row_id).cast("bigint") % p * K_ROW + _c(iteration).cast("bigint") % p * K_ITER
         + _c(position).cast("bigint") % p * K_POS + _c(seed).cast("bigint") % p) % p
    x = (x * x + K_ADD1) % p
    x = (x * K_MUL1) % p
    x = (x * x + K_ADD2) % p
    return (x * K_MUL2) % p


def fires(x: Column, rate) -> Column:
    """True with probability ``rate`` (a float or a Column): the draw lies below that share of its range."""
    if isinstance(rate, Column):
        return x < F.floor(rate.cast("double") * F.lit(float(PRIME)))
    return x < F.lit(threshold(rate))


def threshold(rate: float) -> int:
    """The draw values below this one fire."""
    return int(rate * float(PRIME))


def base_of(x: Column, shift: int = 0) -> Column:
    """A base from ``MUTATION_BASES`` chosen by the draw (``shift`` picks independent digits)."""
    from .codons import MUTATION_BASES

    idx = F.floor(x / F.lit(1000 * 4 ** shift)) % 4 + 1
    return F.lit(MUTATION_BASES).substr(idx.cast("int"), F.lit(1))


def draw_sum(row_id, iteration, position, seed=0) -> np.ndarray:
    """The linear part of a draw: sums of rows, positions and iterations may be added up one by one."""
    part = lambda v, k: np.fmod(np.asarray(v, dtype=np.int64), PRIME) * k  # noqa: E731 - the sign follows v, as in SQL
    return part(row_id, K_ROW) + part(iteration, K_ITER) + part(position, K_POS) + part(seed, 1)


def draw_of_sum(x: np.ndarray) -> np.ndarray:
    """The draw from its linear part."""
    x = np.fmod(x, PRIME)
    x = (x * x + K_ADD1) % PRIME
    x = (x * K_MUL1) % PRIME
    x = (x * x + K_ADD2) % PRIME
    return (x * K_MUL2) % PRIME


def draw_np(row_id, iteration, position, seed=0) -> np.ndarray:
    """numpy twin of :func:`draw` (int64 arithmetic, broadcasts over arrays)."""
    return draw_of_sum(draw_sum(row_id, iteration, position, seed))


def draw_sql(row: str, it: str, pos: str, seed: str | int = 0) -> str:
    """DuckDB text of :func:`draw` (used by the oracles)."""
    x = (f"((CAST({row} AS BIGINT) % {PRIME} * {K_ROW} + CAST({it} AS BIGINT) % {PRIME} * {K_ITER} + "
         f"CAST({pos} AS BIGINT) % {PRIME} * {K_POS} + {seed} % {PRIME}) % {PRIME})")
    x = f"(({x} * {x} + {K_ADD1}) % {PRIME})"
    x = f"(({x} * {K_MUL1}) % {PRIME})"
    x = f"(({x} * {x} + {K_ADD2}) % {PRIME})"
    return f"(({x} * {K_MUL2}) % {PRIME})"

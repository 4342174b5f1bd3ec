"""Mutation Column functions.

Each mutation of row ``row_id`` at ``iteration`` is a pure function of its
inputs: the draw at each position decides whether and how the base changes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codons import MUTATION_BASES
from .draws import PRIME, base_of, draw, draw_np, fires
from .sequence import _col, aa_to_dna, codons, dna_to_aa

ATTACKS = ("nucl", "codon", "bt")


def point_mutation(seq, row_id, iteration, rate=0.1, seed: int = 0) -> Column:
    """each position is redrawn from ``ATCG`` with probability ``rate`` (float or Column; length kept)."""
    s = _col(seq)
    # one pass over the characters (indexing a string by position would rescan it)
    bases = F.transform(F.split(s, ""), lambda ch, i: _redraw(ch, draw(row_id, iteration, i + 1, seed), rate))
    return F.when(F.length(s) == 0, s).otherwise(F.array_join(bases, ""))


def _redraw(ch: Column, x: Column, rate) -> Column:
    return F.when(fires(x, rate), base_of(x)).otherwise(ch)


def codon_mutation(seq, row_id, iteration, rate: float = 0.1, seed: int = 0) -> Column:
    """each 3-letter chunk is replaced by three drawn bases with probability ``rate``."""
    def mutate(c: Column, j: Column) -> Column:
        x = draw(row_id, iteration, j + 1, seed)
        fresh = F.concat(base_of(x, 0), base_of(x, 1), base_of(x, 2))
        return F.when(fires(x, rate), fresh).otherwise(c)

    return F.array_join(F.transform(codons(seq), mutate), "")


def back_translation(seq, row_id, iteration, seed: int = 0) -> Column:
    """DNA -> residues (F7) -> synonymous codons (F8); ignores any rate."""
    return aa_to_dna(dna_to_aa(seq), row_id, iteration, seed)


def mutate(kind: str, seq, row_id, iteration, rate: float = 0.1, seed: int = 0) -> Column:
    """dispatch by attack name ``nucl`` / ``codon`` / ``bt``."""
    if kind == "nucl":
        return point_mutation(seq, row_id, iteration, rate, seed)
    if kind == "codon":
        return codon_mutation(seq, row_id, iteration, rate, seed)
    if kind == "bt":
        return back_translation(seq, row_id, iteration, seed)
    raise ValueError(f"unknown attack {kind!r}; expected one of {ATTACKS}")


def repeated_attack(kind: str, seq, row_id, iterations: int, rate: float = 0.1,
                    seed: int = 0) -> Column:
    """apply the attack ``iterations`` times, compounding (iteration i uses draw index i)."""
    if iterations < 1:
        raise ValueError("iterations must be >= 1")
    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), _col(seq),
                       lambda acc, i: mutate(kind, acc, row_id, i, rate, seed))


# ---- Arrow-batched twin -------------------------------------------------------------------
# Higher-order functions (``transform``) run interpreted, one boxed draw per
# character. For bulk mutation the same draws run vectorised over a whole Arrow
# batch in numpy: one flat code-point array per batch, no per-character Python.

SLICE = 1 << 20  # characters mutated together; longer rows go through the same arrays alone


def _mutate_batch(seqs, rows, its, rates, seed: int):
    """Mutate a batch in runs of rows with about SLICE characters, so memory does not follow the batch size."""
    import numpy as np

    size = seqs.str.len().fillna(0).to_numpy(dtype=np.int64)
    if size.sum() <= SLICE or len(seqs) < 2:
        return _mutate_rows(seqs, rows, its, rates, seed)
    run = (np.cumsum(size) - size) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(seqs)]
    return pd.concat([_mutate_rows(*(c.iloc[a:b] for c in (seqs, rows, its, rates)), seed)
                      for a, b in zip(cuts[:-1], cuts[1:])])


def _mutate_rows(seqs, rows, its, rates, seed: int):
    import numpy as np

    out = pd.Series([None] * len(seqs), index=seqs.index, dtype=object)
    ok = (seqs.notna() & rows.notna() & its.notna() & rates.notna()).to_numpy()
    if not ok.any():
        return out
    s = seqs[ok]
    lens = s.str.len().to_numpy(dtype=np.int64)
    total = int(lens.sum())
    if total == 0:
        out[ok] = s
        return out
    buf = np.frombuffer("".join(s.tolist()).encode("utf-32-le"), dtype=np.uint32).copy()
    starts = np.cumsum(lens) - lens
    pos = np.arange(total, dtype=np.int64) - np.repeat(starts, lens) + 1
    x = draw_np(np.repeat(rows[ok].to_numpy(dtype=np.int64), lens),
                np.repeat(its[ok].to_numpy(dtype=np.int64), lens), pos, seed)
    fire = x < np.repeat(np.floor(rates[ok].to_numpy(dtype=np.float64) * float(PRIME)).astype(np.int64), lens)
    bases = np.array([ord(b) for b in MUTATION_BASES], dtype=np.uint32)
    buf[fire] = bases[(x[fire] // 1000) % 4]
    text = buf.tobytes().decode("utf-32-le")
    ends = starts + lens
    out[ok] = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    return out


def point_mutation_batch(seq, row_id, iteration, rate=0.1, seed: int = 0) -> Column:
    """F9, Arrow-batched: equal to :func:`point_mutation`, vectorised per batch in numpy."""
    @F.pandas_udf("string")
    def _pm(s: pd.Series, r: pd.Series, i: pd.Series, t: pd.Series) -> pd.Series:
        return _mutate_batch(s, r, i, t, seed)

    rate_col = rate if isinstance(rate, Column) else F.lit(float(rate))
    it_col = iteration if isinstance(iteration, Column) else F.lit(int(iteration))
    rid = row_id if isinstance(row_id, Column) else F.col(row_id)
    return _pm(_col(seq), rid.cast("bigint"), it_col.cast("bigint"), rate_col.cast("double"))

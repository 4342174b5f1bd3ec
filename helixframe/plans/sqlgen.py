"""Small text helpers for writing the DuckDB oracle queries."""

from __future__ import annotations


def dbl(x: float) -> str:
    """A DOUBLE literal (a bare ``0.1`` would be DECIMAL in DuckDB)."""
    return f"CAST({x!r} AS DOUBLE)"


def r6(expr: str) -> str:
    """Round to 6 digits and turn -0.0 into 0.0, as the Spark side does."""
    return f"(round({expr}, 6) + 0.0)"


def pivot_positions(value: str, dim: int, pos: str = "i", prefix: str = "emb_", base: int = 1) -> str:
    """``max(CASE WHEN pos = k THEN value END) AS emb_{k-base}`` for every position."""
    return ",\n  ".join(
        f"{r6(f'max(CASE WHEN {pos} = {k + base} THEN {value} END)')} AS {prefix}{k}" for k in range(dim))


def codon_map_sql() -> str:
    """DuckDB map literal of the genetic code."""
    from ..functions.codons import CODON_TABLE

    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CODON_TABLE.items()) + "}"


def residue_map_sql() -> str:
    """DuckDB map literal ``residue -> sorted codon list``."""
    from ..functions.codons import residue_codons

    items = ", ".join(f"'{r}': [" + ", ".join(f"'{c}'" for c in cs) + "]"
                      for r, cs in residue_codons().items())
    return "MAP {" + items + "}"


def lookup_sql(codon: str) -> str:
    return f"coalesce(({codon_map_sql()})[{codon}], 'X')"


def base_sql(x: str, shift: int = 0) -> str:
    return f"substr('ATCG', CAST((({x}) // {1000 * 4 ** shift}) % 4 + 1 AS INTEGER), 1)"


def fires_sql(x: str, rate: float) -> str:
    from ..functions.draws import threshold

    return f"(({x}) < {threshold(rate)})"


def point_mutation_sql(seq: str, row: str, it: str, rate: float, seed: int = 0) -> str:
    from ..functions.draws import draw_sql

    d = draw_sql(row, it, "t[2]", seed)
    return (f"CASE WHEN length({seq}) = 0 THEN {seq} ELSE array_to_string(list_transform("
            f"list_transform(list_zip(string_split({seq}, ''), range(1, length({seq}) + 1)), "
            f"lambda t: {{'ch': t[1], 'x': {d}}}), "
            f"lambda u: CASE WHEN {fires_sql('u.x', rate)} THEN {base_sql('u.x')} "
            f"ELSE u.ch END), '') END")


def codon_mutation_sql(seq: str, row: str, it: str, rate: float, seed: int = 0) -> str:
    from ..functions.draws import draw_sql

    d = draw_sql(row, it, "j", seed)
    fresh = " || ".join(base_sql("x", s) for s in range(3))
    return (f"array_to_string(list_transform(list_transform(regexp_extract_all({seq}, '.{{1,3}}'), "
            f"lambda c, j: {{'c': c, 'x': {d}}}), lambda t: CASE WHEN {fires_sql('t.x', rate)} "
            f"THEN {fresh.replace('x)', 't.x)')} ELSE t.c END), '')")


def dna_to_aa_sql(seq: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({seq}, '.{{1,3}}'), "
            f"lambda c: {lookup_sql('c')}), '')")


def aa_to_dna_sql(aa: str, row: str, it: str, seed: int = 0) -> str:
    from ..functions.draws import draw_sql

    d = draw_sql(row, it, "j", seed)
    rm = residue_map_sql()
    return (f"array_to_string(list_transform(string_split({aa}, ''), lambda r, j: "
            f"CASE WHEN ({rm})[r] IS NULL THEN '' ELSE ({rm})[r][({d}) % len(({rm})[r]) + 1] END), '')")


def round_cols(df, cols: list[str], digits: int = 6):
    """Spark side of :func:`r6` for the listed columns (order kept)."""
    from pyspark.sql import functions as F

    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def draws_nested_sql(source: str, keep: list[str], row: str, it: str, positions: dict[str, str],
                     seed: int = 0) -> str:
    """``SELECT keep..., d_<name>...`` where each ``d_<name>`` is the draw at ``positions[name]``.

    The five mixing steps run as nested projections so that every step is
    evaluated once (no textual blow-up of the squared terms).
    """
    from ..functions.draws import K_ADD1, K_ADD2, K_ITER, K_MUL1, K_MUL2, K_POS, K_ROW, PRIME

    names = list(positions)
    k = ", ".join(keep)
    q = (f"SELECT {k}, " + ", ".join(
        f"(CAST({row} AS BIGINT) % {PRIME} * {K_ROW} + CAST({it} AS BIGINT) % {PRIME} * {K_ITER} + "
        f"CAST({positions[n]} AS BIGINT) % {PRIME} * {K_POS} + {seed} % {PRIME}) % {PRIME} AS d_{n}" for n in names)
        + f" FROM {source}")
    steps = [f"(d_{{n}} * d_{{n}} + {K_ADD1}) % {PRIME}", f"(d_{{n}} * {K_MUL1}) % {PRIME}",
             f"(d_{{n}} * d_{{n}} + {K_ADD2}) % {PRIME}", f"(d_{{n}} * {K_MUL2}) % {PRIME}"]
    for st in steps:
        q = f"SELECT {k}, " + ", ".join(st.format(n=n) + f" AS d_{n}" for n in names) + f" FROM ({q})"
    return q


def rule_weights_sql(n_classes: int, k: int = 3, seed: int = 0) -> str:
    """DuckDB text of ``operators.scoring.rule_weights``: ``(idx, w0..)``."""
    digits = " || ".join(f"substr('ACGT', CAST((idx // {4 ** (k - 1 - j)}) % 4 + 1 AS INTEGER), 1)"
                         for j in range(k))
    ws = ", ".join(f"('0x' || substr(md5(km || ':{c}:{seed}'), 1, 8))::BIGINT % 1001 - 500 AS w{c}"
                   for c in range(n_classes))
    return f"SELECT idx, {ws} FROM (SELECT idx, {digits} AS km FROM range(0, {4 ** k}) r(idx))"

"""Sequence Column functions: cleaning, codons, translation.

All are native Spark expressions; the codon table is a 64-entry map literal
that Catalyst folds to a constant, so lookups cost one hash probe per codon.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codons import ambiguous_codons, CODON_TABLE, RARE_RESIDUES, STOP, UNKNOWN, residue_codons
from .draws import draw


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def codon_map() -> Column:
    """The genetic code as a map literal ``codon -> residue``."""
    kv = []
    for k, v in CODON_TABLE.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def residue_map() -> Column:
    """A24 as a literal: ``residue -> sorted array of codons``."""
    kv = []
    for r, cs in residue_codons().items():
        kv += [F.lit(r), F.array(*[F.lit(c) for c in cs])]
    return F.create_map(*kv)


def upper(seq) -> Column:
    """F1."""
    return F.upper(_col(seq))


def prefix(seq, n: int) -> Column:
    """the first ``n`` characters (shorter strings unchanged)."""
    return F.substring(_col(seq), 1, n)


def clean(seq, max_len: int | None = None) -> Column:
    """F1 then, when ``max_len`` is given, F2 (the model's input length)."""
    s = upper(seq)
    return prefix(s, max_len) if max_len is not None else s


def rna_to_dna(seq) -> Column:
    """upper case, ``U`` -> ``T``."""
    return F.translate(F.upper(_col(seq)), "U", "T")


def codons(seq) -> Column:
    """consecutive 3-letter chunks; the last may be shorter."""
    return F.regexp_extract_all(_col(seq), F.lit("(.{1,3})"), F.lit(1))


def full_codons(seq) -> Column:
    """Consecutive complete codons only (a trailing partial codon is ignored)."""
    return F.regexp_extract_all(_col(seq), F.lit("(.{3})"), F.lit(1))


def lookup_residue(codon: Column) -> Column:
    """Residue of a codon, ``X`` for anything not in the table (never raises)."""
    return F.coalesce(F.try_element_at(codon_map(), codon), F.lit(UNKNOWN))


def dna_to_aa(seq) -> Column:
    """every chunk (partial ones too) -> residue; stops stay as ``_``."""
    return F.array_join(F.transform(codons(seq), lookup_residue), "")


def translate_to_stop(seq) -> Column:
    """translate complete codons and cut at the first stop (stop not included).

    ``U`` reads as ``T``; a codon with ambiguity letters gives its residue if all its readings agree, else ``X``.
    """
    table = F.create_map(*[F.lit(x) for pair in ambiguous_codons().items() for x in pair])
    protein = F.array_join(F.transform(full_codons(seq), lambda c: F.coalesce(
        F.try_element_at(codon_map(), c), F.try_element_at(table, c), F.lit(UNKNOWN))), "")
    return F.substring_index(protein, STOP, 1)


def mask_rare(protein) -> Column:
    """F5 (first half): rare residues ``U Z O B`` -> ``X``."""
    return F.translate(_col(protein), RARE_RESIDUES, UNKNOWN * len(RARE_RESIDUES))


def spaced(protein) -> Column:
    """F5 (second half): one space between residues (empty stays empty)."""
    return F.array_join(F.split(_col(protein), ""), " ")


def aa_to_dna(protein, row_id, iteration, seed: int = 0) -> Column:
    """F8: each residue -> one of its codons chosen by a draw at its position; ``X`` is dropped."""
    rmap = residue_map()

    def pick(r: Column, i: Column) -> Column:
        choices = F.try_element_at(rmap, r)
        x = draw(row_id, iteration, i + 1, seed)
        return F.when(choices.isNull(), F.lit("")).otherwise(
            F.element_at(choices, (x % F.size(choices) + 1).cast("int")))

    return F.array_join(F.transform(F.split(_col(protein), ""), pick), "")

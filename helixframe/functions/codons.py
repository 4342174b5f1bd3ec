"""The genetic code and the symbols the sequence functions use."""

from __future__ import annotations

from itertools import product

# The standard genetic code, DNA codon -> amino-acid residue,
# "_" marks a stop codon. Listed in lexicographic A, C, G, T order.
CODON_TABLE: dict[str, str] = {
    "AAA": "K", "AAC": "N", "AAG": "K", "AAT": "N",
    "ACA": "T", "ACC": "T", "ACG": "T", "ACT": "T",
    "AGA": "R", "AGC": "S", "AGG": "R", "AGT": "S",
    "ATA": "I", "ATC": "I", "ATG": "M", "ATT": "I",
    "CAA": "Q", "CAC": "H", "CAG": "Q", "CAT": "H",
    "CCA": "P", "CCC": "P", "CCG": "P", "CCT": "P",
    "CGA": "R", "CGC": "R", "CGG": "R", "CGT": "R",
    "CTA": "L", "CTC": "L", "CTG": "L", "CTT": "L",
    "GAA": "E", "GAC": "D", "GAG": "E", "GAT": "D",
    "GCA": "A", "GCC": "A", "GCG": "A", "GCT": "A",
    "GGA": "G", "GGC": "G", "GGG": "G", "GGT": "G",
    "GTA": "V", "GTC": "V", "GTG": "V", "GTT": "V",
    "TAA": "_", "TAC": "Y", "TAG": "_", "TAT": "Y",
    "TCA": "S", "TCC": "S", "TCG": "S", "TCT": "S",
    "TGA": "_", "TGC": "C", "TGG": "W", "TGT": "C",
    "TTA": "L", "TTC": "F", "TTG": "L", "TTT": "F",
}
# Stop symbol, unknown-codon residue, the rare residues masked
# for protein models, and the alphabet random bases are drawn from.
STOP = "_"
UNKNOWN = "X"
RARE_RESIDUES = "UZOB"
MUTATION_BASES = "ATCG"
# Base codes used by the k-mer scorer (A=0, C=1, G=2, T=3).
BASE_ORDER = "ACGT"


# The bases an ambiguity letter stands for (U is read as T).
AMBIGUOUS: dict[str, str] = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT",
    "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def ambiguous_codons() -> dict[str, str]:
    """Codons over all letters -> residue, where every reading gives the same residue."""
    out: dict[str, str] = {}
    for letters in product(AMBIGUOUS, repeat=3):
        read = {CODON_TABLE["".join(b)] for b in product(*(AMBIGUOUS[x] for x in letters))}
        if len(read) == 1:
            out["".join(letters)] = read.pop()
    return out


def residue_codons() -> dict[str, list[str]]:
    """A24 (driver side): residue -> sorted list of its codons (21 residues, stop included)."""
    out: dict[str, list[str]] = {}
    for codon in sorted(CODON_TABLE):
        out.setdefault(CODON_TABLE[codon], []).append(codon)
    return out

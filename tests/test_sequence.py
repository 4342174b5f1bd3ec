"""Golden cases (FIXTURES.md section 3) and properties of the sequence functions."""

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import mutation as M
from helixframe.functions import sequence as Q
from helixframe.functions.codons import CODON_TABLE, residue_codons
from helixframe.functions.draws import draw, draw_np


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ",".join(f"{k} {type_of(v)}" for k, v in cols.items()))
    return df.select(col.alias("r")).first()["r"]


def type_of(v):
    return {str: "string", int: "bigint", float: "double"}[type(v)]


def test_f3_rna_to_dna(spark):
    assert one(spark, Q.rna_to_dna("s"), s="acguU") == "ACGTT"


def test_f2_prefix(spark):
    assert one(spark, Q.clean("s", 4), s="ACGTAC") == "ACGT"
    assert one(spark, Q.clean("s", 4), s="AC") == "AC"


def test_f6_codons(spark):
    assert one(spark, Q.codons("s"), s="ACGTACG") == ["ACG", "TAC", "G"]


def test_f7_dna_to_aa(spark):
    assert one(spark, Q.dna_to_aa("s"), s="ATGNNNTAAGG") == "MX_X"


def test_f4_translate_to_stop(spark):
    assert one(spark, Q.translate_to_stop("s"), s="ATGGCCTAAGGG") == "MA"
    assert one(spark, Q.translate_to_stop("s"), s="ATGGC") == "M"
    assert one(spark, Q.translate_to_stop("s"), s="TAA") == ""


def test_f5_mask_and_space(spark):
    assert one(spark, Q.spaced(Q.mask_rare("s")), s="MUZOBK") == "M X X X X K"
    assert one(spark, Q.spaced(Q.mask_rare("s")), s="") == ""


def test_f11_back_translation(spark):
    out = one(spark, M.back_translation("s", F.col("r"), 1), s="ATGNNNTAAGG", r=7)
    assert len(out) == 6 and out.startswith("ATG") and out[3:] in ("TAA", "TAG", "TGA")


def test_a24_inverse_table():
    inv = residue_codons()
    assert len(inv) == 21 and len(CODON_TABLE) == 64
    assert inv["_"] == ["TAA", "TAG", "TGA"] and inv["M"] == ["ATG"] and len(inv["L"]) == 6


def test_f9_rate_zero_is_identity_and_length_kept(spark):
    s = "ACGTTGCAAC" * 7
    assert one(spark, M.point_mutation("s", F.col("r"), 3, 0.0), s=s, r=11) == s
    out = one(spark, M.point_mutation("s", F.col("r"), 3, 0.5), s=s, r=11)
    assert len(out) == len(s) and out != s
    assert one(spark, M.point_mutation("s", F.col("r"), 3, 0.5), s="", r=11) == ""


def test_f10_rate_one(spark):
    out = one(spark, M.codon_mutation("s", F.col("r"), 1, 1.0), s="ACGTACG", r=5)
    assert len(out) == 9 and set(out) <= set("ACGT")


def test_draw_matches_numpy(spark):
    rows = [(r, i, p) for r in (0, 1, 99999) for i in (1, 50) for p in (1, 2, 5000)]
    df = spark.createDataFrame(rows, "r bigint, i int, p int")
    got = [x["d"] for x in df.select(draw(F.col("r"), F.col("i"), F.col("p"), 3).alias("d")).collect()]
    want = draw_np([r for r, _, _ in rows], [i for _, i, _ in rows], [p for _, _, p in rows], 3)
    assert got == [int(v) for v in want]


def test_batch_mutation_equals_native(spark):
    seqs = [(i, "".join(np.random.default_rng(i).choice(list("ACGTN"), size=n)))
            for i, n in enumerate([0, 1, 3, 50, 997])]
    df = spark.createDataFrame(seqs, "r bigint, s string").withColumn("it", F.lit(4))
    got = df.select(M.point_mutation("s", F.col("r"), F.col("it"), 0.3).alias("a"),
                    M.point_mutation_batch("s", F.col("r"), F.col("it"), 0.3).alias("b")).collect()
    assert all(x["a"] == x["b"] for x in got)


def test_f12_compounds(spark):
    s = "ACGT" * 30
    twice = one(spark, M.repeated_attack("nucl", "s", F.col("r"), 2, 0.2), s=s, r=3)
    step1 = one(spark, M.point_mutation("s", F.col("r"), 1, 0.2), s=s, r=3)
    step2 = one(spark, M.point_mutation("s", F.col("r"), 2, 0.2), s=step1, r=3)
    assert twice == step2


def test_draws_agree_for_huge_row_ids_and_tiny_rates(spark):
    import duckdb

    from helixframe.functions.draws import draw_sql, fires, threshold

    rows = [0, 5, 2**31, 5 * 10**15, 2**62]
    df = spark.createDataFrame([(r,) for r in rows], "r bigint")
    got = [x.d for x in df.select(draw(F.col("r"), F.lit(3), F.lit(9), 1).alias("d")).collect()]
    con = duckdb.connect()
    assert got == list(draw_np(rows, 3, 9, 1))
    assert got == [con.execute(f"SELECT {draw_sql(str(r), '3', '9', 1)}").fetchone()[0] for r in rows]
    n = 400_000
    many = spark.range(n).select(draw(F.col("id"), F.lit(1), F.lit(1)).alias("x"))
    hits = many.where(fires(F.col("x"), 0.0004)).count()
    assert 0.5 * 0.0004 * n < hits < 1.6 * 0.0004 * n and threshold(0.0) == 0


def test_f4_ambiguous_codons_and_u(spark):
    for text, protein in {"ATGGCNTAA": "MA", "AUGGCU": "MA", "NNNATG": "XM", "YTRTAR": "L", "GAYRAY": "DX"}.items():
        assert one(spark, Q.translate_to_stop("s"), s=text) == protein
    assert one(spark, Q.dna_to_aa("s"), s="GCN") == "X"


def test_f12_row_repeats_codons_and_back_translation(spark):
    from helixframe.plans import q_sequence as P
    from helixframe.sources import standins as S

    SF001 = "/root/testdata/sf0.001"
    got = {(r.row_id, r.attack): r.seq for r in P.f12_repeated_attack_codons(spark, SF001).collect()}
    want = S.seqs(spark, SF001).select("row_id", F.col("dna").alias("s"))
    for attack in ("codon", "bt"):
        step = want
        for i in range(1, P.F12_ITERS + 1):
            step = spark.createDataFrame(step.select(
                "row_id", M.mutate(attack, "s", F.col("row_id"), i, P.RATE).alias("s")).collect(), "row_id bigint, s string")
        rows = step.collect()
        assert rows and all(got[r.row_id, attack] == r.s for r in rows)
    assert len(got) == 2 * want.count()

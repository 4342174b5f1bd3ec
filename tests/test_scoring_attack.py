"""Scorer and attack properties, checked against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.mutation import point_mutation
from helixframe.operators import attack as A
from helixframe.operators.scoring import attack_logits, kmer_logits, predict, rule_weights
from helixframe.plans import ml


def fixture(spark, n=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, "".join(rng.choice(list("ACGT"), size=int(rng.integers(0, 300)))), int(rng.integers(0, 4)))
            for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, dna string, y int")


def test_fused_attack_equals_scoring_the_mutated_text(spark):
    df = fixture(spark)
    w = rule_weights(spark, 4, 3)
    fused = attack_logits(df, "dna", "row_id", F.array(F.lit(2), F.lit(9)), w, 4, 3, 0.2)
    texts = df.select("row_id", F.explode(F.array(F.lit(2), F.lit(9))).alias("iteration"), "dna")
    texts = texts.withColumn("dna", point_mutation("dna", F.col("row_id"), F.col("iteration"), 0.2))
    plain = kmer_logits(texts, "dna", ["row_id", "iteration"], w, 4, 3)
    a = {(r["row_id"], r["iteration"]): r["logits"] for r in fused.collect()}
    b = {(r["row_id"], r["iteration"]): r["logits"] for r in plain.collect()}
    assert a == b and len(a) == 80


def brute_logits(seq, w, k=3):
    out = [0] * len(w[0])
    for p in range(len(seq) - k + 1):
        km = seq[p:p + k]
        if set(km) <= set("ACGT"):
            idx = sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(km))
            out = [o + w[idx][c] for c, o in enumerate(out)]
    return out


def test_kmer_logits_brute_force(spark):
    df = fixture(spark, 20, 3).union(
        spark.createDataFrame([(100, "ACNGTA", 0), (101, "AC", 1)], "row_id bigint, dna string, y int"))
    wdf = rule_weights(spark, 4, 3)
    w = {r["idx"]: [r[f"w{c}"] for c in range(4)] for r in wdf.collect()}
    w = [w[i] for i in range(64)]
    got = {r["row_id"]: r["logits"] for r in kmer_logits(df, "dna", ["row_id"], wdf, 4, 3).collect()}
    for r in df.collect():
        assert got[r["row_id"]] == brute_logits(r["dna"], w)


def test_first_success_brute_force(spark):
    df = fixture(spark, 30, 5)
    w = rule_weights(spark, 4, 3)
    found = {r["row_id"]: (r["success_iteration"], r["y_atk"])
             for r in A.first_success(df, "dna", "row_id", "y", w, 4, 3, 0.1, max_iter=12,
                                      schedule=(1, 2, 5)).collect()}
    tries = df.select("row_id", "y", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("iteration"), "dna")
    tries = tries.withColumn("dna", point_mutation("dna", F.col("row_id"), F.col("iteration"), 0.1))
    lg = kmer_logits(tries, "dna", ["row_id", "iteration", "y"], w, 4, 3).withColumn("y_atk", predict("logits"))
    brute = {}
    for r in sorted(lg.collect(), key=lambda r: r["iteration"]):
        if r["y_atk"] != r["y"] and r["row_id"] not in brute:
            brute[r["row_id"]] = (r["iteration"], r["y_atk"])
    assert found == brute


def test_long_kmers_are_joined_by_shuffle(spark):
    df = fixture(spark, 12, 3)
    w = rule_weights(spark, 2, 9)
    rows = {r["idx"]: (r["w0"], r["w1"]) for r in w.collect()}
    got = {r["row_id"]: r["logits"] for r in kmer_logits(df, "dna", ["row_id"], w, 2, 9).collect()}
    assert got == {r["row_id"]: brute_logits(r["dna"], rows, 9) for r in df.collect()}
    with pytest.raises(ValueError, match="joined"):
        A.score(df, "dna", "row_id", w, 2, 9)


def test_same_result_on_1_and_8_partitions(spark):
    df = fixture(spark, 30, 7)
    w = rule_weights(spark, 4, 3)
    a = sorted(map(tuple, kmer_logits(df.repartition(1), "dna", ["row_id"], w, 4, 3).collect()))
    b = sorted(map(tuple, kmer_logits(df.repartition(8), "dna", ["row_id"], w, 4, 3).collect()))
    assert a == b


@pytest.mark.parametrize("n", [1, 7, 100, 1001])
def test_split_exact_size(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    got = ml.split_exact(df, "row_id", 0.2, 42)
    rows = {r["row_id"]: r["split"] for r in got.collect()}
    assert len(rows) == n
    hashed = sorted(((int(h), r) for r, h in
                     df.select("row_id", ml.hash_unit(F.col("row_id"), 42).alias("h")).collect()), key=lambda t: t)
    want = {r for _, r in hashed[: -(-n * 2 // 10)]}
    assert {r for r, s in rows.items() if s == "test"} == want


def test_first_success_text_path_equals_fused(spark, monkeypatch):
    """The generic (text-building) W4 path must agree with the fused point-mutation path."""
    import helixframe.functions.mutation as MU
    df = fixture(spark, 25, 9)
    w = rule_weights(spark, 4, 3)
    fused = {tuple(r) for r in A.first_success(df, "dna", "row_id", "y", w, 4, 3, 0.1, 8, (1, 3)).collect()}
    monkeypatch.setattr(A, "mutate", lambda kind, *a: MU.point_mutation(*a))
    textual = {tuple(r) for r in A.first_success(df, "dna", "row_id", "y", w, 4, 3, 0.1, 8, (1, 3),
                                                 attack="bt").collect()}
    assert fused == textual


def test_first_success_codon_and_require_correct(spark):
    df = fixture(spark, 20, 11).withColumn("y_orig", F.col("y"))
    w = rule_weights(spark, 4, 3)
    got = A.first_success(df, "dna", "row_id", "y", w, 4, 3, 0.3, 5, attack="codon")
    assert got.count() >= 1
    none = A.first_success(df.withColumn("y_orig", F.col("y") + 1), "dna", "row_id", "y", w, 4, 3, 0.3, 5,
                           require_correct=True, y_orig="y_orig")
    assert none.count() == 0

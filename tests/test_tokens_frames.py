"""Tokens, frame plumbing and the size-checked join."""

from pyspark.sql import functions as F

from helixframe.functions import mutation as M
from helixframe.operators import attack as A
from helixframe.operators import frames as FR
from helixframe.operators import tokens as T
from helixframe.session import materialize


def test_k1_k2_k3(spark):
    df = spark.createDataFrame([(0, "ACGTAC"), (1, "ACG"), (2, "A")], "row_id bigint, dna string")
    counts = {(r["row_id"], r["kmer"]): r["n"] for r in T.kmer_counts(df, "dna", "row_id", 3).collect()}
    assert counts == {(0, "ACG"): 1, (0, "CGT"): 1, (0, "GTA"): 1, (0, "TAC"): 1, (1, "ACG"): 1}
    vocab = {r["kmer"]: r["id"] for r in T.vocabulary(df, "dna", "row_id", 3).collect()}
    assert vocab == {"ACG": 4, "CGT": 5, "GTA": 6, "TAC": 7}  # df 2 first, then by text
    enc = {r["row_id"]: r["ids"] for r in T.encode(df, "dna", "row_id", spark.createDataFrame(
        [("ACG", 4), ("TAC", 5)], "kmer string, id int"), 3).collect()}
    assert enc == {0: [4, 1, 1, 5], 1: [4], 2: []}


def test_k4_k5(spark):
    df = spark.createDataFrame([([5, 6, 7, 8],)], "ids array<int>")
    t = df.select(T.truncate(F.col("ids"), 4).alias("t")).first()["t"]
    assert t == [2, 5, 6, 3]
    ids, mask = T.pad(F.col("t"), 6)
    r = df.select(T.truncate(F.col("ids"), 4).alias("t")).select(ids.alias("i"), mask.alias("m")).first()
    assert r["i"] == [2, 5, 6, 3, 0, 0] and r["m"] == [1, 1, 1, 1, 0, 0]


def test_j8_overwrite_and_j4_copy(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "row_id bigint, s string, v int")
    patch = spark.createDataFrame([(2, None)], "row_id bigint, s string")
    out = {r["row_id"]: (r["s"], r["v"]) for r in FR.overwrite(base, patch).collect()}
    assert out == {1: ("a", 10), 2: (None, 20)}
    src = spark.createDataFrame([(1, 7)], "row_id bigint, y int")
    got = {r["row_id"]: r["y"] for r in FR.copy_column(base, src, "y").collect()}
    assert got == {1: 7, 2: None}


def test_w3_snapshots(spark):
    clean = spark.createDataFrame([(1, 0, 0), (2, 0, 3)], "row_id bigint, y int, y_orig int")
    found = spark.createDataFrame([(1, 15, 1)], "row_id bigint, success_iteration int, y_atk int")
    orig = spark.createDataFrame([(1, "ACGTACGTACGTACGTACGT"), (2, "ORIG2")], "row_id bigint, dna string")
    state = A.states(clean, found, intervals=(10, 20))
    snap = {(r["row_id"], r["iteration"]): r for r in A.snapshots(state, found, orig, "dna", rate=0.5).collect()}
    mutated = orig.select(M.point_mutation("dna", F.col("row_id"), 15, 0.5).alias("m")).first()["m"]
    assert snap[1, 10]["dna"] == "ACGTACGTACGTACGTACGT" and mutated != "ACGTACGTACGTACGTACGT"
    assert snap[1, 20]["dna"] == mutated and snap[2, 20]["dna"] == "ORIG2"
    assert {k: (r["y_hat"], r["success"]) for k, r in snap.items()} == {
        (1, 10): (0, False), (1, 20): (1, True), (2, 10): (3, False), (2, 20): (3, False)}


def test_k3_dense_array_equals_the_join(spark):
    import random

    import pytest

    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 40)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "AC"), (303, "ACG"), (304, "éACGTé"), (305, "ACGT" * 5000)]
    df = spark.createDataFrame(rows, "row_id bigint, dna string").repartition(3)
    vocab = spark.createDataFrame([("ACG", 4), ("TTT", 5), ("GTA", 6), ("CGT", 9)], "kmer string, id int")
    fast = {r["row_id"]: r["ids"] for r in T.encode(df, "dna", "row_id", vocab, 3).collect()}
    slow = {r["row_id"]: r["ids"] for r in T.encode_by_join(df, "dna", "row_id", vocab, 3).collect()}
    assert fast == slow
    cut = {r["row_id"]: r["ids"] for r in T.encode(df, "dna", "row_id", vocab, 3, limit=7).collect()}
    assert cut == {k: v[:7] for k, v in slow.items()}
    old, T.RUN = T.RUN, 50  # many runs a batch
    try:
        assert {r["row_id"]: r["ids"] for r in T.encode(df, "dna", "row_id", vocab, 3).collect()} == slow
    finally:
        T.RUN = old
    with pytest.raises(ValueError, match="encode_by_join"):
        T.encode(df, "dna", "row_id", spark.createDataFrame([("ANG", 4)], "kmer string, id int"), 3)
    with pytest.raises(ValueError, match="encode_by_join"):
        T.dense_ids(vocab, 12)


def test_k3_plan_has_no_exchange_behind_the_scan(spark, tmp_path, capsys):
    df = spark.range(0, 640, numPartitions=64).select(F.col("id").alias("row_id"), F.lit("ACGTTGCA").alias("dna"))
    df.write.parquet(f"{tmp_path}/s")
    vocab = spark.createDataFrame([("ACG", 4)], "kmer string, id int")
    T.encode(spark.read.parquet(f"{tmp_path}/s"), "dna", "row_id", vocab, 3).explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "Join" not in plan


def test_materialize_cuts_lineage(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    m = materialize(df, "t", key="id")
    assert sorted(r["x"] for r in m.collect()) == list(range(0, 20, 2))

"""Batch-scored tries, pieces of long sequences, the pruned cascade, one-pass pooling, two-phase distinct."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.mutation import codon_mutation, point_mutation
from helixframe.operators import attack as A
from helixframe.operators import labels as L
from helixframe.operators import pooling as P
from helixframe.operators import tokens as T
from helixframe.operators import tries as R
from helixframe.operators.scoring import attack_logits, kmer_logits, rule_weights


def fixture(spark, n=40, seed=1, letters="ACGTNé"):
    rng = random.Random(seed)
    rows = [(i - 3, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200))), rng.randrange(4)) for i in range(n)]
    rows += [(900, "", 0), (901, "A", 1), (902, None, 2), (903, "ACG", 3)]
    return spark.createDataFrame(rows, "row_id bigint, dna string, y int")


@pytest.mark.parametrize(("size", "run"), [(1 << 20, 1 << 20), (7, 1 << 20), (50, 30)])
def test_tries_equal_the_jvm_scorer(spark, monkeypatch, size, run):
    monkeypatch.setattr(R, "RUN", run)
    df = fixture(spark, letters="ACGTN")
    w = rule_weights(spark, 4, 3)
    tries = [(0, 0.0), (2, 0.2), (9, 0.2), (9, 0.7)]
    got = {(r["row_id"], r["try"]): r["logits"] for r in R.try_logits(
        df, "dna", "row_id", ["y"], tries, R.weight_matrix(w, 4, 3), 3, size=size).collect()}
    for t, (it, rate) in enumerate(tries):
        jvm = attack_logits(df, "dna", "row_id", F.array(F.lit(it)), w, 4, 3, rate)
        assert {r["row_id"]: r["logits"] for r in jvm.collect()} == {i: v for (i, u), v in got.items() if u == t}
    clean = {r["row_id"]: r["logits"] for r in kmer_logits(df, "dna", ["row_id"], w, 4, 3).collect()}
    assert clean == {i: v for (i, u), v in got.items() if u == 0}


@pytest.mark.parametrize("size", [3 << 18, 3, 9, 60])
def test_codon_tries_equal_scoring_the_mutated_text(spark, size):
    df = fixture(spark, 60, 5, letters="ACGTN")
    w = rule_weights(spark, 4, 3)
    tries = [(1, 0.3), (2, 0.3), (2, 0.9)]
    got = {(r["row_id"], r["try"]): r["logits"] for r in R.try_logits(
        df, "dna", "row_id", [], tries, R.weight_matrix(w, 4, 3), 3, size=size, attack="codon").collect()}
    for t, (it, rate) in enumerate(tries):
        texts = df.select("row_id", codon_mutation("dna", F.col("row_id"), it, rate).alias("dna"))
        plain = {r["row_id"]: r["logits"] for r in kmer_logits(texts, "dna", ["row_id"], w, 4, 3).collect()}
        assert plain == {i: v for (i, u), v in got.items() if u == t}


def test_codon_texts_equal_the_column_form(spark):
    df = fixture(spark, 50, 6).withColumn("it", F.when(F.col("row_id") % 5 != 0, F.col("row_id") % 7))
    got = df.select("row_id", R.codon_mutated_text(F.col("dna"), F.col("row_id"), F.col("it"), 0.4).alias("m"),
                    codon_mutation("dna", F.col("row_id"), F.col("it"), 0.4).alias("want"), "it", "dna").collect()
    assert all(r["m"] == r["want"] for r in got if r["it"] is not None and r["dna"] is not None)
    assert all(r["m"] is None for r in got if r["it"] is None or r["dna"] is None)


def test_digests_agree_exactly_for_equal_texts(spark):
    df = fixture(spark, 60).union(spark.createDataFrame([(i, "AC", 0) for i in range(2000, 2040)], "a long, b string, c int"))
    w = R.weight_matrix(rule_weights(spark, 4, 3), 4, 3)
    rates = [0.1, 0.5, 0.9]
    for size in (1 << 20, 11):
        got = R.try_logits(df, "dna", "row_id", [], [(1, r) for r in rates], w, 3, digest=True, size=size).collect()
        texts = {}
        for t, r in enumerate(rates):
            for row in df.select("row_id", F.coalesce(point_mutation("dna", F.col("row_id"), 1, r), F.lit("")).alias("m")).collect():
                texts[row["row_id"], t] = row["m"]
        by_text, by_digest = {}, {}
        for r in got:
            by_text.setdefault(texts[r["row_id"], r["try"]], set()).add(bytes(r["digest"]))
            by_digest.setdefault(bytes(r["digest"]), set()).add(texts[r["row_id"], r["try"]])
        assert all(len(v) == 1 for v in by_text.values()) and all(len(v) == 1 for v in by_digest.values())


def test_texts_of_all_rates_come_from_one_draw(spark):
    df = fixture(spark, 30)
    rates = (0.1, 0.4, 0.8)
    got = {r["row_id"]: r["t"] for r in df.select("row_id", A.sweep_texts("dna", "row_id", rates).alias("t")).collect()}
    for t, r in enumerate(rates):
        one = df.select("row_id", F.coalesce(point_mutation("dna", F.col("row_id"), 1, r), F.lit("")).alias("m")).collect()
        assert {x["row_id"]: x["m"] for x in one} == {i: v[t] for i, v in got.items()}


def test_a_long_sequence_is_work_for_many_tasks(spark):
    long = "ACGTTGCANACG" * 20_000
    df = spark.createDataFrame([(1, long), (2, "ACGT")], "row_id bigint, dna string")
    cut = R.pieces(df, "dna", ["row_id"], 3, 1000).cache()
    assert cut.count() == 241 and cut.where("length(piece) > 1002").isEmpty()
    assert cut.select(F.spark_partition_id()).distinct().count() > 3
    counts = {r["kmer"]: r["n"] for r in T.kmer_counts(df.where("row_id = 1"), "dna", "row_id", 3).collect()}
    want = {}
    for p in range(len(long) - 2):
        want[long[p:p + 3]] = want.get(long[p:p + 3], 0) + 1
    assert counts == want
    pos = {(r["pos"], r["kmer"]) for r in T.kmers(df.where("row_id = 2"), "dna", "row_id", 3).collect()}
    assert pos == {(1, "ACG"), (2, "CGT")}


def test_first_try_with_the_clean_pass_changes_nothing(spark):
    df = fixture(spark, 40, 8, letters="ACGT").where("dna IS NOT NULL")
    w = rule_weights(spark, 4, 3)
    plain = {tuple(r) for r in A.first_success(df, "dna", "row_id", "y", w, 4, 3, 0.1, 12).collect()}
    clean, first = A.clean_and_first(df, "dna", "row_id", "y", w, 4, 3, 0.1)
    split = A.first_success(df, "dna", "row_id", "y", w, 4, 3, 0.1, 12, (4, 20), known=first, start=2)
    assert plain == {tuple(r) for r in split.collect()} and len(plain) > 20
    want = {r["row_id"]: r["y_hat"] for r in A.score(df, "dna", "row_id", w, 4).collect()}
    assert {r["row_id"]: r["y_orig"] for r in clean.collect()} == want


def brute_cascade(rows):
    rec, out = {}, []
    zero = sorted((r for r in rows if r[0] == 0), key=lambda r: r[1])
    for step, rid, text, y, yo, ya in zero:
        if y == yo and y != ya:
            rec[text] = y
        out.append((step, rid, y))
    for step, rid, text, y, yo, ya in sorted((r for r in rows if r[0] > 0), key=lambda r: r[:2]):
        if text in rec:
            y = rec[text]
        elif y != ya:
            rec[text] = y
        out.append((step, rid, y))
    return sorted(out)


def test_cascade_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(s, i, f"t{rng.randrange(40)}" if rng.random() < .6 else f"u{s}-{i}", rng.randrange(3), rng.randrange(3),
             rng.randrange(3)) for s in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "step int, row_id bigint, seq string, y int, y_orig int, y_atk int").repartition(5)
    out = A.cascade(df)
    assert out.columns == df.columns
    assert sorted((r["step"], r["row_id"], r["y"]) for r in out.collect()) == brute_cascade(rows)


def test_attention_is_stable_for_scores_of_any_size_and_needs_no_join(spark, capsys):
    rng = np.random.default_rng(3)
    dim, rows = 6, []
    for s in range(5):
        scale = 10.0 ** (s + 1)  # scores of up to about a hundred thousand
        rows += [(f"S{s}", float(rng.integers(0, 5)), [float(np.float32(v * scale)) for v in rng.normal(size=dim)])
                 for _ in range(30)]
    df = spark.createDataFrame(rows, "sample_name string, abundance double, emb array<float>")
    out = P.attention_pool(df, dim=dim, heads=2)
    got = {r["sample_name"]: r["emb"] for r in out.collect()}
    for s in {r[0] for r in rows}:
        want = []
        for h in range(2):
            q = np.array(P.query_vector(dim, h))
            x = np.array([r[2] for r in rows if r[0] == s and int(r[1]) > 0])
            m = np.array([int(r[1]) for r in rows if r[0] == s and int(r[1]) > 0])
            z = x @ q / math.sqrt(dim)
            w = m * np.exp(z - z.max())
            want += list((w[:, None] * x).sum(axis=0) / w.sum())
        assert np.allclose(got[s], want, rtol=1e-9)
    out.explain()
    assert "Join" not in capsys.readouterr().out


@pytest.mark.parametrize("dim", [3, 64, 65, 130])
def test_pooling_of_missing_elements_at_every_width(spark, dim):
    v = [[float(i + j) for i in range(dim)] for j in range(3)]
    v[1][dim - 1] = None
    df = spark.createDataFrame([("a", 1.0, v[0]), ("a", 3.0, v[1]), ("b", 2.0, v[2]), ("z", 0.0, v[0])],
                               "sample_name string, abundance double, emb array<double>")
    got = {r["sample_name"]: r["emb"] for r in P.weighted_mean_pool(df, dim=dim).collect()}
    assert set(got) == {"a", "b"} and got["b"] == v[2]
    assert got["a"][-1] is None and got["a"][:-1] == [(p + 3 * q) / 4 for p, q in zip(v[0][:-1], v[1][:-1])]


def test_distinct_rows_compares_only_repeated_hashes(spark):
    rows = [(i, rng_text, v) for i, (rng_text, v) in enumerate([("a", 1.0), ("a", 1.0), ("b", None), ("b", None),
                                                                 (None, 0.0), (None, -0.0), ("c", 2.0), ("c", 3.0)])]
    df = spark.createDataFrame(rows, "row_id bigint, t string, v double")
    got = sorted((r["row_id"] for r in L.distinct_rows(df).collect()))
    assert got == [0, 2, 4, 6, 7]

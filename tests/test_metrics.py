"""Golden cases for metrics, labels and pooling (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe.functions import numeric as N
from helixframe.operators import attack as A
from helixframe.operators import labels as L
from helixframe.operators import metrics as X
from helixframe.operators import pooling as P


def preds(spark):
    return spark.createDataFrame(list(zip([0, 0, 1, 1, 2], [0, 1, 1, 1, 3])), "y int, y_hat int")


def test_a9_a13(spark):
    s = X.summary(preds(spark)).first()
    assert s["accuracy"] == pytest.approx(0.6)
    assert s["balanced_accuracy"] == pytest.approx(0.5)
    assert s["precision_macro"] == pytest.approx(0.416667, abs=1e-6)
    assert s["recall_macro"] == pytest.approx(0.375)
    assert s["f1_macro"] == pytest.approx(0.366667, abs=1e-6)
    assert s["f1_weighted"] == pytest.approx(0.586667, abs=1e-6)


def test_a14_report_supports(spark):
    r = {x["row"]: x for x in X.classification_report(preds(spark)).collect()}
    assert [r[c]["support"] for c in "0123"] == [2, 2, 1, 0]
    assert r["accuracy"]["f1"] == pytest.approx(0.6) and r["accuracy"]["precision"] is None


def test_a15_confusion(spark):
    labels = spark.createDataFrame([(i,) for i in range(4)], "label int")
    cm = {(x["y"], x["y_hat"]): x["n"] for x in X.confusion_matrix(preds(spark), labels).collect()}
    want = [[1, 1, 0, 0], [0, 2, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]]
    assert all(cm[(i, j)] == want[i][j] for i in range(4) for j in range(4))


def test_entropy_confidence_argmax(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([math.log(3), 0.0],), ([1.0, 3.0, 3.0],)], "z array<double>")
    p = df.select(N.softmax("z").alias("p"), N.argmax("z").alias("k"))
    rows = p.select(N.entropy("p").alias("e"), N.top1("p").alias("t"), "k").collect()
    assert rows[0]["e"] == pytest.approx(0.693147, abs=1e-6) and rows[0]["t"] == pytest.approx(0.5)
    assert rows[1]["e"] == pytest.approx(0.562335, abs=1e-6) and rows[1]["t"] == pytest.approx(0.75)
    assert rows[2]["k"] == 1


def test_a19_focal(spark):
    df = spark.createDataFrame([([math.log(3), 0.0], 0)], "z array<double>, y int")
    r = X.focal_loss(df, gamma=2.0).first()
    assert r["ce"] == pytest.approx(0.287682, abs=1e-6)
    assert r["focal_loss"] == pytest.approx(0.017980, abs=1e-6)


def test_a7_a8(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    w = {x["label"]: x["weight"] for x in L.class_weights(df, "label").collect()}
    assert w[0] == pytest.approx(0.666667, abs=1e-6) and w[1] == pytest.approx(2.0)
    assert L.neg_pos_ratio(df, "label").first()["ratio"] == pytest.approx(3.0)


def test_a1_a2_pooling(spark):
    df = spark.createDataFrame([("S1", 1.0, [1.0, 0.0]), ("S1", 3.0, [0.0, 1.0]), ("S2", 0.0, [5.0, 5.0])],
                               "sample_name string, abundance double, emb array<float>")
    mean = {r["sample_name"]: r["emb"] for r in P.mean_pool(df, dim=2).collect()}
    assert mean["S1"] == [0.5, 0.5] and mean["S2"] == [5.0, 5.0]
    wm = {r["sample_name"]: r["emb"] for r in P.weighted_mean_pool(df, dim=2).collect()}
    assert wm == {"S1": [0.25, 0.75]}


def test_a3_zero_query_equals_weighted(spark, monkeypatch):
    df = spark.createDataFrame([("S1", 2.9, [1.0, 0.0]), ("S1", 1.0, [0.0, 1.0])],
                               "sample_name string, abundance double, emb array<float>")
    monkeypatch.setattr(P, "query_vector", lambda dim, head=0: [0.0] * dim)
    att = P.attention_pool(df, dim=2).first()["emb"]
    assert att == pytest.approx([2 / 3, 1 / 3])


def test_a4_repeat(spark):
    df = spark.createDataFrame([("a", 2.9), ("b", 0.0)], "k string, abundance double")
    assert P.repeat_rows(df).count() == 2


def test_a16(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], [0, 0, 1, 0], [1, 0, 0, 1])), "y int, y_orig int, y_atk int")
    assert X.attack_success_rate(df).first()["success_rate"] == pytest.approx(2 / 3)
    none = spark.createDataFrame([(0, 1, 1)], "y int, y_orig int, y_atk int")
    assert X.attack_success_rate(none).first()["success_rate"] == 0.0


def test_a17_a18(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    r = X.mean_std(df, ["v"]).first()
    assert r["v_mean"] == 2.0 and r["v_std"] == 1.0
    h = {x["bin"]: x["n"] for x in X.histogram(spark.createDataFrame([(0.0,), (10.0,), (5.0,)], "v double"),
                                               "v", 30).collect()}
    assert len(h) == 30 and h[0] == 1 and h[29] == 1 and h[15] == 1 and sum(h.values()) == 3


def test_l1_first_appearance(spark):
    df = spark.createDataFrame(list(enumerate("babc")), "row_id bigint, label string")
    d = {x["label"]: x["id"] for x in L.ids_by_first_appearance(df, "label").collect()}
    assert d == {"b": 0, "a": 1, "c": 2}


def test_l2_pair_dictionary_and_strict(spark):
    df = spark.createDataFrame([(0, 2, "B"), (1, 0, "A"), (2, 2, "B2"), (3, 1, "A")],
                               "row_id bigint, label int, name string")
    d = {x["name"]: x["label"] for x in L.pair_dictionary(df, "label", "name").collect()}
    assert d == {"B2": 2, "A": 1}
    dic = L.pair_dictionary(df, "label", "name").withColumnRenamed("label", "id")
    with pytest.raises(Exception):
        L.encode_strict(df, dic, "name").collect()


def test_l4_label_encoder(spark):
    df = spark.createDataFrame([(0, "forest"), (1, None), (2, "Air")], "row_id bigint, c string")
    d = {x["row_id"]: x["c"] for x in L.label_encode(df, ["c"]).collect()}
    assert d == {2: 0, 0: 1, 1: 2}


def test_p3_p5_p6(spark):
    df = spark.createDataFrame([(0, "not applicable"), (1, None), (2, "0.3"), (3, "0.31")], "row_id bigint, c string")
    kept = L.exclude_sentinel(df, "c")
    lab = {x["row_id"]: x["l"] for x in kept.select("row_id", L.threshold_label(L.to_double("c")).alias("l")).collect()}
    assert lab == {1: 0, 2: 0, 3: 1}
    pres = {x["row_id"]: x["l"] for x in df.select("row_id", L.presence_label("c").alias("l")).collect()}
    assert pres == {0: 0, 1: 1, 2: 1, 3: 1}


def test_w1_sticky(spark):
    rows = [(1, it, 0, 0, ya, f"a{it}") for it, ya in [(1, 0), (2, 1), (3, 0), (4, 1)]]
    df = spark.createDataFrame(rows, "row_id bigint, iteration int, y int, y_orig int, y_atk int, seq string")
    out = {x["iteration"]: x["seq"] for x in A.sticky_success(df, carry=["seq"]).collect()}
    assert out == {1: "a1", 2: "a2", 3: "a2", 4: "a2"}
    wrong = df.withColumn("y_orig", F.lit(1))
    out = {x["iteration"]: x["seq"] for x in A.sticky_success(wrong, carry=["seq"]).collect()}
    assert out == {1: "a1", 2: "a2", 3: "a3", 4: "a4"}


def test_w2_cascade(spark):
    rows = [(0, 10, "t", 4, 4, 0), (1, 11, "t", 7, 7, 7)]
    df = spark.createDataFrame(rows, "step int, row_id bigint, seq string, y int, y_orig int, y_atk int")
    out = {x["step"]: x["y"] for x in A.cascade(df).collect()}
    assert out == {0: 4, 1: 4}


def test_u1_union(spark):
    from helixframe.operators import frames as FR

    a = spark.createDataFrame([(0, 1, 2)], "row_id bigint, a int, b int")
    b = spark.createDataFrame([(0, 1, 3)], "k bigint, a int, c int")
    u = FR.append_rows(a, b, order="row_id", aug_order="k")
    assert set(u.columns) == {"row_id", "a", "b", "c"}
    assert sorted(r["row_id"] for r in u.collect()) == [0, 1]


def test_pooling_of_wide_vectors_missing_elements_and_negative_weights(spark):
    wide = [float(i) for i in range(768)]
    rows = [("a", 2.0, wide), ("a", -1.0, [2 * x for x in wide]), ("b", 1.0, [None] + wide[1:])]
    df = spark.createDataFrame(rows, "sample_name string, abundance double, emb array<float>")
    got = {r["sample_name"]: r["emb"] for r in P.weighted_mean_pool(df, dim=768).collect()}
    assert got["a"] == [0.0] * 768
    assert got["b"][0] is None and got["b"][1:] == wide[1:]
    with pytest.raises(Exception, match="another width"):
        P.mean_pool(df, dim=767).collect()

"""Spark ML queries: M1-M7, M11, S9 (a fitted model has no SQL form: it is checked against its exported expression)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import metrics as X
from ..operators.scoring import batch_model_udf
from ..session import materialize
from ..sources import standins as S
from . import ml
from .q_attack import K as SCORER_K, SEED, _q, dictionary, labelled_seqs
from .registry import register
from .views import with_views

TEST_FRACTION = 0.2
NUMERIC = ["ph", "depth", "elevation"]
TEXT = ["env_biome", "geo_loc_name"]

M01_SQL = with_views("meta", f"""
SELECT row_id, CASE WHEN ('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT
                         < {int(round(TEST_FRACTION * 2 ** 32))} THEN 'test' ELSE 'train' END AS split
FROM meta""")


@register("m01_split", M01_SQL)
def m01_split(spark, sf_dir):
    return ml.split(S.meta(spark, sf_dir).select("row_id"), "row_id", TEST_FRACTION, 42)


M01X_SQL = with_views("meta", f"""
SELECT row_id, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT,
                                            row_id) <= ceil({TEST_FRACTION} * count(*) OVER ())
               THEN 'test' ELSE 'train' END AS split
FROM meta""")


@register("m01_split_exact", M01X_SQL)
def m01_split_exact(spark, sf_dir):
    return ml.split_exact(S.meta(spark, sf_dir).select("row_id"), "row_id", TEST_FRACTION, 42)


def _prepared(spark, sf_dir, label_kind: str):
    """M5: label (P6 presence, or P3 + P5 threshold), L4 encoding, P7 drop, M1 split."""
    m = S.meta(spark, sf_dir)
    if label_kind == "presence":
        m = m.withColumn("label", L.presence_label("co_occur").cast("double"))
    else:
        m = L.exclude_sentinel(m, "co_occur")
        m = m.withColumn("label", L.threshold_label(L.to_double("co_occur")).cast("double"))
    enc = L.label_encode(m.select("row_id", *NUMERIC, *TEXT, "label"), TEXT)
    enc = L.drop_missing(enc, NUMERIC + TEXT + ["label"])
    return ml.split(enc, "row_id", TEST_FRACTION, 42)


_TEST = f"('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT < {int(round(TEST_FRACTION * 2 ** 32))}"
# Test rows and labels of the two targets, after P7.
_LABELLED = {
    "presence": """SELECT row_id, CASE WHEN co_occur = 'not applicable' THEN 0 ELSE 1 END AS label FROM meta
      WHERE ph IS NOT NULL""",
    "threshold": """SELECT row_id, CASE WHEN CAST(co_occur AS DOUBLE) > 0.3 THEN 1 ELSE 0 END AS label FROM meta
      WHERE ph IS NOT NULL AND co_occur IS DISTINCT FROM 'not applicable'"""}


def _test_sql(target: str) -> str:
    return f"SELECT row_id, CAST(label AS DOUBLE) AS label, true AS agrees FROM ({_LABELLED[target]}) WHERE {_TEST}"


@register("m02_assemble", with_views("meta", """
SELECT * FROM (SELECT row_id, ph AS f0, depth AS f1, elevation AS f2,
  CAST(dense_rank() OVER (ORDER BY coalesce(env_biome, 'nan')) - 1 AS DOUBLE) AS f3,
  CAST(dense_rank() OVER (ORDER BY coalesce(geo_loc_name, 'nan')) - 1 AS DOUBLE) AS f4 FROM meta)
WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL"""))
def m02_assemble(spark, sf_dir):
    """The assembled vectors, flattened again."""
    from pyspark.ml.functions import vector_to_array

    d = _prepared(spark, sf_dir, "presence")
    v = ml.assemble(NUMERIC + TEXT).transform(d).select("row_id", vector_to_array("features").alias("v"))
    return v.select("row_id", *[F.col("v")[i].alias(f"f{i}") for i in range(len(NUMERIC + TEXT))])


def _predictions(spark, sf_dir, target: str, kind: str):
    """Test rows with the model's prediction and that of its exported expression."""
    # spread by key: the trees' rows, with their hundred bag counts each, are read by many tasks on every pass
    d = materialize(_prepared(spark, sf_dir, target), "prepared", key="row_id")
    train = d.where(F.col("split") == "train")
    if kind == "forest":
        model = ml.random_forest(NUMERIC + TEXT).fit(ml.balanced_weights(train, "label"))
    else:
        model = ml.gradient_boosting(NUMERIC + TEXT).fit(ml.positive_weights(train, "label"))
    rows = ml.beside_expression(model, NUMERIC + TEXT, d.where(F.col("split") == "test"))
    return rows.select("row_id", "label", "prediction", "by_expression")


def _agreement(p):
    return p.select("row_id", "label", (F.col("prediction") == F.col("by_expression")).alias("agrees"))


@register("m03_random_forest", with_views("meta", _test_sql("presence")))
def m03_random_forest(spark, sf_dir):
    """Test rows, and whether the forest and its column expression predict the same."""
    return _agreement(_predictions(spark, sf_dir, "presence", "forest"))


@register("m04_gradient_boosting", with_views("meta", _test_sql("threshold")))
def m04_gradient_boosting(spark, sf_dir):
    return _agreement(_predictions(spark, sf_dir, "threshold", "boosting"))


M05_SQL = with_views("meta", f"""
WITH t AS (SELECT 'presence' AS target, label FROM ({_test_sql('presence')})
  UNION ALL SELECT 'threshold', label FROM ({_test_sql('threshold')}))
SELECT target, model, row, support, true AS agrees FROM (
  SELECT target, CAST(CAST(label AS INTEGER) AS VARCHAR) AS row, count(*) AS support FROM t GROUP BY ALL
  UNION ALL SELECT target, row, count(*) FROM t, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) r(row) GROUP BY ALL),
  (VALUES ('forest'), ('boosting')) m(model)""")


@register("m05_metadata_report", M05_SQL)
def m05_metadata_report(spark, sf_dir):
    """The four reports (presence and threshold targets, forest and boosting), each figure from the model's and from the
    expression's predictions: rows and supports, and whether all figures agree."""
    out = None
    for target in ("presence", "threshold"):
        for kind in ("forest", "boosting"):
            p = materialize(_predictions(spark, sf_dir, target, kind), "predictions")
            a, b = (X.classification_report(p.select(F.col("label").cast("int").alias("y"), F.col(c).cast("int").alias("y_hat")))
                    for c in ("prediction", "by_expression"))
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("precision", "recall", "f1", "support")]
            r = a.alias("a").join(b.alias("b"), F.col("a.row") == F.col("b.row"), "left").select(
                F.lit(target).alias("target"), F.lit(kind).alias("model"), "a.row", "a.support",
                (same[0] & same[1] & same[2] & same[3]).alias("agrees"))
            out = r if out is None else out.unionByName(r)
    return out


def _seq_training(spark, sf_dir):
    """The rows with their k-mer counts, written once: fitting and scoring read them, not the texts."""
    s = labelled_seqs(spark, sf_dir).withColumn("label", F.col("y").cast("double"))
    s = s.select("row_id", "y", "split", "label", ml.kmer_counts(F.col("dna"), SCORER_K).alias("kmers"))
    return materialize(s, "kmers", key="row_id").withColumn("features", array_to_vector("kmers"))


def _fit_sequence_model(spark, sf_dir):
    s = _seq_training(spark, sf_dir)
    train = ml.balanced_weights(s.where(F.col("split") == "train"), "label")
    return s, ml.sequence_classifier().fit(train)


# The fitted weights have no SQL form; the test rows, their labels and a bound on the accuracy do.
M06_SQL = with_views("seqs", """
WITH d AS (SELECT label_name, CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INTEGER) AS id
  FROM seqs WHERE split = 'train' GROUP BY label_name)
SELECT s.row_id, d.id AS y, true AS beats_majority FROM seqs s JOIN d USING (label_name) WHERE s.split = 'test'""")


@register("m06_sequence_classifier", M06_SQL)
def m06_sequence_classifier(spark, sf_dir):
    """Test rows, and whether the model is right at least as often as the most common class is."""
    s, model = _fit_sequence_model(spark, sf_dir)
    out = model.transform(s.where(F.col("split") == "test")).select("row_id", "y", "prediction")
    out = materialize(out, "predictions")
    right = out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("right"))
    most = out.groupBy("y").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("most"))
    bound = right.crossJoin(most).select((F.col("right") >= F.col("most")).alias("beats_majority"))
    return out.select("row_id", "y").crossJoin(F.broadcast(bound))  # one row


def _numpy_kmer_model(c: int):
    """M7's user model: the md5-rule 3-mer weights as a numpy scorer (built once per Python worker)."""
    k = SCORER_K
    kms = ["".join("ACGT"[(i // 4 ** (k - 1 - j)) % 4] for j in range(k)) for i in range(4 ** k)]
    w = np.array([[int(hashlib.md5(f"{km}:{ci}:{SEED}".encode()).hexdigest()[:8], 16) % 1001 - 500
                   for ci in range(c)] for km in kms], dtype=np.float64)
    lut = np.full(256, -1, dtype=np.int64)
    for i, b in enumerate("ACGT"):
        lut[ord(b)] = i

    def predict(seqs: np.ndarray) -> np.ndarray:
        # one pass over the flat batch; a separator no base matches keeps windows inside a sequence
        raw = [s.encode("ascii", "replace") for s in seqs]
        codes = lut[np.frombuffer(b"\0".join(raw) + b"\0" * k, dtype=np.uint8)]
        win = np.lib.stride_tricks.sliding_window_view(codes, k)
        ok = np.flatnonzero((win >= 0).all(axis=1))
        owner = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])
        idx = (win[ok] * (4 ** np.arange(k - 1, -1, -1))).sum(axis=1)
        return np.stack([np.bincount(owner[ok], w[idx, ci], len(raw)) for ci in range(c)], axis=1)

    return predict


@register("m07_batch_scoring", _q("SELECT row_id, y, y_orig AS y_hat FROM orig"))
def m07_batch_scoring(spark, sf_dir):
    """The user model in batches; its weights follow the same rule as M8's, so the answers agree."""
    d = dictionary(spark, sf_dir)
    s, n = labelled_seqs(spark, sf_dir, d), d.count()
    scorer = batch_model_udf(lambda: _numpy_kmer_model(n), n, batch_size=32)
    lg = s.select("row_id", "y", scorer(F.col("dna")).alias("logits"))
    return lg.select("row_id", "y", (F.array_position("logits", F.array_max("logits")) - 1).cast("int").alias("y_hat"))


@register("m11_reload_compare", with_views("seqs", """
SELECT count(*) AS rows_compared, CAST(0 AS BIGINT) AS rows_different FROM seqs WHERE split = 'test'"""))
def m11_reload_compare(spark, sf_dir):
    """Rows scored by the model and by its saved and loaded copy, and how many differ."""
    s, model = _fit_sequence_model(spark, sf_dir)
    again = ml.load_model(ml.save_model(model, "sequence-classifier"))
    test = s.where(F.col("split") == "test")
    return ml.prediction_diff(model.transform(test), again.transform(test))

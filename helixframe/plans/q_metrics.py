"""Metric queries over the ``logits`` stand-in (embeddings): O2, O3, F15-F17, A9-A21, M9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import labels as L
from ..operators import metrics as X
from ..sources import standins as S
from ..sources.tables import table
from .registry import register
from .sqlgen import r6, round_cols
from .views import folded_sql, with_views


def preds(spark, sf_dir):
    """``(row_id, y, z, y_hat)``: the logit table with its arg-max prediction."""
    lg = S.logits(spark, sf_dir)
    return lg.withColumn("y_hat", N.argmax("z"))


PREDS = """preds AS (SELECT row_id, y, z, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS y_hat
                  FROM logits)"""
PROBS = """probs AS (SELECT row_id, y, y_hat,
                   list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM preds),
probs2 AS (SELECT row_id, y, y_hat, list_transform(e, lambda x: x / list_reduce(e, lambda a, b: a + b)) AS p
           FROM probs),
ent AS (SELECT row_id, y, y_hat, p,
               -list_reduce(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END),
                            lambda a, b: a + b) AS entropy,
               list_max(p) AS top1 FROM probs2)"""
COUNTS = """cc AS (SELECT label, sum(tp) AS tp, sum(t) AS n_true, sum(p) AS n_pred FROM (
    SELECT y AS label, CAST(y = y_hat AS BIGINT) AS tp, 1 AS t, 0 AS p FROM preds
    UNION ALL SELECT y_hat, 0, 0, 1 FROM preds) GROUP BY label),
pc AS (SELECT label, tp, n_true, n_pred,
    CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / n_pred ELSE 0.0 END AS precision,
    CASE WHEN n_true > 0 THEN CAST(tp AS DOUBLE) / n_true ELSE 0.0 END AS recall,
    CASE WHEN n_true + n_pred > 0 THEN 2.0::DOUBLE * tp / (n_true + n_pred) ELSE 0.0 END AS f1 FROM cc),
summ AS (SELECT CAST(sum(tp) AS DOUBLE) / sum(n_true) AS accuracy,
    avg(CASE WHEN n_true > 0 THEN recall END) AS balanced_accuracy,
    avg(f1) AS f1_macro, avg(precision) AS precision_macro, avg(recall) AS recall_macro,
    sum(f1 * n_true) / sum(n_true) AS f1_weighted FROM pc)"""


def _q(body: str, *extra: str) -> str:
    ctes = ",\n".join((PREDS,) + extra)
    return with_views("logits", f"WITH {ctes}\n{body}")


@register("o02_argmax", _q("SELECT row_id, y_hat FROM preds"))
def o02_argmax(spark, sf_dir):
    return preds(spark, sf_dir).select("row_id", "y_hat")


def _probs(spark, sf_dir):
    p = preds(spark, sf_dir).withColumn("p", N.softmax("z"))
    return p.withColumn("entropy", N.entropy("p")).withColumn("top1", N.top1("p"))


@register("f15_softmax", _q(f"SELECT row_id, CAST(k AS INTEGER) AS k, {r6('p[k + 1]')} AS p FROM ent, "
                            "LATERAL (SELECT unnest(range(0, len(p))) AS k)", PROBS))
def f15_softmax(spark, sf_dir):
    p = _probs(spark, sf_dir).select("row_id", F.posexplode("p").alias("k", "p"))
    return round_cols(p.select("row_id", F.col("k").cast("int").alias("k"), "p"), ["p"])


@register("f16_entropy", _q(f"SELECT row_id, {r6('entropy')} AS entropy FROM ent", PROBS))
def f16_entropy(spark, sf_dir):
    return round_cols(_probs(spark, sf_dir).select("row_id", "entropy"), ["entropy"])


@register("o03_top1", _q(f"SELECT row_id, {r6('top1')} AS top1 FROM ent", PROBS))
def o03_top1(spark, sf_dir):
    return round_cols(_probs(spark, sf_dir).select("row_id", "top1"), ["top1"])


def _one_metric(name: str):
    sql = _q(f"SELECT {r6(name)} AS {name} FROM summ", COUNTS)

    def fn(spark, sf_dir):
        return round_cols(X.summary(preds(spark, sf_dir)).select(name), [name])

    return sql, fn


for _qid, _m in (("a09_accuracy", "accuracy"), ("a10_balanced_accuracy", "balanced_accuracy"),
                 ("a11_macro_f1", "f1_macro"), ("a12_macro_precision", "precision_macro"),
                 ("a13_macro_recall", "recall_macro")):
    _sql, _fn = _one_metric(_m)
    _fn.__name__ = _qid
    register(_qid, _sql)(_fn)


A14_SQL = _q(f"""
SELECT CAST(label AS VARCHAR) AS row, {r6('precision')} AS precision, {r6('recall')} AS recall,
       {r6('f1')} AS f1, CAST(n_true AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, {r6('accuracy')}, (SELECT CAST(sum(n_true) AS BIGINT) FROM pc) FROM summ
UNION ALL SELECT 'macro avg', {r6('precision_macro')}, {r6('recall_macro')}, {r6('f1_macro')},
       (SELECT CAST(sum(n_true) AS BIGINT) FROM pc) FROM summ
UNION ALL SELECT 'weighted avg', {r6('sum(precision * n_true) / sum(n_true)')},
       {r6('sum(recall * n_true) / sum(n_true)')}, {r6('sum(f1 * n_true) / sum(n_true)')},
       CAST(sum(n_true) AS BIGINT) FROM pc""", COUNTS)


@register("a14_classification_report", A14_SQL)
def a14_classification_report(spark, sf_dir):
    r = X.classification_report(preds(spark, sf_dir))
    return round_cols(r, ["precision", "recall", "f1"])


A15_SQL = _q("""
SELECT a.y, b.y AS y_hat, CAST(count(p.row_id) AS BIGINT) AS n
FROM (SELECT DISTINCT y FROM preds) a CROSS JOIN (SELECT DISTINCT y FROM preds) b
LEFT JOIN preds p ON p.y = a.y AND p.y_hat = b.y
GROUP BY a.y, b.y""")


@register("a15_confusion_matrix", A15_SQL)
def a15_confusion_matrix(spark, sf_dir):
    p = preds(spark, sf_dir)
    labels = p.select(F.col("y").alias("label")).distinct()
    return X.confusion_matrix(p, labels)


@register("a17_entropy_stats", _q(f"""
SELECT {r6('avg(entropy)')} AS entropy_mean, {r6('stddev_pop(entropy)')} AS entropy_std,
       {r6('avg(top1)')} AS top1_mean, {r6('stddev_pop(top1)')} AS top1_std FROM ent""", PROBS))
def a17_entropy_stats(spark, sf_dir):
    s = X.mean_std(_probs(spark, sf_dir), ["entropy", "top1"])
    return round_cols(s, s.columns)


A18_SQL = _q(f"""
SELECT g.bin, {r6('lo + g.bin * ((hi - lo) / 30.0::DOUBLE)')} AS lo,
       {r6('lo + (g.bin + 1) * ((hi - lo) / 30.0::DOUBLE)')} AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c ON g.bin = c.bin""", PROBS, """r0 AS (SELECT min(entropy) AS lo0, max(entropy) AS hi0 FROM ent),
r AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
c AS (SELECT CAST(least(floor((entropy - lo) * 30.0::DOUBLE / (hi - lo)), 29) AS INTEGER) AS bin,
             count(*) AS n FROM ent, r WHERE entropy IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(unnest(range(0, 30)) AS INTEGER) AS bin, lo, hi FROM r)""")


@register("a18_histogram", A18_SQL)
def a18_histogram(spark, sf_dir):
    h = X.histogram(_probs(spark, sf_dir).select("entropy"), "entropy", 30)
    return round_cols(h, ["lo", "hi"])


CE_SQL = """ce AS (SELECT row_id, y, list_max(z) + ln(list_reduce(list_transform(z, lambda x: exp(x - list_max(z))),
                                                        lambda a, b: a + b)) - z[y + 1] AS ce FROM preds)"""


@register("a19_focal_loss", _q(f"""
SELECT {r6('avg(pow(1.0::DOUBLE - exp(-ce), 2.0::DOUBLE) * ce)')} AS focal_loss, {r6('avg(ce)')} AS ce
FROM ce""", CE_SQL))
def a19_focal_loss(spark, sf_dir):
    f = X.focal_loss(preds(spark, sf_dir), gamma=2.0)
    return round_cols(f, f.columns)


@register("a20_weighted_ce", _q(f"""
SELECT {r6('sum(w.weight * ce.ce) / sum(w.weight)')} AS weighted_ce
FROM ce JOIN (SELECT y AS label, (SELECT count(*) FROM preds) / ((SELECT count(DISTINCT y) FROM preds) * count(*))
              AS weight FROM preds GROUP BY y) w ON ce.y = w.label""", CE_SQL))
def a20_weighted_ce(spark, sf_dir):
    p = preds(spark, sf_dir)
    w = L.class_weights(p.select(F.col("y").alias("label")), "label")
    return round_cols(X.weighted_cross_entropy(p, w), ["weighted_ce"])


N_CANDIDATES = 5


def candidates(spark, sf_dir):
    """A21 stand-in: candidate ``c`` predicts the arg-max of the ``c``-th folding of the whole vector (step = c)."""
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("y"), "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(N_CANDIDATES - 1))).alias("candidate"))
    j = emb.select("row_id", "candidate", "y", S.folded(F.col("embedding"), 10, F.col("candidate")).alias("z"))
    return j.select("row_id", "candidate", F.col("candidate").alias("step"), "y", N.argmax("z").alias("y_hat"))


A21_SQL = with_views("logits", f"""
WITH fold AS (SELECT vec_id AS row_id, label AS y, c, {folded_sql('embedding', 'c')} AS z
    FROM embeddings, (SELECT CAST(unnest(range(0, {N_CANDIDATES})) AS INTEGER) AS c)),
preds AS (SELECT row_id, y, c AS candidate, c AS step, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS y_hat
    FROM fold),
cc AS (SELECT candidate, step, label, sum(tp) AS tp, sum(t) AS n_true, sum(p) AS n_pred FROM (
    SELECT candidate, step, y AS label, CAST(y = y_hat AS BIGINT) AS tp, 1 AS t, 0 AS p FROM preds
    UNION ALL SELECT candidate, step, y_hat, 0, 0, 1 FROM preds) GROUP BY candidate, step, label),
f AS (SELECT candidate, step, avg(CASE WHEN n_true + n_pred > 0 THEN 2.0::DOUBLE * tp / (n_true + n_pred)
                                       ELSE 0.0 END) AS f1_macro FROM cc GROUP BY candidate, step)
SELECT candidate, step, {r6('f1_macro')} AS f1_macro FROM f ORDER BY f1_macro DESC, step ASC LIMIT 1""")


@register("a21_best_candidate", A21_SQL)
def a21_best_candidate(spark, sf_dir):
    return round_cols(X.best_candidate(candidates(spark, sf_dir)), ["f1_macro"])


M09_SQL = _q(f"""
SELECT ord, metric, {r6('value')} AS value FROM summ,
  (VALUES (0, 'accuracy'), (1, 'balanced_accuracy'), (2, 'f1_macro'), (3, 'precision_macro'),
          (4, 'recall_macro')) m(ord, metric),
  LATERAL (SELECT CASE metric WHEN 'accuracy' THEN accuracy WHEN 'balanced_accuracy' THEN balanced_accuracy
                  WHEN 'f1_macro' THEN f1_macro WHEN 'precision_macro' THEN precision_macro
                  ELSE recall_macro END AS value) v""", COUNTS)


@register("m09_evaluate", M09_SQL)
def m09_evaluate(spark, sf_dir):
    m = X.metrics_long(preds(spark, sf_dir)).select("ord", "metric", "value")
    return round_cols(m, ["value"])


@register("s08_metric_report", _q("""
SELECT ord, metric, printf('%s: %.4f', metric, value) AS line FROM summ,
  (VALUES (0, 'accuracy'), (1, 'balanced_accuracy'), (2, 'f1_macro'), (3, 'precision_macro'),
          (4, 'recall_macro')) m(ord, metric),
  LATERAL (SELECT CASE metric WHEN 'accuracy' THEN accuracy WHEN 'balanced_accuracy' THEN balanced_accuracy
                  WHEN 'f1_macro' THEN f1_macro WHEN 'precision_macro' THEN precision_macro
                  ELSE recall_macro END AS value) v""", COUNTS))
def s08_metric_report(spark, sf_dir):
    m = X.metrics_long(preds(spark, sf_dir))
    return m.select("ord", "metric", F.format_string("%s: %.4f", "metric", "value").alias("line"))

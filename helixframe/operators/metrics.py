"""Classification metrics as aggregates.

Everything is computed from one per-class count table
``(label, tp, n_true, n_pred)`` built by a single partial/final aggregate over
the prediction rows: the fact rows are scanned once and only ``k`` rows per
task cross the shuffle, however skewed the classes are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cross_entropy

METRIC_ORDER = ("accuracy", "balanced_accuracy", "f1_macro", "precision_macro", "recall_macro")


def class_counts(df: DataFrame, y: str = "y", y_hat: str = "y_hat",
                 group: list[str] | None = None) -> DataFrame:
    """``(*group, label, tp, n_true, n_pred)`` for every label in truth or prediction."""
    group = group or []
    # count the pairs first (k * k rows per task), then look at each pair from both sides
    pairs = df.groupBy(*group, F.col(y).alias("_y"), F.col(y_hat).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    none = F.lit(0).cast("long")
    both = pairs.select(*group, F.explode(F.array(
        F.struct(F.col("_y").alias("label"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(none).alias("tp"),
                 F.col("_n").alias("t"), none.alias("p")),
        F.struct(F.col("_p").alias("label"), none.alias("tp"), none.alias("t"), F.col("_n").alias("p")))).alias("e"))
    return both.groupBy(*group, F.col("e.label").alias("label")).agg(
        F.sum("e.tp").alias("tp"), F.sum("e.t").alias("n_true"), F.sum("e.p").alias("n_pred"))


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined ratios are 0."""
    tp, t, p = F.col("tp").cast("double"), F.col("n_true"), F.col("n_pred")
    return counts.select(
        "label",
        F.when(p > 0, tp / p).otherwise(F.lit(0.0)).alias("precision"),
        F.when(t > 0, tp / t).otherwise(F.lit(0.0)).alias("recall"),
        F.when(t + p > 0, 2.0 * tp / (t + p)).otherwise(F.lit(0.0)).alias("f1"),
        t.alias("support"), "tp", "n_pred")


def summary(df: DataFrame, y: str = "y", y_hat: str = "y_hat", group: list[str] | None = None) -> DataFrame:
    """A9-A13 (+ A14's weighted F1) from one count table, optionally per ``group``.

    * accuracy = trace / total
    * balanced accuracy = mean recall over classes present in the truth
    * macro P/R/F1 = means over classes in truth or prediction
    """
    group = group or []
    return _summarise(class_counts(df, y, y_hat, group), group)


def _summarise(counts: DataFrame, keys: list[str]) -> DataFrame:
    tp, t, p = F.col("tp").cast("double"), F.col("n_true"), F.col("n_pred")
    prec = F.when(p > 0, tp / p).otherwise(F.lit(0.0))
    rec = F.when(t > 0, tp / t).otherwise(F.lit(0.0))
    f1 = F.when(t + p > 0, 2.0 * tp / (t + p)).otherwise(F.lit(0.0))
    n = F.sum(t)
    return counts.groupBy(*keys).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg(F.when(t > 0, rec)).alias("balanced_accuracy"),
        F.avg(f1).alias("f1_macro"),
        F.avg(prec).alias("precision_macro"),
        F.avg(rec).alias("recall_macro"),
        (F.sum(f1 * t) / n).alias("f1_weighted"),
        n.cast("bigint").alias("n"))


def metrics_long(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """The five metrics as ``(ord, metric, value, line)`` rows in the report's fixed order."""
    s = summary(df, y, y_hat)
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), F.col(m).alias("value"))
                      for i, m in enumerate(METRIC_ORDER)])
    out = s.select(F.explode(pairs).alias("m")).select("m.*")
    return out.withColumn("line", F.format_string("%s: %.4f", F.initcap(F.regexp_replace(
        "metric", "_", " ")), F.col("value")))


def classification_report(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Per-class rows, then ``accuracy``, ``macro avg`` and ``weighted avg`` rows.

    Columns ``(row, precision, recall, f1, support)``; the accuracy row carries
    only f1 (= accuracy) and support (= total), as the text report does.
    """
    pc = per_class(class_counts(df, y, y_hat))
    t = F.col("support").cast("double")
    classes = pc.select(F.col("label").cast("string").alias("row"), "precision", "recall", "f1",
                        F.col("support").cast("bigint").alias("support"))
    tot = pc.agg(
        F.sum("tp").alias("_tp"), F.sum("support").alias("_n"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        (F.sum(F.col("precision") * t) / F.sum(t)).alias("_wp"),
        (F.sum(F.col("recall") * t) / F.sum(t)).alias("_wr"),
        (F.sum(F.col("f1") * t) / F.sum(t)).alias("_wf"))
    rows = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.col("_tp") / F.col("_n")).alias("f1"),
                 F.col("_n").cast("bigint").alias("support")),
        _report_row("macro avg", "_mp", "_mr", "_mf"),
        _report_row("weighted avg", "_wp", "_wr", "_wf"),
    )).alias("r")).select("r.*")
    return classes.unionByName(rows)


def _report_row(name: str, p: str, r: str, f: str):
    return F.struct(F.lit(name).alias("row"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                    F.col(f).alias("f1"), F.col("_n").cast("bigint").alias("support"))


def confusion_matrix(df: DataFrame, labels: DataFrame, y: str = "y", y_hat: str = "y_hat",
                     label: str = "label") -> DataFrame:
    """A15 (long form): one row per ``(y, y_hat)`` over ``labels x labels``, zero cells included.

    Pairs outside the label list are ignored. ``labels`` is the (small) label dimension.
    """
    counts = df.groupBy(F.col(y).alias("y"), F.col(y_hat).alias("y_hat")).agg(F.count(F.lit(1)).alias("n"))
    grid = labels.select(F.col(label).alias("y")).crossJoin(labels.select(F.col(label).alias("y_hat")))
    return grid.join(counts, ["y", "y_hat"], "left").select(
        "y", "y_hat", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def attack_success_rate(df: DataFrame, y: str = "y", y_orig: str = "y_orig", y_atk: str = "y_atk",
                        group: list[str] | None = None) -> DataFrame:
    """Among rows the model got right, the share the attack turned wrong (0.0 if none were right)."""
    right = F.col(y) == F.col(y_orig)
    flipped = right & (F.col(y) != F.col(y_atk))
    return df.groupBy(*(group or [])).agg(F.coalesce(
        F.try_divide(F.count_if(flipped).cast("double"), F.count_if(right).cast("double")),
        F.lit(0.0)).alias("success_rate"))


def mean_std(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and *population* standard deviation of each column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.agg(*aggs)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over ``[min, max]``, last bin closed, every bin listed.

    A zero range is widened by 0.5 on both sides. Bin edges come from a one-row
    aggregate (broadcast: a proven bound); counting is a partial/final aggregate.
    """
    rng = df.agg(F.min(col).alias("_lo0"), F.max(col).alias("_hi0")).select(
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    v = F.col(col)
    b = F.least(F.floor((v - F.col("_lo")) * F.lit(float(bins)) / (F.col("_hi") - F.col("_lo"))),
                F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).crossJoin(F.broadcast(rng)).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = rng.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("_lo") + F.col("bin") * w).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * w).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def focal_loss(df: DataFrame, z: str = "z", y: str = "y", gamma: float = 2.0) -> DataFrame:
    """Mean of ``(1 - exp(-ce))**gamma * ce``."""
    ce = cross_entropy(z, y)
    return df.select(ce.alias("_ce")).agg(
        F.avg(F.pow(1.0 - F.exp(-F.col("_ce")), F.lit(gamma)) * F.col("_ce")).alias("focal_loss"),
        F.avg("_ce").alias("ce"))


def weighted_cross_entropy(df: DataFrame, weights: DataFrame, z: str = "z", y: str = "y",
                           label: str = "label") -> DataFrame:
    """``sum(w_y * ce) / sum(w_y)`` with per-class weights (e.g. from A7)."""
    w = weights.select(F.col(label).alias("_wl"), F.col("weight").alias("_w"))
    j = df.join(w, df[y] == F.col("_wl"), "left")
    ce = cross_entropy(z, y)
    return j.agg((F.sum(F.col("_w") * ce) / F.sum("_w")).alias("weighted_ce"))


def best_candidate(preds: DataFrame, candidate: str = "candidate", step: str = "step",
                   y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """The candidate with the best macro F1; the earliest step wins ties."""
    s = summary(preds, y, y_hat, group=[candidate, step])
    best = s.agg(F.max_by(F.struct(candidate, step, "f1_macro"),
                          F.struct(F.col("f1_macro"), -F.col(step))).alias("b"))
    return best.select("b.*")

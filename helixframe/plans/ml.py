"""Spark ML plans: split, assemble, tree models, sequence classifier, persistence.

Models are fitted by Spark ML's distributed trainers; class balance enters as
a ``weightCol`` built from the A7/A8 aggregates, never by resampling rows.
"""

from __future__ import annotations

import math
import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators.tokens import kmer_numbers
from ..operators.tries import RUN, runs
from ..session import ensure_checkpoint_dir


def hash_unit(key: Column, seed: int = 42) -> Column:
    """A uniform draw in ``[0, 2**32)`` from the md5 of ``seed:key`` (partition independent)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def split(df: DataFrame, key: str = "row_id", test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """M1: seeded, non-stratified train/test tag by an md5 threshold (same rows on any partitioning)."""
    thr = int(round(test_fraction * 2 ** 32))
    return df.withColumn("split", F.when(hash_unit(F.col(key), seed) < F.lit(thr), F.lit("test"))
                         .otherwise(F.lit("train")))


def split_exact(df: DataFrame, key: str = "row_id", test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """M1, exact size: the ``ceil(test_fraction * n)`` rows with the smallest ``(hash, key)`` are test.

    Rows are counted per value of the hash's upper half (partial/final aggregate, 65,536 counts at most); a running
    sum finds the half in which the boundary falls, and the same is done with the lower halves inside it. So the boundary
    is one hash value; only the rows that have it (an n-th of 2**32) are ranked by key.
    """
    d = df.withColumn("_h", hash_unit(F.col(key), seed))
    total = d.count()
    need, inside = math.ceil(Fraction(str(test_fraction)) * total), d
    edge = 0
    for shift in (16, 0):
        part = F.shiftright(F.col("_h"), shift)
        counts = inside.groupBy(part.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = counts.withColumn("_upto", upto).where(F.col("_upto") >= need).orderBy("_b").select(
            "_b", (F.col("_upto") - F.col("_n")).alias("_before")).first()
        if not total or not need or found is None:
            return df.withColumn("split", F.lit("train"))
        edge, need = found["_b"], need - found["_before"]
        inside = inside.where(part == edge)
    cols = df.columns + ["split"]
    rank = F.row_number().over(Window.partitionBy("_h").orderBy(key))
    ranked = d.where(F.col("_h") == edge).withColumn("split", F.when(rank <= need, "test").otherwise("train"))
    rest = d.where(F.col("_h") != edge).withColumn("split", F.when(F.col("_h") < edge, "test").otherwise("train"))
    return rest.select(*cols).unionByName(ranked.select(*cols))


def assemble(features: list[str], out: str = "features") -> VectorAssembler:
    """M2: numeric features (P1 order) -> one vector column."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """A7 weights joined back as a ``weightCol`` (the label dimension is small: broadcast)."""
    w = L.class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")


def positive_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """M4: ``scale_pos_weight`` = negatives / positives on the positive rows, 1 elsewhere."""
    ratio = L.neg_pos_ratio(df, label)
    j = df.crossJoin(F.broadcast(ratio))  # one row
    return j.withColumn(out, F.when(F.col(label) == 1, F.coalesce("ratio", F.lit(1.0))).otherwise(F.lit(1.0))) \
        .drop("ratio")


def random_forest(features: list[str], label: str = "label", weight: str = "weight", max_bins: int = 64,
                  seed: int = 42) -> Pipeline:
    """M3: 100 trees, balanced class weights, seeded."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol=weight, numTrees=100,
                                maxBins=max_bins, seed=seed)
    return Pipeline(stages=[assemble(features), rf])


def gradient_boosting(features: list[str], label: str = "label", weight: str = "weight", max_bins: int = 64,
                      seed: int = 42) -> Pipeline:
    """M4: logistic-loss boosted trees with the positive-class weight."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol=weight, maxBins=max_bins, seed=seed)
    return Pipeline(stages=[assemble(features), gbt])


def _tree_sql(node, features: list[str], leaf) -> str:
    """One tree as nested SQL conditions on the feature columns; ``leaf`` gives a leaf's text."""
    if node.subtreeDepth() == 0:
        return leaf(node)
    split = node.split()
    return (f"CASE WHEN `{features[split.featureIndex()]}` <= {split.threshold()!r}D "
            f"THEN {_tree_sql(node.leftChild(), features, leaf)} ELSE {_tree_sql(node.rightChild(), features, leaf)} END")


def ensemble_expression(model: PipelineModel, features: list[str]) -> Column:
    """The prediction of a fitted binary forest or boosted ensemble as a column expression over the feature columns.

    A forest adds up each tree's share of class 1 in the leaf (ties go to class 0); boosting the weighted leaf values.
    The text grows with the model (100 trees of at most 31 splits), not with the data. Features are continuous (the
    assembler attaches no categories) and not missing.
    """
    ensemble = model.stages[-1]

    def share(node) -> str:
        counts = list(node.impurityStats().stats())
        return f"{counts[1] / sum(counts)!r}D"

    if isinstance(ensemble, GBTClassificationModel):
        terms = [f"{w!r}D * ({_tree_sql(t._java_obj.rootNode(), features, lambda n: f'{n.prediction()!r}D')})"
                 for t, w in zip(ensemble.trees, ensemble.treeWeights, strict=True)]
        bar = 0.0
    else:
        terms = [f"({_tree_sql(t._java_obj.rootNode(), features, share)})" for t in ensemble.trees]
        bar = len(terms) / 2
    # one array folded at the end: a sum of a hundred nested conditions would be one deep expression
    total = F.aggregate(F.array(*[F.expr(t) for t in terms]), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total > bar, 1.0).otherwise(0.0)


def beside_expression(model: PipelineModel, features: list[str], rows: DataFrame) -> DataFrame:
    """``rows`` with the model's ``prediction`` and the exported expression's ``by_expression``."""
    return model.transform(rows).withColumn("by_expression", ensemble_expression(model, features))


def kmer_counts(seq: Column, k: int = 3) -> Column:
    """How often each k-mer stands in an ASCII sequence: an array by k-mer number (``tokens.kmer_numbers``), the last place
    for any k-mer with a letter other than ``ACGT``. A missing sequence has none."""
    @F.arrow_udf("array<double>")
    def counts(texts: pa.Array) -> pa.Array:
        made = [count_kmers(texts.slice(a, b - a), k) for a, b in
                runs(np.asarray(pa.compute.utf8_length(texts), dtype=np.int64), RUN)]
        size = 4 ** k + 1
        flat = np.concatenate([m.ravel() for m in made]).astype(np.float64) if made else np.zeros(0)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * size, flat)

    return counts(F.coalesce(seq, F.lit("")))


def count_kmers(texts: pa.Array, k: int) -> np.ndarray:
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets, size = offsets - offsets[0], 4 ** k + 1
    number = kmer_numbers(data, k)
    number[number < 0] = size - 1
    inside = np.ones(len(number), dtype=bool)
    for j in range(1, k):  # windows over the end of a text
        over = offsets[1:] - j
        inside[over[(over >= 0) & (over < len(number))]] = False
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(np.minimum(offsets, len(number))))
    return np.bincount((owner * size + number)[inside], minlength=len(texts) * size).reshape(len(texts), size)


def sequence_classifier(label: str = "label", weight: str = "weight", max_iter: int = 50) -> Pipeline:
    """M6: k-mer counts (every ``ACGT`` k-mer and the unknown one, ``kmer_counts`` as a vector) -> multinomial logistic
    regression. A k-mer that no training row has gets no weight."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, family="multinomial",
                            maxIter=max_iter)
    return Pipeline(stages=[lr])


def save_model(model: PipelineModel, name: str = "model") -> str:
    """Write the fitted pipeline under the shared checkpoint folder; returns its path."""
    root = ensure_checkpoint_dir(SparkSession.getActiveSession())
    path = f"{root.rstrip('/')}/helix-models/{name}-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline."""
    return PipelineModel.load(path)


def prediction_diff(a: DataFrame, b: DataFrame, key: str = "row_id", col: str = "prediction") -> DataFrame:
    """``(rows_compared, rows_different)`` of two scorings; a row that only one side has differs."""
    j = a.select(key, F.col(col).alias("_a")).join(b.select(key, F.col(col).alias("_b")), key, "full")
    return j.agg(F.count("*").alias("rows_compared"),
                 F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("rows_different"))

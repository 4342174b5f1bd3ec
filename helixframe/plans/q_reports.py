"""Reports, dictionaries and sources joined up: O1, L3, A15 by name, P2, P8, P9, S4, S8 as files, K6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching as B
from ..operators import frames as FR
from ..operators import labels as L
from ..operators import metrics as X
from ..operators import tokens as T
from ..session import materialize, shared_path
from ..sources import readers, sinks
from ..sources import standins as S
from . import q_attack as QA
from .q_metrics import COUNTS, _q as _metrics_q, preds
from .q_tokens import ENC, K, KM, MAX_LENGTH, VOCAB, _encoded
from .registry import register
from .views import with_views


def _clean(spark, sf_dir):
    """Labels' dictionary, sequences and clean predictions."""
    d = QA.dictionary(spark, sf_dir)
    s = QA.labelled_seqs(spark, sf_dir, d)
    return d, s, QA.clean_scores(s, QA.scorer(spark, d))


@register("l03_inverse_dictionary", QA._q("SELECT id, label_name FROM dict"))
def l03_inverse_dictionary(spark, sf_dir):
    """L3: id -> name."""
    return L.inverse(QA.dictionary(spark, sf_dir), "label_name", "id")


NAMED = """names AS (SELECT id, label_name FROM dict),
test AS (SELECT o.row_id, a.label_name AS y, b.label_name AS y_hat FROM orig o JOIN names a ON o.y = a.id
  JOIN names b ON o.y_orig = b.id WHERE o.split = 'test' AND o.y <> 0)"""


def _named_test(spark, sf_dir):
    """Names of truth and prediction in the test split without the first class, and the names in id order.

    The first class is left out so that a label of the dictionary is absent from the split, as the report must allow."""
    d, s, clean = _clean(spark, sf_dir)
    test = clean.join(s.where((F.col("split") == "test") & (F.col("y") != 0)).select("row_id"), "row_id", "left_semi")
    named = L.decode(test.withColumnRenamed("y_orig", "y_hat"), d, "label_name")
    return named.select("row_id", F.col("y_name").alias("y"), F.col("y_hat_name").alias("y_hat")), d


@register("o01_labels_by_id", QA._q("SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS place, label_name FROM dict"))
def o01_labels_by_id(spark, sf_dir):
    """O1: the label names in id order, as one list by place."""
    d = QA.dictionary(spark, sf_dir)
    names = d.agg(F.sort_array(F.collect_list(F.struct("id", "label_name"))).alias("l"))  # the labels: a handful
    return names.select(F.posexplode("l").alias("p", "e")).select((F.col("p") + 1).alias("place"), "e.label_name")


@register("a15_named_confusion", QA._q("""SELECT a.id AS y_place, b.id AS y_hat_place, a.label_name AS y, b.label_name AS y_hat,
  CAST(count(t.row_id) AS BIGINT) AS n
FROM names a CROSS JOIN names b LEFT JOIN test t ON t.y = a.label_name AND t.y_hat = b.label_name GROUP BY ALL""", NAMED))
def a15_named_confusion(spark, sf_dir):
    """A15 over decoded names in id order: every label of the dictionary, those absent from the split included."""
    named, d = _named_test(spark, sf_dir)
    cells = X.confusion_matrix(named, d.select(F.col("label_name").alias("label")))
    place = lambda c: d.select(F.col("label_name").alias(c), F.col("id").alias(f"{c}_place"))
    return cells.join(place("y"), "y").join(place("y_hat"), "y_hat").select("y_place", "y_hat_place", "y", "y_hat", "n")


@register("s08_report_file", _metrics_q("""SELECT metric, printf('%s: %.4f', metric, value) AS line FROM summ,
  (VALUES ('accuracy'), ('balanced_accuracy'), ('f1_macro'), ('precision_macro'), ('recall_macro')) m(metric),
  LATERAL (SELECT CASE metric WHEN 'accuracy' THEN accuracy WHEN 'balanced_accuracy' THEN balanced_accuracy
                  WHEN 'f1_macro' THEN f1_macro WHEN 'precision_macro' THEN precision_macro
                  ELSE recall_macro END AS value) v""", COUNTS))
def s08_report_file(spark, sf_dir):
    """The report written as stamped text lines, and read back."""
    path = shared_path(spark, "report")
    sinks.write_report(X.metrics_long(preds(spark, sf_dir)), path)
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(parts[0].rlike(r"^\d{8}_\d{6}$")).select(parts[1].alias("line"))
    return lines.select(F.split("line", ":")[0].alias("metric"), "line")


@register("p02_project", with_views("seqs", "SELECT split, row_id, length(dna) AS n FROM seqs"))
def p02_project(spark, sf_dir):
    """Named columns in a given order."""
    rows = S.seqs(spark, sf_dir).withColumn("n", F.length("dna").cast("bigint"))
    return FR.project(rows, ["split", "row_id", "n"])


@register("p08_keep_correct", QA._q("SELECT row_id, y FROM orig WHERE y = y_orig"))
def p08_keep_correct(spark, sf_dir):
    """Rows that the model gets right before any attack."""
    return FR.keep_correct(_clean(spark, sf_dir)[2]).select("row_id", "y")


@register("w04_correct_only", QA._q(f"""SELECT h.row_id, CAST(h.success_iteration AS INTEGER) AS success_iteration, h.y_atk
FROM hits h JOIN orig o USING (row_id) WHERE o.y = o.y_orig""", *QA.W04_CTES))
def w04_correct_only(spark, sf_dir):
    """W4 on the rows of P8 alone."""
    d, s, clean = _clean(spark, sf_dir)
    rows = s.join(clean.select("row_id", "y_orig"), "row_id")
    from ..operators.attack import first_success

    found = first_success(rows, "dna", "row_id", "y", **QA.scorer(spark, d), rate=QA.RATE, max_iter=QA.MAX_ITER,
                          seed=QA.SEED, require_correct=True, y_orig="y_orig")
    return found.select("row_id", F.col("success_iteration").cast("int").alias("success_iteration"), "y_atk")


@register("p09_no_augmentation", with_views("seqs", "SELECT row_id, split FROM seqs WHERE split = 'train'"))
def p09_no_augmentation(spark, sf_dir):
    """Augmentation switched off leaves the training rows as they are."""
    train = S.seqs(spark, sf_dir).where(F.col("split") == "train").select("row_id", "split")
    return FR.append_rows(train, None)


@register("s04_biom", with_views("otu", """
SELECT form, CAST(otu_id AS VARCHAR) AS otu_id, sample_name, CAST(abundance AS DOUBLE) AS abundance
FROM otu, (VALUES ('sparse'), ('dense')) f(form) WHERE abundance <> 0
UNION ALL SELECT form, 'axis', kind, CAST(n AS DOUBLE) FROM (SELECT 'rows' AS kind, count(DISTINCT otu_id) AS n FROM otu
  UNION ALL SELECT 'columns', count(DISTINCT sample_name) FROM otu), (VALUES ('sparse'), ('dense')) f(form)"""))
def s04_biom(spark, sf_dir):
    """The abundance table written as a sparse and as a dense BIOM text, and read back; all-zero samples stay."""
    otu = S.otu(spark, sf_dir)
    cells = materialize(otu.select("otu_id", F.col("sample_name").alias("sample_id"), "abundance"), "otu")
    frames = (cells.where("abundance <> 0"), cells.select("otu_id").distinct(), cells.select("sample_id").distinct())
    matrix = sinks.biom_matrix(*frames)
    out = None
    for form in ("sparse", "dense"):
        path = shared_path(spark, form)
        sinks.write_biom_json(*frames, path, dense=form == "dense", compression="lz4", matrix=matrix)
        triples, rows, cols = readers.read_biom_json(spark, path)
        back = triples.withColumnRenamed("sample_id", "sample_name")
        for name, axis in (("rows", rows), ("columns", cols)):
            back = back.unionByName(axis.agg(F.count("*").cast("double").alias("abundance")).select(
                F.lit("axis").alias("otu_id"), F.lit(name).alias("sample_name"), "abundance"))
        back = back.select(F.lit(form).alias("form"), "otu_id", "sample_name", "abundance")
        out = back if out is None else out.unionByName(back)
    return out


@register("k06_batch_padding", with_views("seqs", f"""WITH {KM}, {VOCAB}, {ENC},
tr AS (SELECT row_id, row_id // 32 AS batch, list_concat([2], ids[1:{MAX_LENGTH - 2}], [3]) AS ids FROM enc),
lo AS (SELECT batch, max(len(ids)) AS longest FROM tr GROUP BY batch)
SELECT row_id, CAST(batch AS BIGINT) AS batch, CAST(longest AS INTEGER) AS longest,
  array_to_string(list_concat(ids, list_transform(range(0, longest - len(ids)), lambda x: 0)), ' ') AS input_ids,
  CAST(len(ids) AS INTEGER) AS n_tokens
FROM tr JOIN lo USING (batch)"""))
def k06_batch_padding(spark, sf_dir):
    """K6: token lists padded to the longest of their batch of 32 rows."""
    e = _encoded(spark, sf_dir, MAX_LENGTH - 2).withColumn("ids", T.truncate(F.col("ids"), MAX_LENGTH))
    p = B.pad_batches(e)
    return p.select("row_id", "batch", "longest", F.array_join(F.col("ids").cast("array<string>"), " ").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"))

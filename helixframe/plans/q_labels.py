"""Label, dictionary, predicate and set queries: L1-L4, J1-J2, A5-A8, A23, P1-P8, U1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as FR
from ..operators import labels as L
from ..session import materialize
from ..sources import standins as S
from ..sources.tables import table
from .registry import register
from .sqlgen import round_cols
from .views import with_views

TRAIN_DICT_SQL = """d AS (SELECT label_name, CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INTEGER) AS id
          FROM seqs WHERE split = 'train' GROUP BY label_name)"""


def train_dictionary(spark, sf_dir):
    s = S.seqs(spark, sf_dir, parallel=False)
    return L.ids_by_first_appearance(s.where(F.col("split") == "train"), "label_name")


@register("l01_first_appearance_ids", with_views("seqs", f"WITH {TRAIN_DICT_SQL} SELECT label_name, id FROM d"))
def l01_first_appearance_ids(spark, sf_dir):
    return train_dictionary(spark, sf_dir)


@register("l02_pair_dictionary", """
WITH pairs AS (SELECT doc_id % 5 AS label, lang AS name, min(doc_id) AS f FROM documents GROUP BY 1, 2),
per_label AS (SELECT label, max_by(name, f) AS name, min(f) AS lf FROM pairs GROUP BY label)
SELECT name, max_by(label, lf) AS label FROM per_label GROUP BY name""")
def l02_pair_dictionary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), (F.col("doc_id") % 5).alias("label"), F.col("lang").alias("name"))
    return L.pair_dictionary(d, "label", "name")


@register("l04_label_encoder", with_views("meta", """
SELECT row_id,
  CAST(dense_rank() OVER (ORDER BY coalesce(env_biome, 'nan')) - 1 AS INTEGER) AS env_biome,
  CAST(dense_rank() OVER (ORDER BY coalesce(geo_loc_name, 'nan')) - 1 AS INTEGER) AS geo_loc_name
FROM meta"""))
def l04_label_encoder(spark, sf_dir):
    m = S.meta(spark, sf_dir)
    cols = L.text_columns(m, exclude=("co_occur",))
    return L.label_encode(m.select("row_id", *cols), cols)


@register("j01_label_encode_strict", with_views("seqs", f"""
WITH {TRAIN_DICT_SQL} SELECT s.row_id, s.split, d.id AS y FROM seqs s JOIN d ON s.label_name = d.label_name"""))
def j01_label_encode_strict(spark, sf_dir):
    s = S.seqs(spark, sf_dir).select("row_id", "split", "label_name")
    d = materialize(train_dictionary(spark, sf_dir), "dictionary")
    return L.encode_strict(s, d, "label_name").drop("label_name")


@register("j02_label_encode_lenient", """
WITH d AS (SELECT lang, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS id
           FROM documents WHERE source = 'src0' AND lang <> (SELECT max(lang) FROM documents) GROUP BY lang)
SELECT doc_id AS row_id, d.id AS y FROM documents LEFT JOIN d ON documents.lang = d.lang""")
def j02_label_encode_lenient(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang", "source")
    # a dictionary from one source and without the last language: labels it never saw map to null
    last = docs.agg(F.max("lang").alias("_last"))  # one row
    known = docs.where(F.col("source") == "src0").join(F.broadcast(last), F.col("lang") != F.col("_last")).drop("_last")
    d = L.ids_by_first_appearance(known, "lang")
    return L.encode_lenient(docs.select("row_id", "lang"), d, "lang").select("row_id", "y")


@register("a05_distinct_labels", with_views("seqs", """
SELECT CAST(count(DISTINCT label_name) + max(CAST(label_name IS NULL AS INTEGER)) AS BIGINT) AS n_labels
FROM seqs WHERE split = 'train'"""))
def a05_distinct_labels(spark, sf_dir):
    return L.distinct_labels(S.seqs(spark, sf_dir).where(F.col("split") == "train"), "label_name")


@register("a06_distinct_rows", with_views("seqs", """
SELECT dna, label_name, min(row_id) AS row_id FROM seqs GROUP BY dna, label_name"""))
def a06_distinct_rows(spark, sf_dir):
    return L.distinct_rows(S.seqs(spark, sf_dir).select("row_id", "dna", "label_name"))


@register("a07_class_weights", with_views("labelled", """
WITH c AS (SELECT quality AS label, count(*) AS n_c FROM labelled GROUP BY quality)
SELECT label, n_c, round((SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c), 6) + 0.0 AS weight
FROM c"""))
def a07_class_weights(spark, sf_dir):
    w = L.class_weights(S.labelled(spark, sf_dir).withColumnRenamed("quality", "label"), "label")
    return round_cols(w, ["weight"])


@register("a08_neg_pos_ratio", with_views("labelled", """
SELECT round(CAST(count(*) FILTER (WHERE quality = 0) AS DOUBLE)
             / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) + 0.0 AS ratio
FROM labelled
WHERE ('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 8))::BIGINT % 10 < 7"""))
def a08_neg_pos_ratio(spark, sf_dir):
    lab = S.labelled(spark, sf_dir)
    train = lab.where(S.split_of(F.col("row_id")) == "train")
    return round_cols(L.neg_pos_ratio(train, "quality"), ["ratio"])


@register("a23_row_counts", with_views("seqs", "SELECT split, count(*) AS n FROM seqs GROUP BY split"))
def a23_row_counts(spark, sf_dir):
    return FR.row_counts(S.seqs(spark, sf_dir), ["split"])


FEATURES = ["ph", "depth", "elevation", "env_biome", "geo_loc_name"]


@register("p01_project_features", with_views("meta", f"SELECT row_id, {', '.join(FEATURES)} FROM meta"))
def p01_project_features(spark, sf_dir):
    return FR.project(S.meta(spark, sf_dir), ["row_id"] + FEATURES)


@register("p03_exclude_sentinel", with_views("meta", """
SELECT row_id, co_occur FROM meta WHERE co_occur IS DISTINCT FROM 'not applicable'"""))
def p03_exclude_sentinel(spark, sf_dir):
    return L.exclude_sentinel(S.meta(spark, sf_dir), "co_occur").select("row_id", "co_occur")


@register("p04_to_double", with_views("meta", """
SELECT row_id, CAST(co_occur AS DOUBLE) AS co_occur FROM meta
WHERE co_occur IS DISTINCT FROM 'not applicable'"""))
def p04_to_double(spark, sf_dir):
    m = L.exclude_sentinel(S.meta(spark, sf_dir), "co_occur")
    return m.select("row_id", L.to_double("co_occur", strict=True).alias("co_occur"))


@register("p05_threshold_label", with_views("meta", """
SELECT row_id, CASE WHEN CAST(co_occur AS DOUBLE) > 0.3 THEN 1 ELSE 0 END AS label FROM meta
WHERE co_occur IS DISTINCT FROM 'not applicable'"""))
def p05_threshold_label(spark, sf_dir):
    m = L.exclude_sentinel(S.meta(spark, sf_dir), "co_occur")
    return m.select("row_id", L.threshold_label(L.to_double("co_occur")).alias("label"))


@register("p06_presence_label", with_views("meta", """
SELECT row_id, CASE WHEN co_occur IS NOT DISTINCT FROM 'not applicable' THEN 0 ELSE 1 END AS label
FROM meta"""))
def p06_presence_label(spark, sf_dir):
    return S.meta(spark, sf_dir).select("row_id", L.presence_label("co_occur").alias("label"))


@register("p07_encode_then_dropna", with_views("meta", """
SELECT row_id, ph, depth, elevation,
  CAST(dense_rank() OVER (ORDER BY coalesce(env_biome, 'nan')) - 1 AS INTEGER) AS env_biome,
  CAST(dense_rank() OVER (ORDER BY coalesce(geo_loc_name, 'nan')) - 1 AS INTEGER) AS geo_loc_name,
  CASE WHEN co_occur IS NOT DISTINCT FROM 'not applicable' THEN 0 ELSE 1 END AS label
FROM meta
QUALIFY ph IS NOT NULL AND depth IS NOT NULL AND elevation IS NOT NULL"""))
def p07_encode_then_dropna(spark, sf_dir):
    m = S.meta(spark, sf_dir).withColumn("label", L.presence_label("co_occur"))
    enc = L.label_encode(m.select("row_id", *FEATURES, "label"), ["env_biome", "geo_loc_name"])
    return L.drop_missing(enc, FEATURES + ["label"])


@register("u01_union_augmentation", with_views("seqs", """
SELECT row_id, dna, label_name FROM seqs WHERE split = 'train'
UNION ALL
SELECT (SELECT max(row_id) FROM seqs WHERE split = 'train') + 1 + item_id AS row_id,
       translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')),
                 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS dna,
       NULL AS label_name
FROM benchmark"""))
def u01_union_augmentation(spark, sf_dir):
    train = S.seqs(spark, sf_dir).where(F.col("split") == "train").select("row_id", "dna", "label_name")
    aug = table(spark, sf_dir, "benchmark").select(
        "item_id", S.text_to_dna(F.col("text")).alias("dna"))
    return FR.append_rows(train, aug, order="row_id", aug_order="item_id")

"""Token queries over ``seqs``: K1-K5 (4-mers over the whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokens as T
from ..sources import standins as S
from .registry import register
from .views import with_views

K = 4
MAX_LENGTH = 512

KM = f"""cd AS (SELECT row_id, split, string_split(dna, '') AS ch FROM seqs),
km AS (SELECT row_id, split, p, {" || ".join(f"ch[p + {j}]" for j in range(K))} AS kmer
       FROM (SELECT row_id, split, ch, unnest(range(1, len(ch) - {K - 2})) AS p FROM cd))"""
VOCAB = f"""vocab AS (SELECT kmer, CAST(row_number() OVER (ORDER BY df DESC, kmer) + 3 AS INTEGER) AS id, df
          FROM (SELECT kmer, count(DISTINCT row_id) AS df FROM km WHERE split = 'train' GROUP BY kmer))"""
ENC = """el AS (SELECT k.row_id, list(coalesce(v.id, 1) ORDER BY k.p) AS ids
         FROM km k LEFT JOIN vocab v ON k.kmer = v.kmer GROUP BY k.row_id),
enc AS (SELECT s.row_id, coalesce(el.ids, []) AS ids FROM seqs s LEFT JOIN el ON s.row_id = el.row_id)"""


def _ids_text(c):
    return F.array_join(c.cast("array<string>"), " ")


def _train_vocab(spark, sf_dir):
    s = S.seqs(spark, sf_dir)
    return T.vocabulary(s.where(F.col("split") == "train"), "dna", "row_id", K)


@register("k01_kmer_counts", with_views("seqs", f"WITH {KM} SELECT row_id, kmer, count(*) AS n FROM km GROUP BY row_id, kmer"))
def k01_kmer_counts(spark, sf_dir):
    return T.kmer_counts(S.seqs(spark, sf_dir), "dna", "row_id", K)


@register("k02_vocabulary", with_views("seqs", f"WITH {KM}, {VOCAB} SELECT kmer, id, df FROM vocab"))
def k02_vocabulary(spark, sf_dir):
    return _train_vocab(spark, sf_dir)


def _encoded(spark, sf_dir, limit=None):
    return T.encode(S.seqs(spark, sf_dir), "dna", "row_id", _train_vocab(spark, sf_dir), K, limit=limit)


@register("k03_encode", with_views("seqs", f"""WITH {KM}, {VOCAB}, {ENC}
SELECT row_id, array_to_string(ids, ' ') AS ids, CAST(len(ids) AS INTEGER) AS n_ids FROM enc"""))
def k03_encode(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("row_id", _ids_text(F.col("ids")).alias("ids"), F.size("ids").alias("n_ids"))


@register("k04_truncate", with_views("seqs", f"""WITH {KM}, {VOCAB}, {ENC}
SELECT row_id, array_to_string(list_concat([2], ids[1:{MAX_LENGTH - 2}], [3]), ' ') AS ids FROM enc"""))
def k04_truncate(spark, sf_dir):
    e = _encoded(spark, sf_dir, MAX_LENGTH - 2)
    return e.select("row_id", _ids_text(T.truncate(F.col("ids"), MAX_LENGTH)).alias("ids"))


@register("k05_pad", with_views("seqs", f"""WITH {KM}, {VOCAB}, {ENC},
tr AS (SELECT row_id, list_concat([2], ids[1:{MAX_LENGTH - 2}], [3]) AS ids FROM enc)
SELECT row_id,
  array_to_string(list_concat(ids, list_transform(range(0, {MAX_LENGTH} - len(ids)), lambda x: 0)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(range(0, len(ids)), lambda x: 1),
                              list_transform(range(0, {MAX_LENGTH} - len(ids)), lambda x: 0)), ' ') AS attention_mask
FROM tr"""))
def k05_pad(spark, sf_dir):
    e = _encoded(spark, sf_dir, MAX_LENGTH - 2)
    ids, mask = T.pad(T.truncate(F.col("ids"), MAX_LENGTH), MAX_LENGTH)
    return e.select("row_id", _ids_text(ids).alias("input_ids"), _ids_text(mask).alias("attention_mask"))

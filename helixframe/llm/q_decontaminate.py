"""op3: every document against every benchmark item."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate
from .common import table
from .registry import register

SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
             lambda w: w <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
             lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT o.doc_id, o.i, o.n, win.item FROM occ o JOIN win USING (n, k)),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit)
        GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(per.n_hit, 0) AS n_hit,
  coalesce(its.n_items, 0) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
  coalesce(per.n_hit, 0) > 0 AND 20 * coalesce(per.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register("op3_decontaminate", SQL)
def op3_decontaminate(spark, sf_dir):
    """Hits per document, with the digest of the items found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"),
                      decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))

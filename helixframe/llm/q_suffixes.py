"""op7: all documents without the long strings that stand earlier."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import suffixes
from .common import table
from .registry import register

SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 200)) AS s FROM (SELECT doc_id, x,
  unnest(range(0, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
r AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM f
  WHERE k > 1),
g AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM r),
p AS (SELECT doc_id, n, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY ALL),
q AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b
  FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE
    array_to_string(list_transform(range(1, n_spans + 2), lambda k: substr(x,
      CAST(2 * CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END + 1 AS BIGINT),
      CAST(2 * (CASE WHEN k > n_spans THEN length(x) // 2 ELSE a[k] END - CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END)
        AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""


@register("op7_suffixes", SQL)
def op7_suffixes(spark, sf_dir):
    """Bytes, removed bytes and runs of every document, and the digest of what remains."""
    got = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

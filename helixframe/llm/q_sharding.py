"""op11: all documents in eight shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sharding
from .common import table
from .registry import register

SHARDS = 8

# DuckDB has no crc32: bytes through the table, folded by list_reduce.
SQL = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) + 1 AS size,
  substr(md5(coalesce(text, '')), 1, 16) AS g, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k
  FROM documents),
o AS (SELECT *, row_number() OVER w - 1 AS i, sum(size) OVER w - size AS start,
  coalesce(lag(g) OVER w = g, false) AS cut FROM d WINDOW w AS (ORDER BY g, k ROWS UNBOUNDED PRECEDING)),
b AS (SELECT i, start, cut FROM o UNION ALL SELECT count(*), coalesce(sum(size), 0), false FROM d),
s AS (SELECT j, arg_min(i, (CASE WHEN NOT cut AND abs({SHARDS} * start - j * total) <= {sharding.TOLERANCE} * total
    THEN 0 ELSE 1 END, abs({SHARDS} * start - j * total), i)) AS first
  FROM b, (SELECT coalesce(sum(size), 0) AS total FROM d), range(1, {SHARDS}) r(j) GROUP BY j)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(x)), '..'),
    lambda b: CAST('0x' || b AS BIGINT))),
    lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1]))) AS BIGINT) AS text_crc32,
  'bytes' AS law, CAST((SELECT count(*) FROM s WHERE s.first <= o.i) AS INTEGER) AS shard,
  CAST(i - coalesce((SELECT max(first) FROM s WHERE s.first <= o.i), 0) AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM o, crc
"""


@register("op11_sharding")
def op11_sharding(spark, sf_dir):
    """Per document: size, checksum, shard and slot under the law of equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = sharding.assign(docs, SHARDS)
    return got.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

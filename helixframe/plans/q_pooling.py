"""Pooling queries: A1-A4, A22, A25 over ``otu`` / ``otu_emb`` (lineitem x embeddings)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import pooling as P
from ..sources import standins as S
from .registry import register
from .sqlgen import dbl, pivot_positions, r6
from .views import with_views

EMB_DIM = 64  # width of the driver's embedding vectors (stand-in parameter)

_EXPLODED = """e AS (SELECT sample_name, abundance, unnest(emb) AS v, generate_subscripts(emb, 1) AS i
                  FROM otu_emb)"""

A01_SQL = with_views("otu_emb", f"""
WITH {_EXPLODED},
s AS (SELECT sample_name, i, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY sample_name, i)
SELECT sample_name,
  {pivot_positions('m', EMB_DIM)}
FROM s GROUP BY sample_name""")


@register("a01_mean_pool", A01_SQL)
def a01_mean_pool(spark, sf_dir):
    pooled = P.mean_pool(S.otu_emb(spark, sf_dir), dim=EMB_DIM)
    return P.expand_vector(pooled, dim=EMB_DIM)


A02_SQL = with_views("otu_emb", f"""
WITH {_EXPLODED},
s AS (SELECT sample_name, i, sum(abundance * CAST(v AS DOUBLE)) AS s FROM e GROUP BY sample_name, i),
w AS (SELECT sample_name, sum(abundance) AS w FROM otu_emb GROUP BY sample_name HAVING sum(abundance) <> 0)
SELECT s.sample_name,
  {pivot_positions('s / w', EMB_DIM)}
FROM s JOIN w ON s.sample_name = w.sample_name GROUP BY s.sample_name""")


@register("a02_weighted_pool", A02_SQL)
def a02_weighted_pool(spark, sf_dir):
    pooled = P.weighted_mean_pool(S.otu_emb(spark, sf_dir), dim=EMB_DIM)
    return P.expand_vector(pooled, dim=EMB_DIM)


def _a03_sql() -> str:
    q = P.query_vector(EMB_DIM, 0)
    dot = "(" + " + ".join(["0.0"] + [f"CAST(emb[{i + 1}] AS DOUBLE) * {dbl(q[i])}"
                                      for i in range(EMB_DIM)]) + ")"
    return with_views("otu_emb", f"""
WITH b AS (SELECT sample_name, emb, CAST(trunc(abundance) AS INTEGER) AS m,
                  {dot} / {dbl(math.sqrt(EMB_DIM))} AS s
           FROM otu_emb WHERE CAST(trunc(abundance) AS INTEGER) > 0),
t AS (SELECT sample_name, max(s) AS top FROM b GROUP BY sample_name),
bw AS (SELECT b.sample_name, b.emb, b.m * exp(b.s - t.top) AS ww FROM b JOIN t USING (sample_name)),
e AS (SELECT sample_name, ww, unnest(emb) AS v, generate_subscripts(emb, 1) AS i FROM bw),
s AS (SELECT sample_name, i, sum(ww * CAST(v AS DOUBLE)) AS s FROM e GROUP BY sample_name, i),
w AS (SELECT sample_name, sum(ww) AS w FROM bw GROUP BY sample_name)
SELECT s.sample_name,
  {pivot_positions('s / w', EMB_DIM)}
FROM s JOIN w ON s.sample_name = w.sample_name GROUP BY s.sample_name""")


@register("a03_attention_pool", _a03_sql())
def a03_attention_pool(spark, sf_dir):
    pooled = P.attention_pool(S.otu_emb(spark, sf_dir), dim=EMB_DIM)
    return P.expand_vector(pooled, dim=EMB_DIM)


WIDE = 768  # the reference's width: the 64 values twelve times over, each repeat scaled by its number
_WIDE_SQL = """wide AS (SELECT sample_name, abundance, (j - 1) * 64 + i AS i, CAST(v AS DOUBLE) * j AS v
  FROM (SELECT sample_name, abundance, unnest(emb) AS v, generate_subscripts(emb, 1) AS i FROM otu_emb),
       (SELECT unnest(range(1, 13)) AS j))"""


def wide(spark, sf_dir):
    def scaled(j: int):
        return F.transform("emb", lambda x: x.cast("double") * F.lit(float(j)))

    # rows of a sample stand together before they are widened, so a task's sums are few; a range of (sample, OTU) may
    # end inside a large sample
    rows = S.otu_emb(spark, sf_dir).repartitionByRange("sample_name", "otu_id").sortWithinPartitions("sample_name")
    return rows.withColumn("emb", F.concat(*(scaled(j) for j in range(1, WIDE // EMB_DIM + 1))))


@register("a01_wide", with_views("otu_emb", f"""
WITH {_WIDE_SQL}, s AS (SELECT sample_name, i, avg(v) AS m FROM wide GROUP BY sample_name, i)
SELECT sample_name, CAST(i - 1 AS INTEGER) AS pos, {r6('m')} AS v FROM s"""))
def a01_wide(spark, sf_dir):
    return _long(P.mean_pool(wide(spark, sf_dir), dim=WIDE))


@register("a02_wide", with_views("otu_emb", f"""
WITH {_WIDE_SQL}, s AS (SELECT sample_name, i, sum(abundance * v) / sum(abundance) AS m FROM wide
  GROUP BY sample_name, i HAVING sum(abundance) <> 0)
SELECT sample_name, CAST(i - 1 AS INTEGER) AS pos, {r6('m')} AS v FROM s"""))
def a02_wide(spark, sf_dir):
    return _long(P.weighted_mean_pool(wide(spark, sf_dir), dim=WIDE))


def _long(pooled):
    rows = pooled.select("sample_name", F.posexplode("emb").alias("pos", "v"))
    return rows.select("sample_name", "pos", (F.round("v", 6) + F.lit(0.0)).alias("v"))


def _a03_heads_sql(heads: int) -> str:
    parts = []
    for h in range(heads):
        q = P.query_vector(EMB_DIM, h)
        dot = "(" + " + ".join(["0.0"] + [f"CAST(emb[{i + 1}] AS DOUBLE) * {dbl(q[i])}" for i in range(EMB_DIM)]) + ")"
        parts.append(f"SELECT sample_name, emb, CAST(trunc(abundance) AS INTEGER) AS m, {h} AS h, "
                     f"{dot} / {dbl(math.sqrt(EMB_DIM))} AS s FROM otu_emb WHERE CAST(trunc(abundance) AS INTEGER) > 0")
    return with_views("otu_emb", f"""
WITH b AS ({' UNION ALL '.join(parts)}),
w AS (SELECT *, m * exp(s - max(s) OVER (PARTITION BY sample_name, h)) AS ww FROM b),
e AS (SELECT sample_name, h, ww, unnest(emb) AS v, generate_subscripts(emb, 1) AS i FROM w)
SELECT sample_name, CAST(h * {EMB_DIM} + i - 1 AS INTEGER) AS pos, {r6('sum(ww * CAST(v AS DOUBLE)) / sum(ww)')} AS v
FROM e GROUP BY sample_name, h, i""")


@register("a03_heads", _a03_heads_sql(3))
def a03_heads(spark, sf_dir):
    return _long(P.attention_pool(S.otu_emb(spark, sf_dir), dim=EMB_DIM, heads=3))


A04_SQL = with_views("otu", """
SELECT sample_name, otu_id, CAST(c.copy AS BIGINT) AS copy
FROM otu, LATERAL (SELECT unnest(range(0, greatest(CAST(trunc(abundance) AS INTEGER), 0))) AS copy) c""")


@register("a04_repeat_rows", A04_SQL)
def a04_repeat_rows(spark, sf_dir):
    r = P.repeat_rows(S.otu(spark, sf_dir).select("sample_name", "otu_id", "abundance"))
    return r.select("sample_name", "otu_id", F.col("copy").cast("bigint").alias("copy"))


A22_SQL = with_views("otu", """
SELECT count(DISTINCT otu_id) AS n_rows, count(DISTINCT sample_name) AS n_cols FROM otu""")


@register("a22_matrix_shape", A22_SQL)
def a22_matrix_shape(spark, sf_dir):
    return P.matrix_shape(S.otu(spark, sf_dir))


A25_SQL = with_views("otu", """
SELECT ids.otu_id, coalesce(c.abundance, 0.0) AS abundance
FROM (SELECT DISTINCT otu_id FROM otu) ids
LEFT JOIN (SELECT otu_id, sum(abundance) AS abundance FROM otu WHERE sample_name = 'S1' GROUP BY otu_id) c
  ON ids.otu_id = c.otu_id""")


@register("a25_sample_profile", A25_SQL)
def a25_sample_profile(spark, sf_dir):
    return P.sample_profile(S.otu(spark, sf_dir), "S1")

"""A1, A2 of wide vectors: numpy partial sums equal the sums of single positions."""

import math

from pyspark.sql import functions as F

from helixframe.operators import pooling as P


def test_f4_f10_wide_sums(spark, monkeypatch):
    monkeypatch.setattr(P, "WIDE_RUN", 400)  # runs of three rows
    dim, rows = 130, []
    for i in range(40):
        v = [float((i * 7 + j) % 11 - 5) for j in range(dim)]
        if i == 8:
            v[3] = None
        if i == 9:
            v[4] = math.nan
        rows.append((None if i % 9 == 0 else f"s{i % 4}", None if i % 5 == 1 else float(i % 3), v))
    rows += [("none", None, [1.0] * dim), ("zero", 0.0, [1.0] * dim)]
    df = spark.createDataFrame(rows, "sample_name string, abundance double, emb array<double>").repartition(3)
    for pool, weight in ((P.mean_pool, lambda r: 1.0), (P.weighted_mean_pool, lambda r: r[1])):
        want = {}
        for name in {r[0] for r in rows}:
            own = [(weight(r), r[2]) for r in rows if r[0] == name and weight(r) is not None]
            total = sum(w for w, _ in own)
            if total:
                cells = [[w * (math.nan if v[j] is None else v[j]) for w, v in own] for j in range(dim)]
                want[name] = [None if math.isnan(sum(c)) else round(sum(c) / total, 9) for c in cells]
        pooled = pool(df, dim=dim)
        got = {r.sample_name: [None if x is None else round(x, 9) for x in r.emb] for r in pooled.collect()}
        assert got == want
        assert "MapInArrow" in pooled._jdf.queryExecution().toString()
    assert pooled.where(F.col("sample_name") == "none").isEmpty()

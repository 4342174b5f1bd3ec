"""Histogram selection against a full sort."""

import math
import random

from helixframe.llm import topk


def brute(rows, queries, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: v for i, v in reversed([r for r in fine if r[0] in queries])}.items()):
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def run(spark, rows, k=10, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = df.where("vec_id % 100 = 0")
    got = topk.search(df, q, k=k, **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_random_vectors_many_ties_and_bad_rows(spark):
    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(-1, 1), 3) for _ in range(6)]) for i in range(1, 320)]
    rows = [(i, [float.fromhex((x).hex()) for x in v]) for i, v in rows]
    same = [0.5, 0.25, -0.5, 1.0, 0.0, 0.125]
    rows += [(i, same) for i in range(1000, 1300)]  # one vector in very many rows
    rows += [(2000, None), (2100, [float("nan")] * 6), (2200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, same),
             (2300, [float("inf")] * 6), (5, same)]
    import numpy as np

    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    queries = {i for i, _ in rows if i is not None and i % 100 == 0}
    expected = brute(rows, queries, 10)
    assert run(spark, rows) == expected
    assert run(spark, rows, query_block=2) == expected


def test_few_candidates_and_no_rows(spark):
    rows = [(100, [1.0, 0.0]), (1, [0.5, 0.5]), (200, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, {100, 200}, 10)
    assert run(spark, [(100, [1.0])]) == []
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [2e6, 1.0]), (2, [2e6, 1.0009765625]), (3, [-5.0, 2.0])]
    assert run(spark, rows, k=3) == brute(rows, {0}, 3)


def test_unequal_lengths_end_in_zeros(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0]), (2, [1.0, 1.0, 5.0])]
    assert [(v, s) for _, _, v, s in run(spark, rows)] == [(2, 2 * 1024 * 1024), (1, 1024 * 1024)]


def test_five_blocks_leave_one_scan(spark, capsys):
    rows = [(i, [((i * 37) % 101) / 100, ((i * 53) % 89) / 100]) for i in range(1, 900)]
    queries = {i for i, _ in rows if i % 100 == 0}
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.search(df, df.where("vec_id % 100 = 0"), k=3, query_block=2)
    out.explain()
    plan = capsys.readouterr().out
    assert "Union" not in plan and "MapInArrow" not in plan and plan.count("FileScan") == 1
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == brute(rows, queries, 3)


def test_huge_components_and_saturated_sums(spark):
    rows = [(100, [1e306, 1.0]), (1, [1e306, 0.0]), (2, [-1e306, 0.0]), (3, [0.0, 5.0]), (4, [1e200, 2.0]), (200, [0.0, 1.0]),
            *[(10 + i, [-1e300, float(i)]) for i in range(5)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in topk.search(df, df.where("vec_id % 100 = 0"), k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    top, low = 2 ** 63 - 1, -2 ** 63
    assert sorted(got[100])[:2] == [(1, 1, top), (2, 4, top)] and sorted(got[100])[2][1] == 3
    assert sorted(got[200]) == [(1, 3, 5 * 2 ** 20), (2, 14, 4 * 2 ** 20), (3, 13, 3 * 2 ** 20)]
    worst = topk.search(df, df.where("vec_id = 100"), k=10).orderBy("rank").collect()[-1]
    assert worst.score == low and len(got) == 2

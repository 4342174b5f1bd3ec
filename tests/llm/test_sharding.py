"""Sharding: the rule by a full sort, groups of copies, equal rows, and the plan."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import sharding
from helixframe.llm.q_sharding import op11_sharding


def brute(rows, n, tolerance=sharding.TOLERANCE):
    """(key, text) -> sorted list of (size, shard, slot)."""
    def digits(v):
        return hashlib.md5(("" if v is None else str(v)).encode()).hexdigest()[:16]

    order = sorted(((digits(t), digits(k)), k, t) for k, t in [(str(k) if k is not None else "", t or "") for k, t in rows])
    sizes = [len(t.encode()) + 1 for _, _, t in order]
    before = [0]
    for s in sizes:
        before.append(before[-1] + s)
    total = before[-1]
    cut = [i > 0 and i < len(order) and order[i][0][0] == order[i - 1][0][0] for i in range(len(order) + 1)]
    starts = [0]
    for j in range(1, n):
        off = [abs(n * b - j * total) for b in before]
        starts.append(min((0 if not cut[i] and off[i] <= tolerance * total else 1, off[i], i)
                          for i in range(len(before)))[2])
    out = []
    for i, (_, k, t) in enumerate(order):
        shard = sum(s <= i for s in starts[1:])
        out.append((k, t, sizes[i], shard, i - starts[shard]))
    return sorted(out)


def run(spark, rows, n, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.assign(df, n, **options).collect()
    return sorted(("" if r.doc_id is None else str(r.doc_id), r.text or "", r.size, r.shard, r.slot) for r in got)


def corpus(seed, n=600):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("aé漢 \n") for _ in range(rng.randint(0, 80)))) for i in range(n)]
    rows += [(10_000 + i, "a hot text of many copies") for i in range(n // 2)]  # a third of all rows
    rows += [(20_000 + i, f"copy {i % 7}" * 9) for i in range(60)]
    rows += [(30_000, "x" * 3000), (30_001, "y" * 9000), (None, "no key"), (30_002, None), (30_003, ""), (-4, "below")]
    return rows


@pytest.mark.parametrize(("seed", "n", "tolerance"), [(1, 8, 0.005), (2, 3, 0.05), (3, 8, 0.2)])
def test_against_a_full_sort(spark, seed, n, tolerance):
    rows = corpus(seed)
    assert run(spark, rows, n, tolerance=tolerance) == brute(rows, n, tolerance)


def test_equal_rows_are_cut_by_count(spark):
    rows = [(5, "the same row " * 3)] * 500 + [(i, "other") for i in range(20)]
    assert run(spark, rows, 8) == brute(rows, 8)
    rows = [(i, "one text only") for i in range(300)]
    assert run(spark, rows, 8) == brute(rows, 8)


def test_balance_slots_and_groups(spark):
    rows = corpus(4, 3000)
    got = run(spark, rows, 8)
    shards = {s: sorted(r[4] for r in got if r[3] == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) and slots for slots in shards.values())
    size = [sum(r[2] for r in got if r[3] == s) for s in range(8)]
    assert max(size) - min(size) < 0.03 * sum(size) / 8 + 9001
    of = {}
    for r in got:
        of.setdefault(r[1], set()).add(r[3])
    assert sum(len(s) > 1 for t, s in of.items() if t != "a hot text of many copies") == 0


def test_few_rows_empty_table_and_clashing_columns(spark):
    assert run(spark, [(1, "a"), (2, "b")], 8) == brute([(1, "a"), (2, "b")], 8)
    df = spark.createDataFrame([(1, "a", "p", "c", 3, "s")], "place long, text string, cell string, before string,"
                               " shard int, own string")
    out = sharding.assign(df, 4, key="place")
    assert out.columns == ["place", "text", "cell", "before", "own", "size", "shard", "slot"]
    assert tuple(out.first())[:6] == (1, "a", "p", "c", "s", 2)
    empty = sharding.assign(df.limit(0), 4, key="place")
    assert empty.columns == out.columns and empty.count() == 0


def test_one_exchange_of_texts_without_python(spark, capsys):
    op11_sharding(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    # the rows move once, dealt by cell; the only other exchange is that of the leaves' few rows
    assert plan.count("Exchange hashpartitioning(cell") == 1


def test_written_shards(spark, tmp_path):
    rows = corpus(6, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write(sharding.assign(df, 4), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    counts = {r.shard: (r.n, r.top) for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"))
              .collect()}
    assert sum(n for n, _ in counts.values()) == len(rows) and all(n == top + 1 for n, top in counts.values())

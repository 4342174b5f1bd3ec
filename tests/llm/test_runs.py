"""Periodic runs: every interval by definition, the grammar itself, the query's planted texts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from helixframe.llm import runs
from helixframe.llm.q_runs import lines, planted


def brute(x, shortest=6, exponent=4):
    """Every run of one sequence: maximal stretches of x[i] == x[i + q] for each q, smallest period of each interval."""
    found = {}
    for q in range(1, len(x) // exponent + 1):
        same = [x[i] == x[i + q] for i in range(len(x) - q)]
        i = 0
        while i < len(same):
            if same[i]:
                j = i
                while j < len(same) and same[j]:
                    j += 1
                if j - i + q >= max(shortest, exponent * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e, q) for (s, e), q in found.items())


def sequences(seed, n=150):
    rng = random.Random(seed)
    out = [[], [1], [1] * 5, [1] * 6, [1] * 257, [1, 2] * 40, ([1, 2] * 4 + [3]) * 9, [1, 1, 2] * 30 + [1, 1] * 9]
    thue = [0]
    while len(thue) < 300:
        thue += [1 - v for v in thue]
    out.append(thue)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    out.append(fib[-1])
    while len(out) < n:
        x = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            unit = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randint(1, 12))]
            tail = unit * rng.randint(1, 9)
            at = rng.randint(0, len(x))
            x = x[:at] + tail + unit[:rng.randint(0, len(unit))] + x[at:]
        out.append(x)
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 20), (2, 7), (3, 100)])
def test_every_run_of_a_batch(monkeypatch, seed, block):
    monkeypatch.setattr(runs, "_BLOCK", block)
    many = sequences(seed)
    bounds = np.cumsum([0] + [len(x) for x in many])
    got = runs.find(np.array([v for x in many for v in x], dtype=np.int64), bounds)
    expected = [(s + b, e + b, q) for b, x in zip(bounds, many) for s, e, q in brute(x)]
    assert sorted(zip(*got.tolist())) == sorted(expected)


def test_grammar_derives_its_sequences():
    many = sequences(5)
    x = np.array([v for y in many for v in y], dtype=np.int64)
    bounds = np.cumsum([0] + [len(y) for y in many])
    g = runs.Grammar(x, bounds)
    for node, place in zip(g.node.tolist(), g.place.tolist()):
        size = g.end[node] - g.first[node]
        assert (x[place:place + size] == x[g.first[node]:g.end[node]]).all()
    doc = np.searchsorted(bounds, g.place, side="right")
    assert (doc == np.searchsorted(bounds, g.place + (g.end - g.first)[g.node] - 1, side="right")).all()
    derived = {(p, p + int((g.end - g.first)[k])) for k, p in zip(g.node.tolist(), g.place.tolist())}
    assert all((a, b) in derived for a, b in zip(bounds.tolist(), bounds.tolist()[1:]) if b - a > 1)  # one root each
    assert len(g.first) < len(g.place)  # shared nonterminals


def test_long_periodic_text_is_fast_and_exact():
    unit = list(range(1000))
    x = np.array([7] * 50_000 + unit * 40, dtype=np.int64)
    assert runs.find(x, np.array([0, len(x)])).T.tolist() == [[0, 50_000, 1], [50_000, 90_000, 1000]]


def plain(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if key is not None:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted((s, e - s, q) for s, e, q in brute(w))
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    text = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = " ".join(v for i, v in enumerate(w) if i not in gone)
    return (key, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_against_a_plain_version(spark, tmp_path):
    from helixframe.llm.queries import QUERIES

    rng = random.Random(9)
    rows = []
    for i, x in enumerate(sequences(7, 120)):
        gaps = [rng.choice([" ", "\n", "\t ", "\x0b", "\x0c\r", "  "]) for _ in x]
        rows.append((i, rng.choice(["", " "]) + "".join(f"wö{v}{gap}" for v, gap in zip(x, gaps)), "x"))
    rows += [(1000 + i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 90))), "x") for i in range(60)]
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, " \n ", "x"), (None, "a " * 9, "x"), (3, rows[3][1], "x"),
             (2003, "a b a b " * 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain(*r[:2]) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in got) > 60


def test_general_interface_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", "own", 5)], "doc_id long, text string, runs string, best int")
    row = runs.detect(df).select("doc_id", "n_words", "n_runs", lines().alias("l"), "collapsed").first()
    assert tuple(row) == (1, 9, 1, "0,8,2\n", "a b c")
    assert runs.detect(df.limit(0)).count() == 0
    assert planted(df).columns == df.columns

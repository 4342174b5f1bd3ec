"""Fill-in-the-middle: the rank index, a plain version of the whole, exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from helixframe.llm import fim


def brute(key, text):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(lines)
    d = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return key, n, "plain", None, None, t
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    if h[3] % 100 < 50:
        return key, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return key, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def corpus():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "é", "\n", "漢", "<", "S>", " ", "\r", " ", "𝄞"])
                        for _ in range(rng.randint(0, 120)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "\n"), (303, "\n\n\n"), (304, "x"), (305, "a<M>b\nc"), (306, "<P\n>"),
             (307, "<\nP>\n<S\n>"), (None, "a\nb\nc"), (308, "w" * 50_000 + "\n" + "v\n" * 20_000), (309, "same\nrow"),
             (309, "same\nrow"), (-5, "a\nb"), (310, "<S\n>\n<\nM>")]
    return rows


def order(rows):
    return sorted(rows, key=repr)


def test_against_a_plain_version_and_back(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], "doc_id long, text string, form string, extra int")
    made = fim.transform(df.repartition(3))
    assert made.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text",
                      fim.restore().alias("back")).collect()
    assert order(tuple(r)[:6] for r in got) == order(brute(*r) for r in rows)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rate_and_seed(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\nd\n") for i in range(400)], "doc_id long, text string")
    forms = [r.form for r in fim.transform(df, rate=30, spm=0).collect()]
    assert 60 < sum(f == "psm" for f in forms) < 180 and "spm" not in forms
    one = [r.output for r in fim.transform(df, seed=1).orderBy("doc_id").collect()]
    assert one == [r.output for r in fim.transform(df.repartition(5), seed=1).orderBy("doc_id").collect()]
    assert one != [r.output for r in fim.transform(df, seed=2).orderBy("doc_id").collect()]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(df).count() == 0


@pytest.mark.parametrize("error", [0, 1, 7, 100, 5000])
def test_rank_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(error)
    lists = [[0], [0, 5], np.arange(0, 3000, 3), np.cumsum(rng.integers(1, 4000, 3000)),
             np.cumsum(np.r_[np.ones(1000, int), rng.integers(1, 10, 1000), [10**9], np.ones(500, int)])]
    for offsets in lists:
        index = fim.RankIndex(np.asarray(offsets), error)
        assert (index.offset(np.arange(len(offsets))) == np.asarray(offsets)).all()
        assert np.abs(index.residuals).max() <= error + 1
    even = fim.RankIndex(np.arange(0, 300_000, 3), error)
    assert len(even.starts) == 1
    assert fim.RankIndex(np.cumsum(rng.integers(60, 100, 5000)), 100).residuals.dtype == np.int8

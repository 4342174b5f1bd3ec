"""Repeated strings against brute force; transforms against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest

from helixframe.llm import suffixes as S
from helixframe.llm.common import Substrings


def brute(rows):
    """{(id, text): (bytes, removed, runs, digest)}: a string goes if it starts earlier by (id, start)."""
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 99):
            s = data[i:i + 100]
            first[s] = min(first.get(s, (key, i)), (key, i))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(b" " * len(data))
        for i in range(len(data) - 99):
            if first[data[i:i + 100]] < (key, i):
                gone[i:i + 100] = b"x" * 100
        kept = bytes(b for b, g in zip(data, gone) if g == 32)
        out.append((key, len(data), gone.count(b"x"), len(bytes(gone).split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(22)
    rows = [(0, passage), (1, text(40)), (2, passage), (3, text(5) + passage + text(5)), (4, None), (5, ""),
            (6, "a" * 700), (7, "ab" * 300), (8, "a" * 99), (9, "x" + "a" * 100), (3, text(30)), (3, passage)]
    for i in range(40):  # near copies, and one line in ever new surroundings
        words = passage.split()
        words[rng.randrange(len(words))] = word()
        rows.append((20 + i, " ".join(words)))
        rows.append((80 + i, text(rng.randint(0, 30)) + line + text(rng.randint(0, 30))))
    rows += [(200, text(300)), (201, passage + passage), (202, passage[:101]), (203, passage[:99])]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, n_bytes string")
    got = S.remove_repeats(df.repartition(4)).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got)


@pytest.mark.parametrize(("group", "shard", "block"), [(S.GROUP, S.SHARD, S.BLOCK), (6, 5, 20), (2, 3, 7)])
def test_against_brute_force(spark, monkeypatch, group, shard, block):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "SHARD", shard)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_a_common_line_in_more_surroundings_than_a_merge_holds(spark):
    rng = random.Random(8)
    line = "".join(rng.choice("abcdef ") for _ in range(130))
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + line
             + "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(3 * S.GROUP + 40)]
    assert run(spark, rows) == brute(rows)


def test_halves():
    for level in range(8):
        spans = S.halves(level)
        assert [x for a, b in spans for x in range(a, b + 1)] == list(range(S.SIDE + 1))
    assert all(a == b for a, b in S.halves(6))


def test_empty_table_and_whole_characters(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).count() == 0
    a = "é" * 60
    df = spark.createDataFrame([(1, a + "b"), (2, "c" + a), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in S.remove_repeats(df, as_text=True).collect()}
    assert got[3] is None and got[2].startswith("c") and set(got[2]) <= {"c", "é"}


def test_merge_orders_like_a_sort():
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 4, (60, 30), dtype=np.uint8)
    rows[20:40] = rows[:20]
    group = np.sort(rng.integers(0, 5, 60)).astype(np.uint16)
    cuts = [0, 17, 34, 60]
    groups = [group[a:b] for a, b in zip(cuts, cuts[1:])]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    transforms = [S.transform(g, p) for g, p in zip(groups, parts)]
    for j, which, rank, common in S.merge(groups, transforms):
        suffixes = []
        for g, p in zip(groups, parts):
            suffixes.append(sorted((int(x), bytes(r[j:])) for x, r in zip(g, p)))
        merged = [suffixes[w][r] for w, r in zip(which, rank)]
        assert merged == sorted(merged)
        for x, y, c in zip(merged, merged[1:], common[1:]):
            same = next((k for k, (p, q) in enumerate(zip(x[1], y[1])) if p != q), len(x[1])) if x[0] == y[0] else 0
            assert same == c


def test_steps_find_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    whole = S.anchors(data, Substrings())
    monkeypatch.setattr(S, "STEP", 700)
    for a, b in zip(whole, S.anchors(data, Substrings())):
        assert (a == b).all()

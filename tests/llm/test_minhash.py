"""Near-duplicate components against all pairs."""

import random

from helixframe.llm import minhash as M
from helixframe.llm.common import Scratch
from helixframe.llm.components import connected


def sets(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((str(key), len(own[i]), str(component), key == component))
    return sorted(out)


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    base = [word() for _ in range(120)]
    common = " ".join(word() for _ in range(12))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "One  TWO"), (10, "one two three"),
            (11, "a b c d e"), (12, "A b\tc d e"), (None, " ".join(base)), (4, "dup id"), (4, "dup id"), (4, " ".join(base))]
    for i in range(40):  # a chain: each is an edit of the one before
        base = list(base)
        base[rng.randrange(len(base))] = word()
        rows.append((100 + i, " ".join(base)))
    star = [word() for _ in range(100)]
    for i in range(40):  # a star: edits of one base, and a common line
        own = list(star)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = word()
        rows.append((200 + i, " ".join(own) + " " + common))
        rows.append((300 + i, common + " " + " ".join(word() for _ in range(rng.randint(1, 40)))))
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in M.deduplicate(df).collect())
    assert got == brute(rows)


def test_complete_search_finds_what_leaders_miss(spark, monkeypatch):
    monkeypatch.setattr(M, "LEADER_ROUNDS", 0)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in M.deduplicate(df).collect())
    assert got == brute(rows)


def test_keep_one_row_of_each_component(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "x"), (2, text, "y"), (2, text, "z"), (9, text + " end", "w"), (1, "", "a"), (1, "", "b"),
            (7, None, "c"), (None, text, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_key string")
    got = sorted((str(r.doc_id), r.text) for r in M.keep_one(df).collect())
    assert got == sorted([("2", text), ("1", ""), ("1", ""), ("7", None)], key=lambda r: (r[0], r[1])) or got == [
        ("1", ""), ("1", ""), ("2", text), ("7", None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.deduplicate(df).count() == 0 and M.keep_one(df).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(50, 50)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected(df, Scratch(spark, "test"), "c").collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{i: 100 for i in range(101, 140)}}

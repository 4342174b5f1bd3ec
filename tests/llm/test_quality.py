"""Quality vote: held-out accuracy and the vote against brute force."""

import numpy as np

from helixframe.llm import q_quality
from helixframe.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = q_quality.op5_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_vote_is_the_exact_neighbours_vote():
    rng = np.random.default_rng(1)
    rows = rng.random((40, 10)).astype(np.float32)
    model = {"projection": np.eye(10, dtype=np.float32), "labels": (rng.random(60) > 0.4).astype(np.float32),
             "vectors": Q._unit(rng.random((60, 10)).astype(np.float32))}
    got = Q.vote(rows, model, neighbours=7)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for i, r in enumerate(unit):
        near = sorted(range(60), key=lambda j: (-float(r @ model["vectors"][j]), j))[:7]
        w = [float(r @ model["vectors"][j]) for j in near]
        assert abs(got[i] - np.dot(w, model["labels"][near]) / sum(w)) < 1e-5


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "Good plain text here.", 2), (3, "$$$ %%% ###", 2)],
                                 "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, Q.learn(docs, none)).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1), (3, 0), (4, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = Q.score(docs, Q.learn(docs, some)).collect()
    assert [r.score for r in got[:2]] == [1.0, 1.0] and len(got) == 4
    assert Q.score(docs.limit(0), Q.learn(docs.limit(0), some)).count() == 0


def test_document_frequencies_cover_all_documents(spark):
    texts = ["good text", "good text", "also good", "$$$ %%%", None, "", "x x\n\nx x"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = Q._matrix([t for t in texts if t is not None], Q.Substrings())
    n, having = Q.document_frequencies(docs)
    assert n == 18 and (having == (rows > 0).sum(axis=0)).all()
    # the weights follow the corpus beside the labelled texts
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")
    few, more = (Q.learn(d, labels)["projection"] for d in (docs.where("doc_id in (0, 3)"), docs))
    scale = lambda p: np.linalg.norm(p, axis=1)
    idf = lambda n, having: np.log((1 + n) / (1 + having)) + 1
    both = Q._matrix([texts[0], texts[3]], Q.Substrings())
    for p, want in ((few, idf(2, (both > 0).sum(axis=0))), (more, idf(n, having))):
        weighted = Q._unit(both * want.astype(np.float32))
        basis = Q._leading(weighted.astype(np.float64), 2)
        assert np.allclose(scale(p), want * np.linalg.norm(basis, axis=1), atol=1e-4)


def plain_counts(text):
    """Term counts of a whole text, one by one."""
    raw = text.encode()
    counts, grams = np.zeros(Q.DIM), [Q._SHAPE[list(raw[i:i + 3])] for i in range(len(raw) - 2)]
    for a, b, c in grams:
        gram = np.array([(int(a) << 14) | (int(b) << 7) | int(c)], np.uint64)
        counts[int(Q.mix(gram)[0] % np.uint64(Q.DIM - Q.REPEATS))] += 1
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    counts[Q.DIM - 2] = 3 * sum(len(b) for a, b in zip(words, words[1:]) if a == b)
    counts[Q.DIM - 1] = 3 * (sum(map(len, lines)) - sum(map(len, set(lines))))
    return np.sqrt(counts / max(1, len(grams))).astype(np.float32)


def test_terms_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["", "ab", "\n\n", "one one\none one\n\ntwo é é\none one", " a" * 9 + "\nlong line of words\nb\nlong line of words"]
    texts += ["".join(rng.choice(list("aab \n"), 60)) for _ in range(20)]
    for step in (1, 2, 3, 7, 16, 1 << 20):
        monkeypatch.setattr(Q, "STEP", step)
        for t in texts:
            assert (Q.term_counts(t, Q.Substrings()) == plain_counts(t)).all(), (step, t)


def test_line_that_repeats_beyond_a_megabyte():
    line, other = "the very same line", "".join(f"{i:x}\n" for i in range(250_000))
    size = len(line) * 2 + len(other) + 1
    assert size > Q.STEP
    got = Q.term_counts(f"{line}\n{other}{line}", Q.Substrings())
    assert got[Q.DIM - 1] == np.float32(np.sqrt(3 * len(line) / (size - 2)))

"""Language identification: held-out accuracy, Viterbi against brute force, mixed text."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest

from helixframe.llm import language as L
from helixframe.llm import q_language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark):
    got = q_language.op4_language(spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    sizes = [4, 1, 6, 0, 3]
    score = rng.normal(0, 4, (sum(sizes), 3)).astype(np.float32)
    first = np.cumsum(sizes) - sizes
    got = L.viterbi(score, first, np.array(sizes), switch=2.5)
    for a, n in zip(first, sizes):
        value = lambda p: sum(score[a + i, l] for i, l in enumerate(p)) - 2.5 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731, E741
        if n:
            best = max(value(p) for p in itertools.product(range(3), repeat=n))
            assert value(tuple(got[a:a + n])) == pytest.approx(best, abs=1e-4)


def test_mixed_text_nulls_and_clashes(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    en, de = (docs.where(f"lang = '{x}' and n_chars > 1500").orderBy("doc_id").first().text[:600] for x in ("en", "de"))
    rows = [(1, en + "\n" + de, 1), (2, None, 1), (3, "", 1), (4, "12 34 --", 1), (5, "Ελληνικά", 1), (1, en, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = L.identify(df, model).collect()
    assert [s.lang for s in got[0].lang_spans] == ["en", "de"]
    a, b = got[0].lang_spans
    assert abs(a.stop - 600) < 30 and 0.4 < got[0].score < 0.7
    assert [r.lang_pred for r in got[1:4]] == ["und"] * 3 and [r.score for r in got[1:4]] == [0.0] * 3
    assert got[4].lang_pred in model["langs"] and got[5].lang_pred == "en"
    assert L.identify(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = L.learn(df)
    assert model["langs"] == [] and {r.lang_pred for r in L.identify(df, model).collect()} == {"und"}


def plain_words(text):
    """(start, stop, buckets, script) of every word, letter by letter."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    at = 0
    for is_letter, run in itertools.groupby(text, str.isalpha):
        n = len(list(run))
        if is_letter:
            edged = [0, *(ord(c) for c in low[at:at + n]), 0]
            grams = [edged[i] << 42 | edged[i + 1] << 21 | edged[i + 2] for i in range(n)]
            script = [s for first, s in L.SCRIPTS if first <= ord(text[at])][-1]
            yield at, at + n, (L.mix(np.array(grams, np.uint64)) % np.uint64(L.BUCKETS)).tolist(), script
        at += n


def plain_model(rows):
    """Log probabilities and scripts used by each language, from (language, text) rows counted one by one."""
    grams, scripts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, text in set(rows):
        for a, b, buckets, script in plain_words(text):
            grams[lang].update(buckets)
            scripts[lang][script] += b - a
    langs = sorted(grams)
    total = {x: sum(grams[x].values()) for x in langs}
    prob = lambda x, g: math.log((grams[x][g] + 0.5) / (total[x] + 0.5 * L.BUCKETS))
    uses = {x: {s for s, n in scripts[x].items() if n >= L.SCRIPT_SHARE * sum(scripts[x].values())} for x in langs}
    return langs, prob, uses


def plain_prediction(text, model):
    langs, prob, uses = model
    words = list(plain_words(text or ""))
    if not words:
        return "und", 0.0
    best, paths = None, []
    for _, _, buckets, script in words:
        own = [x for x in langs if script in uses[x]]
        value = [0.0 if not own else -1e6 if x not in own else sum(prob(x, g) for g in buckets) for x in langs]
        if best is None:
            best = value
            continue
        top = best.index(max(best))
        paths.append([i if best[i] >= best[top] - L.SWITCH else top for i in range(len(langs))])
        best = [max(best[i], best[top] - L.SWITCH) + value[i] for i in range(len(langs))]
    at = best.index(max(best))
    weight = [0] * len(langs)
    for (a, b, _, _), back in zip(words[::-1], [*paths[::-1], None]):
        weight[at] += b - a
        at = back[at] if back else at
    return langs[weight.index(max(weight))], max(weight) / sum(weight)


def test_query_against_brute_force(spark, tmp_path):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(250)
            .collect()]
    two = {x: next(t for _, t, y in docs if y == x and t) for x in ("en", "de")}
    docs += [(9001, None, "en"), (9002, "", "de"), (9003, "12 -- 34", "en"), (9004, "Ελληνικά Αθήνα", None),
             (9005, two["en"][:300] + "\n" + two["de"][:300], None), (9006, "日本語 text", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}
    model = plain_model([(x, t) for i, t, x in docs if not held[i] and x is not None and t is not None])
    want = {i: plain_prediction(t, model) for i, t, _ in docs}
    got = q_language.op4_language(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        assert (r.held_out, r.lang_pred) == (held[r.doc_id], want[r.doc_id][0])
        assert r.score == pytest.approx(want[r.doc_id][1], abs=1e-9)


def test_long_texts_go_part_by_part(model, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [None, "", "ab cd", "x" * 70 + " yy", *("".join(rng.choice(list("abcé 1\n日"), n)) for n in (5, 40, 90, 200)), "", "z"]
    letters = L.Letters()
    whole = L.scored_words(texts, letters, model)
    for part in (1, 8, 33):
        monkeypatch.setattr(L, "PART", part)
        for a, b in zip(L.scored_words(texts, letters, model), whole, strict=True):
            assert np.allclose(a, b, atol=1e-3)

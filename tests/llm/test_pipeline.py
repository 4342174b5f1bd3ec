"""The pipeline against a plain version of its stages on a small fixture."""

import re

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from helixframe.llm import minhash, quality
from helixframe.llm.common import Scratch, Substrings


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of the smallest input with planted nulls, copies, repeats and an extra column."""
    out = tmp_path_factory.mktemp("sf")
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    rows = docs.orderBy("doc_id").limit(120).collect()
    item = spark.read.parquet(f"{source}/benchmark.parquet").first()
    base = max((r.text for r in rows if len(r.text) < 3000), key=len)
    extra = [(9001, None), (9002, ""), (9003, base), (9004, base + " more"), (9005, "Intro. " + base[100:600] + " End."),
             (9006, "Before it " + item.text + " after it."), (9003, base)]
    made = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1) for r in rows]
    made += [(k, t, "en", "x", None, 2) for k, t in extra]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(
        str(out / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(str(out / f"{t}.parquet"))
    return str(out)


def plain(spark, folder):
    from test_decontaminate import brute as window_hits
    from test_minhash import sets

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~P.held_out())
    model = quality.learn(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    score = quality.vote(np.stack([quality.term_counts(t, Substrings()) for _, t in rows]), model)
    rows = sorted((r for r, s in zip(rows, score) if s >= 0.3), key=lambda r: (r[0], r[1] or ""))
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:  # plain label spreading
        for i in range(len(rows)):
            for j in range(i):
                if root[i] != root[j] and own[i] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                    low, high = sorted((root[i], root[j]))
                    root = [low if x == high else x for x in root]
        break
    rows = [r for i, r in enumerate(rows) if not own[i] or root[i] == i]
    seen, cut = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(b" " * len(data))
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                gone[i:i + 100] = b"x" * 100
            seen.add(data[i:i + 100])
        runs = [data[m.start():m.end()].decode("utf-8", "ignore") for m in re.finditer(rb" +", bytes(gone))]
        cut.append((key, None if text is None else "".join(runs)))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    out = []
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for key, text in cut:
        words, hit, _ = window_hits(text, items)
        if not (hit and 20 * hit >= words):
            ids = library.encode(text or "", add_special_tokens=False).ids
            out.append((key, len(ids), np.array(ids, "<u4").tobytes()))
    return sorted(out)


def test_run_equals_the_plain_version(spark, folder, monkeypatch):
    monkeypatch.syspath_prepend(__file__.rsplit("/", 1)[0])
    got = sorted((r.doc_id, r.n_tokens, bytes(r.token_ids)) for r in P.run(spark, folder).collect())
    assert got == plain(spark, folder)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    scratch = Scratch(spark, "test")
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe":
            assert out.columns == docs.columns
        docs = scratch.keep(out, name)
        assert docs.count() == 0


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "suffix_dedup", "decontaminate", "bpe"]
    assert minhash.SIZE == 5 and minhash.PERCENT == 75

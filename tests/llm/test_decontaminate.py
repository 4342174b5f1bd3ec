"""Window hits against brute force, in one block of items and in many."""

import random
import re

from helixframe.llm import decontaminate as D


def brute(text, items, window=D.WINDOW):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hit, found = set(), set()
    for item, body in items:
        if item is None or body is None:
            continue
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", body.translate({c: c + 32 for c in range(65, 91)}))
        for a in range(max(1, len(own) - window + 1) if own else 0):
            w = own[a:a + window]
            for i in range(len(words) - len(w) + 1):
                if words[i:i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def cases():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "日本", "2"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    items = [(1, " ".join(passage)), (2, " ".join(passage[5:20])), (3, "short One!"), (4, ""), (5, None), (6, "... --"),
             (None, "w1 w2"), (3, "other short"), (10, "short-one")]
    docs = [(1, " ".join(passage)), (2, "x " + ", ".join(passage[:14]).upper() + " y"), (3, "a SHORT one b short one"),
            (4, None), (5, ""), (6, " ".join(passage[:12])), (1, " ".join(passage)), (7, "other short other short")]
    docs += [(20 + i, " ".join(rng.choice(vocabulary + ["short", "one"]) for _ in range(200))) for i in range(20)]
    return docs, items


def check(spark, **options):
    docs, items = cases()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in D.scan(d, b, **options).collect())
    assert got == sorted((k, *brute(t, items)) for k, t in docs)


def test_one_block(spark):
    check(spark)


def test_many_blocks_add_up(spark):
    check(spark, block_bytes=60)


def test_spans_map_to_the_original(spark):
    d = spark.createDataFrame([(1, "é É — Short,  ONE! tail")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "short one")], "item_id long, text string")
    r = D.scan(d, b).first()
    (span,) = r.hit_spans
    assert r.text[span.start:span.stop] == "Short,  ONE"


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in D.scan(d, none).collect()] == [(2, 0)]
    assert D.scan(d.limit(0), none).count() == 0

"""The BPE transducer against the tokenizers library, and its bounds."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    v = vocabulary
    return bpe.Encoder(v.single, v.merges, v.special, {i: len(b) for i, b in v.bytes_of.items()}, v.lookahead)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = ["", " ", "\n", "a", "Hello world", "don't we'll I'm", "x<|endoftext|>y<|endoftext|>", "  two  spaces \n\t tab ",
         "a b c", "日本語 テキスト", "🙂🙂 é́", "\x00\x01\xad", "12345 6.7e8", "'s's 's", " 's",
         "line\n\n\nline", "end ", "##$$%%", "ﬁne ſ", "​‍"]


def ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(encoder, library, text):
    assert encoder.encode(text) == ids(library, text)


def test_random_and_very_long_texts(encoder, library, vocabulary):
    rng = random.Random(3)
    parts = ["a", "the", " ", "\n", "é", "1", "'re", "!!", "日本", "🙂", "\xad", "ing", "<|endoftext|>", "\t"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        assert encoder.encode(text) == ids(library, text)
    for text in ("a" * 30000, " " * 20000 + "b", "\n" * 9999, "=-" * 9000,
                 "".join(rng.choice("aeinthrs") for _ in range(20000))):
        got = encoder.encode(text)
        assert got == ids(library, text)
        assert bpe.Decoder(vocabulary.bytes_of).decode(np.frombuffer(got, "<u4")) == text


def test_blocks_do_not_change_the_tokens(encoder):
    rng = random.Random(5)
    for _ in range(5):
        piece = "".join(rng.choice("aeinthrsol") for _ in range(4000)).encode()
        whole = np.array(encoder.merge(piece), "<u4").tobytes()
        block, encoder.block = encoder.block, encoder.lookahead + 200
        try:
            assert encoder.transduce(piece) == whole
        finally:
            encoder.block = block


def test_long_texts_go_part_by_part_and_the_memo_is_bounded(encoder, library, monkeypatch):
    rng = random.Random(7)
    words = ["a", "the", "\n", "é", "it's", "", "日本", "🙂x", "\t", "tab\t", "x" * 80, " ", "end.", "<|endoftext|>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    texts += [" " * 500, " a" * 300, "a " * 300, "a" * 500 + " b", "x" * 99 + "  " * 99]
    for part in (1, 7, 64):
        monkeypatch.setattr(bpe, "PART", part)
        for text in texts:
            assert "".join(encoder.parts(text)) == text
            assert encoder.encode(text) == ids(library, text)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 2000)
    encoder.words.clear()
    encoder.held = 0
    for n in range(300):
        text = f"some {n} words {n * 7919} " + "y" * n + " and more"
        assert encoder.encode(text) == ids(library, text)
        assert encoder.held <= 2000 and len(encoder.words) <= 20 and max(map(len, encoder.words), default=0) <= bpe.SHORT


def test_lookahead_of_a_small_merge_list():
    # b"ab" joins first; a chain through c needs both left parts
    size = {0: b"a", 1: b"b", 2: b"c", 3: b"ab", 4: b"cab"}
    assert bpe.sufficient_lookahead([(0, 1, 3), (2, 3, 4)], size) >= 1 + 1 + 1


def test_decoder_keeps_open_characters_and_replaces_malformed_bytes(vocabulary, library):
    decoder = bpe.Decoder(vocabulary.bytes_of)
    decoder.STEP = 1
    got = np.frombuffer(ids(library, "é🙂日"), "<u4")
    assert decoder.decode(got) == "é🙂日"
    assert decoder.decode(got[:1]) == library.decode(got[:1].tolist(), skip_special_tokens=False)


def test_operator_on_nulls_clashes_and_empty_tables(spark, vocabulary, library):
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (2, "Hi there", "old"), (2, "Hi there", "old")],
                               "doc_id long, text string, n_tokens string")
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in got) == [
        (1, 0, ""), (2, 0, ""), (2, 2, "Hi there"), (2, 2, "Hi there")]
    assert bpe.encode(df.limit(0), vocabulary).count() == 0

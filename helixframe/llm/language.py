"""Language identification of mixed-language text.

Learning: letter trigrams (with word edges, lower-cased, hashed to a fixed
number of buckets) and scripts are counted per language over a bounded sample of
labelled documents: at most ``per_language`` different texts of a language, those with
the smallest hashes. Model size is languages x BUCKETS.

Prediction, whole texts: words are runs of letters. A word's script leaves only
the languages that were seen to use it; its score per language is the sum of its
trigrams' log probabilities. Viterbi with a penalty for switching labels every
word, vectorised over the documents of a batch, which gives spans of one
language each. The document's language has most of the labelled letters and the
score is its share of them.

Defined cases: null text, text without letters, and an empty model give ``und``,
score 0 and no spans; words whose script no language uses add no evidence and
follow their neighbours; equal shares go to the language first in order; rows
are independent, so repeated rows agree; columns named like results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, map_columns, mix

BUCKETS = 1 << 15
PART = 1 << 20  # characters whose trigrams are looked at together, about
PER_LANGUAGE = 1500  # labelled documents learned from, at most, for each language
SWITCH = 8.0  # log-probability cost of a change of language between two words
SCRIPT_SHARE = 0.005  # a language uses a script that holds this share of its letters
UNKNOWN = "und"

#: First code points of script ranges and the script from there on.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0x10000, "Other"), (0x20000, "Han"),
)
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


class Letters:
    """Lower case (0: not a letter) of code points, tabulated a page of 256 at a time as pages are met."""

    def __init__(self):
        self.lower = np.zeros(0x110000, dtype=np.uint32)
        self.known = np.zeros(0x1100, dtype=bool)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        pages = np.flatnonzero(np.bincount(code >> 8, minlength=0x1100).astype(bool) & ~self.known)
        for p in pages.tolist():
            for c in range(p << 8, (p + 1) << 8):
                ch = chr(c)
                if ch.isalpha():
                    low = ch.lower()
                    self.lower[c] = ord(low) if len(low) == 1 else c
            self.known[p] = True
        return self.lower[code]


class Words:
    """Words of a batch of texts: letters, trigram buckets, scripts and bounds."""

    def __init__(self, texts: list[str | None], letters: Letters):
        joined = "\n".join([t or "" for t in texts]) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        low = letters(code)
        is_letter = low > 0
        edge = np.diff(is_letter.astype(np.int8), prepend=0)
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.flatnonzero(is_letter)
        wide = np.concatenate([[0], low]).astype(np.uint64)  # wide[i + 1] is letter i; a word is edged by 0
        gram = wide[at] << np.uint64(42) | wide[at + 1] << np.uint64(21) | wide[np.minimum(at + 2, len(low))]
        self.bucket = (mix(gram) & np.uint64(BUCKETS - 1)).astype(np.int32)
        self.first = np.searchsorted(at, self.start)  # a word's first letter among all letters
        self.script = _SCRIPT[np.searchsorted(_STARTS, code[self.start], side="right") - 1]
        size = np.array([len(t or "") + 1 for t in texts], dtype=np.int64)
        self.offset = np.cumsum(size) - size  # where each text starts
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        self.size = self.stop - self.start


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> dict:
    """Model of the labelled documents: languages, log probabilities [bucket, language], scripts used."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    near = hash_sample(rows, "lang", "h", per_language).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")  # about 1.5 * per_language rows a language
    sample = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "text")
    n_scripts = len(SCRIPT_NAMES)

    def count(batches):
        letters = Letters()
        for batch in batches:
            lang_of = np.array(batch.column("lang").to_pylist(), dtype=object)
            w = Words(batch.column("text").to_pylist(), letters)
            letter_doc = np.repeat(w.doc, w.size)
            names, own = np.unique(lang_of.astype(str), return_inverse=True)
            for i, name in enumerate(names):
                grams = np.bincount(w.bucket[own[letter_doc] == i], minlength=BUCKETS)
                used = np.bincount(w.script[own[w.doc] == i], w.size[own[w.doc] == i], n_scripts).astype(np.int64)
                n = np.concatenate([grams, used])
                key = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(key)), pa.array(key.astype(np.int32)),
                                                  pa.array(n[key].astype(np.int64))], names=["lang", "key", "n"])

    counts = (sample.repartition(F.xxhash64("text")).mapInArrow(count, "lang string, key int, n long")
              .groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow())
    lang_col = np.array(counts.column("lang").to_pylist(), dtype=object)
    key, n = np.asarray(counts.column("key")), np.asarray(counts.column("n"))
    langs = sorted(set(lang_col.tolist()))
    table = np.zeros((BUCKETS + n_scripts, len(langs)))
    if langs:
        table[key, np.searchsorted(np.array(langs, dtype=object), lang_col)] = n
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    prob = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)) if langs else grams
    uses = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return {"langs": langs, "prob": prob.astype(np.float32), "uses": uses & (scripts > 0)}


def parts(text: str):
    """Parts of a text (offset, part) of about PART characters, each cut before a character that is no letter."""
    start = 0
    while len(text) - start > PART:
        stop = start + PART
        while stop < len(text) and text[stop].isalpha():
            stop += 1
        yield start, text[start:stop]
        start = stop
    yield start, text[start:]


def scored_words(texts: list[str | None], letters: Letters, model: dict) -> tuple[np.ndarray, ...]:
    """Start and stop in its text, text number and scores of every word; one part of a long text at a time."""
    runs: list[tuple[int, int, list[str | None]]] = []  # first text, offset in it, texts or the part of one
    for i, t in enumerate(texts):
        if t is not None and len(t) > PART:
            runs += [(i, a, [part]) for a, part in parts(t)]
        elif runs and runs[-1][1] == 0 and len(texts[i - 1] or "") <= PART:
            runs[-1][2].append(t)
        else:
            runs.append((i, 0, [t]))
    found = []
    for first, at, run in runs:
        w = Words(run, letters)
        shift = at - w.offset[w.doc]
        found.append((w.start + shift, w.stop + shift, w.doc + first, word_scores(w, model)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_scores(w: Words, model: dict) -> np.ndarray:
    """Score of every word per language; languages that do not use the word's script are out."""
    out = np.zeros((len(w.start), len(model["langs"])), dtype=np.float32)
    if len(w.start):
        for i in range(out.shape[1]):
            out[:, i] = np.add.reduceat(model["prob"][:, i][w.bucket], w.first)
        uses = model["uses"][w.script]
        out = np.where(uses, out, np.where(uses.any(axis=1, keepdims=True), np.float32(-1e6), np.float32(0)))
    return out


def viterbi(score: np.ndarray, first: np.ndarray, n: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word. ``first``/``n``: where each text's words begin and how many there are.

    Texts run side by side, longest first: step t handles word t of every text that has one.
    """
    label = np.zeros(len(score), dtype=np.int16)
    if not len(score):
        return label
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts with more than t words
    own = np.arange(score.shape[1], dtype=np.int16)
    back = np.empty(score.shape, dtype=np.int16)
    best = score[first[:active[0]]].astype(np.float64)
    last = np.empty((len(n), score.shape[1]))
    for t in range(1, int(n[0])):
        k = active[t]
        if k < len(best):
            last[k:len(best)] = best[k:]
            best = best[:k]
        row = first[:k] + t
        top = best.argmax(axis=1)
        jump = best[np.arange(k), top] - switch
        stay = best >= jump[:, None]
        back[row] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, jump[:, None]) + score[row]
    last[:len(best)] = best
    at = last[:active[0]].argmax(axis=1).astype(np.int16)
    for t in range(int(n[0]) - 1, -1, -1):
        k = active[t]
        row = first[:k] + t
        label[row] = at[:k]
        if t:
            at[:k] = back[row, at[:k]]
    return label


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
                     T.StructField("lang", T.StringType())])


def identify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred``, ``score`` (0 to 1) and ``lang_spans`` (character offsets, language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        letters, model = Letters(), shared.value
        langs = np.array(model["langs"], dtype=object)

        def fn(batch):
            n_docs = batch.num_rows
            if not len(langs) or not n_docs:
                return [[UNKNOWN] * n_docs, np.zeros(n_docs), [[]] * n_docs]
            begin, end, doc, score = scored_words(batch.column(text).to_pylist(), letters, model)
            n = np.bincount(doc, minlength=n_docs)
            first = np.cumsum(n) - n
            label = viterbi(score, first, n)
            weight = np.zeros((n_docs, len(langs)))
            np.add.at(weight, (doc, label), end - begin)
            total = weight.sum(axis=1)
            best = weight.argmax(axis=1)
            share = np.where(total > 0, weight[np.arange(n_docs), best] / np.maximum(total, 1), 0.0)
            # a span runs from its first word's start to its last word's end
            new = np.ones(len(label), dtype=bool)
            new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(label))[:len(a)] - 1
            spans = pa.StructArray.from_arrays(
                [pa.array(begin[a], pa.int64()), pa.array(end[b], pa.int64()), pa.array(langs[label[a]], pa.string())],
                names=["start", "stop", "lang"])
            edges = np.searchsorted(doc[a], np.arange(n_docs + 1)).astype(np.int32)
            return [np.where(total > 0, langs[best], UNKNOWN), share,
                    pa.ListArray.from_arrays(pa.array(edges), spans)]

        return fn

    return map_columns(docs, text, [("lang_pred", T.StringType()), ("score", T.DoubleType()),
                                    ("lang_spans", T.ArrayType(SPAN))], start, limit=4 << 20, keep=keep)

"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Terms of a text are trigrams of character shapes (letters by case, digits,
white space, every ASCII mark for itself), hashed to DIM buckets, plus marks for
words and lines that repeat. Counts are damped, weighted by inverse document
frequency over all documents and scaled to unit length; the space is spanned by
the leading singular vectors of a bounded labelled sample (at most ``per_label``
different texts of each label, those with the smallest hashes).

The projection and the sample's vectors and labels are broadcast (their size is
fixed by the parameters, not by the data). Every document is projected and its
cosine with every labelled vector is computed exactly, block by block; the
``neighbours`` nearest vote with their similarity as weight. The score is the
share of label 1.

Defined cases: null and empty texts have a zero vector, no similarity, and score
the sample's share of label 1; without any labelled text every score is 0.5;
a document labelled several times has the largest of its labels; a label without
a document or without a value is not learned from; equal similarities go to the
earlier sample row, in the order of hash and text; repeated rows agree; columns
named like results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, Substrings, hash_sample, map_columns, mix, slices

DIM = 2048  # hashed term space
RANK = 48  # latent dimensions
PER_LABEL = 1500  # labelled documents of each label learned from, at most
NEIGHBOURS = 15
THRESHOLD = 0.3
BLOCK = 256  # documents whose cosines are computed at a time
STEP = 1 << 20  # bytes of one text looked at together; terms go on across slices

_SHAPE = np.zeros(256, dtype=np.uint8)
_SHAPE[:] = np.arange(256) % 128
_SHAPE[ord("a"):ord("z") + 1] = ord("a")
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")  # bytes of other characters count as letters
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Buckets kept free of hashed trigrams: repeated words, repeated lines.
REPEATS = 2


def term_counts(text: str | None, hashes: Substrings) -> np.ndarray:
    """Damped term frequencies of one whole text, not yet weighted: float32[DIM]."""
    counts = np.zeros(DIM)
    raw = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    total = 0
    words, lines = Units(hashes), Units(hashes)
    last = None  # hash of the word before
    hashed, sizes = [], []  # of all lines
    for a in range(0, len(raw), STEP):
        data, done = raw[a:a + STEP], a + STEP >= len(raw)
        s = _SHAPE[raw[max(0, a - 2):a + STEP]].astype(np.uint64)  # two bytes of the slice before
        if len(s) >= 3:
            gram = (s[:-2] << np.uint64(14)) | (s[1:-1] << np.uint64(7)) | s[2:]
            counts += np.bincount((mix(gram) % np.uint64(DIM - REPEATS)).astype(np.int64), minlength=DIM)
            total += len(s) - 2
        prefix = hashes.prefix(data)
        unit, size = words.closed(prefix, _SPACE[data], done)
        if len(unit):
            same = np.append(last is not None and unit[0] == last, unit[1:] == unit[:-1])
            counts[DIM - 2] += 3.0 * size[same].sum()
            last = unit[-1]
        unit, size = lines.closed(prefix, data == 10, done)
        hashed.append(unit)
        sizes.append(size)
    if hashed:
        unit, size = np.concatenate(hashed), np.concatenate(sizes)
        order = np.argsort(unit)
        counts[DIM - 1] += 3.0 * size[order][1:][np.diff(unit[order]) == 0].sum()
    return np.sqrt(counts / max(1, total)).astype(np.float32)


class Units:
    """Hashes and lengths of the words or lines of a text that is read in slices."""

    def __init__(self, hashes: Substrings):
        self.hashes, self.open, self.length = hashes, 0, 0

    def closed(self, prefix: np.ndarray, ends: np.ndarray, done: bool) -> tuple[np.ndarray, np.ndarray]:
        """The units that end in this slice; one that reaches its end stays open, unless the text is done."""
        edge = np.diff(ends.astype(np.int8), prepend=1, append=1)
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        part, size = (prefix[stop] - prefix[start]) * self.hashes.down[start], stop - start
        if self.length:
            if not ends[0]:
                part[0] = (self.open + pow(BASE, self.length, 1 << 64) * int(part[0])) % (1 << 64)
                size[0] += self.length
            else:
                part, size = np.append(np.uint64(self.open), part), np.append(self.length, size)
            self.length = 0
        if not done and not ends[-1]:
            self.open, self.length = int(part[-1]), int(size[-1])
            part, size = part[:-1], size[:-1]
        return mix(part), size


def _matrix(texts: list[str | None], hashes: Substrings) -> np.ndarray:
    return np.stack([term_counts(t, hashes) for t in texts]) if texts else np.zeros((0, DIM), np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents with a text, and of those with each term: int64[DIM]."""

    def partial(batches):
        hashes = Substrings()
        seen, n = np.zeros(DIM, dtype=np.int64), 0
        for b in batches:
            for part in slices(b, "text", 8 << 20):
                for t in part.column("text").to_pylist():
                    seen += term_counts(t, hashes) > 0
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(seen, n))],
                                         names=["term", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    got = rows.mapInArrow(partial, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIM + 1, dtype=np.int64)
    out[np.asarray(got.column("term"))] = np.asarray(got.column("n"))
    return int(out[DIM]), out[:DIM]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          per_label: int = PER_LABEL, rank: int = RANK) -> dict:
    """Model from the labelled documents: projection, latent vectors, labels."""
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
             .agg(F.max(label).cast("int").alias("y")))
    chosen = (docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("h"))
              .join(known, "k"))
    near = hash_sample(chosen, "y", "h", per_label).groupBy("y", "h").agg(F.min("k").alias("k"))
    order = Window.partitionBy("y").orderBy("h")  # about 1.5 * per_label rows a label
    ids = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label).select("k", "y").distinct()
    sample = (docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
              .join(F.broadcast(ids), "k").groupBy("k", "y").agg(F.min("text").alias("text")))

    def vectors(batches):
        hashes = Substrings()
        for b in batches:
            rows = _matrix(b.column("text").to_pylist(), hashes).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), b.column("y"),
                                              b.column("h")], names=["v", "y", "h"])

    got = sample.withColumn("h", F.xxhash64("text")).mapInArrow(vectors, "v binary, y int, h long").toArrow()
    if not got.num_rows:
        return {"labels": np.zeros(0, np.float32)}
    rows = np.stack([np.frombuffer(v, dtype="<f4") for v in got.column("v").to_pylist()])
    y, h = np.asarray(got.column("y")), np.asarray(got.column("h"))
    order = np.lexsort((y, h))
    rows, y = rows[order], y[order]
    total, having = document_frequencies(docs, text)
    idf = np.log((1 + total) / (1 + having)).astype(np.float32) + 1
    weighted = _unit(rows * idf)
    basis = _leading(weighted.astype(np.float64), min(rank, len(rows))).astype(np.float32)
    return {"projection": idf[:, None] * basis, "vectors": _unit(weighted @ basis), "labels": y.astype(np.float32)}


def _leading(rows: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    rng = np.random.Generator(np.random.PCG64(5))
    basis = rng.standard_normal((rows.shape[1], min(rank + 16, rows.shape[1])))
    for _ in range(rounds):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :rank]


def vote(rows: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by cosine."""
    labels = model["labels"]
    if not len(labels):
        return np.full(len(rows), 0.5)
    prior = float(labels.mean())
    out = np.empty(len(rows))
    k = min(neighbours, len(labels))
    for a in range(0, len(rows), BLOCK):
        cosine = _unit(rows[a:a + BLOCK] @ model["projection"]) @ model["vectors"].T
        # ties at the kth cosine: the earlier sample row wins
        kth = -np.partition(-cosine, k - 1, axis=1)[:, k - 1:k]
        over, at = cosine > kth, cosine == kth
        take = over | (at & (np.cumsum(at, axis=1) <= k - over.sum(axis=1, keepdims=True)))
        weight = np.where(take, np.maximum(cosine, 0), 0)
        total = weight.sum(axis=1)
        out[a:a + BLOCK] = np.where(total > 0, (weight * labels).sum(axis=1) / np.where(total > 0, total, 1), prior)
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD,
          keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        hashes, model = Substrings(), shared.value

        def fn(batch):
            texts = batch.column(text).to_pylist()
            got = np.concatenate([vote(_matrix(texts[a:a + BLOCK], hashes), model)
                                  for a in range(0, len(texts), BLOCK)] or [np.zeros(0)])
            return [got, (got >= threshold).astype(np.int32)]

        return fn

    return map_columns(docs, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], start,
                       limit=8 << 20, keep=keep)

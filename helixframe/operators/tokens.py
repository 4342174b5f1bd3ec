"""Tokenisation as corpus jobs (K1-K5).

K6 (padding to the longest in a batch of 32) is result-neutral and belongs to
the model call: ``operators.scoring.batch_model_udf`` batches rows per task.

Overlapping k-mers are cut from the ASCII bytes of a sequence (binary
``substr`` is O(1) per position), counted with a partial/final aggregate, and a
vocabulary is numbered over the *distinct* k-mers only, by range partitions.

Encoding is map-only. Over an alphabet of ``a`` letters a k-mer is a number below
``a ** k`` (its letters as digits), so the vocabulary is one dense array of ids
indexed by that number, ``MAX_CODES`` at most, sent to the tasks with the
function; each Arrow batch is one pass of numpy over its bytes. No position
becomes a row and nothing is joined or regrouped. Vocabularies over other texts
are joined by shuffle (``encode_by_join``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .labels import numbered
from .tries import pieces

# Special token ids (pad, unknown, class, separator), ids 0-3.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_ID = 4

DNA = "ACGT"
MAX_CODES = 1 << 20  # entries of a dense id array (4 MB): 10-mers of DNA
MAX_NUMBERED = 15  # letters of a k-mer over DNA whose number fits 31 bits
RUN = 1 << 22  # bytes encoded together


def kmers(df: DataFrame, seq: str, key: str, k: int = 6, outer: bool = False) -> DataFrame:
    """K1 (long form): ``(key, pos, kmer)`` for every overlapping k-mer (1-based position).

    Sequences are cut into overlapping pieces first, so a very long one is no single row's array of positions and its
    pieces are dealt out."""
    d = pieces(df, seq, [key], k).select(key, "at", F.col("piece").cast("binary").alias("_raw"))
    n = F.length("_raw") - F.lit(k - 1)
    pos = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    e = d.select(key, "at", "_raw", (F.explode_outer if outer else F.explode)(pos).alias("_p"))
    return e.select(key, (F.col("at") + F.col("_p")).alias("pos"),
                    F.col("_raw").substr(F.col("_p"), F.lit(k)).cast("string").alias("kmer"))


def _letters(numbers: np.ndarray, k: int) -> np.ndarray:
    """The k-mers of the numbers, as bytes of their letters."""
    digits = np.stack([(numbers // 4 ** (k - 1 - j)) % 4 for j in range(k)], axis=1)
    return np.frombuffer(DNA.encode(), np.uint8)[digits]


def _piece_counts(raw: bytes, k: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """The numbers of a piece's k-mers over ``ACGT`` with their counts, and the counts of its other k-mers."""
    n = max(len(raw) - k + 1, 0)
    number = kmer_numbers(np.frombuffer(raw, np.uint8), k) if k <= MAX_NUMBERED else np.full(n, -1, dtype=np.int32)
    own, counts = np.unique(number[number >= 0], return_counts=True)
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(number < 0).tolist():
        others[raw[i:i + k]] = others.get(raw[i:i + k], 0) + 1
    return own, counts, others


def kmer_counts(df: DataFrame, seq: str, key: str, k: int = 6) -> DataFrame:
    """K1: ``(key, kmer, n)`` occurrences of each k-mer in each sequence.

    A piece's k-mers are counted where it is read and travel as one packed row, two short buffers. The packed rows of
    a key stand side by side after a sort and are added up one key at a time, so no table of all (key, k-mer) groups is held."""
    cut = pieces(df, seq, [key], k).select(key, F.col("piece").cast("binary").alias("_raw"))
    other = "array<struct<kmer:binary,n:bigint>>"

    @F.arrow_udf(f"struct<numbers:binary,counts:binary,others:{other}>")
    def packed(raws: pa.Array) -> pa.Array:
        rows = []
        for raw in raws:
            own, counts, others = _piece_counts(raw.as_py(), k)
            rows.append({"numbers": own.astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes(),
                         "others": [{"kmer": t, "n": n} for t, n in others.items()]})
        return pa.array(rows, pa.struct([("numbers", pa.binary()), ("counts", pa.binary()), (
            "others", pa.list_(pa.struct([("kmer", pa.binary()), ("n", pa.int64())])))]))

    side = cut.select(key, packed("_raw").alias("_p")).repartition(key).sortWithinPartitions(key)
    side = side.select(key, "_p.numbers", "_p.counts", "_p.others")

    def added(batches):
        """One list ``(key, numbers, counts, others)`` a key."""
        last = None
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for name, numbers, counts, others in rows:
                numbers, counts = np.frombuffer(numbers, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)
                if last is None or last[0] != name:
                    if last is not None:
                        yield last
                    last = [name, numbers, counts, {}]
                else:
                    own, place = np.unique(np.concatenate([last[1], numbers]), return_inverse=True)
                    total = np.zeros(len(own), dtype=np.int64)
                    np.add.at(total, place, np.concatenate([last[2], counts]))
                    last[1:3] = own, total
                for o in others:
                    last[3][o["kmer"]] = last[3].get(o["kmer"], 0) + o["n"]
        if last is not None:
            yield last

    def unpacked(batches):
        names, sizes, numbers, counts = [], [], [], []
        schema = None

        def out():
            ids = pa.array(names, key_type).take(pa.array(np.repeat(np.arange(len(names)), sizes)))
            own = np.concatenate(numbers)
            texts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(own), [None, pa.py_buffer(
                np.ascontiguousarray(_letters(own, k)))]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([ids, texts, pa.array(np.concatenate(counts), pa.int64())],
                                              names=[key, "kmer", "n"])

        def peeked():
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield batch

        for name, own, n, others in added(peeked()):
            key_type = schema.field(0).type
            if len(own):
                names.append(name)
                sizes.append(len(own))
                numbers.append(own)
                counts.append(n)
            if others:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(others), key_type), pa.array(list(others), pa.binary()),
                                                  pa.array(list(others.values()), pa.int64())], names=[key, "kmer", "n"])
            if sum(sizes) >= RUN // 16:
                yield out()
                names, sizes, numbers, counts = [], [], [], []
        if names:
            yield out()

    schema = S.StructType([df.schema[key], S.StructField("kmer", S.BinaryType()), S.StructField("n", S.LongType())])
    return side.mapInArrow(unpacked, schema).select(key, F.col("kmer").cast("string").alias("kmer"), "n")


def vocabulary(df: DataFrame, seq: str, key: str, k: int = 6, min_df: int = 1) -> DataFrame:
    """K2: ``(kmer, id, df)`` numbered by document frequency (desc), ties by k-mer text; ids from 4."""
    docfreq = kmers(df, seq, key, k).select(key, "kmer").distinct().groupBy("kmer").agg(
        F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    ranked = numbered(docfreq, [F.col("df").desc(), F.col("kmer")], "_rank")
    return ranked.select("kmer", (F.col("_rank") + FIRST_ID).cast("int").alias("id"), "df")


def dense_ids(vocab: DataFrame, k: int, alphabet: str = DNA) -> np.ndarray:
    """Ids by k-mer number over ``alphabet`` (``UNK`` where the vocabulary has none); ``len(alphabet) ** k`` entries.

    K-mers with letters outside the alphabet have no number: they raise, so that no known k-mer turns unknown.
    """
    size = len(alphabet) ** k
    if size > MAX_CODES:
        raise ValueError(f"{len(alphabet)} letters and k = {k} make {size} k-mers, more than {MAX_CODES}: encode_by_join")
    own = vocab.select("kmer", "id").where(F.col("kmer").rlike(f"^[{alphabet}]{{{k}}}$"))
    rows, total = own.collect(), vocab.count()
    if len(rows) != total:
        raise ValueError(f"{total - len(rows)} k-mers are not {k} letters of {alphabet}: encode_by_join")
    ids = np.full(size, UNK, dtype=np.int32)
    for r in rows:
        number = 0
        for letter in r["kmer"]:
            number = number * len(alphabet) + alphabet.index(letter)
        ids[number] = r["id"]
    return ids


def kmer_numbers(data: np.ndarray, k: int, alphabet: str = DNA) -> np.ndarray:
    """The number of the k-mer at every byte but the last ``k - 1``; -1 where it has another letter."""
    code = np.full(256, -1, dtype=np.int32)
    code[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    c, n = code[data], max(len(data) - k + 1, 0)
    number, bad = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool)
    for j in range(k):
        number = number * len(alphabet) + c[j:j + n]
        bad |= c[j:j + n] < 0
    number[bad] = -1
    return number


def _encode_batch(texts: pa.Array, ids: np.ndarray, k: int, alphabet: str, limit: int | None) -> pa.Array:
    """Id lists of a batch, in runs of about ``RUN`` bytes."""
    missing = np.asarray(texts.is_null())
    raw = pa.compute.fill_null(texts, "").cast(pa.large_binary())
    if limit is not None:
        raw = pa.compute.binary_slice(raw, 0, limit + k - 1)
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, dtype=np.uint8)
    lens = np.maximum(np.diff(offsets) - (k - 1), 0)
    full = np.append(ids, np.int32(UNK))  # number -1 reads the last entry
    out, cuts = [], [0, *(np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // RUN)) + 1).tolist(), len(raw)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first, last = int(offsets[a]), int(offsets[b])
        number = kmer_numbers(data[first:last], k, alphabet)
        stay = np.ones(len(number), dtype=bool)  # windows across two sequences go
        for j in range(1, k):
            over = offsets[a + 1:b] - first - j
            stay[over[(over >= 0) & (over < len(number))]] = False
        # a sequence shorter than k has no window of its own, and every window over its end has gone
        out.append(full[number[stay]])
    flat = np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
    mask = pa.array(missing) if missing.any() else None
    starts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat), mask=mask)


def encode(df: DataFrame, seq: str, key: str, vocab: DataFrame, k: int = 6, alphabet: str = DNA,
           limit: int | None = None) -> DataFrame:
    """K3: ``(key, ids)``: k-mer ids in position order, unknown k-mers -> ``UNK``; a null sequence has no ids.

    With ``limit`` only the first ``limit`` positions are encoded (what K4 and K5 keep)."""
    ids = dense_ids(vocab, k, alphabet)

    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        return _encode_batch(texts, ids, k, alphabet, limit)

    return df.select(key, numbers(F.coalesce(F.col(seq), F.lit(""))).alias("ids"))


def encode_by_join(df: DataFrame, seq: str, key: str, vocab: DataFrame, k: int = 6) -> DataFrame:
    """K3 for vocabularies over any texts: joins them to the positions and rebuilds each sequence's id list in
    position order; a group is one sequence, never more."""
    km = kmers(df, seq, key, k, outer=True)  # a sequence shorter than k keeps one row without a position
    j = km.join(vocab.select("kmer", "id"), "kmer", "left")
    t = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id")))
    ids = j.groupBy(key).agg(F.sort_array(F.collect_list(t)).alias("_t"))
    return ids.select(key, F.transform("_t", lambda t: t["id"]).alias("ids"))


def truncate(ids: Column, max_length: int = 512) -> Column:
    """K4: ``[CLS] + ids[:max_length - 2] + [SEP]``."""
    return F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, max_length - 2), F.array(F.lit(SEP)))


def pad(ids: Column, length: int = 512) -> tuple[Column, Column]:
    """K5: pad to ``length`` with ``PAD`` and build the attention mask (1 = token, 0 = pad)."""
    fill = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    padded = F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(PAD), fill))
    mask = F.concat(F.array_repeat(F.lit(1), F.least(F.size(ids), F.lit(length))),
                    F.array_repeat(F.lit(0), fill))
    return padded, mask

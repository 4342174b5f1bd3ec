"""Attack tries scored batch by batch (M8, W1, W2, W4): draws, mutation and k-mer sums in one pass of numpy.

A try is ``(iteration, rate)``; tries of one iteration share their draws. Sequences are cut into pieces of ``PIECE``
characters that overlap by k - 1 (``pieces``), dealt out by key and piece, so one very long sequence is work
for many tasks and no task holds more than a batch of pieces. A piece yields its sums per try and class, a few numbers,
and the sums of a sequence are added up by key. No mutated text leaves a task; where one is needed as a
key, its 128-bit digest does.

The integer sums equal those of ``scoring.attack_logits`` (the same draws, in the JVM, one row a position).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codons import BASE_ORDER, CODON_TABLE, MUTATION_BASES, residue_codons
from ..functions.draws import draw_np, draw_of_sum, draw_sum, threshold
from .scoring import MAX_K

PIECE = 3 << 18  # characters of a piece, without the overlap: whole codons
RUN = 1 << 20  # characters worked on together
TRIED = 1 << 16  # characters tried together: their draws and k-mers stay in the processor's cache over the tries
GAP = 0x110000  # no character: fills a text up to a whole codon
CODONS = sorted(CODON_TABLE)  # by number: letters as digits over BASE_ORDER


def pieces(df: DataFrame, seq: str, keys: list[str], k: int = 1, size: int = PIECE) -> DataFrame:
    """``(keys, at, piece, last)``: substrings of ``size + k - 1`` characters every ``size``, so that each k-mer lies in
    exactly one; dealt out by key and piece. An empty or null sequence is one empty piece.

    The number of partitions is given: few bytes may be much work (a piece is tried many times), so they are not put
    together by size.
    """
    s = F.coalesce(F.col(seq), F.lit(""))
    windows = F.greatest(F.length(s) - (k - 1), F.lit(1))
    starts = F.sequence(F.lit(0), (F.floor((windows - 1) / size) * size).cast("int"), F.lit(size))
    cut = df.select(*keys, s.alias("_s"), windows.alias("_n"), F.explode(starts).alias("at"))
    cut = cut.select(*keys, "at", F.substring("_s", F.col("at") + 1, F.lit(size + k - 1)).alias("piece"),
                     (F.col("at") + size >= F.col("_n")).alias("last"))
    return cut.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "at")


def weight_matrix(weights: DataFrame, n_classes: int, k: int) -> np.ndarray:
    """The scorer's ``4**k`` rows as an array, with a row of zeros behind them for k-mers of other letters."""
    if k > MAX_K:
        raise ValueError(f"k = {k}: beyond {MAX_K} the weights are joined, see scoring.kmer_logits")
    out = np.zeros((4 ** k + 1, n_classes), dtype=np.int64)
    for r in weights.collect():  # 4**k rows
        out[r["idx"]] = [r[f"w{c}"] for c in range(n_classes)]
    return out


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets of the texts."""
    lens = np.asarray(pa.compute.utf8_length(texts), dtype=np.int64)
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    if lens.sum() == ends[-1] - ends[0]:  # one byte a character
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        return data[ends[0]:ends[-1]].astype(np.uint32), ends - ends[0]
    offsets = np.concatenate([[0], np.cumsum(lens)])
    raw = "".join(texts.to_pylist()).encode("utf-32-le")
    return np.frombuffer(raw, dtype=np.uint32), offsets


def mutated(chars: np.ndarray, x: np.ndarray, rate: float) -> np.ndarray:
    """The characters with the drawn bases where the draws fire."""
    bases = np.array([ord(b) for b in MUTATION_BASES], dtype=np.uint32)
    return np.where(x < threshold(rate), bases[(x // 1000) % 4], chars)


def codons_mutated(chars: np.ndarray, offsets: np.ndarray, x: np.ndarray, rate: float) -> np.ndarray:
    """The characters with three drawn letters where the draw of their codon fires (``x``: one draw a codon of each text,
    the last one may be short). What fills a last codon up is replaced only then, as one of one or two letters becomes
    one of three."""
    lens = np.diff(offsets)
    count = -(-lens // 3)
    fire = np.flatnonzero(x < threshold(rate))
    owner = np.searchsorted(np.cumsum(count), fire, side="right")
    start = offsets[owner] + 3 * (fire - (np.cumsum(count) - count)[owner])
    bases = np.array([ord(b) for b in MUTATION_BASES], dtype=np.uint32)
    out, drawn = chars.copy(), x[fire]
    for shift in range(3):
        inside = start + shift < offsets[owner + 1]
        out[start[inside] + shift] = bases[(drawn[inside] // (1000 * 4 ** shift)) % 4]
    return out


def codon_places(offsets: np.ndarray, at=0) -> tuple[np.ndarray, np.ndarray]:
    """How many codons each text has, and the place (from 1) of each in its sequence; texts begin at character ``at``."""
    count = -(-np.diff(offsets) // 3)
    return count, np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - at // 3, count) + 1


def whole_codons(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts filled up to whole codons with ``GAP``."""
    lens = np.diff(offsets)
    ends = np.concatenate([[0], np.cumsum(-(-lens // 3) * 3)])
    out = np.full(int(ends[-1]), GAP, dtype=np.uint32)
    out[np.arange(len(chars)) + np.repeat(ends[:-1] - offsets[:-1], lens)] = chars
    return out, ends


def without_gaps(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stay = chars != GAP
    return chars[stay], np.concatenate([[0], np.cumsum(stay)])[offsets]


def codon_numbers(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of every codon of the texts; 64 for a short one and one with other letters than ``ACGT``."""
    whole, _ = whole_codons(chars, offsets)
    code = np.full(128, -64, dtype=np.int32)
    code[[ord(b) for b in BASE_ORDER]] = np.arange(4)
    number = code[np.minimum(whole, 127)].reshape(-1, 3) @ np.array([16, 4, 1], dtype=np.int32)
    return np.where(number < 0, 64, number)


def _synonyms() -> tuple[np.ndarray, np.ndarray]:
    """By codon number: how many codons have its residue, and their numbers in order."""
    size, numbers = np.ones(65, dtype=np.int64), np.full((65, 6), 64, dtype=np.int64)
    lists = residue_codons()
    for n, codon in enumerate(CODONS):
        own = lists[CODON_TABLE[codon]]
        size[n] = len(own)
        numbers[n, :len(own)] = [CODONS.index(c) for c in own]
    return size, numbers


SYNONYMS = _synonyms()
CODON_CHARS = np.array([[ord(b) for b in c] for c in CODONS], dtype=np.uint32)


def back_translated(number: np.ndarray, count: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters and offsets of the texts whose codons (``count`` each) are replaced by a drawn one of their residue;
    codons without a residue are dropped."""
    size, numbers = SYNONYMS
    known = number < 64
    own = number[known]
    new = CODON_CHARS[numbers[own, x[known] % size[own]]].ravel()
    kept = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(count)])]
    return new, kept * 3


def attacked(attack: str, chars: np.ndarray, offsets: np.ndarray, ids: np.ndarray, iteration, rate: float,
             seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters and offsets of the texts after one try (``iteration``: one number, or one a text)."""
    if attack == "nucl":
        count = np.diff(offsets)
        place = np.arange(len(chars)) - np.repeat(offsets[:-1], count) + 1
    else:
        count, place = codon_places(offsets)
    x = draw_of_sum(np.repeat(draw_sum(ids, iteration, 0, seed), count) + draw_sum(0, 0, place))
    if attack == "nucl":
        return mutated(chars, x, rate), offsets
    if attack == "codon":
        whole, ends = whole_codons(chars, offsets)
        return without_gaps(codons_mutated(whole, ends, x, rate), ends)
    if attack == "bt":
        return back_translated(codon_numbers(chars, offsets), count, x)
    raise ValueError(f"unknown attack {attack!r}")


def split_text(chars: np.ndarray, offsets: np.ndarray) -> list[str]:
    text = chars.tobytes().decode("utf-32-le")
    return [text[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def text_array(chars: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if len(chars) and chars.max() > 127:
        return pa.array(split_text(chars, offsets), pa.string())
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)),
                                       pa.py_buffer(chars.astype(np.uint8)))


def runs(lens: np.ndarray, size: int):
    """Consecutive rows with about ``size`` characters together."""
    if not len(lens):
        return
    run = (np.cumsum(lens) - lens) // size
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(lens)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _codes(chars: np.ndarray, size: int) -> np.ndarray:
    code = np.full(128, -size, dtype=np.int32)  # any such letter makes the k-mer's number negative
    code[[ord(b) for b in BASE_ORDER]] = np.arange(4)
    return code[np.minimum(chars, 127)]


def _numbers(c: np.ndarray, offsets: np.ndarray, size: int, k: int) -> np.ndarray:
    """The number of the k-mer at every letter but the last ``k - 1``; ``size`` for other letters and over a text's end."""
    n = max(len(c) - k + 1, 0)
    number = np.zeros(n, dtype=np.int32)
    for j in range(k):
        number *= 4
        number += c[j:j + n]
    number[number < 0] = size
    for j in range(1, k):  # windows over the end of a text
        over = offsets[1:] - j
        number[over[(over >= 0) & (over < n)]] = size
    return number


def _number_sums(number, offsets, weights):
    n, size = len(number), len(weights) - 1
    out = np.zeros((len(offsets) - 1, weights.shape[1]), dtype=np.int64)
    if not n:
        return out
    if (size + 1) * len(out) <= 2 * n:  # k-mers counted per text
        owner = np.repeat(np.arange(len(out), dtype=np.int64) * (size + 1), np.diff(np.minimum(offsets, n)))
        counts = np.bincount(owner + number, minlength=(size + 1) * len(out))
        return counts.reshape(len(out), size + 1) @ weights
    full = np.flatnonzero(offsets[:-1] < np.minimum(offsets[1:], n))
    for y in range(weights.shape[1]):
        out[full, y] = np.add.reduceat(weights[:, y][number], offsets[full])
    return out


def _sums(chars, offsets, weights, k):
    """Per text and class the sum of the weights of its k-mers."""
    size = len(weights) - 1
    return _number_sums(_numbers(_codes(chars, size), offsets, size, k), offsets, weights)


class Clean:
    """The k-mers of clean texts, and the sums of tries that replace some letters: only k-mers over a replaced letter are
    counted anew."""

    def __init__(self, chars: np.ndarray, offsets: np.ndarray, weights: np.ndarray, k: int):
        self.chars, self.offsets, self.weights, self.k = chars, offsets, weights, k
        self.size = len(weights) - 1
        self.code = _codes(chars, self.size)
        self.number = _numbers(self.code, offsets, self.size, k)
        n = len(self.number)
        self.counts = None
        if (self.size + 1) * (len(offsets) - 1) <= 2 * n:  # else the counts are larger than the texts
            self.own = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64) * (self.size + 1),
                                 np.diff(np.minimum(offsets, n)))
            self.counts = np.bincount(self.own + self.number, minlength=(self.size + 1) * (len(offsets) - 1))
        self.inside = np.ones(n, dtype=bool)
        for j in range(1, k):
            over = offsets[1:] - j
            self.inside[over[(over >= 0) & (over < n)]] = False

    def sums_of(self, new: np.ndarray) -> np.ndarray:
        n, k = len(self.number), self.k
        if self.counts is None:
            return _sums(new, self.offsets, self.weights, k)
        counts = self.counts
        other = np.flatnonzero(new != self.chars)
        if len(other):
            code = self.code.copy()
            code[other] = _codes(new[other], self.size)
            mark = np.zeros(len(new) + k - 1, dtype=bool)  # window i is marked at i + k - 1, its last letter
            for j in range(k):
                mark[other + j] = True
            at = np.flatnonzero(mark[k - 1:k - 1 + n] & self.inside)
            number = code[at]
            for j in range(1, k):
                number *= 4
                number += code[at + j]
            number[number < 0] = self.size
            own = self.own[at]
            counts = counts + np.bincount(own + number, minlength=len(counts))
            counts -= np.bincount(own + self.number[at], minlength=len(counts))
        return counts.reshape(-1, self.size + 1) @ self.weights


def _tries(ids: pa.Array, at: pa.Array, texts: pa.Array, tries, weights, k, seed, size, digest, attack="nucl"):
    """Struct array ``(sums, digests)`` of a batch of pieces: T * C numbers and T * 16 bytes a piece."""
    n_classes, n = weights.shape[1], len(texts)
    ids, at = np.asarray(ids, dtype=np.int64), np.asarray(at, dtype=np.int64)
    sums = np.zeros((n, len(tries), n_classes), dtype=np.int64)
    digests = [[b""] * len(tries) for _ in range(n)]
    lens = np.asarray(pa.compute.utf8_length(texts), dtype=np.int64)
    for a, b in runs(lens, min(RUN, TRIED)):
        chars, offsets = characters(texts.slice(a, b - a))
        if attack == "nucl":
            count = lens[a:b]
            place = np.arange(len(chars)) - np.repeat(offsets[:-1] - at[a:b], count) + 1
        else:
            count, place = codon_places(offsets, at[a:b])
        known = np.repeat(draw_sum(ids[a:b], 0, 0, seed), count) + draw_sum(0, 0, place)
        number = codon_numbers(chars, offsets) if attack == "bt" else None
        clean = Clean(chars, offsets, weights, k) if attack != "bt" else None
        drawn: dict[int, np.ndarray] = {}
        for t, (iteration, rate) in enumerate(tries):
            new, ends = chars, offsets
            if rate > 0:
                if iteration not in drawn:
                    drawn = {iteration: draw_of_sum(known + draw_sum(0, iteration, 0))}
                if attack == "bt":
                    new, ends = back_translated(number, count, drawn[iteration])
                elif attack == "codon":
                    new = codons_mutated(chars, offsets, drawn[iteration], rate)
                else:
                    new = mutated(chars, drawn[iteration], rate)
            sums[a:b, t] = _sums(new, ends, weights, k) if clean is None else clean.sums_of(new)
            if digest:
                for i, text in enumerate(split_text(new, offsets)):
                    digests[a + i][t] = hashlib.md5(text[:size].encode()).digest()
    flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (len(tries) * n_classes), sums.ravel())
    return pa.StructArray.from_arrays([flat, pa.array([b"".join(d) for d in digests], pa.binary())],
                                      names=["sums", "digests"])


def try_logits(df: DataFrame, seq: str, row_id: str, keys: list[str], tries: list[tuple[int, float]],
               weights: np.ndarray, k: int = 3, seed: int = 0, digest: bool = False, size: int = PIECE,
               attack: str = "nucl") -> DataFrame:
    """``(row_id, keys..., try, logits[, digest])`` for every row and every try (its place in ``tries``).

    A rate of 0 is the clean sequence. ``attack`` is ``nucl`` (point mutation), ``codon`` or ``bt`` (back-translation; it may
    drop codons, so a sequence is one piece). ``digest`` adds a 128-bit digest of the attacked text, equal for equal texts.
    """
    n_classes = weights.shape[1]
    tries = [(int(i), float(r)) for i, r in tries]

    @F.arrow_udf("struct<sums:array<bigint>,digests:binary>")
    def score(ids: pa.Array, at: pa.Array, texts: pa.Array) -> pa.Array:
        return _tries(ids, at, texts, tries, weights, k, seed, size, digest, attack)

    by = [row_id, *keys]
    if attack != "nucl" and (digest or size % 3):
        raise ValueError("codon tries have no digests, and pieces of whole codons")
    cut = pieces(df, seq, by, k, 3 << 28 if attack == "bt" else size)
    if attack == "codon":
        # the last piece gets empty places up to a whole codon
        gap = F.pmod(-(F.col("at") + F.length("piece")), F.lit(3))
        padded = F.concat("piece", F.repeat(F.lit("\0"), gap))
        cut = cut.withColumn("piece", F.when(F.col("last"), padded).otherwise(F.col("piece")))
    scored = cut.select(
        *by, "at", score(F.col(row_id).cast("bigint"), F.col("at"), F.col("piece")).alias("_r"))
    each = scored.select(*by, "at", "_r", F.explode(F.sequence(F.lit(0), F.lit(len(tries) - 1))).alias("try"))
    cell = [F.get("_r.sums", F.col("try") * n_classes + c).alias(f"l{c}") for c in range(n_classes)]
    part = F.hex(F.substring("_r.digests", F.col("try") * 16 + 1, F.lit(16))).alias("_d")
    each = each.select(*by, "at", "try", *cell, *([part] if digest else []))
    # the digests of a sequence's pieces, in order: one but for sequences beyond a piece
    text = F.unhex(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "_d"))),
                                                  lambda p: p["_d"]), "").cast("binary"))).alias("digest")
    total = each.groupBy(*by, "try").agg(*[F.sum(f"l{c}").alias(f"l{c}") for c in range(n_classes)],
                                         *([text] if digest else []))
    return total.select(*by, "try", F.array(*[F.col(f"l{c}") for c in range(n_classes)]).alias("logits"),
                        *(["digest"] if digest else []))


def mutated_texts(seq, row_id, iteration: int, rates: list[float], seed: int = 0):
    """a Column with the attacked text of each rate; one array of draws serves all of them."""
    rates = [float(r) for r in rates]

    @F.pandas_udf("array<string>")
    def texts(s: pd.Series, ids: pd.Series) -> pd.Series:
        made = []
        ids = ids.to_numpy(dtype=np.int64)
        lens = s.str.len().to_numpy(dtype=np.int64)
        for a, b in runs(lens, RUN):
            chars, offsets = characters(pa.array(s.iloc[a:b].tolist(), pa.string()))
            place = np.arange(len(chars)) - np.repeat(offsets[:-1], lens[a:b]) + 1
            x = draw_np(np.repeat(ids[a:b], lens[a:b]), iteration, place, seed)
            each = [split_text(mutated(chars, x, r), offsets) for r in rates]
            made.extend(map(list, zip(*each, strict=True)))
        return pd.Series(made, index=s.index, dtype=object)

    return texts(F.coalesce(seq, F.lit("")), row_id.cast("bigint"))


def codon_mutated_text(seq, row_id, iteration, rate: float, seed: int = 0):
    """F10 in batches: equal to ``mutation.codon_mutation``; null where an input is null."""

    @F.pandas_udf("string")
    def texts(s: pd.Series, ids: pd.Series, its: pd.Series) -> pd.Series:
        ok = s.notna() & ids.notna() & its.notna()
        rows = pa.array(s[ok].tolist(), pa.string())
        lens = np.asarray(pa.compute.utf8_length(rows), dtype=np.int64)
        ids, its = ids[ok].to_numpy(dtype=np.int64), its[ok].to_numpy(dtype=np.int64)
        made = []
        for a, b in runs(lens, RUN):
            chars, offsets = characters(rows.slice(a, b - a))
            made += split_text(*attacked("codon", chars, offsets, ids[a:b], its[a:b], rate, seed))
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        out[ok] = made
        return out

    return texts(seq, row_id.cast("bigint"), iteration.cast("bigint"))


def _texts(batch: pa.RecordBatch, seq: str, row_id: str, iteration: str | None, tries, seed: int) -> pa.Array:
    """The list of a row's texts, one a try, for a batch of about ``RUN`` characters."""
    given, n = batch.column(seq), batch.num_rows
    ids = batch.column(row_id).cast(pa.int64())
    its = None if iteration is None else batch.column(iteration).cast(pa.int64())
    bad = pa.compute.or_(given.is_null(), ids.is_null())
    if its is not None:
        bad = pa.compute.or_(bad, its.is_null())
    chars, offsets = characters(pa.compute.if_else(bad, "", given))
    ids = np.asarray(ids.fill_null(0))
    its = None if its is None else np.asarray(its.fill_null(0))
    drawn: dict[int, np.ndarray] = {}
    each = []
    for attack, rate, iterations in tries:
        if attack == "nucl" and its is None and len(iterations) == 1:  # tries of one iteration share their draws
            i = iterations[0]
            if i not in drawn:
                place = np.arange(len(chars)) - np.repeat(offsets[:-1], np.diff(offsets)) + 1
                drawn = {i: draw_of_sum(np.repeat(draw_sum(ids, i, 0, seed), np.diff(offsets)) + draw_sum(0, 0, place))}
            new, ends = mutated(chars, drawn[i], rate), offsets
        else:
            new, ends = chars, offsets
            for i in iterations if its is None else [its]:
                new, ends = attacked(attack, new, ends, ids, i, rate, seed)
        # without a row id no draw fires, and no codon is chosen
        same = pa.nulls(n, pa.string()) if its is not None else given if attack != "bt" else pa.compute.if_else(
            given.is_null(), pa.scalar(None, pa.string()), "")
        each.append(pa.compute.if_else(bad, same, text_array(new, ends)))
    flat = pa.concat_arrays([e.cast(pa.string()) for e in each])
    by_row = np.arange(n * len(tries)).reshape(len(tries), n).T.ravel()
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(tries), flat.take(pa.array(by_row)))


def attacked_texts(df: DataFrame, seq: str, row_id: str, tries: list[tuple], out: str = "t", seed: int = 0,
                   iteration: str | None = None) -> DataFrame:
    """``df`` with ``out``: the attacked texts, one a try ``(attack, rate, iterations)``.

    The iterations of a try compound (F12). With ``iteration``, a column, a row has its own one instead. Texts are made
    and handed on run by run, so a task holds an input batch and one run of results. A null text stays null; without a
    row id no draw fires (F9, F10) and no codon is chosen (F11); without its own iteration a row has a null.
    """
    tries = [(a, float(r), [int(i) for i in its]) for a, r, its in tries]

    def build(batches):
        for batch in batches:
            lens = np.asarray(pa.compute.utf8_length(batch.column(seq).fill_null("")), dtype=np.int64)
            for a, b in runs(lens, RUN):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(part, seq, row_id, iteration, tries, seed)],
                                                 names=[*part.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    return df.mapInArrow(build, schema)

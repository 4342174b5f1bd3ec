"""Periodic runs of words, found on a grammar.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length at least
``max(SHORTEST, EXPONENT * q)`` that no neighbouring word extends keeping period q. The words of a batch of documents
become ids and are compressed together:

1. Re-Pair in rounds: pairs of neighbouring symbols are counted, and each pair that occurs twice or more, and is
   more frequent than the pairs it overlaps, becomes a nonterminal; what is left when no pair repeats is paired up
   level by level, so that each document has one root. Pairs never cross documents.
2. A run of a text lies in one lowest node of its derivation tree, whose boundary it crosses. So for each nonterminal,
   once, the maximal runs of its expansion that cross its boundary are computed: a stretch of equalities x[i] = x[i+q] of
   at least three periods must hold the first or the last of the q equalities at the boundary, and is extended from
   there by doubling and halving over prefix fingerprints.
3. These intervals are translated to every position at which the nonterminal is derived (each replacement is one), and
   intervals of one period that overlap by a period are merged into maximal ones. Of equal intervals the smallest
   period stays: two periods of an interval of four periods have a common divisor as period.

Every run is checked word by word at the end, so nothing rests on fingerprints alone.

Defined cases: null and empty texts have no words and no runs; one very long text is one batch; repeated rows give
repeated results; an empty table gives an empty result; input columns named like a result are replaced. Work is map-only;
a task holds one batch of about 4 MB (or one longer text) and arrays of a few numbers a word.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns, mix

SHORTEST, EXPONENT = 6, 4
BATCH = 4 << 20  # bytes of text a batch
_BLOCK = 1 << 20  # (nonterminal, period) pairs looked at together

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FIELDS = [("n_words", T.LongType()), ("n_runs", T.LongType()), ("best", RUN), ("runs", T.ArrayType(RUN)),
          ("collapsed", T.StringType())]

#: Two primes below 2^31 and a base for each.
_FIELDS2 = ((2147483647, 1103515245), (2147483629, 1664525))


class Fingerprints:
    """Equality of substrings of a word-id sequence through prefix sums modulo two primes."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.parts = []
        for k, (p, base) in enumerate(_FIELDS2):
            power = np.ones(n + 1, dtype=np.uint64)
            done = 1
            while done <= n:
                step = min(done, n + 1 - done)
                power[done:done + step] = power[:step] * np.uint64(pow(base, done, p)) % np.uint64(p)
                done += step
            value = mix(x.astype(np.uint64) + np.uint64(k << 40)) % np.uint64(p)
            prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(value * power[:n] % np.uint64(p), out=prefix[1:])
            self.parts.append((np.uint64(p), power, prefix % np.uint64(p)))

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether x[i:i+size] equals x[j:j+size], for i <= j."""
        out = np.ones(len(i), dtype=bool)
        for p, power, prefix in self.parts:
            left = (prefix[i + size] + p - prefix[i]) % p
            right = (prefix[j + size] + p - prefix[j]) % p
            out &= left * power[j - i] % p == right
        return out

    def forward(self, i, j, limit):
        """Common prefix lengths of x[i:] and x[j:], at most ``limit``."""
        return self._extend(limit, lambda rows, size: self.equal(i[rows], j[rows], size))

    def backward(self, i, j, limit):
        """Common suffix lengths of x[:i] and x[:j], at most ``limit``."""
        return self._extend(limit, lambda rows, size: self.equal(i[rows] - size, j[rows] - size, size))

    @staticmethod
    def _extend(limit, same):
        low = np.zeros(len(limit), dtype=np.int64)
        high = limit.astype(np.int64)
        rows, step = np.flatnonzero(high > 0), 1
        while len(rows):  # double while equal
            size = np.minimum(step, high[rows])
            ok = same(rows, size)
            low[rows[ok]] = size[ok]
            high[rows[~ok]] = size[~ok] - 1
            rows = rows[ok & (low[rows] < high[rows])]
            step *= 2
        rows = np.flatnonzero(low < high)
        while len(rows):  # then halve
            size = (low[rows] + high[rows] + 1) // 2
            ok = same(rows, size)
            low[rows[ok]] = size[ok]
            high[rows[~ok]] = size[~ok] - 1
            rows = rows[low[rows] < high[rows]]
        return low


def _kinds(key: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the values of ``key``, in rising order."""
    n = len(key)
    bits = max(n, 1).bit_length()
    if n and int(key.max()).bit_length() + bits < 64:  # values and places sort as one number
        packed = np.sort((key << bits) | np.arange(n))
        order, ranked = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
    kinds = np.empty(n, dtype=np.int64)
    kinds[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]][:n])
    return kinds


class Grammar:
    """Nonterminals of the sequences ``x`` (cut at ``bounds``) and the positions at which they are derived.

    ``first``, ``mid`` and ``end`` bound one expansion of each nonterminal and its two halves in ``x``; ``node`` and
    ``place`` list every derivation.
    """

    def __init__(self, x: np.ndarray, bounds: np.ndarray):
        symbol = x.astype(np.int64)
        place = np.arange(len(x), dtype=np.int64)
        self.end_of = np.repeat(bounds[1:], np.diff(bounds))  # end of the sequence that holds a position
        self.terminals = self.next = int(x.max()) + 1 if len(x) else 0
        self.first, self.mid, self.end, self.node, self.place = [], [], [], [], []
        while len(symbol) > 1:
            a, kinds = self._repeated(symbol, place)
            if not len(a):
                break
            symbol, place = self._replace(symbol, place, a, kinds)
        while len(symbol) > 1:  # the rest of each document, paired up
            owner = self.end_of[place]
            fresh = np.r_[True, owner[1:] != owner[:-1]]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(symbol)), 0))
            a = np.flatnonzero(((np.arange(len(symbol)) - begin) % 2 == 0)[:-1] & ~fresh[1:])
            if not len(a):
                break
            kinds = _kinds(self._pairs(symbol, a))
            symbol, place = self._replace(symbol, place, a, kinds)
        for c in ("first", "mid", "end", "node", "place"):
            got = getattr(self, c)
            setattr(self, c, np.concatenate(got) if got else np.zeros(0, dtype=np.int64))

    def _pairs(self, symbol, a):
        return symbol[a] * self.next + symbol[a + 1]

    def _repeated(self, symbol, place):
        """Starts and kinds of the pairs to replace in this round."""
        n = len(symbol) - 1
        inside = self.end_of[place[:-1]] == self.end_of[place[1:]]
        key = self._pairs(symbol, np.arange(n))
        kinds = _kinds(key)
        counts = np.bincount(kinds)
        weight = np.where(inside, counts[kinds], 0)
        # the more frequent of two overlapping pairs wins; ties go by a scattered number, so that a repeated passage,
        # whose pairs are all as frequent, shrinks by a share a round and not by one pair
        lot = mix(kinds.astype(np.uint64))
        ahead = (weight[:-1] > weight[1:]) | ((weight[:-1] == weight[1:]) & (lot[:-1] < lot[1:]))
        same = (kinds[:-1] == kinds[1:]) & inside[:-1] & inside[1:]
        wins = weight >= 2
        wins[:-1] &= ahead | same
        wins[1:] &= ~ahead | same
        # in a stretch of one pair (x x x ...), every other one
        at = np.arange(n)
        new = np.r_[True, ~same] if n else np.zeros(0, dtype=bool)
        wins &= (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0
        a = np.flatnonzero(wins)
        # a rule needs two uses
        used = np.bincount(kinds[a], minlength=len(counts))
        a = a[used[kinds[a]] >= 2]
        return a, (np.cumsum(used >= 2) - 1)[kinds[a]]

    def _replace(self, symbol, place, a, kinds):
        one = np.empty(int(kinds.max()) + 1, dtype=np.int64)
        one[kinds[::-1]] = np.arange(len(kinds) - 1, -1, -1)  # the first use of each kind
        ends = np.r_[place[1:], 0]
        lasts = np.flatnonzero(np.r_[self.end_of[place[1:]] != self.end_of[place[:-1]], True])
        ends[lasts] = self.end_of[place[lasts]]
        self.first.append(place[a[one]])
        self.mid.append(place[a[one] + 1])
        self.end.append(ends[a[one] + 1])
        self.node.append(kinds + (self.next - self.terminals))
        self.place.append(place[a])
        symbol = symbol.copy()
        symbol[a] = self.next + kinds
        self.next += len(one)
        stay = np.ones(len(symbol), dtype=bool)
        stay[a + 1] = False
        return symbol[stay], place[stay]


def _crossing(x: np.ndarray, marks: Fingerprints, g: Grammar):
    """Node, start (from the node's first word), length and period of the runs across each nonterminal's boundary."""
    most = (g.end - g.first) // EXPONENT  # periods that fit
    nodes = np.flatnonzero((most > 0) & (g.end - g.first >= SHORTEST))
    most = most[nodes]
    found = []
    total = np.cumsum(most)
    at = 0
    while at < (int(total[-1]) if len(total) else 0):
        stop = min(at + _BLOCK, int(total[-1]))
        flat = np.arange(at, stop)
        row = np.searchsorted(total, flat, side="right")
        q = flat - (total[row] - most[row]) + 1
        at = stop
        node = nodes[row]
        for side in ("first", "last"):
            # the equality x[i] = x[i + q] at either end of the boundary's window
            i = g.mid[node] - (q if side == "first" else 1)
            ok = (i >= g.first[node]) & (i + q < g.end[node])
            n, p, i = node[ok], q[ok], i[ok]
            ok = x[i] == x[i + p]
            n, p, i = n[ok], p[ok], i[ok]
            # at least three equalities in a row hold this one
            low, high = g.first[n], g.end[n] - p - 1
            left = (i - 1 >= low) & (x[np.maximum(i - 1, 0)] == x[np.maximum(i - 1, 0) + p])
            left2 = left & (i - 2 >= low) & (x[np.maximum(i - 2, 0)] == x[np.maximum(i - 2, 0) + p])
            r1, r2 = np.minimum(i + 1, high), np.minimum(i + 2, high)
            right = (i + 1 <= high) & (x[r1] == x[r1 + p])
            right2 = right & (i + 2 <= high) & (x[r2] == x[r2 + p])
            ok = left2 | right2 | (left & right)
            n, p, i = n[ok], p[ok], i[ok]
            if not len(n):
                continue
            back = marks.backward(i, i + p, i - g.first[n])
            on = marks.forward(i, i + p, g.end[n] - i - p)
            size = back + on + p
            ok = size >= np.maximum(SHORTEST, EXPONENT * p)
            found.append(np.stack([n[ok], (i - back - g.first[n])[ok], size[ok], p[ok]]))
    if not found:
        return np.zeros((4, 0), dtype=np.int64)
    got = np.unique(np.concatenate(found, axis=1), axis=1)
    keep = np.ones(got.shape[1], dtype=bool)  # the smallest period of an interval comes first
    keep[1:] = (got[:3, 1:] != got[:3, :-1]).any(axis=0)
    return got[:, keep]


def _derived(g: Grammar, found: np.ndarray) -> np.ndarray:
    """The intervals at every derivation: start, end, period."""
    counts = np.bincount(found[0], minlength=len(g.first))
    hits = np.flatnonzero(counts[g.node] > 0)
    node, place = g.node[hits], g.place[hits]
    begin = np.cumsum(counts) - counts
    reps = counts[node]
    k = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(begin[node], reps)
    start = np.repeat(place, reps) + found[1, k]
    return np.stack([start, start + found[2, k], found[3, k]])


def _merged(got: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Maximal intervals of each period and document (start, end, period), each with its smallest period, in order."""
    doc = np.searchsorted(bounds, got[0], side="right")
    order = np.lexsort((got[0], got[2], doc))
    doc, (start, end, period) = doc[order], got[:, order]
    group = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (period[1:] != period[:-1])]) - 1
    wide = np.int64(bounds[-1] + 1)
    reach = np.maximum.accumulate(group * wide + end) - group * wide  # furthest end so far in the group
    fresh = np.r_[True, (group[1:] != group[:-1]) | (start[1:] + period[1:] > reach[:-1])]
    heads = np.flatnonzero(fresh)
    start, period = start[heads], period[heads]
    end = reach[np.r_[heads[1:], len(fresh)] - 1]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    one = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
    start, end, period = start[one], end[one], period[one]
    order = np.lexsort((period, start))
    return np.stack([start[order], end[order], period[order]])


def _check(x: np.ndarray, runs: np.ndarray) -> None:
    """Every run's words, compared."""
    size = runs[1] - runs[0] - runs[2]
    total = np.cumsum(size)
    at = 0
    while at < (int(total[-1]) if len(total) else 0):
        stop = min(at + _BLOCK, int(total[-1]))
        flat = np.arange(at, stop)
        row = np.searchsorted(total, flat, side="right")
        i = flat - (total[row] - size[row]) + runs[0, row]
        if (x[i] != x[i + runs[2, row]]).any():
            raise RuntimeError("two different word sequences have equal fingerprints")
        at = stop


def find(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs (start, end, period; by start, then period) of the sequences of ``x`` between ``bounds``."""
    x, bounds = np.asarray(x, dtype=np.int64), np.asarray(bounds, dtype=np.int64)
    if not len(x):
        return np.zeros((3, 0), dtype=np.int64)
    g = Grammar(x, bounds)
    got = _derived(g, _crossing(x, Fingerprints(x), g))
    if not got.shape[1]:
        return got
    runs = _merged(got, bounds)
    _check(x, runs)
    return runs


def _best(runs: np.ndarray) -> int:
    """Column of the greatest length / period; the smallest start, then period, among ties."""
    size = runs[1] - runs[0]
    ratio = size / runs[2]
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9))
    return max(near.tolist(), key=lambda k: (Fraction(int(size[k]), int(runs[2, k])), -runs[0, k], -runs[2, k]))


def words(texts: pa.Array) -> pa.ListArray:
    """Words between ASCII white space (null texts: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(np.asarray(full))])
    offsets = np.asarray(lists.offsets) - int(lists.offsets[0].as_py())
    return pa.LargeListArray.from_arrays(pa.array(kept[offsets], pa.int64()), flat.filter(full))


def _batch(texts: pa.Array) -> list[pa.Array]:
    lists = words(texts)
    flat, bounds = lists.values, np.asarray(lists.offsets)
    x = np.asarray(pc.dictionary_encode(flat).indices) if len(flat) else np.zeros(0, dtype=np.int64)
    runs = find(x, bounds)
    start, end, period = runs
    doc = np.searchsorted(bounds, start, side="right") - 1
    n = len(bounds) - 1
    counts = np.bincount(doc, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    kinds = [pa.field(f.name, pa.int64()) for f in RUN.fields]
    rows = pa.StructArray.from_arrays([pa.array(start - bounds[doc]), pa.array(end - start), pa.array(period)],
                                      fields=kinds)
    first = [_best(runs[:, a:b]) + a if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    # words that a run covers behind its first period
    change = np.zeros(len(x) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    stay = np.cumsum(change)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(stay)])
    kept = pa.LargeListArray.from_arrays(pa.array(left[bounds], pa.int64()), flat.filter(pa.array(stay)))
    return [pa.array(np.diff(bounds)), pa.array(counts.astype(np.int64)), rows.take(pa.array(first, pa.int64())),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows),
            pc.binary_join(kept, pa.scalar(" ", pa.large_string()))]


def detect(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_words``, ``n_runs``, ``best`` (the run of the greatest exponent), ``runs`` and ``collapsed`` (the
    words that no run covers behind its first period, joined by one space) to ``keep`` (default: all columns)."""
    return map_columns(df, text, FIELDS, lambda: lambda batch: _batch(batch.column(text)), limit=BATCH, keep=keep)

"""Byte-level BPE: encoding by a bounded-lookahead transducer, decoding by a byte-to-text state machine.

Encoding. Text is cut at special tokens and by the vocabulary's split pattern;
each piece goes through the transducer. Merges act on adjacent tokens in rank
order, so bytes further right can change a token only through a chain of merges
that reaches it. ``lookahead`` bounds that reach from the merge list alone: if
the merge of rank r joins u and v, a difference at the start of v moves left by
len(u); it can only act there if the token at that place was made by an earlier
merge of the chain and lies on the left spine of v (v, its left part, and so
on). The longest such chain, weighted by len(u), is a sufficient lookahead: a
token that ends that many bytes before the end of what was read is stable. The
transducer reads a block, merges it, emits the stable tokens and goes on with
the rest, so memory is one block however long the piece is. Short
pieces are merged many at once, and a memo of short words, bounded in bytes, holds
the results. A long text is encoded part by part, cut where a piece always starts,
so word lists are those of one part.

Decoding. Token bytes are fed to an incremental UTF-8 machine that keeps the
open bytes of a character between tokens; malformed bytes become U+FFFD.

Null text counts as empty: no tokens. Null ids decode to the empty text.
"""

from __future__ import annotations

import codecs
import heapq
import json
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns

#: The split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What the split pattern's library calls white space (the Unicode property).
SPACES = r"\t-\r\x20\x85\xA0  -     　"

MEMO_BYTES = 64 << 20  # of the words that a task remembers
ENTRY = 100  # bytes of a dictionary entry beside its key and value
PART = 1 << 20  # characters of a long text that are split into words together, about
SHORT = 64  # bytes; pieces up to here are merged many at once, longer ones go through the transducer's blocks
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """Vocabulary character -> byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge list and token bytes of a byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.lookahead = sufficient_lookahead(self.merges, self.bytes_of)


def sufficient_lookahead(merges: list[tuple[int, int, int]], bytes_of: dict[int, bytes]) -> int:
    """Bytes that must follow a token for it to be stable, from the merge list alone."""
    left_of: dict[int, int] = {}
    reach: dict[int, int] = {}  # token u -> longest chain so far whose last merge has u as its left part
    most = 0
    for a, b, made in merges:
        token, chain = b, 0
        while token is not None:
            chain = max(chain, reach.get(token, 0))
            token = left_of.get(token)
        chain += len(bytes_of[a])
        reach[a] = max(reach.get(a, 0), chain)
        left_of.setdefault(made, a)
        most = max(most, chain)
    return most + max(map(len, bytes_of.values()))


class Encoder:
    """The transducer: text in, packed ids (little-endian unsigned 32-bit) out.

    A space between two characters that are not white space always starts a
    piece, so what stands between such spaces is encoded on its own and
    remembered; other texts go piece by piece.
    """

    def __init__(self, single: list[int], merges: list[tuple[int, int, int]], special: dict[str, int],
                 sizes: dict[int, int], lookahead: int):
        self.single, self.special, self.sizes, self.lookahead = single, special, sizes, lookahead
        self.bytes_to_ids = np.array(single, dtype=np.int32)
        self.rank = {(a << 32 | b): (r, made) for r, (a, b, made) in reversed(list(enumerate(merges)))}
        keys = np.array(list(self.rank), dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.rank.values()], dtype=np.int32)[order]
        self.made = np.array([m for _, _, m in sorted((a << 32 | b, r, m) for r, (a, b, m) in enumerate(merges)
                                                       if self.rank[a << 32 | b][0] == r)], dtype=np.int32)
        every = np.broadcast_to(self.bytes_to_ids, (256, 256))
        self.rank_of_bytes, self.place_of_bytes = self._pairs(every.T, every)
        self.block = max(4 * lookahead, 4096)
        self.split = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]")
                                   .replace(r"\S", f"[^{SPACES}]"))
        self.spaces = frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{SPACES}]", c))
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
                                 or r"(?!)")
        self.words: dict[str, bytes | None] = {}  # what follows a space -> packed ids; None: needs its neighbours
        self.held = 0  # bytes of the words remembered

    # -- merging

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or a large number) and place in the merge table of each pair of ids; ids below 0 pair with nothing."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1).astype(np.int32)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE), at

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Tokens of many short pieces at once: each round does every piece's lowest-ranked, leftmost merge."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        order = np.argsort(sizes, kind="stable")
        edges = np.searchsorted(sizes[order], [0, 4, 6, 8, 10, 12, 16, 24, 32, SHORT], side="right")
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for start in range(lo, hi, 1 << 14):
                rows = order[start:min(hi, start + (1 << 14))]
                if len(rows):
                    self._merge_rows([pieces[i] for i in rows], rows, out)
        for i in order[edges[-1]:].tolist():
            out[i] = self.transduce(pieces[i])
        return out

    def _merge_rows(self, pieces: list[bytes], rows: np.ndarray, out: list[bytes]) -> None:
        n, width = len(pieces), max(map(len, pieces))
        data = np.array(pieces, dtype=f"S{width}").view(np.uint8).reshape(n, width)
        sizes = np.fromiter(map(len, pieces), dtype=np.int32, count=n)
        inside = np.arange(width) < sizes[:, None]
        ids = np.where(inside, self.bytes_to_ids[data], -1)
        rank = np.where(inside[:, 1:], self.rank_of_bytes[data[:, :-1], data[:, 1:]], NONE)
        at = self.place_of_bytes[data[:, :-1], data[:, 1:]]
        while len(ids):
            if ids.shape[1] > 1:
                best = rank.argmin(axis=1)
                line = np.arange(len(ids))
                going = rank[line, best] != NONE
            else:
                going = np.zeros(len(ids), dtype=bool)
            if not going.all():
                over = ids[~going]
                own = over >= 0
                ends = (np.cumsum(own.sum(axis=1)) * 4).tolist()
                flat = over[own].astype("<u4").tobytes()
                for i, a, b in zip(rows[~going].tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[a:b]
                if not going.any():
                    return
                rows, ids, rank, at, best = rows[going], ids[going], rank[going], at[going], best[going]
                line = np.arange(len(ids))
            ids[line, best] = self.made[at[line, best]]
            take = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, take + (take > best[:, None]), axis=1)
            if ids.shape[1] < 2:
                continue
            take = take[:-1] + (take[:-1] >= best[:, None])
            rank, at = np.take_along_axis(rank, take, axis=1), np.take_along_axis(at, take, axis=1)
            for side in (best, best - 1):
                own = (side >= 0) & (side < ids.shape[1] - 1)
                i, j = line[own], side[own]
                rank[i, j], at[i, j] = self._pairs(ids[i, j], ids[i, j + 1])

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a block on its own: lowest rank first, leftmost first."""
        ids = [self.single[b] for b in data]
        rank, n = self.rank, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got[0], i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (got := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i] = rank[a << 32 | b][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (got := rank.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (got[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (got := rank.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (got[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def transduce(self, piece: bytes) -> bytes:
        """Read a piece block by block and emit each token once it is stable."""
        out, start, n = [], 0, len(piece)
        while start < n:
            end = min(n, start + self.block)
            ids = self.merge(piece[start:end])
            if end < n:
                ends = np.cumsum([self.sizes[i] for i in ids])
                ids = ids[:int(np.searchsorted(ends, end - start - self.lookahead, side="right"))]
                start += int(ends[len(ids) - 1])
            else:
                start = n
            out.append(np.array(ids, dtype="<u4").tobytes())
        return b"".join(out)

    # -- texts

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that are cut by the split pattern, all their pieces merged together."""
        cut = [self.split.findall(t) for t in texts]
        distinct = list({p for c in cut for p in c})
        ids = dict(zip(distinct, self.merge_many([p.encode("utf-8") for p in distinct]), strict=True))
        return [b"".join([ids[p] for p in c]) for c in cut]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Packed ids of words that each follow a space; only a word's first piece starts with that space."""
        if not words:
            return []
        pieces = self.split.findall(" " + " ".join(words))
        distinct = list(set(pieces))
        ids = dict(zip(distinct, self.merge_many([p.encode("utf-8") for p in distinct]), strict=True))
        packed = [ids[p] for p in pieces]
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        return [packed[a] if b == a + 1 else b"".join(packed[a:b])
                for a, b in zip(starts, [*starts[1:], len(pieces)], strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                at, parts = 0, []
                for m in self.cut.finditer(text):
                    parts += [self.encode_batch([text[at:m.start()]])[0],
                              np.array([self.special[m[0]]], dtype="<u4").tobytes()]
                    at = m.end()
                out[i] = b"".join([*parts, self.encode_batch([text[at:]])[0]])
            elif len(text) > PART:
                out[i] = b"".join([self._plain([part])[0] for part in self.parts(text)])
            else:
                plain.append((i, text))
        for (i, _), ids in zip(plain, self._plain([t for _, t in plain]), strict=True):
            out[i] = ids
        return out

    def parts(self, text: str):
        """Parts of a long text, each cut before a space between two characters that are not white space."""
        start, last = 0, len(text) - 1
        while last - start > PART:
            at = text.find(" ", start + PART, last)
            while at > 0 and (text[at - 1] in self.spaces or text[at + 1] in self.spaces):
                at = text.find(" ", at + 1, last)
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts without special tokens."""
        split = [t.split(" ") for t in texts]
        words, slow = self.words, []
        new = set().union(*(p[1:] for p in split)) - words.keys() if split else set()
        alone = [w for w in new if w and w[0] not in self.spaces and w[-1] not in self.spaces]
        words.update(dict.fromkeys(new))
        words.update(zip(alone, self._spaced(alone), strict=True))
        out = self._pieces([p[0] for p in split])
        for i, parts in enumerate(split):
            if len(parts) == 1:
                continue
            tail = [words[w] for w in parts[1:]]
            if None in tail or not parts[0] or parts[0][-1] in self.spaces:
                slow.append(i)
            else:
                out[i] += b"".join(tail)
        for i, got in zip(slow, self._pieces([texts[i] for i in slow]), strict=True):
            out[i] = got
        self._remember(new)
        return out

    def _remember(self, new: set[str]) -> None:
        """Of words just met, keep the short ones; beyond the memo's bound, begin anew."""
        for w in new:
            if len(w) > SHORT:
                del self.words[w]
            else:
                self.held += ENTRY + sys.getsizeof(w) + sys.getsizeof(self.words[w])
        if self.held > MEMO_BYTES:
            self.words.clear()
            self.held = 0

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]


class Decoder:
    """Incremental byte-to-text machine over token ids."""

    STEP = 1 << 16  # ids turned into bytes at a time

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of

    def decode(self, ids: np.ndarray) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        look = self.bytes_of.get
        out = [machine.decode(b"".join([look(i, b"") for i in ids[a:a + self.STEP].tolist()]))
               for a in range(0, len(ids), self.STEP)]
        return "".join([*out, machine.decode(b"", True)])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_tokens`` (long) and ``token_ids`` (binary, little-endian unsigned 32-bit ids) of ``text``.

    Columns of the same names are replaced; null and empty texts have no tokens. The vocabulary (a fixed file, its
    size does not follow the data) is broadcast.
    """
    spec = (vocabulary.single, vocabulary.merges, vocabulary.special,
            {i: len(b) for i, b in vocabulary.bytes_of.items()}, vocabulary.lookahead)
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def start():
        encoder = Encoder(*shared.value)

        def fn(batch):
            ids = encoder.encode_batch(batch.column(text).to_pylist())
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

        return fn

    return map_columns(df, text, [("n_tokens", T.LongType()), ("token_ids", T.BinaryType())], start,
                       limit=4 << 20, keep=keep)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Append ``decoded`` (string): the text of the packed ids in ``ids``; ids outside the vocabulary add nothing."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.bytes_of)

    def start():
        decoder = Decoder(shared.value)

        def fn(batch):
            return [[decoder.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column(ids).to_pylist()]]

        return fn

    return map_columns(df, ids, [("decoded", T.StringType())], start, limit=8 << 20, keep=keep)

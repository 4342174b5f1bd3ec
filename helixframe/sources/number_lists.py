"""Lists of numbers in the records of a JSON text (S4), read in numpy: zeros cost a byte pass, not a row each."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run of lists (``n`` of them, ``least`` numbers in the shortest; of each list the count of its non-zero numbers, and of
#: these the place in the list and the value), or else another record's text.
LISTS = ("file string, block bigint, line bigint, sub int, value string, n int, least int, "
         "counts array<int>, places array<int>, numbers array<double>")
CELLS = "r int, c int, abundance double"

_STEP = 1 << 21  # bytes looked at together: what the CPU's cache holds
_DIGIT, _OPEN, _ODD = 1, 2, 3
_CLASS = np.full(256, _ODD, np.uint8)  # of the bytes above '0' and below '+'
_CLASS[np.frombuffer(b" \t\n\r\f\veE", np.uint8)] = 0
_CLASS[ord("1"):ord("9") + 1] = _DIGIT
_CLASS[ord("[")] = _OPEN
_DATA = re.compile(rb'(?<!\\)"data"\s*:\s*\[')
_LIST = re.compile(rb"\s*,?\s*\[[-+0-9.eE,\s]*")


def _places(mask: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` places that are true, looked for eight at a time; the length of ``mask`` is a multiple of 8."""
    mask[n:] = False
    eights = np.flatnonzero(mask.view(np.uint64))
    eight, one = np.nonzero(mask.reshape(-1, 8)[eights])
    return eights[eight] * 8 + one


class _Commas:
    """Number of commas before a place, from the population counts of 64 bytes each."""

    def __init__(self, buf: np.ndarray):
        is_comma = buf == ord(",")
        twice = is_comma[1:] & is_comma[:-1]
        self.doubled = np.flatnonzero(twice) if twice.any() else np.empty(0, np.int64)
        bits = np.zeros((len(buf) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(is_comma, bitorder="little")
        bits[:len(packed)] = packed
        self.words = bits.view(np.uint64)
        self.sums = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.sums[1:], dtype=np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        w, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[w] + np.bitwise_count(self.words[w] & low)


def _tokens(buf: np.ndarray, at: np.ndarray, limit: np.ndarray) -> pa.Array:
    """The numbers around the places ``at``, whose records end at ``limit``."""
    start, end = at.copy(), at + 1
    todo = np.arange(len(at))
    while len(todo):
        b = buf[start[todo] - 1]
        todo = todo[(b != ord(",")) & (b != ord("["))]
        start[todo] -= 1
    todo = np.flatnonzero(end < limit)
    while len(todo):
        todo = todo[buf[end[todo]] != ord(",")]
        end[todo] += 1
        todo = todo[end[todo] < limit[todo]]
    length = end - start
    offsets = np.zeros(len(at) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    flat = buf[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    texts = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return pc.cast(pc.ascii_trim_whitespace(texts), pa.float64())


def _parse(buf: np.ndarray, offs: np.ndarray):
    """Which records are lists of numbers, and of those: sizes, counts of non-zero numbers, their places and values."""
    n, begin = len(offs) - 1, offs[:-1]
    above = np.empty(-(-len(buf) // 8) * 8, np.uint8)
    np.subtract(buf, np.uint8(ord("+")), out=above[:len(buf)])
    at = _places(above > ord("0") - ord("+"), len(buf))  # not + , - . / 0
    kind = _CLASS[buf[at]]
    at, kind = at[kind > 0], kind[kind > 0]
    rec = np.searchsorted(offs, at, "right") - 1
    opened = kind == _OPEN
    is_list = (np.bincount(rec[kind == _ODD], minlength=n) == 0) & (np.bincount(rec[opened], minlength=n) == 1)
    bracket = begin.copy()
    bracket[rec[opened]] = at[opened]
    for i in np.flatnonzero(is_list & (bracket > begin)) if not _plain(buf, begin, bracket, is_list) else ():
        is_list[i] = bytes(buf[begin[i]:bracket[i]]).strip() in (b"", b",")
    commas = _Commas(buf)
    sizes = commas.before(offs[1:]) - commas.before(bracket) + 1
    if len(commas.doubled) and is_list[np.searchsorted(offs, commas.doubled, "right") - 1].any():
        raise ValueError("a list of numbers holds an empty place")
    digit = (kind == _DIGIT) & is_list[rec]
    at, rec = at[digit], rec[digit]
    place = commas.before(at) - commas.before(bracket)[rec]
    new = np.ones(len(at), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (place[1:] != place[:-1])
    at, rec, place = at[new], rec[new], place[new]
    values = _tokens(buf, at, offs[1:][rec]).to_numpy(zero_copy_only=False)
    some = values != 0
    counts = np.bincount(rec[some], minlength=n)
    return is_list, sizes, counts.astype(np.int32), place[some].astype(np.int32), values[some]


def _plain(buf, begin, bracket, is_list) -> bool:
    """Whether all lists begin at once, behind one comma or behind a line end and one comma."""
    gap = (bracket - begin)[is_list]
    if not len(gap) or gap.max() > 2:
        return False
    b = begin[is_list]
    one = (gap == 1) & (buf[b] == ord(","))
    two = (gap == 2) & (buf[b] == ord("\n")) & (buf[np.minimum(b + 1, len(buf) - 1)] == ord(","))
    return bool(((gap == 0) | one | two).all())


def _rows(values, offs, a, b, lines):
    """LISTS without the file and block of the records ``a`` to ``b``, in order; blank records are left out."""
    buf, own = values[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
    is_list, sizes, counts, places, numbers = _parse(buf, own)
    ends = np.concatenate([[0], np.cumsum(counts)])

    def run(i, j):
        lists = np.flatnonzero(is_list[i:j]) + i
        if len(lists):
            part = slice(ends[i], ends[j])
            yield (lines[a + lists[0]], 1, None, len(lists), int(sizes[lists].min()), counts[lists], places[part], numbers[part])

    i = 0
    for j in np.flatnonzero(~is_list):
        text = bytes(buf[own[j]:own[j + 1]])
        if not text.strip():
            continue
        yield from run(i, j)
        i = j + 1
        key = list(_DATA.finditer(text))[-1:] if b'"data"' in text else []
        rest = text[key[0].end():] if key else b""
        first = bool(_LIST.fullmatch(rest))  # the first list follows its key without a closing bracket between
        yield (lines[a + j], 0, (text[:key[0].end()] if first else text).decode(), *[None] * 5)
        if first:
            _, size, count, place, number = _parse(np.frombuffer(rest, np.uint8), np.array([0, len(rest)]))
            yield (lines[a + j], 1, None, 1, int(size[0]), count, place, number)
    yield from run(i, b - a)


def number_lists(batches):
    """Records ``(value, file, block, line)`` in Arrow batches -> LISTS."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.list_(pa.float64())]
    names = [x.split()[0] for x in LISTS.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(0).cast(pa.large_binary())
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        values = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        files = batch.column(1).dictionary_encode()
        file, block, lines = files.indices.to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        a = 0
        for edge in [*edges, len(texts)]:
            while a < edge:
                b = min(max(np.searchsorted(offs, offs[a] + _STEP, "right") - 1, a + 1), edge)
                rows = [(files.dictionary[file[a]].as_py(), block[a], *r) for r in _rows(values, offs, a, b, lines)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types,
                                                                                        strict=True)], names=names)
                a = b


def list_cells(dense: bool):
    """Runs of lists ``(first, counts, places, numbers)`` -> their non-zero cells ``(r, c, abundance)``: a dense list is the
    row of its number, a sparse one holds row, column and value."""

    def cells(batches):
        for batch in batches:
            for first, counts, places, numbers in zip(*(batch.column(i) for i in range(4)), strict=True):
                count, place = counts.values.to_numpy(), places.values.to_numpy()
                number = numbers.values.to_numpy()
                of = np.repeat(np.arange(len(count)), count)
                if dense:
                    r, c, x = of + first.as_py(), place, number
                else:
                    cell = np.zeros((len(count), 3))
                    used = place < 3
                    cell[of[used], place[used]] = number[used]
                    r, c, x = cell[cell[:, 2] != 0].T
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(x)],
                                                 names=["r", "c", "abundance"])

    return cells

"""Removal of long repeated byte strings by merged positional Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes over it also starts earlier (smaller id,
or the same document further left). Whole texts take part as UTF-8 bytes.

1. Anchors. Any LENGTH bytes hold a position whose ANCHOR-byte hash is the least
   among the LENGTH - ANCHOR + 1 hashes inside, and that position depends on
   those bytes only, so equal strings meet at equal anchors. Anchors that occur
   once in the whole input cannot lie in a repeated string and leave here.
2. Contexts. All strings of LENGTH bytes over an anchor lie in the anchor's
   context: LENGTH - ANCHOR bytes on either side. Occurrences of one anchor with
   equal contexts repeat as a whole: all but the first are removed without
   looking at bytes. One first occurrence per context goes on, and only where an
   anchor has several contexts.
3. Transforms. Contexts of an anchor are aligned at it. Each shard of contexts
   gets its positional Burrows-Wheeler transform: for every column the bytes
   before the suffixes that start there, in suffix order. Shards are merged
   without sorting suffixes again: the interleave of the shards' rows is
   refined once per column, by a stable distribution of the merged transform's
   bytes, and common prefix lengths are carried along (one more than the least
   between the two rows, for equal bytes; else 0). Runs of rows with a common
   prefix of LENGTH are the repeated intervals; all but their earliest row lose
   that string.
4. Every anchor's contexts are dealt to merges of GROUP at random, so one task never gets all of a very common
   anchor. Where an anchor has more than one merge, the strings that no merge has settled (the earliest of their
   merge) go on: the range of starts is halved, contexts are grouped by the bytes that all strings of a half
   share, groups of one leave, and the rest are merged again, until every group is a single merge. Equal strings stay in
   one group all the way, and each round settles all but one of a merge's equal strings or lengthens the shared
   bytes, so a few rounds do.
5. Removed ranges are merged per document and cut out of its bytes.

Each shuffle is by anchor and lot, context or document; a hot anchor's rows only meet in joins, whose large partitions
adaptive execution splits, or in partial aggregates.

Defined cases: null text counts as empty; texts below LENGTH bytes lose nothing;
rows that repeat an id count as one document (the order is id, then start), so
identical rows with one id do not remove each other; a null id sorts first;
columns other than id and text are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, Substrings, map_columns

LENGTH = 100
ANCHOR = 50
GROUP = 256  # contexts of one anchor that are merged together
SHARD = 2048  # contexts behind one transform
BLOCK = 8192  # contexts that one batch of merges holds
SIDE = LENGTH - ANCHOR
COLUMNS = ANCHOR + 2 * SIDE
STEP = 1 << 20  # bytes of one text hashed together

#: UTF-8 has no bytes 0xC0 and 0xC1, so bytes below move up by one and 0 ends a text.
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[:0xC0] += 1


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of ``width`` values."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:n], x[width - size:width - size + n])


def anchors(data: np.ndarray, hashes: Substrings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and context hash of the anchors of one text, and its prefix hashes, in bounded steps."""
    n = len(data)
    width = LENGTH - ANCHOR + 1
    starts, values, contexts = [], [], []
    for a in range(0, max(0, n - LENGTH + 1), STEP):
        # strings that start in [a, a + STEP); their contexts reach SIDE further on both sides
        lo, hi = max(0, a - SIDE), min(n, a + STEP + LENGTH + SIDE)
        prefix = hashes.prefix(data[lo:hi])
        h = hashes.windows(prefix, ANCHOR)[a - lo:min(n, a + STEP + LENGTH - 1) - ANCHOR + 1 - lo]
        least = _slide(h, width, np.minimum)
        room = np.zeros(width - 1, dtype=np.uint64)
        p = np.flatnonzero(_slide(np.concatenate([room, least, room]), width, np.maximum) == h)
        at = p + a
        left, right = np.maximum(0, at - SIDE), np.minimum(n, at + ANCHOR + SIDE)
        starts.append(at)
        values.append(h[p])
        contexts.append(hashes.spans(prefix, left - lo, right - lo) + (at - left).astype(np.uint64))
    if not starts:
        none = np.zeros(0, dtype=np.uint64)
        return none.astype(np.int64), none, none
    if len(starts) == 1:
        return starts[0], values[0], contexts[0]
    at, own = np.unique(np.concatenate(starts), return_index=True)  # neighbouring steps share some anchors
    return at, np.concatenate(values)[own], np.concatenate(contexts)[own]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tag, text): the order of documents and a tag that tells rows of one id apart."""
    low = F.lit(-(1 << 63)).cast("long")
    return docs.select(F.coalesce(F.col(key).cast("long"), low).alias("doc"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(0x7FFFFFFF).alias("tag"),
                       F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))


def _occurrences(rows: DataFrame, with_context: bool) -> DataFrame:
    """One row per anchor: its hash alone, or hash, context, doc and place (start * 2^31 + tag)."""
    schema = "h long, c long, doc long, place long" if with_context else "h long"

    def run(batches):
        hashes = Substrings()
        for batch in batches:
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            held = [[], [], [], []]
            size = 0
            for i, value in enumerate(batch.column("text")):
                at, h, c = anchors(_bytes(value.as_py()), hashes)
                held[0].append(h.view(np.int64))
                if with_context:
                    held[1].append(c.view(np.int64))
                    held[2].append(np.full(len(at), doc[i]))
                    held[3].append(at << 31 | tag[i])
                size += len(at)
                if size >= 1 << 18 or i + 1 == batch.num_rows:
                    cols = [np.concatenate(x) for x in held if x]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols],
                                                     names=["h", "c", "doc", "place"][:len(cols)])
                    held, size = [[], [], [], []], 0

    return rows.select("doc", "tag", "text").mapInArrow(run, schema)


def _contexts(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Fetch the bytes of asked contexts: (h, n, doc, place, context), one row each."""
    per_doc = asked.groupBy("doc", F.col("place").bitwiseAND(0x7FFFFFFF).alias("tag")).agg(
        F.collect_list(F.struct("h", "place", "n")).alias("asked"))
    found = rows.join(per_doc, ["doc", "tag"])

    def run(batches):
        for batch in batches:
            for doc, value, asked_here in zip(batch.column("doc").to_pylist(), batch.column("text"),
                                              batch.column("asked"), strict=True):
                data = value.as_py().encode("utf-8")
                out = [[], [], [], [], []]
                for a in asked_here.as_py():
                    at = a["place"] >> 31
                    for col, v in zip(out, (a["h"], a["n"], doc, a["place"],
                                            data[max(0, at - SIDE):at + ANCHOR + SIDE]), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())],
                    names=["h", "n", "doc", "place", "context"])

    return found.select("doc", "text", "asked").mapInArrow(
        run, "h long, n long, doc long, place long, context binary")


# --- transforms


def _distribute(group: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Stable order by group, then symbol."""
    first = np.argsort(symbol, kind="stable")
    return first[np.argsort(group[first], kind="stable")]


def transform(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positional transform of one shard: [column, rank] -> byte before the suffix of that rank.

    ``group`` is ascending; row ranks are by group, then by the suffix from the column on. Entry [j] lists the bytes
    of column j in the order of the suffixes that start at column j + 1.
    """
    n, columns = rows.shape
    out = np.empty((columns, n), dtype=np.uint8)
    order = np.arange(n)
    for j in range(columns - 1, -1, -1):
        out[j] = rows[order, j]
        order = order[_distribute(group[order], out[j])]
    return out


def merge(groups: list[np.ndarray], transforms: list[np.ndarray]):
    """Merge shards' transforms column by column.

    Yields (column, shard of each merged rank, rank within that shard's suffix order, common prefix with the rank
    before). Only the transforms are read: the interleave is refined by the merged bytes.
    """
    shard = np.repeat(np.arange(len(groups), dtype=np.int32), [len(g) for g in groups])
    group = np.concatenate(groups)
    order = np.argsort(group, kind="stable")  # empty suffixes: by group, then by shard
    shard, group = shard[order], group[order]
    size = np.array([len(g) for g in groups])
    base = np.cumsum(size) - size
    n, columns = len(shard), transforms[0].shape[0]
    edge = np.ones(n, dtype=bool)
    edge[1:] = group[1:] != group[:-1]
    common = np.zeros(n + 1, dtype=np.int16)
    flat = np.empty(n, dtype=np.uint8)
    for j in range(columns - 1, -1, -1):
        by_shard = np.argsort(shard, kind="stable")  # the rth entry of a shard is the rth of its transform
        flat[by_shard] = np.concatenate([t[j] for t in transforms])
        step = _distribute(group, flat)
        symbol = flat[step]
        same = np.zeros(n, dtype=bool)
        same[1:] = (symbol[1:] == symbol[:-1]) & ~edge[1:]
        i = np.flatnonzero(same)
        after = np.zeros(n + 1, dtype=np.int16)
        if len(i):
            bounds = np.empty(2 * len(i), dtype=np.int64)
            bounds[::2], bounds[1::2] = step[i - 1] + 1, step[i] + 1
            after[i] = np.minimum.reduceat(common, bounds)[::2] + 1
        # before the first column all suffixes are empty and agree within a group: no limit but the columns read
        common = after
        shard = shard[step]
        rank = np.empty(n, dtype=np.int64)
        by_shard = np.argsort(shard, kind="stable")
        rank[by_shard] = np.arange(n) - np.repeat(base, size)
        yield j, shard, rank, common[:n]


def repeated(group: np.ndarray, rows: np.ndarray, earliest: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """[row, start] -> whether the string of LENGTH bytes at that column also stands, at that column, in a row of the
    same group with a smaller ``earliest``. ``group`` must be ascending."""
    cuts = range(0, len(rows), shard)
    groups = [group[a:a + shard] for a in cuts]
    parts = [rows[a:a + shard] for a in cuts]
    transforms = [transform(g, p) for g, p in zip(groups, parts, strict=True)]
    out = np.zeros((len(rows), SIDE + 1), dtype=bool)
    starts = np.array(cuts)
    orders = [np.arange(len(p)) for p in parts]
    for j, which, rank, common in merge(groups, transforms):
        # suffix order of each shard at this column, from its own transform
        orders = [o[_distribute(g[o], t[j])] for o, g, t in zip(orders, groups, transforms, strict=True)]
        if j > SIDE:
            continue
        row = np.concatenate([o + a for o, a in zip(orders, cuts, strict=True)])[starts[which] + rank]
        new = common < LENGTH  # rows that share LENGTH bytes from here on are one run
        first = np.minimum.reduceat(earliest[row], np.flatnonzero(new))
        out[row, j] = earliest[row] > first[np.cumsum(new) - 1]
    return out


def halves(level: int) -> list[tuple[int, int]]:
    """The ranges of starts (first, last) of a round: all starts, halved ``level`` times where that is possible."""
    spans = [(0, SIDE)]
    for _ in range(level):
        spans = [p for a, b in spans for p in ([(a, (a + b) // 2), ((a + b) // 2 + 1, b)] if b > a else [(a, b)])]
    return spans


def _block(held: list[tuple], level: int) -> pa.RecordBatch | None:
    """Results of a block of contexts (key, lot, n, doc, place, open, context) sorted by key and lot.

    Rows with a start and stop are removed ranges; rows with a key and context are what the next round looks at."""
    doc, place, several, open_ = (np.array([x[k] for x in held], dtype=np.int64) for k in (3, 4, 2, 5))
    at = place >> 31
    rows = np.zeros((len(held), COLUMNS), dtype=np.uint8)
    inside = np.zeros((len(held), COLUMNS), dtype=bool)
    lead = SIDE - np.minimum(at, SIDE)
    sizes = np.array([len(x[6]) for x in held])
    flat = np.frombuffer(b"".join(x[6] for x in held), dtype=np.uint8)
    line = np.arange(COLUMNS)
    inside[:] = (line >= lead[:, None]) & (line < (lead + sizes)[:, None])
    rows[inside] = _SYMBOL[flat]
    fresh = [False] + [x[:2] != y[:2] for x, y in zip(held[1:], held[:-1], strict=True)]
    group = np.cumsum(fresh).astype(np.uint16)
    order = np.lexsort((at, doc))
    later = np.ones(len(held), dtype=np.int64)
    later[1:] = (np.diff(doc[order]) != 0) | (np.diff(at[order]) != 0)
    earliest = np.empty(len(held), dtype=np.int64)
    earliest[order] = np.cumsum(later)  # equal for one start in rows of one id
    # strings of real bytes only, and those that are still open
    real = inside[:, :SIDE + 1] & inside[:, LENGTH - 1:] & ((open_[:, None] >> np.arange(SIDE + 1)) & 1).astype(bool)
    hit = repeated(group, rows, earliest) & real
    out = [*_ranges(hit, doc, place, at - SIDE)]
    left = real & ~hit & (several > GROUP)[:, None]
    cols: list[list] = [[], [], [], [], []]
    for first, last in halves(level + 1):
        some = np.flatnonzero(left[:, first:last + 1].any(axis=1))
        bits = (left[some, first:last + 1] << np.arange(first, last + 1)).sum(axis=1)
        for i, b in zip(some.tolist(), bits.tolist(), strict=True):
            key = blake2b(rows[i, last:first + LENGTH].tobytes() + held[i][0], digest_size=16, salt=bytes([first]))
            for col, v in zip(cols, (key.digest(), doc[i], place[i], b, held[i][6]), strict=True):
                col.append(v)
    n, m = len(out[0]), len(cols[0])
    if not n + m:
        return None
    none = [None] * n
    arrays = [pa.array(np.concatenate([out[0], np.array(cols[1], dtype=np.int64)])),
              pa.array(np.concatenate([out[1], np.array(cols[2], dtype=np.int64)])),
              pa.array([*out[2], *[None] * m], pa.int64()), pa.array([*out[3], *[None] * m], pa.int64()),
              pa.array(none + cols[0], pa.binary()), pa.array(none + cols[3], pa.int64()),
              pa.array(none + cols[4], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "place", "start", "stop", "key", "open", "context"])


def _ranges(hit: np.ndarray, doc: np.ndarray, place: np.ndarray, origin: np.ndarray):
    """Runs of hit starts as byte ranges: doc, place, start, stop."""
    step = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(step == 1)
    b = np.nonzero(step == -1)[1]
    return doc[row], place[row], origin[row] + a, origin[row] + b - 1 + LENGTH


def _round(contexts: DataFrame, level: int) -> DataFrame:
    """Merges of contexts (key, n, doc, place, open, context), dealt by key and lot; a block ends at a lot's end."""
    columns = ["key", "lot", "n", "doc", "place", "open", "context"]

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if len(held) >= BLOCK and row[:2] != held[-1][:2]:
                    if (out := _block(held, level)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := _block(held, level)) is not None:
            yield out

    lots = F.ceil(F.col("n") / GROUP)
    dealt = contexts.withColumn("lot", F.pmod(F.xxhash64("doc", "place"), lots)).repartition("key", "lot")
    return dealt.sortWithinPartitions("key", "lot", "doc", "place").select(*columns).mapInArrow(
        run, "doc long, place long, start long, stop long, key binary, open long, context binary")


def _settle(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """Ranges (doc, tag, start, stop) from the merges of all contexts (h, n, doc, place, context), round by round."""
    todo = contexts.select(F.col("h").cast("string").cast("binary").alias("key"), "n", "doc", "place",
                           F.lit((1 << (SIDE + 1)) - 1).alias("open"), "context")
    found, level = None, 0
    while True:
        done = scratch.keep(_round(todo, level), f"round{level}")
        cut = done.where("key is null").select("doc", F.col("place").bitwiseAND(0x7FFFFFFF).alias("tag"), "start", "stop")
        found = cut if found is None else found.unionByName(cut)
        left = done.where("key is not null")
        counts = left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        if counts.isEmpty():
            return found
        todo = left.join(counts, "key").select("key", "n", "doc", "place", "open", "context")
        level += 1


def ranges(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, tag, start, stop) of removed bytes, overlapping as found."""
    shared = scratch.keep(_occurrences(rows, False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
                          .select("h"), "shared")
    found = scratch.keep(_occurrences(rows, True).join(shared, "h"), "found")
    first = scratch.keep(found.groupBy("h", "c").agg(F.min(F.struct("doc", "place")).alias("first")), "first")
    start = F.shiftright("place", 31)
    later = (found.join(first, ["h", "c"])
             .where((F.col("doc") != F.col("first.doc")) | (start != F.shiftright("first.place", 31)))
             .select("doc", F.col("place").bitwiseAND(0x7FFFFFFF).alias("tag"),
                     F.greatest(start - SIDE, F.lit(0)).alias("start"), (start + LENGTH).alias("stop")))
    later = scratch.keep(later, "later")
    scratch.drop("found")
    several = first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    asked = first.join(several, "h").select("h", "first.doc", "first.place", "n")
    contexts = scratch.keep(_contexts(asked, rows), "contexts")
    merged = _settle(contexts, scratch)
    for name in ("shared", "first", "contexts"):
        scratch.drop(name)
    return later.unionByName(merged)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                   as_text: bool = False) -> DataFrame:
    """Per row: the key column (and ``keep``), ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` and ``kept``.

    ``spans`` are the maximal removed byte ranges; ``kept`` the other bytes. With ``as_text`` it is a string (null for
    a null text): the whole characters of each kept run, since a cut may fall inside a character.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = _rows(docs, key, text)
    found = ranges(rows, scratch)
    # starts and stops packed in one number; a range is at most a text long
    per_doc = found.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("cut"))
    others = [c for c in (keep or []) if c not in (key, text)]
    tagged = docs.select(*others, F.col(key), F.col(text).alias("text")).withColumns(
        {"_doc": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")),
         "_tag": F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0x7FFFFFFF)})
    joined = tagged.join(per_doc.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "cut"),
                         ["_doc", "_tag"], "left")

    def start():
        def fn(batch):
            out = [[], [], [], [], []]
            for value, cut in zip(batch.column("text"), batch.column("cut"), strict=True):
                data = (value.as_py() or "").encode("utf-8")
                spans: list[list[int]] = []
                for c in sorted((c["start"], min(c["stop"], len(data))) for c in cut.as_py() or ()):
                    if spans and c[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], c[1])
                    else:
                        spans.append(list(c))
                ends = [0, *(x for s in spans for x in s), len(data)]
                out[0].append(len(data))
                out[1].append(sum(b - a for a, b in spans))
                out[2].append(len(spans))
                out[3].append([{"start": a, "stop": b} for a, b in spans])
                runs = [data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]
                if not as_text:
                    out[4].append(b"".join(runs))
                else:
                    out[4].append("".join(r.decode("utf-8", "ignore") for r in runs) if value.is_valid else None)
            return out

        return fn

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    return map_columns(joined, "text", [("n_bytes", T.LongType()), ("n_removed", T.LongType()),
                                        ("n_spans", T.LongType()), ("spans", T.ArrayType(span)),
                                        ("kept", T.StringType() if as_text else T.BinaryType())], start, limit=8 << 20, keep=[*others, key, "cut"]
                       ).drop("cut")

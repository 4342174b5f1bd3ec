"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

Texts are lower-cased in A-Z and cut into words (runs of digits, a-z and bytes
from 0x80 on). A pattern is 13 consecutive words of an item, or the whole item
if it has fewer; the automaton runs over word numbers, so a match starts and
ends at words. A document is scanned once; every match marks its words, and
spans are mapped back to character offsets of the original text.

Items are taken in blocks of a bounded number of bytes. One block's automaton
is broadcast at a time and documents are scanned once per block; results of
blocks add up, so any number of items is handled with bounded memory.

Defined cases: null text has no words and no hits; items without words (or
null) give no window; repeated items and windows count each item id once; a null
item id takes no part; extra columns pass through, and columns named like the
results are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_columns

WINDOW = 13
BLOCK_BYTES = 8 << 20  # item text behind one automaton

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

HIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("item_ids", T.ArrayType(T.StringType())),
          ("hit_spans", T.ArrayType(HIT)), ("hit_words", T.ArrayType(HIT))]


def words_of(text: str | None) -> list[bytes]:
    """Normalised words. Only spaces separate after the byte translation."""
    return text.encode("utf-8").translate(_LETTERS).split() if text else []


class Automaton:
    """Word-level automaton of one block of (item id, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            for a in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[a:a + window], set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in owners.items():
            self.machine.add_word(key, (len(key), tuple(found)))
        self.empty = not owners
        if not self.empty:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs [start, stop) of hit words, and the items with a window here."""
        if self.empty or not words:
            return [], set()
        look = self.number.get
        runs, items = [], set()
        for end, (size, owners) in self.machine.iter(tuple([look(w, 0) for w in words])):
            runs.append((end - size + 1, end + 1))
            items.update(owners)
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of runs of words."""
    raw = text.encode("utf-8")
    bounds = [m.span() for m in _WORD.finditer(raw)]
    ascii_only = len(raw) == len(text)
    at = (lambda b: b) if ascii_only else (lambda b: len(raw[:b].decode("utf-8")))
    return [{"start": at(bounds[a][0]), "stop": at(bounds[b - 1][1])} for a, b in runs]


def item_blocks(items: DataFrame, item: str, text: str, limit: int = BLOCK_BYTES):
    """Yield the items in blocks of about ``limit`` bytes; the driver holds one block at a time."""
    rows = items.select(F.col(item).cast("string").alias("id"), F.col(text).alias("text")).where(
        "id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // (limit // 2)))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], r["text"]) for r in part.toLocalIterator()]


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Append ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings), ``hit_spans`` (character offsets) and
    ``hit_words`` (word offsets) to every document; with several blocks of items each pass is written before the next.
    """
    spark = docs.sparkSession
    names = [n for n, _ in FIELDS]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    blocks = item_blocks(items, item, item_text, block_bytes)
    out, scratch, n, more = docs, Scratch(spark, "decontaminate"), 0, next(blocks)
    while more is not None:
        block, more = more, next(blocks, None)
        # only the last pass may leave the text behind
        columns = kept if more is None else list(dict.fromkeys([*kept, text]))
        out = _pass(out, spark.sparkContext.broadcast(block), text, columns, window, first=n == 0)
        if more is not None:
            out = scratch.keep(out, f"block-{n}")
            if n:
                scratch.drop(f"block-{n - 1}")
        n += 1
    return out


def _pass(docs: DataFrame, shared, text: str, columns: list[str], window: int, first: bool) -> DataFrame:
    carried = [] if first else ["item_ids", "hit_words"]
    source = docs if first else docs.withColumnsRenamed({c: f"_{c}" for c in carried})

    def start():
        automaton = Automaton(shared.value, window)

        def fn(batch):
            got = [[], [], [], [], []]
            before = [batch.column(f"_{c}").to_pylist() for c in carried] or [[None] * batch.num_rows] * 2
            for value, ids, runs in zip(batch.column(text).to_pylist(), *before, strict=True):
                words = words_of(value)
                hits, items = automaton.scan(words)
                if ids or runs:
                    items |= set(ids or ())
                    hits = merged(hits + [(r["start"], r["stop"]) for r in runs or ()])
                got[0].append(len(words))
                got[1].append(sum(b - a for a, b in hits))
                got[2].append(sorted(items))
                got[3].append(char_spans(value, hits) if hits else [])
                got[4].append([{"start": a, "stop": b} for a, b in hits])
            return got

        return fn

    keep = [*columns, *(f"_{c}" for c in carried)]
    return map_columns(source, text, FIELDS, start, limit=8 << 20, keep=keep).drop(*(f"_{c}" for c in carried))


def contaminated(n_hit, n_words):
    """The contamination rule: some word is hit, and at least a twentieth of the words are."""
    return (n_hit > 0) & (20 * n_hit >= n_words)

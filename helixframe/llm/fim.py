"""Fill-in-the-middle transformation of texts, cut between lines through a learned rank index.

A text's lines are the units. The offsets of all line boundaries form a sorted list; a piecewise-linear function is
fitted to (rank, offset) by a shrinking cone: each segment starts at a boundary and goes on as long as one slope
stays within ``ERROR`` bytes of every offset in it. Per boundary only the residual (offset less prediction) is kept,
in as few bytes as the bound allows. A cut at rank k is predicted from its segment and corrected by its residual, which
gives the exact offset. The index takes about one byte a line besides the segments.

Two ranks drawn from the document's key cut the text into prefix, middle and suffix, which are put in one of two orders
with the markers ``<P>``, ``<S>`` and ``<M>``: ``psm`` or ``spm``. A text that is empty or contains a marker stays
``plain``. No marker begins with the end of another, so the first occurrence of each in an output is the one
that was put there, and ``restore`` rebuilds the text exactly with string functions alone.

Defined cases: a null text counts as empty; a null key is drawn as the empty string; a text without line breaks has one
unit, a text of line breaks only as many units as breaks; repeated rows give repeated results; an empty table gives an
empty result; input columns named like a result are replaced. Work is map-only; a task holds one batch of about 16 MB
(or one longer text) and its boundary list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: The index's error bound in bytes: residuals fit one signed byte.
ERROR = 100
_SPAN = 64  # boundaries that a segment looks ahead at first; doubled while the segment goes on

FIELDS = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()),
          ("middle_chars", T.LongType()), ("output", T.StringType())]
_DRAWS = [f"_fim_h{i}" for i in range(1, 5)]


class RankIndex:
    """Rank -> offset for a rising list of offsets, by error-bounded segments and stored residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        offsets = np.asarray(offsets, dtype=np.int64)
        starts, slopes = _segments(offsets, error)
        self.starts = np.asarray(starts, dtype=np.int64)
        self.base = offsets[self.starts]
        self.slopes = np.asarray(slopes)
        self.residuals = np.zeros(len(offsets), dtype=np.int8 if error < 120 else np.int32)
        guess = self.predict(np.arange(len(offsets)))
        off = offsets - guess
        assert len(off) == 0 or np.abs(off).max() <= error + 1
        self.residuals[:] = off

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        seg = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.base[seg] + np.floor(self.slopes[seg] * (ranks - self.starts[seg])).astype(np.int64)

    def offset(self, ranks) -> np.ndarray:
        """Exact offsets of ``ranks``."""
        ranks = np.asarray(ranks, dtype=np.int64)
        return self.predict(ranks) + self.residuals[ranks]


def _segments(offsets: np.ndarray, error: int) -> tuple[list[int], list[float]]:
    """First ranks and slopes of the segments of a shrinking cone."""
    starts, slopes, n, at = [], [], len(offsets), 0
    while at < n:
        low, high, done, span = 0.0, np.inf, at + 1, _SPAN
        while done < n:
            end = min(n, done + span)
            steps = np.arange(done - at, end - at)
            rise = offsets[done:end] - offsets[at]
            lows = np.maximum(low, np.maximum.accumulate((rise - error) / steps))
            highs = np.minimum(high, np.minimum.accumulate((rise + error) / steps))
            out = np.flatnonzero(lows > highs)
            last = int(out[0]) if len(out) else len(steps)
            if last:
                low, high = float(lows[last - 1]), float(highs[last - 1])
            done += last
            if len(out):
                break
            span *= 2
        starts.append(at)
        slopes.append((low + high) / 2 if np.isfinite(high) else 0.0)
        at = done
    return starts, slopes


def boundaries(data: np.ndarray) -> np.ndarray:
    """Offsets 0 .. n+1 of the line boundaries of UTF-8 bytes: each line ends behind its break or at the text's end."""
    ends = np.flatnonzero(data == 10) + 1
    tail = [len(data)] if len(data) and (len(ends) == 0 or ends[-1] != len(data)) else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _split(raw: bytes, h: list[int], rate: int, spm: int, error: int):
    """n, form, prefix and middle code points, output bytes of one text."""
    data = np.frombuffer(raw, np.uint8)
    marks = boundaries(data)
    n = len(marks) - 1
    if not raw or h[2] % 100 >= rate or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    index = RankIndex(marks, error)
    del marks
    a, b = index.offset(sorted((h[0] % (n + 1), h[1] % (n + 1)))).tolist()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h[3] % 100 < spm:
        form, out = "spm", (s, raw[b:], p, raw[:a], m, raw[a:b])
    else:
        form, out = "psm", (p, raw[:a], s, raw[b:], m, raw[a:b])
    return n, form, _chars(data[:a]), _chars(data[a:b]), b"".join(out)


def _draws(key: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(_DRAWS)]


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = 100,
              spm: int = 50, error: int = ERROR, keep: list[str] | None = None) -> DataFrame:
    """Append ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` to ``keep`` (default: all).

    ``rate`` is the share of transformed texts and ``spm`` the share of these in suffix-first order, in hundredths; both
    are decided by the key's draws, so a rerun gives the same cuts.
    """
    names = {n for n, _ in FIELDS}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*dict.fromkeys([*kept, text]), *_draws(key, seed))

    def start():
        def fn(batch):
            h = np.stack([batch.column(c).to_numpy() for c in _DRAWS], axis=1).tolist()
            col = pa.compute.fill_null(batch.column(text), "").cast(pa.binary())
            rows = [_split(raw.as_py(), h[i], rate, spm, error) for i, raw in enumerate(col)]
            cols = list(zip(*rows, strict=True))
            return [*map(list, cols[:4]), pa.array(cols[4], pa.binary()).cast(pa.string())]

        return fn

    return map_columns(source, text, FIELDS, start, keep=[*kept, *_DRAWS]).drop(*_DRAWS)


def restore(output: str = "output", form: str = "form") -> Column:
    """The exact text behind an output, from the two columns."""
    out, kind = F.coalesce(F.col(output), F.lit("")), F.col(form)
    m = F.locate(MIDDLE, out)
    psm, spm = F.locate(SUFFIX, out), F.locate(PREFIX, out)
    second = F.when(kind == "psm", psm).otherwise(spm)
    first_piece = F.substring(out, F.lit(4), second - 4)
    second_piece = F.substring(out, second + 3, m - second - 3)
    middle = F.substring(out, m + 3, F.length(out))
    return (F.when(kind == "psm", F.concat(first_piece, middle, second_piece))
            .when(kind == "spm", F.concat(second_piece, middle, first_piece)).otherwise(out))

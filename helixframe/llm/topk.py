"""Exact top-k search by distributed histogram selection.

Every pass scores all candidates against a block of queries (integer inner
products of floor(1024 * x)) inside tasks, and only per-query counts leave them:

1. bounds: a task's own kth best score bounds the global kth value from below;
2. value: histograms over the remaining score range are summed over all tasks
   and the range shrinks to the bin that holds the kth value, until it is one
   value wide;
3. ties: where more candidates share that value than there is room for, the
   same refinement over their ids finds the largest id to take;
4. filter: one more pass emits exactly the rows above the value or within the
   id bound.

No task and no shuffle ever holds a query's candidates together, so a vector
repeated in a third of the rows costs one histogram bin. Queries are a stated
set and are taken in blocks of a bounded number. A block's result is written and its broadcast destroyed before the
next block begins, so the driver and the tasks hold one block of queries and one row of state per query of it.

Defined cases: rows with a null id, a null vector, or a null or non-finite
component take no part; vectors of unequal length are compared as if the
shorter one ended in zeros; a candidate with the query's own id is no partner;
a component so large that 1024 times it is no double counts as the largest one, and a
score that a long cannot hold as the nearest long;
repeated candidate rows count as rows of their own; a query with fewer than k
candidates returns all of them; repeated query ids keep the first vector in
array order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 1024
QUERY_BLOCK = 2048  # queries scored at a time
ROWS = 2048  # candidates scored at a time in a task
BINS = 1024
FAR = np.finfo(np.float64).max


def unpack(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and quantised vectors (float64 holding integers, zero-padded) of the rows that take part."""
    valid = np.asarray(pa.compute.and_(ids.is_valid(), vectors.is_valid()))
    rows = pa.compute.filter(vectors, pa.array(valid))
    key = np.asarray(pa.compute.filter(ids, pa.array(valid)), dtype=np.int64)
    size = np.asarray(pa.compute.list_value_length(rows), dtype=np.int64)
    flat = np.asarray(rows.flatten().cast(pa.float64()).fill_null(np.nan))
    width = int(size.max()) if len(size) else 0
    if len(size) and (size == width).all():
        out = flat.reshape(len(size), width)
    else:
        out = np.zeros((len(size), width))
        out[np.arange(width) < size[:, None]] = flat
    fine = np.isfinite(out).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(out[fine] * SCALE)
    return key[fine], np.clip(scaled, -FAR, FAR)


def scores(rows: np.ndarray, queries: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products [candidate, query]: by floating point where that is exact, else by whole numbers."""
    width = min(rows.shape[1], queries.shape[1])
    a, b = rows[:, :width], queries[:, :width]
    if len(a) == 0 or width == 0:
        return np.zeros((len(a), len(queries)), dtype=np.int64)
    if float(np.abs(a).max()) * top * width < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return np.clip(whole(a) @ whole(b).T, LOW, HIGH).astype(np.int64)  # a long holds no more


def _each(df: DataFrame, schema: str, block, init, step, finish):
    """Run over the candidates: ``step(state, ids, scores, own)`` per chunk, ``finish(state)`` -> columns per task."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        keys, matrix = block.value
        top = float(np.abs(matrix).max()) if matrix.size else 0.0
        state = init(len(keys))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids, rows = unpack(part.column(0), part.column(1))
                if len(ids):
                    s = scores(rows, matrix, top)
                    out = step(state, ids, s, ids[:, None] == keys[None, :])
                    if out is not None and len(out[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
        out = finish(state)
        if out is not None and len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    return df.mapInArrow(run, schema)


LOW = np.iinfo(np.int64).min
HIGH = np.iinfo(np.int64).max


def _bounds(df, block, k):
    """Per query: number of candidates, least and greatest score, and a lower bound of the kth value."""

    def init(n):
        return {"best": np.full((0, n), LOW), "n": np.zeros(n, np.int64), "min": np.full(n, HIGH)}

    def step(state, ids, s, own):
        state["n"] += (~own).sum(axis=0)
        state["min"] = np.minimum(state["min"], np.where(own, HIGH, s).min(axis=0))
        best = np.concatenate([state["best"], np.where(own, LOW, s)])
        state["best"] = np.partition(best, len(best) - k, axis=0)[-k:] if len(best) > k else best

    def finish(state):
        if not len(state["best"]):
            return None
        n = state["n"]
        kth = np.where(n >= k, state["best"].min(axis=0), LOW)
        own = np.flatnonzero(n)
        return [own, n[own], state["min"][own], state["best"].max(axis=0)[own], kth[own]]

    rows = _each(df, "q long, n long, low long, high long, kth long", block, init, step, finish)
    return rows.groupBy("q").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                 F.max("kth").alias("kth")).collect()


def _gap(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.int64).view(np.uint64) - low.astype(np.int64).view(np.uint64)


def _refine(df, block, live, low, high, need, of_value=None, descending=True):
    """One histogram pass over [low, high] of the live queries; returns per query (bin low, bin high, counted before).

    ``of_value``: histogram the ids of candidates with this score instead of the scores.
    """
    # unsigned differences: a range may be wider than a long
    width = _gap(high, low) // np.uint64(BINS) + np.uint64(1)

    def init(n):
        return {"bins": np.zeros((len(live), BINS), np.int32)}

    def step(state, ids, s, own):
        s, own = s[:, live], own[:, live]
        if of_value is None:
            inside = ~own & (s >= low) & (s <= high)
            row, q = np.nonzero(inside)
            value = s[row, q]
        else:
            row, q = np.nonzero(~own & (s == of_value) & (ids[:, None] >= low) & (ids[:, None] <= high))
            value = ids[row]
        at = _gap(value, low[q]) // width[q]
        np.add.at(state["bins"], (q, at.astype(np.int64)), 1)

    def finish(state):
        q, at = np.nonzero(state["bins"])
        return [q, at, state["bins"][q, at].astype(np.int64)]

    counts = _each(df, "q long, bin long, n long", block, init, step, finish)
    total = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"))
    order = F.col("bin").desc() if descending else F.col("bin")
    upto = Window.partitionBy("q").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # at most BINS rows each
    limit = df.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(need)], "q long, need long")
    cum = total.withColumn("cum", F.sum("n").over(upto)).join(F.broadcast(limit), "q")
    return cum.where("cum >= need and cum - n < need").select("q", "bin", "n", "cum").collect(), width


def _select(df, block, keys, k):
    """For each query of a block: value bound and id bound of its k best candidates."""
    n_queries = len(keys)
    value, bound = np.full(n_queries, HIGH), np.full(n_queries, LOW)
    low, high, need = np.zeros(n_queries, np.int64), np.zeros(n_queries, np.int64), np.zeros(n_queries, np.int64)
    live = []
    for r in _bounds(df, block, k):
        low[r.q] = r.low if r.kth is None or r.kth == LOW else max(r.low, r.kth)
        high[r.q] = r.high
        if r.n <= k:
            value[r.q], bound[r.q] = LOW, HIGH
        else:
            need[r.q] = k
            live.append(r.q)
    live = np.array(sorted(live), dtype=np.int64)
    same = np.zeros(n_queries, np.int64)  # candidates at the kth value, once known
    while len(live):
        got, width = _refine(df, block, live, low[live], high[live], need[live])
        rest = []
        for r in got:
            q = live[r.q]
            need[q] -= r.cum - r.n
            new = int(low[q]) + r.bin * int(width[r.q])
            high[q] = min(int(high[q]), new + int(width[r.q]) - 1)
            low[q] = new
            if low[q] == high[q]:
                value[q], same[q] = low[q], r.n
            elif need[q] == r.n:  # the whole bin is taken: its lower edge separates
                value[q], bound[q], same[q] = low[q], HIGH, -1
            else:
                rest.append(q)
        live = np.array(sorted(rest), dtype=np.int64)
    ties = np.flatnonzero((same > 0) & (same > need))
    bound[(same > 0) & (same <= need)] = HIGH
    if len(ties):
        first, last = df.agg(F.min("id"), F.max("id")).first()
        low[ties], high[ties] = first, last
        live = ties
        while len(live):
            got, width = _refine(df, block, live, low[live], high[live], need[live], value[live], descending=False)
            rest = []
            for r in got:
                q = live[r.q]
                need[q] -= r.cum - r.n
                new = int(low[q]) + r.bin * int(width[r.q])
                high[q] = min(int(high[q]), new + int(width[r.q]) - 1)
                low[q] = new
                if low[q] == high[q] or need[q] == r.n:
                    bound[q] = high[q]
                else:
                    rest.append(q)
            live = np.array(sorted(rest), dtype=np.int64)
    return value, bound


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding",
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact k best candidates of every query: query_id, rank (from 1), vec_id, score."""
    spark = candidates.sparkSession
    df = candidates.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = (queries.where(F.col(id).isNotNull() & F.col(vector).isNotNull())
             .groupBy(F.col(id).cast("long").alias("id"))
             .agg(F.min(F.col(vector).cast("array<double>")).alias("vector")))
    total = asked.count()
    blocks = max(1, -(-total * 4 // (3 * query_block)))  # room for uneven hashing
    scratch = Scratch(spark, "topk")
    found = None
    for b in range(blocks):
        rows = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        local = rows.toArrow()
        keys, matrix = unpack(local.column("id").combine_chunks(), local.column("vector").combine_chunks())
        if not len(keys):
            continue
        block = spark.sparkContext.broadcast((keys, matrix))
        value, bound = _select(df, block, keys, k)

        def step(state, ids, s, own, keys=keys, value=value, bound=bound):
            row, q = np.nonzero(~own & ((s > value) | ((s == value) & (ids[:, None] <= bound))))
            return [keys[q], ids[row], s[row, q]]

        part = scratch.keep(_each(df, "query_id long, vec_id long, score long", block, lambda n: None, step,
                                  lambda state: None), f"found/block={b}")
        block.destroy()
        found = part if found is None else found
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema(found.schema).parquet(f"{scratch.root}/found")  # all blocks, one scan
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows, more only for repeated ids
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

"""Per-sample pooling of organism embeddings (A1-A4) and abundance-matrix views.

Vectors travel as ``array<float>`` of a declared width between operators; a
vector of another width raises. Pooling cuts every vector into chunks of CHUNK
positions and sums each position of a chunk with one aggregate expression: a
hash aggregate with a partial (map-side) phase, so a sample holding a third of
all rows is reduced inside every task before the shuffle, and only one row per
sample, chunk and task crosses the network. The same plan serves every width.
A missing element makes its position's result missing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 64  # positions summed in one row
STEP = 1000  # copies in one block of a repeated row
WIDE_RUN = 1 << 20  # numbers of wide vectors added up together
BAND = 64  # width of a score band: exp(64) leaves room for 1e280 rows


def _checked(vec: str, dim: int) -> Column:
    """The vector, or an error if its width is not the declared one."""
    return F.when(F.coalesce(F.size(F.col(vec)), F.lit(-1)) == dim, F.col(vec)).otherwise(
        F.raise_error(F.concat(F.lit(f"vector of another width than {dim}: "), F.size(F.col(vec)).cast("string"))))


def _pooled(df: DataFrame, key: str, vec: str, dim: int, weights: list[Column],
            scales: list[Column] | None = None) -> DataFrame:
    """``(key, _w, emb)``: for each weight in turn ``sum(w * v) / sum(w)`` per position, one after the other.

    ``_w`` holds the weight sums. NaN stands for a missing element inside the sums and becomes null. With ``scales``
    (whole numbers) a weight counts ``exp(BAND * scale)`` times: rows are summed per scale, and the few sums of a
    group are brought to its largest scale at the end, so no weight overflows and none is shifted by hand.
    """
    if dim > CHUNK and len(weights) == 1 and scales is None:
        return _wide(df, key, vec, dim, weights[0])
    n, width = -(-dim // CHUNK), min(dim, CHUNK)
    parts = n * len(weights)  # chunks of the result
    rows = df.select(key, _checked(vec, dim).alias("_v"), F.array(*weights).alias("_ws"),
                     *([F.array(*scales).alias("_ks")] if scales else []))
    if parts > 1:
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_c"))
        which = F.floor(F.col("_c") / n).cast("int")
        piece = F.slice("_v", (F.col("_c") % n) * CHUNK + 1, F.lit(CHUNK)) if n > 1 else F.col("_v")
    else:
        which, piece = F.lit(0), F.col("_v")
    by = [key, *(["_c"] if parts > 1 else []), *(["_k"] if scales else [])]
    cells = rows.select(key, *(["_c"] if parts > 1 else []), F.get("_ws", which).alias("_w"),
                        *([F.get("_ks", which).alias("_k")] if scales else []), piece.alias("_v"))
    value = lambda i: F.coalesce(F.get(F.col("_v"), F.lit(i)).cast("double"), F.lit(float("nan")))
    sums = cells.groupBy(*by).agg(F.sum("_w").alias("_w"), *[
        F.sum(F.col("_w") * value(i)).alias(f"_s{i}") for i in range(width)])
    if parts == 1 and not scales:
        mean = [F.try_divide(F.col(f"_s{i}"), F.col("_w")) for i in range(width)]
        return sums.select(key, F.array("_w").alias("_w"), F.array(*[F.when(~F.isnan(m), m) for m in mean]).alias("emb"))
    c, k = F.col("_c") if parts > 1 else F.lit(0), F.col("_k") if scales else F.lit(0).cast("long")
    last = dim - (n - 1) * CHUNK  # the last chunk may be shorter
    total = F.array(*[F.col(f"_s{i}") for i in range(width)])
    total = F.when(c % n == n - 1, F.slice(total, 1, last)).otherwise(total)
    cell = F.struct(c.alias("c"), k.alias("k"), F.col("_w").alias("w"), total.alias("s"))
    back = sums.groupBy(key).agg(F.collect_list(cell).alias("_cs"))  # chunks of a vector, a few scales each
    ordered = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.filter("_cs", lambda x: x["c"] == i))
    merged = F.transform(ordered, _one_scale)
    back = back.select(key, merged.alias("_m"))
    mean = lambda m: F.transform(m["s"], lambda x: F.try_divide(x, m["w"]))
    back = back.select(key, F.transform("_m", lambda m: m["w"]).alias("_w"), F.flatten(F.transform("_m", mean)).alias("emb"))
    return back.select(key, "_w", F.transform("emb", lambda x: F.when(~F.isnan(x), x)).alias("emb"))


def _wide(df: DataFrame, key: str, vec: str, dim: int, weight: Column) -> DataFrame:
    """``_pooled`` of one weight for wide vectors: numpy adds up the rows of a key inside each run of an Arrow batch, and the
    partial sums of a key, side by side after a sort, are added up one key at a time."""
    rows = df.select(key, weight.cast("double").alias("_w"), _checked(vec, dim).cast("array<double>").alias("_v"))
    step = max(WIDE_RUN // dim, 1)

    def record(schema, names, w, n, sums):
        flat = pa.array(np.ascontiguousarray(sums).ravel())
        lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * dim, flat)
        return pa.RecordBatch.from_arrays([names, pa.array(w), pa.array(n, pa.int64()), lists],
                                          names=[key, "_w", "_n", "_s"])

    def partial(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                names = part.column(0).dictionary_encode(null_encoding="encode")
                code = np.asarray(names.indices)
                order = np.argsort(code, kind="stable")
                given = np.asarray(part.column(1).is_valid())[order]
                w = np.where(given, np.asarray(part.column(1).fill_null(0.0))[order], 0.0)
                v = np.asarray(part.column(2).flatten().fill_null(float("nan"))).reshape(-1, dim)[order]
                v = np.where(given[:, None], v * w[:, None], 0.0)  # a row without a weight does not count
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                yield record(part.schema, names.dictionary.take(pa.array(code[order][starts])), np.add.reduceat(w, starts),
                             np.add.reduceat(given.astype(np.int64), starts), np.add.reduceat(v, starts, axis=0))

    def merged(batches):
        last = schema = None
        for batch in batches:
            schema = batch.schema
            for i, (name, w, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                s = np.asarray(batch.column(3)[i].values)
                if last is not None and last[0] == name:
                    last = [name, last[1] + w, last[2] + n, last[3] + s]
                    continue
                if last is not None:
                    yield record(schema, pa.array([last[0]], schema.field(0).type), [last[1]], [last[2]], last[3])
                last = [name, w, n, s]
        if last is not None:
            yield record(schema, pa.array([last[0]], schema.field(0).type), [last[1]], [last[2]], last[3])

    schema = T.StructType([df.schema[key], T.StructField("_w", T.DoubleType()), T.StructField("_n", T.LongType()),
                           T.StructField("_s", T.ArrayType(T.DoubleType()))])
    sums = rows.mapInArrow(partial, schema).repartition(key).sortWithinPartitions(key).mapInArrow(merged, schema)
    w = F.when(F.col("_n") > 0, F.col("_w"))
    sums = sums.select(key, w.alias("_w"), F.transform("_s", lambda x: F.try_divide(x, w)).alias("emb"))
    return sums.select(key, F.array("_w").alias("_w"), F.transform("emb", lambda x: F.when(~F.isnan(x), x)).alias("emb"))


def _one_scale(cells: Column) -> Column:
    """The sums of one chunk over all its scales, at the largest of them."""
    top = F.array_max(F.transform(cells, lambda x: x["k"]))
    factor = lambda x: F.exp((x["k"] - top).cast("double") * float(BAND))
    first = F.get(cells, F.lit(0))
    rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    scaled = lambda x: F.struct((x["w"] * factor(x)).alias("w"),
                                F.transform(x["s"], lambda v: v * factor(x)).alias("s"))
    return F.aggregate(rest, scaled(first), lambda acc, x: F.struct(
        (acc["w"] + scaled(x)["w"]).alias("w"), F.zip_with(acc["s"], scaled(x)["s"], lambda p, q: p + q).alias("s")))


def mean_pool(df: DataFrame, key: str = "sample_name", vec: str = "emb", *, dim: int) -> DataFrame:
    """A1: plain mean of the vectors in each group (abundance ignored, so zero-abundance groups stay)."""
    return _pooled(df, key, vec, dim, [F.lit(1.0)]).drop("_w")


def weighted_mean_pool(df: DataFrame, key: str = "sample_name", vec: str = "emb",
                       weight: str = "abundance", *, dim: int) -> DataFrame:
    """A2: ``sum(w * v) / sum(w)`` per position; groups whose weights sum to 0 are dropped."""
    return _pooled(df, key, vec, dim, [F.col(weight).cast("double")]).where(F.col("_w")[0] != 0).drop("_w")


def query_vector(dim: int, head: int = 0) -> list[float]:
    """Fixed, seeded attention query of width ``dim`` (exact rationals, same in every engine)."""
    return [(((i + 1) * 7919 + head * 104729) % 201 - 100) / 1000.0 for i in range(dim)]


def attention_pool(df: DataFrame, key: str = "sample_name", vec: str = "emb",
                   weight: str = "abundance", *, dim: int, heads: int = 1) -> DataFrame:
    """A3: softmax attention pooling over the abundance-repeated set, without repeating rows.

    Softmax attention over a set in which vector ``x`` appears ``m = int(abundance)``
    times equals attention over the distinct vectors with weights ``m * exp(q.x)``.
    A score is split into ``BAND * scale + rest``: rows are summed with ``m * exp(rest)``
    per scale (partial + final aggregate, skew safe) and a group's few scales are merged
    at its largest, so scores of any size are stable without knowing the group's
    maximum first: one pass, no join. Groups whose multiplicities sum to 0 are
    dropped. ``heads`` outputs are concatenated.
    """
    m = F.col(weight).cast("int")
    base = df.select(key, vec, m.alias("_m")).where(F.col("_m") > 0)
    score = []
    for h in range(heads):
        # One fold over the array: a 64-term expression tree compiles to a method
        # too large for the JIT and ran ~5x slower.
        qa = F.array(*[F.lit(x) for x in query_vector(dim, h)])
        s = F.aggregate(F.zip_with(F.col(vec), qa, lambda a, b: a.cast("double") * b), F.lit(0.0),
                        lambda acc, x: acc + x)
        score.append((s / F.lit(math.sqrt(dim))).alias(f"_s{h}"))
    scored = base.select(key, vec, "_m", *score)
    scales = [F.coalesce(F.floor(F.col(f"_s{h}") / BAND), F.lit(0)).cast("long") for h in range(heads)]
    weights = [F.col("_m") * F.exp(F.col(f"_s{h}") - scales[h] * float(BAND)) for h in range(heads)]
    return _pooled(scored, key, vec, dim, weights, scales).drop("_w")


def repeat_rows(df: DataFrame, weight: str = "abundance") -> DataFrame:
    """A4: repeat each row ``int(weight)`` times (0 or negative -> no rows); adds ``copy`` (0-based)."""
    n = F.greatest(F.col(weight).cast("int"), F.lit(0))
    # two levels, so that one huge weight builds no huge array: blocks of STEP copies, then the copies of a block
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")))
    rows = df.select("*", n.alias("_n"), F.explode(blocks).alias("_b"))
    inside = F.sequence(F.col("_b") * STEP, F.least(F.col("_n"), (F.col("_b") + 1) * STEP) - 1)
    return rows.select(*df.columns, F.explode(inside).alias("copy"))


def expand_vector(df: DataFrame, vec: str = "emb", dim: int = 64, prefix: str = "emb_",
                  digits: int | None = 6) -> DataFrame:
    """S6 form: the array column back to ``emb_0 .. emb_{dim-1}`` columns (rounded for reports)."""
    cols = []
    for i in range(dim):
        c = F.col(vec)[i].cast("double")
        if digits is not None:
            c = F.round(c, digits) + F.lit(0.0)
        cols.append(c.alias(f"{prefix}{i}"))
    return df.select(*[c for c in df.columns if c != vec], *cols)


def matrix_shape(triples: DataFrame, row: str = "otu_id", col: str = "sample_name") -> DataFrame:
    """``(n_rows, n_cols)`` of a long sparse matrix (axis ids counted even when all zero)."""
    return triples.agg(F.countDistinct(row).alias("n_rows"), F.countDistinct(col).alias("n_cols"))


def sample_profile(triples: DataFrame, sample: str, row: str = "otu_id",
                   col: str = "sample_name", value: str = "abundance") -> DataFrame:
    """One sample's dense profile over all row ids (absent cells -> 0)."""
    ids = triples.select(row).distinct()
    cells = triples.where(F.col(col) == F.lit(sample)).groupBy(row).agg(F.sum(value).alias(value))
    return ids.join(cells, row, "left").select(
        row, F.coalesce(F.col(value), F.lit(0.0)).alias(value))

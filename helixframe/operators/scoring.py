"""Sequence scoring (M7, M8).

M8 is a linear k-mer scorer: the logit of class ``c`` is the sum, over every
overlapping k-mer of the sequence, of an integer weight ``W[kmer, c]``. Integer
weights keep sums exact, so the arg-max is identical in every engine and under
any partitioning. Weights come from an md5 rule (``seed``) or from a fitted
model (``plans.ml``).

Scoring is written in *long form*: one row per (sequence, k-mer position),
the k-mer index is plain arithmetic inside whole-stage codegen, the weights
are a broadcast join against a ``4**k``-row table (a proven bound), and the
per-sequence sums are a partial/final hash aggregate keyed by the sequence
key, so only ``C`` sums per sequence and task are shuffled. When the input is
already hash-partitioned by the key (``sources.tables.spread`` on the scan)
the aggregate adds no exchange at all.

The attack scorer fuses point mutation into the same long form: the mutated
base at position ``q`` is a pure function of ``(row_id, iteration, q)``, so
each k-mer row recomputes its ``k`` bases from the original text with no
string ever materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codons import BASE_ORDER, MUTATION_BASES
from ..functions.draws import draw, fires

MAX_K = 8  # 4**8 = 65,536 weight rows: the broadcast bound; longer k-mers are joined by shuffle


def kmer_of_index(idx: Column, k: int) -> Column:
    """The k-mer text of index ``idx`` (base-4 digits over ``ACGT``)."""
    digits = [F.lit(BASE_ORDER).substr(((idx / F.lit(4 ** (k - 1 - j))).cast("bigint") % 4 + 1).cast("int"),
                                        F.lit(1)) for j in range(k)]
    return F.concat(*digits)


def rule_weight(kmer: Column, c: int, seed: int = 0) -> Column:
    """Integer weight in ``[-500, 500]`` from the md5 of ``kmer:c:seed``."""
    h = F.conv(F.substring(F.md5(F.concat(kmer, F.lit(f":{c}:{seed}"))), 1, 8), 16, 10).cast("bigint")
    return h % 1001 - 500


def rule_weights(spark: SparkSession, n_classes: int, k: int = 3, seed: int = 0) -> DataFrame:
    """``(idx, w0 .. w{C-1})``: one row per k-mer, built from the md5 rule."""
    if not 1 <= k <= 15:  # 4**15 numbers fit the k-mer text's arithmetic
        raise ValueError("k must be in 1..15")
    ids = spark.range(4 ** k).select(F.col("id").alias("idx"))
    km = kmer_of_index(F.col("idx"), k)
    return ids.select("idx", *[rule_weight(km, c, seed).alias(f"w{c}") for c in range(n_classes)])


def base_code(byte: Column) -> Column:
    """One byte of an ASCII sequence: ``A C G T`` -> 0..3, anything else -> -1."""
    return F.instr(F.lit(BASE_ORDER), byte.cast("string")) - 1


def _byte_at(raw: Column, q: Column) -> Column:
    # Sequences are ASCII, so byte q is character q. Binary substr is O(1);
    # string substr must walk the UTF-8 text from its start (O(q)).
    return raw.substr(q, F.lit(1))


def _mutated_code(raw: Column, row_id: Column, iteration: Column, q: Column, rate, seed: int) -> Column:
    x = draw(row_id, iteration, q, seed)
    # code of MUTATION_BASES[j] in BASE_ORDER, for j = 0..3
    codes = F.array(*[F.lit(BASE_ORDER.index(b)) for b in MUTATION_BASES])
    drawn = F.element_at(codes, (F.floor(x / F.lit(1000)) % 4 + 1).cast("int"))
    return F.when(fires(x, rate), drawn).otherwise(base_code(_byte_at(raw, q)))


def _index(codes: list[Column]) -> Column:
    """k-mer index from base codes; null when any base is not ``ACGT``."""
    k = len(codes)
    idx = sum((c * F.lit(4 ** (k - 1 - j)) for j, c in enumerate(codes)), F.lit(0))
    return F.when(F.least(*codes) >= 0, idx.cast("bigint")) if k > 1 else \
        F.when(codes[0] >= 0, idx.cast("bigint"))


def _with_codes(long: DataFrame, keep: list[str], codes: list[Column]) -> DataFrame:
    """Project the base codes first and the k-mer index from them (small generated methods)."""
    named = long.select(*keep, *[c.alias(f"_c{j}") for j, c in enumerate(codes)])
    return named.select(*keep, _index([F.col(f"_c{j}") for j in range(len(codes))]).alias("idx"))


def _positions(seq: Column, k: int) -> Column:
    n = F.length(seq) - F.lit(k - 1)
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _sum_logits(long: DataFrame, keys: list[str], weights: DataFrame, n_classes: int, k: int) -> DataFrame:
    if k > MAX_K:  # equal k-mers of a sequence are counted before the join, absent ones (null) leave it
        counts = long.where("idx IS NOT NULL").groupBy(*keys, "idx").agg(F.count("*").alias("_n"))
        hit = counts.join(weights, "idx").select(*keys, *[(F.col(f"w{c}") * F.col("_n")).alias(f"w{c}")
                                                         for c in range(n_classes)])
        none = long.select(*keys).distinct()  # sequences without any k-mer score 0
        j = hit.unionByName(none.select(*keys, *[F.lit(0).cast("bigint").alias(f"w{c}") for c in range(n_classes)]))
    else:
        j = long.join(F.broadcast(weights), "idx", "left")  # 4**k rows: a proven bound
    g = j.groupBy(*keys).agg(*[F.coalesce(F.sum(f"w{c}"), F.lit(0)).cast("bigint").alias(f"l{c}")
                              for c in range(n_classes)])
    return g.select(*keys, F.array(*[F.col(f"l{c}") for c in range(n_classes)]).alias("logits"))


def kmer_logits(df: DataFrame, seq: str, keys: list[str], weights: DataFrame, n_classes: int,
                k: int = 3) -> DataFrame:
    """M8: ``(keys..., logits array<bigint>)`` for every row of ``df`` (short sequences score 0)."""
    raw = F.col(seq).cast("binary").alias("_raw")
    long = df.select(*keys, raw).select(*keys, "_raw", F.explode_outer(_positions(F.col("_raw"), k)).alias("_p"))
    codes = [base_code(_byte_at(F.col("_raw"), F.col("_p") + j)) for j in range(k)]
    long = _with_codes(long, keys, codes)
    return _sum_logits(long, keys, weights, n_classes, k)


def attack_logits(df: DataFrame, seq: str, row_id: str, iterations: Column, weights: DataFrame,
                  n_classes: int, k: int = 3, rate=0.1, seed: int = 0,
                  keys: list[str] | None = None) -> DataFrame:
    """Logits of ``point_mutation(seq, row_id, it, rate)`` for every ``it`` in ``iterations``.

    ``(row_id, iteration, *keys, logits)``; equal to scoring the mutated strings,
    without building them.
    """
    keys = keys or []
    raw, rid = F.col("_raw"), F.col(row_id)
    rows = df.select(row_id, *keys, F.col(seq).cast("binary").alias("_raw"), F.explode(iterations).alias("iteration"))
    long = rows.select(row_id, "iteration", *keys, "_raw", F.explode_outer(_positions(raw, k)).alias("_p"))
    it = F.col("iteration")
    codes = [_mutated_code(raw, rid, it, F.col("_p") + j, rate, seed) for j in range(k)]
    long = _with_codes(long, [row_id, "iteration", *keys], codes)
    return _sum_logits(long, [row_id, "iteration", *keys], weights, n_classes, k)


def predict(logits: str = "logits") -> Column:
    """Arg-max class of a logit array (first maximum)."""
    z = F.col(logits)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def batch_model_udf(make_predict_fn, n_outputs: int, batch_size: int = 32):
    """M7: wrap a user model as an Arrow-batched scorer (one logit vector per row).

    ``make_predict_fn`` is called once per Python worker and returns
    ``f(np.ndarray[str]) -> np.ndarray[float, (n, n_outputs)]``; Spark feeds it
    batches of ``batch_size`` rows. Ship the model by path, load it inside
    ``make_predict_fn``.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    return predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size)

"""MinHash near-duplicate classes by an inverted join over signature coordinates.

1. Every text becomes its set of distinct word shingles (64-bit hashes of the
   normalised shingle bytes) and a MinHash signature of COORDINATES values. Texts
   with equal sets fall into one class before anything is joined, so copies
   cost one row each.
2. Every class is posted under its (coordinate, value) pairs. A pair of classes
   above the similarity shares at least MATCHES of its coordinates (see below), so
   with values in one global order, rarest first, it meets in the first
   COORDINATES - MATCHES + 1 of both (the prefix). Values of one class only are
   skipped. The long lists of common values lie behind the prefix.
3. In each posting list classes are paired with its most popular class, not with
   each other. Collisions of a pair are counted by skipping straight to both
   signatures; pairs with MATCHES or more are confirmed on their full sets, and
   confirmed links give components. Two such rounds, with the popular class of
   what is left, connect the bulk of every group.
4. Classes of lists that still span several components are searched completely on
   their full sets: shingles in one global order, rare ones first (by counts in a
   table of fixed size; any order is correct), and a pair above the similarity
   shares a shingle among the first quarter of both. Classes outside a list's
   main component meet the classes of other components there, and a pair is only
   made if the places of the shared shingle leave room for the overlap that the
   two sizes need. No link between components is left out, pairs inside one are
   not made, and a class whose many rare shingles rule out every partner makes none.

A similarity s makes each coordinate agree with probability s; at s = 0.75 fewer
than 21 of 48 agree with probability below 1e-6.

Defined cases: null or wordless texts have no shingle and are components of
their own, kept; with fewer than ``size`` words the whole sequence is the one
shingle; rows that repeat an id are documents of their own (kept if their id is
the component's); a null id takes the least id of its component, or null; ties
of popularity go to the lesser class key; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, Substrings, map_columns, slices
from .components import connected

SIZE = 5  # words in a shingle
PERCENT = 75  # least similarity, in hundredths
COORDINATES = 48
MATCHES = 21
LEADER_ROUNDS = 2
BUCKETS = 1 << 20  # counts that order shingles in the complete search
STEP = 1 << 15  # shingles whose coordinates are computed together

_RNG = np.random.Generator(np.random.PCG64(48))
_MULTIPLY = _RNG.integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)


def shingles(text: str | None, hashes: Substrings, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text; A-Z lower-cased, ASCII white space separates."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)  # words hold no spaces, so these are the joints
    start = np.concatenate([[0], gaps + 1])
    stop = np.append(gaps, len(data))
    n = min(size, len(words))
    return np.unique(hashes.spans(hashes.prefix(data), start[:len(words) - n + 1], stop[n - 1:]))


def signature(x: np.ndarray) -> np.ndarray:
    """Posting keys coordinate * 2^32 + value, one for each coordinate."""
    least = np.full(COORDINATES, np.uint64(2**64 - 1))
    for a in range(0, len(x), STEP):
        part = x[a:a + STEP]
        for k in range(COORDINATES):
            least[k] = min(least[k], (part * _MULTIPLY[k] + _ADD[k]).min())
    return (np.arange(COORDINATES, dtype=np.int64) << 32) | (least >> np.uint64(32)).astype(np.int64)


def sketch(docs: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """Append ``n_shingles``, ``class_key`` (digest of the set; null if empty) and ``keys`` (posting keys)."""

    def start():
        hashes = Substrings()

        def fn(batch):
            n, key, keys = [], [], []
            for value in batch.column(text).to_pylist():
                x = shingles(value, hashes, size)
                n.append(len(x))
                key.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                keys.append(signature(x) if len(x) else None)
            return [n, pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

        return fn

    return map_columns(docs, text, [("n_shingles", T.LongType()), ("class_key", T.BinaryType()),
                                    ("keys", T.ArrayType(T.LongType()))], start, limit=8 << 20, keep=keep)


def class_keys(docs: DataFrame, text: str, size: int, name: str) -> DataFrame:
    """Append the class key of every row's text (null without words) as column ``name``."""

    def start():
        hashes = Substrings()

        def fn(batch):
            sets = (shingles(v, hashes, size) for v in batch.column(text).to_pylist())
            return [pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets],
                             pa.binary())]

        return fn

    return map_columns(docs, text, [(name, T.BinaryType())], start, limit=8 << 20)


def postings(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, class_key, popularity) of the prefix of every class that can have a partner."""
    posted = classes.select("class_key", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = posted.join(shared, "key")
    own = found.groupBy("class_key").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))
    own = own.where(F.size("own") >= MATCHES)
    # values of one class only come first in the global order and use up prefix places
    places = F.size("own") - F.lit(MATCHES - 1)
    popular = F.aggregate("own", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    rows = own.select("class_key", popular.alias("popularity"), F.explode(F.slice("own", F.lit(1), places)).alias("e"))
    return scratch.keep(rows.select(F.col("e.key").alias("key"), "class_key", "popularity"), "postings")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full shingle sets reach the similarity."""
    left = texts.select(F.col("class_key").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("class_key").alias("v"), F.col("text").alias("text_v"))
    rows = pairs.join(right, "v").join(left, "u").select("u", "v", "text_u", "text_v")

    def check(batches):
        hashes = Substrings()
        last, x = None, None
        for batch in batches:
            good = []
            for u, a, b in zip(batch.column("u").to_pylist(), batch.column("text_u").to_pylist(),
                               batch.column("text_v").to_pylist(), strict=True):
                if u != last:
                    last, x = u, shingles(a, hashes, size)
                y = shingles(b, hashes, size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(check, pairs.select("u", "v").schema)


def _collisions(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs that agree in MATCHES coordinates or more."""
    keys = classes.select("class_key", "keys")
    got = (pairs.distinct().join(keys.select(F.col("class_key").alias("v"), F.col("keys").alias("keys_v")), "v")
           .join(keys.select(F.col("class_key").alias("u"), F.col("keys").alias("keys_u")), "u"))
    return got.where(F.size(F.array_intersect("keys_u", "keys_v")) >= MATCHES).select("u", "v")


def _labelled(posts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Posts with their class's component so far."""
    if roots is None:
        return posts.withColumn("comp", F.col("class_key"))
    return (posts.join(roots.withColumnRenamed("node", "class_key"), "class_key", "left")
            .withColumn("comp", F.coalesce("root", "class_key")).drop("root"))


def _open(posts: DataFrame) -> DataFrame:
    """Posts of the lists that span more than one component, with the component of their most popular class."""
    state = posts.groupBy("key").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b"),
        F.max(F.struct("popularity", "class_key", "comp")).alias("lead")).where("a <> b")
    return posts.join(state.select("key", "lead"), "key")


def _prefixes(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(shingle, place, n, class_key, comp, minor): the prefix of every open class in a common order, rare first."""
    rows = classes.join(texts, "class_key")
    spark = rows.sparkSession

    def count(batches):
        hashes = Substrings()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                x = np.concatenate([shingles(t, hashes, size) for t in part.column("text").to_pylist()] or [[]])
                key, n = np.unique((x.astype(np.uint64) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    table = np.zeros(BUCKETS, dtype=np.int64)
    table[np.asarray(counted.column("bucket"))] = np.asarray(counted.column("n"))
    shared = spark.sparkContext.broadcast(table)

    def cut(batches):
        hashes = Substrings()
        for batch in batches:
            out = [[], [], [], [], [], []]
            for key, comp, minor, value in zip(*(batch.column(c).to_pylist() for c in (
                    "class_key", "comp", "minor", "text")), strict=True):
                x = shingles(value, hashes, size)
                x = x[np.lexsort((x, shared.value[(x % np.uint64(BUCKETS)).astype(np.int64)]))]
                keep = len(x) - -(-percent * len(x) // 100) + 1
                for col, v in zip(out, (x[:keep].view(np.int64), np.arange(keep), np.full(keep, len(x)),
                                        [key] * keep, [comp] * keep, [minor] * keep), strict=True):
                    col.append(v)
            flat = [np.concatenate(c) if out[0] else np.zeros(0, np.int64) for c in out[:3]]
            lists = [[v for part in c for v in part] for c in out[3:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[0]), pa.array(flat[1]), pa.array(flat[2]), pa.array(lists[0], pa.binary()),
                 pa.array(lists[1], pa.binary()), pa.array(lists[2], pa.bool_())],
                names=["shingle", "place", "n", "class_key", "comp", "minor"])

    return rows.select("class_key", "comp", "minor", "text").mapInArrow(
        cut, "shingle long, place long, n long, class_key binary, comp binary, minor boolean")


def _complete(left: DataFrame, texts: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Every pair (u, v) of open classes of different components that can reach the similarity."""
    classes = left.groupBy("class_key").agg(F.first("comp").alias("comp"),
                                            F.max(F.col("comp") != F.col("lead.comp")).alias("minor"))
    rows = scratch.keep(_prefixes(classes, texts, size, percent), "prefixes")
    u = rows.where("minor").select("shingle", *[F.col(c).alias(f"{c}_u") for c in ("place", "n", "class_key", "comp")])
    v = rows.select("shingle", *[F.col(c).alias(f"{c}_v") for c in ("place", "n", "class_key", "comp", "minor")])
    room = F.least(F.col("n_u") - F.col("place_u"), F.col("n_v") - F.col("place_v"))
    pairs = u.join(v, (u["shingle"] == v["shingle"]) & (F.col("comp_u") != F.col("comp_v"))
                   & (~F.col("minor_v") | (F.col("class_key_u") < F.col("class_key_v")))
                   & ((100 + percent) * room >= percent * (F.col("n_u") + F.col("n_v"))))
    return pairs.select(F.col("class_key_u").alias("u"), F.col("class_key_v").alias("v")).distinct()


def near_classes(docs: DataFrame, text: str = "text", size: int = SIZE, percent: int = PERCENT,
                 key: str = "doc_id") -> tuple[DataFrame, Scratch]:
    """Rows (key, n_shingles, class_key, component_key) of all documents, and the scratch folder that they live in."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sketched = scratch.keep(sketch(rows, "text", keep=["id"], size=size), "sketch")
    classes = scratch.keep(sketched.where("class_key is not null").groupBy("class_key").agg(
        F.first("keys").alias("keys")), "classes")  # equal sets have equal keys
    posts = postings(classes, scratch)
    able = posts.select("class_key").distinct()
    signed = scratch.keep(classes.join(able, "class_key", "left_semi"), "signed")
    texts = class_keys(rows.select("text"), "text", size, "class_key").join(able, "class_key", "left_semi")
    texts = scratch.keep(texts.groupBy("class_key").agg(F.min("text").alias("text")), "texts")
    roots, links = None, None
    for step in range(LEADER_ROUNDS + 1):
        left = scratch.keep(_open(_labelled(posts, roots)), f"open-{step}")
        if left.isEmpty():
            break
        if step < LEADER_ROUNDS:
            if step == 0:
                pairs = left.select(F.col("lead.class_key").alias("u"), F.col("class_key").alias("v"))
            else:  # outside the first leader's component: to the list's most popular class out there, and into it
                away = left.where("comp <> lead.comp")
                next_lead = away.groupBy("key").agg(
                    F.max(F.struct("popularity", "class_key", "comp")).alias("second"))
                pairs = left.join(next_lead, "key").where("comp <> second.comp").select(
                    F.col("second.class_key").alias("u"), F.col("class_key").alias("v"))
            pairs = _collisions(pairs.where("u <> v"), signed)
        else:
            pairs = _complete(left, texts, scratch, size, percent)
        pairs = scratch.keep(pairs, f"pairs-{step}")
        found = confirm(pairs, texts, size, percent)
        links = scratch.keep(found if roots is None else found.unionByName(
            roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), f"links-{step}")
        roots = connected(links, scratch, f"star-{step}")
        for name in (f"open-{step}", f"pairs-{step}", *([f"links-{step - 1}"] if step else [])):
            scratch.drop(name)
    for name in ("classes", "postings", "signed", "texts"):  # the result reads the sketch and the last star only
        scratch.drop(name)
    labelled = sketched.select("id", "n_shingles", "class_key")
    if roots is None:
        return labelled.withColumn("component_key", F.col("class_key")), scratch
    return (labelled.join(roots.withColumnRenamed("node", "class_key"), "class_key", "left")
            .select("id", "n_shingles", "class_key", F.coalesce("root", "class_key").alias("component_key")), scratch)


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE,
                percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: the key column, ``n_shingles``, ``component_id`` and ``kept``."""
    rows, _ = near_classes(docs, text, size, percent, key)
    least = rows.where("component_key is not null").groupBy("component_key").agg(F.min("id").alias("component_id"))
    out = rows.join(least, "component_key", "left")
    component = F.when(F.col("class_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE,
             percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the row with the least id; wordless rows all stay.

    Of rows that repeat the id and the shingle set of a kept row, one stays.
    """
    rows, _ = near_classes(docs, text, size, percent, key)
    first = (rows.where("component_key is not null").groupBy("component_key")
             .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "class_key")).alias("w"))
             .select(F.col("w.id").alias("_id"), F.col("w.class_key").alias("_class"), F.lit(True).alias("_first")))
    made = class_keys(docs, text, size, "_class_of")
    joined = made.join(first, made[key].eqNullSafe(first["_id"]) & (made["_class_of"] == first["_class"]), "left")
    stay = joined.where("_class_of is null or _first")
    # rows without words are not copies of each other
    alone = F.when(F.col("_class_of").isNull(), F.monotonically_increasing_id())
    return stay.withColumn("_alone", alone).dropDuplicates([key, "_class_of", "_alone"]).select(docs.columns)

"""Sharding by histogram sort: shards of near equal bytes that are consecutive ranges of one order of the rows.

Rows are ordered by 16 hexadecimal digits of their text's digest and 16 of their key's, so copies of one text stand
together and the order is a shuffle. Splitters are found by counting, not by sorting: a cell is a prefix of the order,
and each round counts the exact bytes and rows of every open cell's sub-cells below all probes (two more digits behind what
the cell's least and greatest row share, so 256 probes a cell) in one partial aggregate over narrow rows (order
key and size). A cell stays open while

* it holds more than ``tolerance`` of a shard's mean, in bytes or rows, or
* a target (an n-th of all bytes) lies inside it and it holds more than one text, or is a part of one text,

and it holds two different rows. A splitter is then the boundary between two texts nearest to its target, if that is
within ``tolerance`` of a shard's mean, else the boundary between two rows nearest to it. So copies of one text share a
shard unless they are too many. The rows are exchanged once, by cell: a cell's base comes from the counts, a row's place in its
cell from one window over the cell, and both together give shard and slot.

Open cells are at most ``2 n / tolerance + n`` a round (they are disjoint and each holds its share, or a target), which
bounds what is broadcast; their sub-cells are 256 times as many at most. Only totals and n - 1 splitters reach the driver.
Cells are small, so no task gets a large share, whatever one text's copies weigh.

Defined cases: a null text counts as empty, a null key as the empty string; rows that agree in text and key have
no order among them (they may be cut between shards, by count); fewer rows than shards leave shards empty; an empty
table gives an empty result; input columns named ``size``, ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TOLERANCE = 0.005
STEP = 2  # digits a round
WIDTH = 16  # digits of the text's digest in the order key


def _digits(c: Column) -> Column:
    return F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, WIDTH)


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) and one."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def _shared(a: str, b: str) -> Column:
    """Number of leading characters that two columns of equal length share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.length(a)).cast("int")


def _counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("parent", "cell").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("place").alias("least"),
        F.max("place").alias("greatest"), *[F.first(c).alias(c) for c in ("base", "before", "text_base")])


def _one_text() -> Column:
    return F.substring("least", 1, WIDTH) == F.substring("greatest", 1, WIDTH)


class Cells:
    """Leaf cells of the order with their bytes and rows before them, and the open cells of each round."""

    def __init__(self, keys: DataFrame, n: int, tolerance: float, scratch: Scratch):
        """``keys``: place (32 digits) and size of every row."""
        totals = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("c"),
                          F.min("place").alias("lo"), F.max("place").alias("hi")).first()
        self.n, self.tolerance, self.bytes, self.rows = n, tolerance, totals.b, totals.c
        self.open, self.leaves = [], None
        if not self.rows:
            return
        same = len(os.path.commonprefix([totals.lo, totals.hi]))
        self.first = self._probe(same)
        zero, text_base = F.lit(0).cast("long"), F.lit(0 if same >= WIDTH else None).cast("long")
        current = keys.select("place", "size", F.lit("").alias("parent"), F.substring("place", 1, self.first).alias("cell"),
                              zero.alias("base"), zero.alias("before"), text_base.alias("text_base"))
        closed = []
        while True:
            order = Window.partitionBy("parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
            counted = scratch.keep(_counts(current).select(
                "cell", "bytes", "rows", "least", "greatest", "text_base",
                (F.col("base") + F.coalesce(F.sum("bytes").over(order), F.lit(0))).alias("base"),
                (F.col("before") + F.coalesce(F.sum("rows").over(order), F.lit(0))).alias("before")),
                f"cells{len(closed)}")
            wide = self._wide()
            closed.append(counted.where(~wide))
            opened = scratch.keep(self._step(counted.where(wide)), f"open{len(closed)}")
            if opened.isEmpty():
                break
            self.open.append(opened)
            current = current.select("place", "size", "cell").join(
                F.broadcast(opened.withColumnRenamed("cell", "parent")), F.col("cell") == F.col("parent")).select(
                "place", "size", "parent", F.expr("substr(place, 1, upto)").alias("cell"), "base", "before", "text_base")
        self.leaves = closed[0]
        for more in closed[1:]:
            self.leaves = self.leaves.unionByName(more)

    def _wide(self) -> Column:
        """Whether a cell has to be counted more finely."""
        heavy = ((F.col("bytes") > self.tolerance * self.bytes / self.n)
                 | (F.col("rows") > self.tolerance * self.rows / self.n))
        target = (F.expr(f"({self.n} * base) div {self.bytes}") + 1) * self.bytes  # the next target, n times
        inside = target < self.n * (F.col("base") + F.col("bytes"))
        part = F.length("cell") > WIDTH
        return (F.col("least") != F.col("greatest")) & (heavy | inside & (~_one_text() | part))

    @staticmethod
    def _step(cells: DataFrame) -> DataFrame:
        """Open cells; ``text_base`` has the bytes before a cell's text, if it has one text only."""
        same = _shared("least", "greatest")
        upto = F.when(same < WIDTH, F.least(same + STEP, F.lit(WIDTH))).otherwise(same + STEP)
        return cells.select("cell", "base", "before", upto.cast("int").alias("upto"),
                            F.when(_one_text(), F.coalesce("text_base", "base")).alias("text_base"))

    @staticmethod
    def _probe(same: int) -> int:
        """Digits of the sub-cells of rows that share ``same`` digits."""
        return min(same + STEP, WIDTH) if same < WIDTH else same + STEP

    def splitters(self) -> list[int]:
        """Rows before each shard but the first."""
        if not self.rows or self.n < 2:
            return [0] * (self.n - 1)
        n, total = self.n, self.bytes
        targets = F.explode(F.array(*[F.lit(j) for j in range(1, n)])).alias("j")
        goal = F.col("j").cast("long") * F.lit(total).cast("long")  # in n-ths of a byte
        # rows that agree in text and key have one size and can be cut anywhere
        alike = (F.col("least") == F.col("greatest")) & (F.col("rows") > 1)
        inner = F.when(alike, F.expr(f"(j * {total}L - {n} * base) div ({n} * (bytes div rows))"))
        skips = [F.greatest(F.lit(0), F.least(F.col("rows") - 1, F.coalesce(inner + d, F.lit(0)))) for d in (0, 1)]
        inside = F.col("base") > F.col("text_base")  # the leaf begins inside a text
        begins = self.leaves.select("*", targets).select("*", F.explode(F.array_distinct(F.array(
            F.lit(0).cast("long"), *skips))).alias("skip")).select(
                "j", (F.col("before") + F.col("skip")).alias("row"),
                (F.col("base") + F.col("skip") * F.expr("bytes div rows")).alias("start"),
                (F.coalesce(inside, F.lit(False)) | (F.col("skip") > 0)).alias("cut"))
        end = self.leaves.sparkSession.range(1).select(
            targets, F.lit(self.rows).cast("long").alias("row"), F.lit(total).cast("long").alias("start"),
            F.lit(False).alias("cut"))
        off = F.abs(n * F.col("start") - goal)
        whole = ~F.col("cut") & (off <= self.tolerance * total)
        best = F.min(F.struct(F.when(whole, 0).otherwise(1).alias("kind"), off.alias("off"), F.col("row")))
        rows = {r.j: r.best.row for r in begins.unionByName(end).groupBy("j").agg(best.alias("best")).collect()}
        return [rows[j] for j in range(1, n)]

    def cell_of(self, rows: DataFrame) -> DataFrame:
        """Append ``cell``, the leaf that holds the row's ``place``."""
        out = rows.withColumn("cell", F.substring("place", 1, self.first))
        for opened in self.open:
            step = opened.select(F.col("cell").alias("_parent"), "upto")
            out = out.join(F.broadcast(step), F.col("cell") == F.col("_parent"), "left")
            deeper = F.when(F.col("upto").isNotNull(), F.expr("substr(place, 1, upto)")).otherwise(F.col("cell"))
            out = out.withColumn("cell", deeper).drop("_parent", "upto")
        return out


def assign(rows: DataFrame, n: int, text: str = "text", key: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Append ``size``, ``shard`` (0 to n - 1) and ``slot`` (0, 1, ... in each shard) to ``rows``."""
    names = ["size", "shard", "slot"]
    rows = rows.select([c for c in rows.columns if c not in names])
    own = rows.columns
    inside = ["place", "cell", "before"]  # set aside where they clash
    rows = rows.withColumnsRenamed({c: f"_own_{c}" for c in own if c in inside})
    text, key = (f"_own_{c}" if c in inside else c for c in (text, key))
    keyed = rows.withColumns({"place": F.concat(_digits(F.col(text)), _digits(F.col(key))), "size": row_size(text)})
    scratch = Scratch(rows.sparkSession, "shards")
    keys = scratch.keep(keyed.select("place", "size"), "keys")
    cells = Cells(keys, n, tolerance, scratch)
    if not cells.rows:
        return keyed.select(*[c for c in keyed.columns if c not in inside], F.lit(0).alias("shard"),
                            F.lit(0).cast("long").alias("slot")).withColumnsRenamed({f"_own_{c}": c for c in inside})
    starts = [0, *cells.splitters()]
    in_cell = Window.partitionBy("cell").orderBy("place")
    numbered = cells.cell_of(keyed).withColumn("_nth", F.row_number().over(in_cell))
    leaves = cells.leaves.select(F.col("cell").alias("_leaf"), "before")
    placed = numbered.join(leaves, F.col("cell") == F.col("_leaf"))
    row = F.col("before") + F.col("_nth") - 1
    shard = sum(((row >= s).cast("int") for s in starts[1:]), F.lit(0))
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard") + 1)
    out = placed.withColumn("_row", row).withColumn("shard", shard).withColumn("slot", F.col("_row") - first)
    gone = [*inside, "_nth", "_leaf", "_row"]
    return out.drop(*gone).withColumnsRenamed({f"_own_{c}": c for c in inside}).select(*own, *names)


def write(sharded: DataFrame, path: str) -> None:
    """Parquet files, one folder a shard; a reader restores a shard's order by ``slot``."""
    sharded.write.partitionBy("shard").parquet(path)

"""Sharding: best-fit-decreasing bin packing of indivisible groups into shards of one capacity.

A group is all rows of equal text. Groups are only summed, never gathered:

* groups of at least 1/64 of a mean shard are items of their own. There are at most 64 * shards of them, whatever the
  input's size;
* all other groups are items too, but those of nearly equal bytes (a factor of LEVEL apart) form a level, and only the
  count and sum of each level go to the driver: some thousand numbers. As the items of a level are alike, one step of the
  packing puts as many of them as fit into the bin it has found. Which ones these are is settled where the groups lie: they
  are numbered within their level by a hash, without a gap, and each run of numbers has its bin.

Items sorted by size enter the bin with the tightest sufficient remaining capacity, found in a balanced (AVL) tree keyed
by remaining capacity. The capacity is the least one, by bisection, at which that many bins take all items. A group larger
than a mean shard cannot be balanced while it stays whole: it gets a bin of its own and the others are balanced among
themselves.

Ties of size go by the group's hashes. Nulls: a null text counts as an empty one (16 bytes, crc32 0). Repeated rows each get a slot. An empty table gives no
rows. A very long text is a group like any other. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textgate.llm.common import stored, table

ROW_BYTES = 16
FINE = 64
LEVEL = 1.02
CELL_ROWS = 100_000


class CapacityTree:
    """AVL tree of (remaining capacity, bin); best_fit() takes out the least entry that holds a size."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _balanced(self, node: list) -> list:
        tall = self._height
        node[3] = 1 + max(tall(node[1]), tall(node[2]))
        lean = tall(node[1]) - tall(node[2])
        if lean > 1:
            if tall(node[1][1]) < tall(node[1][2]):
                node[1] = self._rotated(node[1], 2)
            return self._rotated(node, 1)
        if lean < -1:
            if tall(node[2][2]) < tall(node[2][1]):
                node[2] = self._rotated(node[2], 1)
            return self._rotated(node, 2)
        return node

    def _rotated(self, node: list, side: int) -> list:
        """Lift the child on that side (1 left, 2 right) above its parent."""
        child, other = node[side], 3 - side
        node[side], child[other] = child[other], node
        for x in (node, child):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return child

    def add(self, key: tuple[int, int]) -> None:
        def put(node: list | None) -> list:
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._balanced(node)

        self.root = put(self.root)

    def _without(self, node: list, key: tuple[int, int]) -> list | None:
        if key == node[0]:
            if not node[1] or not node[2]:
                return node[1] or node[2]
            heir = node[2]
            while heir[1]:
                heir = heir[1]
            node[0] = heir[0]
            node[2] = self._without(node[2], heir[0])
        else:
            side = 1 if key < node[0] else 2
            node[side] = self._without(node[side], key)
        return self._balanced(node)

    def best_fit(self, size: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self.root = self._without(self.root, best)
        return best


Runs = list[tuple[int, int]]  # (bin, how many items)


def place(items: list[tuple[float, int]], capacity: float, most_bins: int) -> list[Runs] | None:
    """For each (size, count), in descending order of size, the bins of its items; None if they need more than most_bins."""
    tree, placed, opened = CapacityTree(), [], 0
    for size, count in items:
        runs: Runs = []
        while count:
            found = tree.best_fit(size)
            if found is None:
                if opened == most_bins or size > capacity:
                    return None
                found, opened = (capacity, opened), opened + 1
            n = max(1, min(count, int(found[0] // size)))
            runs.append((found[1], n))
            tree.add((found[0] - n * size, found[1]))
            count -= n
        placed.append(runs)
    return placed


def best_fit_decreasing(sizes: list[int], capacity: int, most_bins: int) -> list[int] | None:
    """The bin of each item (sizes must be in descending order), or None if they need more than most_bins bins."""
    placed = place([(s, 1) for s in sizes], capacity, most_bins)
    return None if placed is None else [runs[0][0] for runs in placed]


def pack(items: list[tuple[float, int, object]], n_bins: int) -> dict[object, Runs]:
    """Bins of each name's items. items: (size, count, name), of any order; all bins get nearly equal sums where that is
    possible."""
    items = sorted(items, key=lambda x: (-x[0], str(x[2])))
    placed: dict[object, Runs] = {}
    first = 0
    while items and items[0][1] == 1 and n_bins - first > 1 and items[0][0] * (n_bins - first) > sum(s * c for s, c, _ in items):
        placed[items.pop(0)[2]] = [(first, 1)]
        first += 1
    if not items:
        return placed
    left, sizes = n_bins - first, [(s, c) for s, c, _ in items]
    low = max(math.ceil(sizes[0][0]), math.ceil(sum(s * c for s, c in sizes) / left))
    high = max(low, 2 * low)
    while (best := place(sizes, high, left)) is None:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        found = place(sizes, middle, left)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return placed | {name: [(first + b, n) for b, n in runs] for (_, _, name), runs in zip(items, best, strict=True)}


def pack_shards(docs: DataFrame, n_shards: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_group"),
    )
    # The two hashes and the size stand for the text. Texts that collided would share a shard, which harms nothing.
    rows = stored(rows, "shard-rows")
    key = ["_group", "text_crc32", "size"]
    groups = stored(rows.groupBy(*key).agg(F.sum("size").alias("_bytes")), "shard-groups")
    total, n_groups = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.count("*")).first()
    is_large = F.col("_bytes") * FINE * n_shards >= total
    small = groups.filter(~is_large).withColumn("_level", F.floor(F.log("_bytes") / F.log(F.lit(LEVEL))).cast("int"))
    levels = small.groupBy("_level").agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")).collect()
    items: list[tuple[float, int, object]] = [(r["_bytes"], 1, tuple(r[:3])) for r in groups.filter(is_large).collect()]
    bins = pack(items + [(r["b"] / r["n"], r["n"], r["_level"]) for r in levels], n_shards)
    spark = docs.sparkSession
    large = spark.createDataFrame([(*k, runs[0][0]) for k, runs in bins.items() if isinstance(k, tuple)], "_group long, text_crc32 long, size long, _large int")
    ranges = []
    for level, runs in bins.items():
        begin = 0
        for b, n in runs if not isinstance(level, tuple) else ():
            ranges.append((level, begin, begin + n, b))
            begin += n
    runs_of = F.broadcast(spark.createDataFrame(ranges, "_level int, _from long, _to long, _small int"))  # levels, and a few for each bin
    ranked = numbered(small, ["_level"], key, n_groups // CELL_ROWS)
    in_run = (ranked["_level"] == runs_of["_level"]) & (F.col("_nth") >= F.col("_from")) & (F.col("_nth") < F.col("_to"))
    of_small = ranked.join(runs_of, in_run).select(*key, "_small")
    # Large groups come by a broadcast, so none of the keys that are shuffled has many bytes.
    placed = rows.join(F.broadcast(large), key, "left")
    placed = placed.filter("_large is not null").withColumn("shard", F.col("_large")).drop("_large").unionByName(
        placed.filter("_large is null").drop("_large").join(of_small, key).withColumnRenamed("_small", "shard")
    )
    return numbered(placed.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id", "text_crc32", "size"], n_groups // CELL_ROWS).withColumnRenamed("_nth", "slot")


def numbered(rows: DataFrame, within: list[str], order: list[str], cells: int) -> DataFrame:
    """Adds _nth: the rows of equal `within` numbered from 0 without gaps, by (cell, order).

    No task gets all rows of one `within`: they are dealt into cells by a hash of the row, numbered in their cell and
    shifted by the number of rows in the cells before it. The number of cells grows with the input."""
    cells = max(16, cells)
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    sums = Window.partitionBy(*within).orderBy("_cell")
    before = rows.groupBy(*within, "_cell").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(sums) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*within, "_cell").orderBy(*order))
    out = rows.withColumn("_in_cell", place).join(F.broadcast(before) if cells <= 1024 else before, [*within, "_cell"])
    return out.withColumn("_nth", F.col("_before") + F.col("_in_cell") - 1).drop("_cell", "_in_cell", "_before")


N_SHARDS = 40


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(table(spark, sf_dir, "documents"), N_SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that stays together. Groups of equal size
are interchangeable, so best fit needs only how many groups there are of each
size: groups are counted by size class (exact below 2^``EXACT`` bytes, above
that the leading bits, at most 2^-``EXACT`` apart), at most some 300,000
classes whatever the input, and only those counts reach the driver.
Classes sorted by size enter the shard with the tightest remaining capacity
that holds them, as many of their groups as fit, found in a balanced tree of
remaining capacities; bisection finds the least capacity with which the
wanted number of shards is enough.

The groups of a class are then ranked where they are, in blocks by hash, and
go to the class's shards by rank. Slots are numbered the same way, without a
global sort: rows are ranked inside blocks and the blocks of a shard are laid
end to end.

Defined cases: a null text has no bytes and size 1, an empty text size 1
too but a group of its own (null is not equal to empty); a group larger
than total/shards makes its shard larger than the others, since it can't be
divided; groups of equal size are dealt by a hash of their text; an empty
table gives no rows; repeated doc_ids, null ones and repeated rows are rows of
their own. Other columns than doc_id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import only, written

#: Sizes of fewer bits are classes by themselves; larger ones keep so many leading bits.
EXACT = 14
#: Rows that one task ranks at a time, about.
BLOCK_ROWS = 50_000


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, remove and least entry from a bound on, each in logarithmic time."""

    def __init__(self) -> None:
        self.root = None
        self.state = 0x2545F491

    def _priority(self) -> int:
        self.state = (self.state * 1103515245 + 12345) & 0x7FFFFFFF
        return self.state

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, None, None, self._priority()]), right)

    def take_at_least(self, room: int) -> tuple[int, int] | None:
        """Remove and return the entry with the least capacity that is at least ``room``."""
        left, right = self._split(self.root, (room, -1))
        if right is None:
            self.root = left
            return None
        least = right
        while least[1] is not None:
            least = least[1]
        _, rest = self._split(right, (least[0][0], least[0][1] + 1))
        self.root = self._merge(left, rest)
        return least[0]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """For each (size, count) of items, largest first, the (bin, count) that take them; a new bin opens when no open one has room. Items above the capacity get bins of their own."""
    tree, bins, out = CapacityTree(), 0, []
    for size, count in sizes:
        taken: list[tuple[int, int]] = []
        while count:
            found = tree.take_at_least(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            number = min(count, found[0] // size)
            taken.append((found[1], number))
            tree.insert((found[0] - number * size, found[1]))
            count -= number
        out.append(taken)
    return out


def fit_shards(sizes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Best fit decreasing under the least capacity (by bisection) for which at most ``shards`` bins are opened."""
    if not sizes:
        return []
    opened = lambda tried: max(b for taken in tried for b, _ in taken) + 1
    low = max(-(-sum(s * n for s, n in sizes) // shards), sizes[0][0])
    high = low + sizes[0][0]
    best = best_fit_decreasing(sizes, high)
    while opened(best) > shards:
        high *= 2
        best = best_fit_decreasing(sizes, high)
    step = max(1, low // 20_000)
    while low < high - step:
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle)
        if opened(tried) <= shards:
            best, high = tried, middle
        else:
            low = middle + 1
    tried = best_fit_decreasing(sizes, low)
    return tried if opened(tried) <= shards else best


def size_class(size: Column) -> Column:
    """The largest size of a size's class."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - EXACT)
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return F.when(drop == 0, size).otherwise(F.floor(size / unit).cast("long") * unit + unit - 1)


def ranked(rows: DataFrame, by: list[str], salt: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0 on and gapless within ``by``: rows are ranked in blocks by ``salt``, whose counts give where each block begins."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(salt), F.lit(blocks)))
    counts = dealt.groupBy(*by, "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    starts = counts.select(*by, "block", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy(*by, "block").orderBy(*order))
    return dealt.withColumn("own", own).join(starts, [*by, "block"]).withColumn("rank", (F.col("start") + F.col("own") - 1).cast("long")).drop("block", "own", "start")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, group_key, shard, slot`` for every document."""
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("null")).alias("group_key"),
    )
    # Written once, so a row's number stays what it is; it tells repeated rows apart.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes"))))
    listed = groups.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect()  # bounded by the number of classes
    placed = fit_shards([(r["class"], r["n"]) for r in listed], shards)
    quotas = []
    for r, taken in zip(listed, placed, strict=True):
        first = 0
        for k, number in taken:
            quotas.append((r["class"], first, first + number, k))
            first += number
    quota = spark.createDataFrame(quotas, "class long, first long, last long, shard int")
    # Ranges of ranks: at most one for each class and shard beside one a class.
    placed_groups = ranked(groups, ["class"], "group_key", ["group_key"]).join(F.broadcast(quota), "class").where("rank >= first AND rank < last")
    items = rows.join(placed_groups.select("group_key", "shard"), "group_key")
    return ranked(written(items), ["shard"], "row", ["doc_id", "row"]).select("doc_id", "size", "text_crc32", "group_key", "shard", F.col("rank").alias("slot"))

"""Distances between rankings in long form (id, item, pos), and the joins made of them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permuta.sources.tables import materialize, small


def motions(a: DataFrame, b: DataFrame, key: str, a_pos: str = "pos", b_pos: str = "pos") -> DataFrame:
    """(key, item, motion): signed displacement of each item of a, for rankings with equal keys."""
    right = b.select(key, "item", F.col(b_pos).alias("_to"))
    return a.select(key, "item", F.col(a_pos).alias("_from")).join(right, [key, "item"]).select(key, "item", (F.col("_to") - F.col("_from")).alias("motion"))


def closest_first(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions, one of a and one of b, the closest first, each position used once; ties to the earlier in a, then in b.

    Positions of either side are distinct, so the closest pair left always stands side by
    side among what is left: a heap of neighbours and a linked list find all of them.
    """
    points = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    before, after = list(range(-1, len(points) - 1)), list(range(1, len(points) + 1))
    heap, gone, found = [], [False] * len(points), []

    def meet(i: int, j: int) -> None:
        if 0 <= i and j < len(points) and points[i][1] != points[j][1]:
            x, y = (points[i][0], points[j][0]) if points[i][1] == 0 else (points[j][0], points[i][0])
            heapq.heappush(heap, (abs(x - y), x, y, i, j))

    for i in range(len(points) - 1):
        meet(i, i + 1)
    while heap:
        _, x, y, i, j = heapq.heappop(heap)
        if gone[i] or gone[j]:
            continue
        gone[i] = gone[j] = True
        found.append((x, y))
        left, right = before[i], after[j]
        if left >= 0:
            after[left] = right
        if right < len(points):
            before[right] = left
        meet(left, right)
    return found


def with_repeats(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, item, pos, motion) where items repeat: of one item's occurrences the closest pair of a and b is taken and both are used up, then the next.

    An occurrence without a partner left has no motion. What one task holds of a key and
    item are its positions.
    """
    side = lambda rows, name: rows.groupBy(key, "item").agg(F.collect_list("pos").alias(name))
    both = side(a, "_a").join(side(b, "_b"), [key, "item"])
    kinds = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in (key, "item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [closest_first(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            pairs = np.array([x for y in found for x in y], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1] - pairs[:, 0])], names=[key, "item", "pos", "motion"])

    kind = a.schema["pos"].dataType.simpleString()
    found = both.select(key, "item", "_a", "_b").mapInArrow(run, f"{kinds}, pos bigint, motion bigint")
    return found.select(key, "item", F.col("pos").cast(kind).alias("pos"), F.col("motion").cast(kind).alias("motion"))


def centered(moved: DataFrame, key: str) -> DataFrame:
    """Motions less their mean, rounded half to even."""
    mean = F.avg("motion").over(Window.partitionBy(key))
    return moved.withColumn("motion", F.bround(F.col("motion") - mean, 0).cast("int"))


def missing_center(a: DataFrame, b: DataFrame, key: str, size: Column) -> DataFrame:
    """(key, distance) of keys in both: absent items stand at half the vocabulary's size, so those absent from both add nothing."""
    left, right = a.select(key, "item", F.col("pos").alias("_a")), b.select(key, "item", F.col("pos").alias("_b"))
    apart = F.abs(F.coalesce(F.col("_a"), 0.5 * size) - F.coalesce(F.col("_b"), 0.5 * size))
    sums = left.join(right, [key, "item"], "full").groupBy(key).agg(F.sum(apart).alias("distance"), F.count("_a").alias("_n"), F.count("_b").alias("_m"))
    return sums.where("_n > 0 and _m > 0").select(key, "distance")


def deletion_penalty(prototypes: DataFrame, rows: DataFrame, key: str, size: Column) -> DataFrame:
    """(key, distance): swaps plus half of what deleted items cost, V less their position; half to even."""
    right = rows.select(key, "item", F.col("pos").alias("_b"))
    both = prototypes.select(key, "item", "pos").join(right, [key, "item"], "left")
    deleted = F.sum(F.when(F.col("_b").isNull(), size - F.col("pos")).otherwise(0))
    swapped = F.sum(F.coalesce(F.abs(F.col("_b") - F.col("pos")), F.lit(0)))
    return both.groupBy(key).agg((F.bround(0.5 * deleted, 0) + swapped).cast("bigint").alias("distance"))


def prototype_distances(rows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, proto, distance) for every pair: the small side's positions are joined on item and summed with partial aggregation.

    For banks of up to about 50 prototypes; larger ones go through model.rank_stack.
    """
    bank = prototypes.select("proto", "item", F.col("pos").alias("_p"))
    return rows.select("id", "item", "pos").join(small(bank), "item").groupBy("id", "proto").agg(F.sum(F.abs(F.col("pos") - F.col("_p"))).cast("bigint").alias("distance"))


def rank_layer(rows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """All prototypes of each row in order of distance: a ranking of prototypes (id, item, pos)."""
    order = Window.partitionBy("id").orderBy("distance", "proto")
    return prototype_distances(rows, prototypes).select("id", F.col("proto").alias("item"), (F.row_number().over(order) - 1).alias("pos"))


def nearest_prototype(rows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, proto, distance) of the closest prototype, ties to the smaller one."""
    best = F.min(F.struct("distance", "proto")).alias("b")
    return prototype_distances(rows, prototypes).groupBy("id").agg(best).select("id", "b.proto", "b.distance")


#: Prototypes that are sent to all rows as one array, at most.
MOST_PROTOTYPES = 1000


def nearest_in_arrays(rows: DataFrame, prototypes: DataFrame, keep: list[str]) -> DataFrame:
    """(id, keep.., proto, distance) of rows (id, keep.., v: positions of all items in ascending order of the items), ties to the smaller prototype.

    Rows stay where they are: prototypes, all of the same items as the rows, are sent as one
    array, and the closest is found in one expression, without a shuffle. More than
    MOST_PROTOTYPES are joined by item instead. Without prototypes there are no rows.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item", "pos"))), lambda s: s["pos"])
    bank = materialize(prototypes.groupBy("proto").agg(ordered.alias("v")), "prototypes")
    if bank.count() > MOST_PROTOTYPES:
        long = lambda side, key: side.select(key, F.posexplode("v").alias("item", "pos"))
        return rows.select("id", *keep).join(nearest_prototype(long(rows, "id"), long(bank, "proto")), "id")
    one = bank.agg(F.collect_list(F.struct("proto", "v")).alias("_bank"))
    total = lambda p: F.aggregate(F.zip_with("v", p["v"], lambda a, b: F.abs(a - b)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    closest = F.array_min(F.transform("_bank", lambda p: F.struct(total(p).alias("distance"), p["proto"].alias("proto"))))
    found = rows.join(F.broadcast(one)).where(F.size("_bank") > 0).select("id", *keep, closest.alias("_b"))
    return found.select("id", *keep, F.col("_b.proto").alias("proto"), F.col("_b.distance").alias("distance"))


def inversions(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each group 0 .. of consecutive values, how many pairs stand in descending order; equal values don't count.

    Values are split by their bits from the highest: in a stable split every 0 that stands
    behind a 1 with the same higher bits is an inversion, so sums over each of log(n)
    levels count all of them, as merging sorted halves would.
    """
    many = int(group.max(initial=-1)) + 1
    found = np.zeros(many, np.int64)
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    bits = int(ranks.max(initial=0)).bit_length()
    order, block = np.arange(len(ranks)), group.astype(np.int64)
    for bit in range(bits - 1, -1, -1):
        one = (ranks[order] >> bit) & 1
        ones = np.cumsum(one) - one
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        size = np.diff(np.append(first, len(block)))
        ahead = ones - np.repeat(ones[first], size)
        np.add.at(found, group[order][one == 0], ahead[one == 0])
        key = 2 * block + one
        again = np.argsort(key, kind="stable")
        order, block = order[again], key[again]
        # Blocks are named anew, so that their numbers don't grow with the levels.
        block = np.cumsum(np.append(0, block[1:] != block[:-1])) if len(block) else block
    return found


def kendall(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, discordant): item pairs that a and b order differently; pairs tied in either don't count.

    In the order of a, discordant pairs are the inversions of b's positions. They are
    counted in batches of rankings, in n log n of a ranking's length.
    """
    both = a.select(key, "item", F.col("pos").alias("_a")).join(b.select(key, "item", F.col("pos").alias("_b")), [key, "item"])
    rows = both.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_a", "_b"))), lambda s: s["_b"]).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            found = inversions(lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.append(found, np.zeros(len(sizes) - len(found), np.int64)))], names=[key, "discordant"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, discordant bigint")

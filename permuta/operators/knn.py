"""Exact nearest neighbours under a metric, by a pivot index that leaves most blocks out.

A few rows are pivots. Every row belongs to the ball of its nearest pivot, and inside a
ball rows in order of that distance form blocks; a block is a table row that holds its
rows and, for every pivot, their least and largest distance to it. Queries are packed
the same way. By the triangle inequality two rows are at least as far apart as their
distances to any pivot differ, which bounds two balls or two blocks as well as two rows.

A pack is first compared with the block most like it, which gives each query a reach: its
k-th distance so far. Packs of neighbouring balls form groups; a task holds a group's
queries while blocks of the balls they reach stream by, so a row moves once for each
group and a query once for each task of its group, not for each pair of blocks. Blocks
that no pack reaches are passed over, the others are compared with the queries that reach
them: roughly in single precision with room for its error, exactly where that leaves it
open. What is found shortens the reach. The result is exact; the pairs left to compare
still grow faster than the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permuta.functions.rankings import hash_uniform
from permuta.sources.tables import materialize

BLOCK = 256
PIVOTS = 48
#: Numbers of a distance table computed at once.
CELLS = 1 << 18
#: Queries that a task holds, at most, and rows that it is worth a task to compare them with.
HELD = 32768
COLUMN = 8192
#: Distances are compared after rounding to so many places; bounds leave room for it.
PLACES = 9


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two small sets, by components: l1 or l2."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        apart = x[:, i, None] - y[None, :, i]
        out += np.abs(apart) if metric == "l1" else apart * apart
    return np.round(out if metric == "l1" else np.sqrt(out), PLACES)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as rows of doubles."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1 or column.null_count:
        raise ValueError("vectors must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def packed(rows: DataFrame, pivots: np.ndarray, metric: str, block: int) -> DataFrame:
    """Blocks of (id, v, label): ball, block, n, near (middle distance to the ball's pivot), low and high by pivot, ids, labels, rows, spans (each row's distances to the pivots)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            spans = np.concatenate([distances(x[i : i + 4096], pivots, metric) for i in range(0, len(x), 4096)])
            ball = spans.argmin(axis=1)
            packs = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packs, pa.array(ball.astype(np.int32)), pa.array(spans[np.arange(len(x)), ball])], names=["id", "label", "row", "span", "ball", "far"])

    placed = rows.select("id", F.col("v").cast("array<double>").alias("v"), F.col("label").cast("bigint").alias("label")).mapInArrow(place, "id bigint, label bigint, row binary, span binary, ball int, far double")
    width = len(pivots)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= 4 * block:
                done = blocks_of(held, block, width, False)
                yield from done[0]
                held = done[1]
        if held is not None and held.num_rows:
            yield from blocks_of(held, block, width, True)[0]

    # A range of rows in order of ball and distance is cut into blocks as it streams by.
    ordered = placed.repartitionByRange("ball", "far", "id").sortWithinPartitions("ball", "far", "id")
    kinds = "ball int, n bigint, near double, low binary, high binary, ids binary, labels binary, rows binary, spans binary"
    return ordered.mapInArrow(build, kinds).withColumn("block", F.monotonically_increasing_id())


def blocks_of(rows: pa.Table, block: int, width: int, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
    """Blocks of sorted rows, no block of two balls; and what is left of the last ball where more rows may follow."""
    rows = rows.combine_chunks()
    balls = rows.column("ball").to_numpy()
    first = np.flatnonzero(np.append(True, balls[1:] != balls[:-1]))
    out, end = [], 0
    for a, b in zip(first, np.append(first[1:], len(balls)), strict=True):
        for at in range(a, b, block):
            if not last and b == len(balls) and at + block > b:
                break
            part = rows.slice(at, min(block, b - at))
            spans = np.frombuffer(b"".join(part.column("span").to_pylist()), np.float64).reshape(-1, width)
            ids, labels = part.column("id").to_numpy().astype(np.int64), part.column("label").fill_null(-1).to_numpy().astype(np.int64)
            cells = [int(balls[a]), len(part), float(part.column("far").to_numpy().mean()), spans.min(axis=0).tobytes(), spans.max(axis=0).tobytes(), ids.tobytes(), labels.tobytes(), b"".join(part.column("row").to_pylist()), spans.tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.float64(), *[pa.binary()] * 6]
            names = ["ball", "n", "near", "low", "high", "ids", "labels", "rows", "spans"]
            out.append(pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names))
            end = at + len(part)
    return out, rows.slice(end)


def gap(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """The least distance that rows between two pairs of bounds can have."""
    return np.maximum(low - other_high, other_low - high).max(axis=-1, initial=0) - 10.0**-PLACES


def homes(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    """(pack, reach, most, compared) of a pack and one block each (q_ids, q_rows, ids, rows): every query's k-th distance there, and the largest of them; infinite where the block has fewer rows, which says nothing about the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, many = len(row["q_ids"]) // 8, len(row["ids"]) // 8
                x, y = np.frombuffer(row["q_rows"], np.float64).reshape(n, -1), np.frombuffer(row["rows"], np.float64).reshape(many, -1)
                reach = np.partition(distances(x, y, metric), k - 1, axis=1)[:, k - 1] if many >= k else np.full(n, np.inf)
                out.append((row["pack"], reach.tobytes(), float(reach.max()), n * many))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.float64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.float64(), pa.int64())], names=["pack", "reach", "most", "compared"])

    return pairs.select("pack", "q_ids", "q_rows", "ids", "rows").mapInArrow(run, "pack bigint, reach binary, most double, compared bigint")


class Held:
    """Queries of a tile with what has been found for each: the k nearest so far, and the reach beyond which nothing counts."""

    def __init__(self, packs: list[dict], k: int, metric: str, centre: np.ndarray):
        join = lambda c, t: np.frombuffer(b"".join(p[c] for p in packs), t)
        self.k, self.metric, self.centre, self.compared = k, metric, centre, 0
        self.ids, self.reach = join("ids", np.int64), join("reach", np.float64).copy()
        n = len(self.ids)
        self.rows, self.spans = join("rows", np.float64).reshape(n, -1), join("spans", np.float64).reshape(n, -1)
        self.low, self.high = join("low", np.float64).reshape(len(packs), -1), join("high", np.float64).reshape(len(packs), -1)
        self.first = np.cumsum([0, *(len(p["ids"]) // 8 for p in packs)])
        self.far, self.ref, self.label = np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.most = np.maximum.reduceat(self.reach, self.first[:-1])
        middle = self.rows - centre
        self.size = float(np.abs(middle).max(initial=0))
        # Half precision of a double is enough to leave pairs out, unless numbers are beyond it.
        self.kind = np.float32 if self.size < 1e15 else np.float64
        self.short = middle.astype(self.kind)
        self.norm = (self.short.astype(np.float64) ** 2).sum(axis=1).astype(self.kind)

    def meet(self, block: dict) -> None:
        """Take what is nearer in a block."""
        low, high = np.frombuffer(block["low"], np.float64), np.frombuffer(block["high"], np.float64)
        packs = np.flatnonzero(gap(self.low, self.high, low, high) <= self.most)
        if not len(packs):
            return
        ask = np.concatenate([np.arange(self.first[p], self.first[p + 1]) for p in packs])
        ask = ask[gap(self.spans[ask], self.spans[ask], low, high) <= self.reach[ask]]
        ids, labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
        y = np.frombuffer(block["rows"], np.float64).reshape(len(ids), -1)
        middle = y - self.centre
        size = self.size + float(np.abs(middle).max(initial=0))
        short = np.ascontiguousarray(middle.astype(self.kind if size < 1e15 else np.float64).T)
        self.compared += len(ask) * len(ids)
        width = y.shape[1]
        slack = 1.2e-7 * width * (width + 4) * (size if self.metric == "l1" else size * size)
        step = max(1, CELLS // len(ids))
        for at in range(0, len(ask), step):
            some = ask[at : at + step]
            limit = self.reach[some] + slack if self.metric == "l1" else (self.reach[some] + 10.0**-PLACES) ** 2 + slack
            # Pairs that aren't surely farther, numbers that overflow among them, are measured exactly.
            with np.errstate(all="ignore"):
                i, j = np.nonzero(~(self.about(some, short) > limit[:, None]))
            if len(i):
                self.take(some[i], y[j], ids[j], labels[j])
        for p in packs:
            self.most[p] = self.reach[self.first[p] : self.first[p + 1]].max()

    def about(self, some: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Distances (l2: their squares) of some queries and a block's columns, up to rounding."""
        x = self.short[some]
        if self.metric != "l1":
            return self.norm[some][:, None] + (short * short).sum(axis=0) - 2 * (x @ short)
        out = np.zeros((len(x), short.shape[1]), np.result_type(x, short))
        apart = np.empty_like(out)
        for c in range(len(short)):
            np.subtract(x[:, c, None], short[c], out=apart)
            np.abs(apart, out=apart)
            out += apart
        return out

    def take(self, who: np.ndarray, y: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Measure pairs and keep each query's k nearest of them and those before, ties by id."""
        x, far = self.rows[who], np.zeros(len(who))
        for c in range(x.shape[1]):
            apart = x[:, c] - y[:, c]
            far += np.abs(apart) if self.metric == "l1" else apart * apart
        far = np.round(far if self.metric == "l1" else np.sqrt(far), PLACES)
        near = far <= self.reach[who]
        who, far, ids, labels = who[near], far[near], ids[near], labels[near]
        asked = np.unique(who)
        had, at = np.nonzero(np.isfinite(self.far[asked]))
        had = asked[had]
        who = np.concatenate([had, who])
        far, ids, labels = np.concatenate([self.far[had, at], far]), np.concatenate([self.ref[had, at], ids]), np.concatenate([self.label[had, at], labels])
        order = np.lexsort((ids, far, who))
        who = who[order]
        begin = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, int)
        place = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
        order, who, place = order[place < self.k], who[place < self.k], place[place < self.k]
        self.far[who, place], self.ref[who, place], self.label[who, place] = far[order], ids[order], labels[order]
        self.reach[asked] = np.minimum(self.reach[asked], self.far[asked, -1])

    def found(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), 4096):
            part = slice(at, at + 4096)
            i, j = np.nonzero(np.isfinite(self.far[part]))
            cells = [self.ids[part][i], self.ref[part][i, j], self.far[part][i, j], self.label[part][i, j]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cells), pa.nulls(len(i), pa.int64())], names=_NAMES)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())), pa.array([self.compared], pa.int64())], names=_NAMES)


_NAMES = ["id", "ref", "distance", "label", "compared"]


def compare(tiles: DataFrame, k: int, metric: str, centre: np.ndarray) -> DataFrame:
    """The k nearest in each partition's blocks to each of its queries, for partitions of rows whose packs (those with a reach) come first. A row without ref says how many pairs were compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[dict] = []
        held: Held | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["reach"] is not None:
                    packs.append(row)
                elif packs or held:
                    held, packs = held or Held(packs, k, metric, centre), []
                    held.meet(row)
        if held:
            yield from held.found()

    return tiles.select("low", "high", "ids", "labels", "rows", "spans", "reach").mapInArrow(run, "id bigint, ref bigint, distance double, label bigint, compared bigint")


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy("distance", "ref")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def search(queries: DataFrame, train: DataFrame, k: int, metric: str = "l1", pivots: int = PIVOTS, block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The k nearest of train (id, v, label) to each query (id, v), as (id, ref, distance, label) with ties by id; and a table of one row: pairs there are, and pairs compared.

    k stops at the number of training rows less one. Vectors have one length; rows that
    repeat an id are rows of their own, null labels come back null.
    """
    n_train = train.count()
    k = max(1, min(k, n_train - 1))
    spark = train.sparkSession
    chosen = train.select("id", F.col("v").cast("array<double>").alias("v")).orderBy(hash_uniform(seed, F.col("id")), "id").limit(pivots).collect()
    if not chosen:
        none = spark.createDataFrame([], "id bigint, ref bigint, distance double, label bigint")
        return none, spark.createDataFrame([(0, 0)], "pairs bigint, compared bigint")
    points = np.array([r["v"] for r in chosen])
    width = len(points)
    blocks = materialize(packed(train, points, metric, block), "knn-blocks")
    asks = materialize(packed(queries.withColumn("label", F.lit(None).cast("bigint")), points, metric, block).withColumn("pack", F.monotonically_increasing_id()), "knn-packs")
    q = asks.select("pack", F.col("ball").alias("q_ball"), F.col("near").alias("q_near"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))

    # Bounds of whole balls and their rows: as many rows as there are pivots, whatever the number of rows.
    def whole(frame: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        cells = frame.select("ball", "low", "high").mapInArrow(span_rows, "ball int, at int, low double, high double").groupBy("ball", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in cells.collect():
            low, high = out.setdefault(r["ball"], (np.zeros(width), np.zeros(width)))
            low[r["at"]], high[r["at"]] = r["low"], r["high"]
        return out

    balls, ask_balls = whole(blocks), whole(asks)
    # Each pack's first block: in its own ball, or the ball whose bounds are closest, the one whose rows are as far from the pivot.
    home = [(b, min(balls, key=lambda o: (o != b, gap(*balls[o], low, high), o))) for b, (low, high) in ask_balls.items()]
    home = F.broadcast(spark.createDataFrame(home, "q_ball int, ball int"))
    near = q.select("pack", "q_ball", "q_near").join(home, "q_ball").join(blocks.select("ball", "block", F.col("near").alias("_near")), "ball")
    # Comparing costs more than moving: as many tasks as the session's setting says, however few bytes there are.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = near.groupBy("pack").agg(F.min(F.struct(F.abs(F.col("_near") - F.col("q_near")).alias("d"), "ball", "block")).alias("b"))
    near = materialize(near.select("pack", "b.ball", "b.block"), "knn-homes")
    first = near.join(q, "pack").repartition(parts, "ball", "block").join(blocks, ["ball", "block"])
    first = materialize(homes(first, k, metric), "knn-first")
    most = asks.select("pack", "ball", "n").join(first.select("pack", "most"), "pack").groupBy("ball").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
    most = {r["ball"]: (r["most"], r["n"]) for r in most.collect()}
    group_of = grouped({b: n for b, (_, n) in sorted(most.items())}, parts)
    groups = 1 + max((g + split - 1 for g, split in group_of.values()), default=-1)
    columns = max(1, min(-(-parts // max(1, groups)), -(-n_train // COLUMN)))
    # Every group of packs meets the blocks of the balls that one of its balls reaches, the closest balls first.
    apart = distances(points, points, metric)
    meet: dict[tuple[int, int], float] = {}
    for b, (low, high) in ask_balls.items():
        for o in balls:
            if gap(low, high, *balls[o]) <= most[b][0]:
                for g in range(group_of[b][0], sum(group_of[b])):
                    meet[g, o] = min(meet.get((g, o), np.inf), float(apart[b, o]))
    meets = F.broadcast(spark.createDataFrame([(o, g, d) for (g, o), d in meet.items()], "ball int, group int, at double"))
    packs = F.broadcast(spark.createDataFrame([(b, *v) for b, v in group_of.items()], "ball int, start int, split int"))
    cells = ["tile", "at", "low", "high", "ids", "labels", "rows", "spans", "reach"]
    left = asks.join(first.select("pack", "reach"), "pack").join(packs, "ball").withColumn("at", F.lit(-1.0))
    group = F.col("start") + F.pmod(F.hash("pack"), F.col("split"))
    left = left.withColumn("tile", F.explode(F.sequence(group * columns, group * columns + columns - 1))).select(cells)
    right = blocks.withColumn("reach", F.lit(None).cast("binary")).withColumn("spans", F.lit(None).cast("binary")).join(meets, "ball")
    right = right.withColumn("tile", F.col("group") * columns + F.pmod(F.hash("block"), F.lit(columns))).select(cells)
    tiles = left.unionByName(right).repartitionById(max(1, groups * columns), F.col("tile")).sortWithinPartitions("at")
    rest = materialize(compare(tiles, k, metric, points.mean(axis=0)), "knn-rest")
    compared = first.agg(F.sum("compared").alias("c")).unionByName(rest.agg(F.sum("compared").alias("c"))).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("compared"))
    counts = compared.select(F.lit(n_train * queries.count()).cast("bigint").alias("pairs"), "compared")
    found = top(rest.where("ref is not null").select("id", "ref", "distance", F.when(F.col("label") >= 0, F.col("label")).alias("label")), k)
    return found, counts


def grouped(sizes: dict[int, int], parts: int) -> dict[int, tuple[int, int]]:
    """ball -> (first group, groups it is split into), for groups of about as many queries each, HELD at most: small balls share one, large ones are split."""
    most = min(HELD, max(1, -(-sum(sizes.values()) // max(1, round(parts**0.5)))))
    out, group, room = {}, -1, 0
    for ball, n in sizes.items():
        if n > room:
            group, room = group + 1, most
        split = max(1, -(-n // most))
        out[ball] = (group, split)
        group, room = group + split - 1, room - n if split == 1 else 0
    return out


def span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ball, low, high) of blocks -> a row for each of a task's balls and pivots."""
    seen: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for ball, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = np.frombuffer(low, np.float64), np.frombuffer(high, np.float64)
            have = seen.setdefault(ball, [low, high])
            seen[ball] = [np.minimum(have[0], low), np.maximum(have[1], high)]
    for ball, (low, high) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([ball] * len(low), pa.int32()), pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], names=["ball", "at", "low", "high"])


def nearest(queries: DataFrame, train: DataFrame, k: int, metric: str = "l1") -> DataFrame:
    """(id, ref, distance, label): the k nearest of train (id, v, label) to each query (id, v); ties by id."""
    return search(queries, train, k, metric)[0]


def knn_vote(found: DataFrame, weighted: bool = False) -> DataFrame:
    """(id, label): most votes, or the largest sum of inverse distances; ties to the lowest label."""
    weight = F.sum(1 / F.greatest("distance", F.lit(1e-12))) if weighted else F.count("*")
    votes = found.groupBy("id", "label").agg(weight.cast("double").alias("_v"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("_v")).alias("v"), "label")).alias("b")).select("id", "b.label")


def grid_errors(queries: DataFrame, train: DataFrame, ks: tuple[int, ...], metrics: tuple[str, ...] = ("l1", "l2")) -> DataFrame:
    """(metric, k, weights, error) of queries (id, v, label): every number of neighbours, equal votes and votes by inverse distance.

    A metric is searched once, for the largest k; smaller ones are its first rows.
    """
    order = Window.partitionBy("id").orderBy("distance", "ref")
    out = None
    for metric in metrics:
        found = nearest(queries.select("id", "v"), train, max(ks), metric).withColumn("rank", F.row_number().over(order))
        found = found.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: F.col("rank") <= k)))
        votes = found.groupBy("id", "k", "label").agg(F.count("*").cast("double").alias("uniform"), F.sum(1 / F.greatest("distance", F.lit(1e-12))).alias("distance"))
        named = votes.select("id", "k", "label", F.explode(F.array(*[F.struct(F.lit(w).alias("weights"), F.round(w, 6).alias("vote")) for w in ("uniform", "distance")])).alias("v"))
        best = named.groupBy("id", "k", "v.weights").agg(F.min(F.struct((-F.col("v.vote")).alias("vote"), "label")).alias("b"))
        wrong = best.join(queries.select("id", F.col("label").alias("_true")), "id").select("k", "weights", (F.col("b.label") != F.col("_true")).cast("int").alias("wrong"))
        part = wrong.groupBy("k", "weights").agg(F.avg("wrong").alias("error")).select(F.lit(metric).alias("metric"), "k", "weights", "error")
        out = part if out is None else out.unionByName(part)
    return out

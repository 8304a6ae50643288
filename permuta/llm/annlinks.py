"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Equal vectors are one point. Points are dealt into shards by a hash and every shard
gets a graph of its own. The graph's own edges of near copies tie a shard's points into
groups. A graph is written and sent as a row for each of its points, and no row grows with
the shard. All points then search every shard: a task reads a graph's rows, then the points
of a block as they stream by, and what a search finds links two groups. Before that a sample
of the points, dealt by a hash, searches and is compared with all points as well; the
beam is widened until this audit passes, which says on how many links it rests.

Links are counted group by group. A group's points stand in cells around a centre each:
where two cells lie so close that all their points must link, the cells' sizes are the
counts; where they lie too far apart for any link nothing is compared; the rest is
compared in double precision, two cells at a time. So no task returns the pairs of a
dense group, counts are the same for both ends of a link, and a dense group needs to be
met by one of its points' searches only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, roots
from .shared import materialize, mix, record

COSINE = 0.95
SHARDS = 4
SHARD_ROWS = 100_000
#: Bytes of a shard's vectors, in single and in double precision.
SHARD_BYTES = 128 << 20
#: Points of a block. There are more and smaller blocks, of FEW_ROWS at least, where shards and blocks would make fewer than TASKS tasks.
BLOCK_ROWS, FEW_ROWS, TASKS = 131_072, 16_384, 32
DEGREE = 8
BEAM = 24
BUILD_BEAM = 32
BATCH = 256
#: Points of a cell.
CELL = 512
SCAN_CELLS = 1 << 22
#: Bytes of cells that are sent at once.
CELL_BYTES = 1 << 22
#: Of the points, the part that recall is measured on, but so many at least.
AUDIT_SHARE = 0.01
AUDIT = 2048
#: An audit rests on so many links, or else on pairs of NEAREST neighbours down to the first lower similarity that has as many.
AUDIT_LINKS = 100
NEAREST = 3
STEPS, STEP = 10, 0.05
#: Pairs that are verified at once.
PAIRS = 1 << 16
#: Share of an audited point's links to be found, and of its nearest neighbours where those are measured.
RECALL, RECALL_NEAREST = 0.99, 0.95
AT_ONCE = 4
#: Angles are certain but for so much.
SURE = 1e-6


def dots(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Each query with each of its row's vectors."""
    return np.matmul(vectors[np.maximum(ids, 0)], queries[:, :, None])[:, :, 0]


def choose_neighbours(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 where none) those nearer to it than to any chosen before; then the best of the rest."""
    rows, width = near.shape
    held = vectors[np.maximum(near, 0)]
    among = np.matmul(held, held.transpose(0, 2, 1))
    taken = np.zeros((rows, width), bool)
    for i in range(width):
        blocked = (taken & (among[:, i] >= sims[:, i, None])).any(axis=1)
        taken[:, i] = (near[:, i] >= 0) & ~blocked & (taken.sum(axis=1) < most)
    rank = np.where(near < 0, 2 * width, np.where(taken, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.full((rows, most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, axis=1)
    return out


def beam_search(links: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the best ``beam`` nodes that each query reaches from its entries (-1 where none)."""
    rows = len(queries)
    seen = np.zeros((rows, len(vectors) + 1), bool)
    index = np.arange(rows)[:, None]
    seen[index, entry] = True
    ids = np.full((rows, beam), -1, np.int64)
    sims = np.full((rows, beam), -2.0, np.float32)
    open_ = np.zeros((rows, beam), bool)
    k = min(entry.shape[1], beam)
    start = np.where(entry >= 0, dots(vectors, entry, queries), -2.0)
    order = np.argsort(-start, axis=1)[:, :k]
    ids[:, :k], sims[:, :k] = np.take_along_axis(entry, order, axis=1), np.take_along_axis(start, order, axis=1)
    open_[:, :k] = ids[:, :k] >= 0
    alive = np.arange(rows)
    while len(alive):
        look = open_[alive]
        first = np.argsort(~look, axis=1, kind="stable")[:, :AT_ONCE]
        usable = np.take_along_axis(look, first, axis=1)
        keep = usable.any(axis=1)
        alive, first, usable = alive[keep], first[keep], usable[keep]
        if not len(alive):
            break
        expand = np.where(usable, np.take_along_axis(ids[alive], first, axis=1), -1)
        open_[alive[:, None], first] = False
        fresh = np.where(expand[:, :, None] >= 0, links[np.maximum(expand, 0)], -1).reshape(len(alive), -1)
        fresh = np.where(seen[alive[:, None], fresh], -1, fresh)
        # A node may be linked from two of the expanded ones; only the first counts.
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        seen[alive[:, None], fresh] = True
        seen[:, -1] = False
        near = np.where(fresh >= 0, dots(vectors, fresh, queries[alive]), np.float32(-2))
        all_sims = np.concatenate([sims[alive], near], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[alive] = np.take_along_axis(all_sims, order, axis=1)
        ids[alive] = np.take_along_axis(np.concatenate([ids[alive], fresh], axis=1), order, axis=1)
        open_[alive] = np.take_along_axis(np.concatenate([open_[alive], fresh >= 0], axis=1), order, axis=1)
    return ids, sims


class SmallWorld:
    """A graph in layers; node i of layer l is node members[l][i] overall, layer 0 holds all."""

    def __init__(self, vectors: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.members, self.links = vectors, members, links

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, degree: int = DEGREE) -> SmallWorld:
        """Layers from the top down; a node's highest layer follows from a hash of its id."""
        u = (mix(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(degree)).astype(int)
        made = cls(vectors, [], [])
        for at in range(min(int(level.max(initial=0)), 12), -1, -1):
            nodes = np.flatnonzero(level >= at)
            links = made._layer(nodes, degree * (2 if at == 0 else 1))
            made.members.insert(0, nodes)
            made.links.insert(0, links)
        return made

    def _layer(self, nodes: np.ndarray, degree: int) -> np.ndarray:
        """Insert a layer's nodes batch by batch, each batch as large as half of what is there."""
        vectors = self.vectors[nodes]
        links = np.full((len(nodes), degree), -1, np.int32)
        above = np.searchsorted(nodes, self.members[0]) if self.members else np.zeros(0, np.int64)
        rest = np.setdiff1d(np.arange(len(nodes)), above)
        order, done = np.concatenate([above, rest]), 0
        while done < len(order):
            batch = order[done : done + max(32, min(BATCH, done // 2))]
            own = vectors[batch] @ vectors[batch].T
            np.fill_diagonal(own, -2)
            near, sims = np.tile(batch, (len(batch), 1)), own
            if done:
                entry = self._entries(vectors[batch], nodes, order[:done])
                ids, found = beam_search(links, vectors, vectors[batch], entry, BUILD_BEAM)
                near, sims = np.concatenate([near, ids], axis=1), np.concatenate([sims, found], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            near, sims = np.take_along_axis(near, best, axis=1), np.take_along_axis(sims, best, axis=1)
            near = np.where(sims > -2, near, -1)
            links[batch] = choose_neighbours(near, sims, vectors, degree)
            self._back(links, vectors, batch)
            done += len(batch)
        return links

    def _entries(self, queries: np.ndarray, nodes: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Where searches start: the best found in the layers above, else the first nodes of the layer."""
        if not self.members:
            return np.tile(there[:1], (len(queries), 1))
        return np.searchsorted(nodes, self._descend(queries)[:, None])

    def _descend(self, queries: np.ndarray, to: int = 0) -> np.ndarray:
        """The nearest node found in layer ``to``, going down from the top."""
        at = np.full(len(queries), self.members[-1][0])
        for layer in range(len(self.members) - 1, to - 1, -1):
            nodes = self.members[layer]
            ids, _ = beam_search(self.links[layer], self.vectors[nodes], queries, np.searchsorted(nodes, at)[:, None], 4)
            at = nodes[ids[:, 0]]
        return at

    @staticmethod
    def _back(links: np.ndarray, vectors: np.ndarray, batch: np.ndarray) -> None:
        """Link the chosen neighbours back; a full node chooses again among old and new."""
        degree = links.shape[1]
        to, source = links[batch].ravel(), np.repeat(batch, degree)
        to, source = to[to >= 0], source[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        many = np.diff(np.append(cuts, len(to)))
        for lo in range(0, len(cuts), BATCH):
            nodes, counts = to[cuts[lo : lo + BATCH]], np.minimum(many[lo : lo + BATCH], 3 * degree)
            fresh = np.full((len(nodes), int(counts.max(initial=0))), -1, np.int64)
            inside = np.arange(fresh.shape[1]) < counts[:, None]
            fresh[inside] = source[(cuts[lo : lo + BATCH, None] + np.arange(fresh.shape[1]))[inside]]
            near = np.sort(np.concatenate([links[nodes], fresh], axis=1), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            sims = np.where(near >= 0, dots(vectors, near, vectors[nodes]), -2)
            best = np.argsort(-sims, axis=1, kind="stable")
            links[nodes] = choose_neighbours(np.take_along_axis(near, best, axis=1), np.take_along_axis(sims, best, axis=1), vectors, degree)

    def near(self, queries: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some of the queries' places, and the nodes and similarities that their beams end with (-1 where none)."""
        for lo in range(0, len(queries), BATCH):
            rows = np.arange(lo, min(lo + BATCH, len(queries)))
            yield rows, *beam_search(self.links[0], self.vectors, queries[rows], self._descend(queries[rows])[:, None], min(beam, len(self.vectors)))

    def ties(self, exact: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The graph's own edges between vectors of at least that cosine."""
        a = np.repeat(np.arange(len(exact)), self.links[0].shape[1])
        b = self.links[0].ravel()
        a, b = a[b >= 0], b[b >= 0]
        keep = cosines(exact, a, exact, b) >= least
        return a[keep], b[keep]

    def edges(self) -> list[bytes]:
        """Each node's links in layer 0, then in the layers above that it is in."""
        out = [row.tobytes() for row in self.links[0]]
        for nodes, links in zip(self.members[1:], self.links[1:], strict=True):
            for i, row in zip(nodes.tolist(), links, strict=True):
                out[i] += row.tobytes()
        return out

    @classmethod
    def of(cls, vectors: np.ndarray, edges: list[bytes], degree: int = DEGREE) -> SmallWorld:
        """The graph that had these edges."""
        size = np.fromiter(map(len, edges), np.int64, len(edges)) // 4
        flat, start, level = np.frombuffer(b"".join(edges), np.int32), np.cumsum(size) - size, size // degree - 2
        members = [np.flatnonzero(level >= at) for at in range(int(level.max()) + 1)]
        return cls(vectors, members, [flat[(start[x] + (at and (at + 1) * degree))[:, None] + np.arange(degree if at else 2 * degree)] for at, x in enumerate(members)])


def cosines(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit vectors x[a], y[b] in double precision."""
    return np.concatenate([np.zeros(0), *(np.einsum("id,id->i", x[a[lo : lo + PAIRS]], y[b[lo : lo + PAIRS]]) for lo in range(0, len(a), PAIRS))])


class Shard:
    """A shard's graph, exact vectors and groups, and a block of queries on it with their groups."""

    def __init__(self, graph: SmallWorld, ids: np.ndarray, exact: np.ndarray, groups: np.ndarray, own: np.ndarray, own_groups: np.ndarray, queries: np.ndarray, least: float):
        self.graph, self.ids, self.exact, self.groups, self.own, self.own_groups, self.queries, self.least = graph, ids, exact, groups, own, own_groups, queries, least
        self.fast = queries.astype(np.float32)
        #: Single precision is never further off than this (vectors have length 1).
        self.slack = max(1e-5, (exact.shape[1] + 8) * 2.0**-23)

    def links(self, beam: int) -> pd.DataFrame:
        """Pairs (a < b) of different groups that a search ties by a verified link."""
        found = []
        for rows, ids, sims in self.graph.near(self.fast, beam):
            r, c = np.nonzero((sims >= self.least - self.slack) & (ids >= 0))
            q, x = rows[r], ids[r, c]
            apart = self.own_groups[q] != self.groups[x]
            q, x = q[apart], x[apart]
            keep = cosines(self.queries, q, self.exact, x) >= self.least
            pairs = np.stack([self.own_groups[q[keep]], self.groups[x[keep]]], axis=1)
            found.append(np.unique(np.sort(pairs, axis=1), axis=0))
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    def audit(self, beam: int) -> pd.DataFrame:
        """(id, level, true, found) of queries compared with the whole shard: level 0 are links, found where the search meets the node's group; level k the NEAREST nodes with a similarity of least - k * STEP or more, found where the search meets the node."""
        out = []
        for rows, ids, sims in self.graph.near(self.fast, beam):
            step = max(1, SCAN_CELLS // len(self.ids))
            for lo in range(0, len(rows), step):
                part, met = rows[lo : lo + step], ids[lo : lo + step]
                all_ = self.fast[part] @ self.graph.vectors.T
                itself = np.searchsorted(self.ids, self.own[part])
                mine = np.flatnonzero((itself < len(self.ids)) & (self.ids[np.minimum(itself, len(self.ids) - 1)] == self.own[part]))
                all_[mine, itself[mine]] = -2
                r, c = np.nonzero(all_ >= self.least - self.slack)
                keep = cosines(self.queries, part[r], self.exact, c) >= self.least
                r, c = r[keep], c[keep]
                hit = (met >= 0) & (sims[lo : lo + step] >= self.least)
                tied = {(int(i), int(g)) for i, g in zip(*(np.nonzero(hit)[0], self.groups[met[hit]]), strict=True)} | {(i, int(g)) for i, g in enumerate(self.own_groups[part])}
                good = np.fromiter(((int(i), int(g)) in tied for i, g in zip(r, self.groups[c], strict=True)), bool, len(r))
                levels = [(0, np.bincount(r, minlength=len(part)), np.bincount(r[good], minlength=len(part)))]
                few = min(NEAREST, all_.shape[1])
                top = np.argpartition(-all_, few - 1, axis=1)[:, :few]
                value = np.take_along_axis(all_, top, axis=1)
                seen = (top[:, :, None] == met[:, None, :]).any(axis=2)
                levels += [(k, (value >= self.least - k * STEP).sum(axis=1), ((value >= self.least - k * STEP) & seen).sum(axis=1)) for k in range(1, STEPS + 1)]
                for k, true, found in levels:
                    some = np.flatnonzero(true)
                    out.append(pd.DataFrame({"id": self.own[part[some]], "level": k, "true": true[some], "found": found[some]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "level": [], "true": [], "found": []}).astype("int64")


def cells_of(ids: np.ndarray, n: np.ndarray, exact: np.ndarray, groups: np.ndarray) -> Iterator[dict]:
    """Each group's points in cells, in order of their angle to the group's centre: a cell's centre and the largest angle to it, and its points."""
    order = np.argsort(groups, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(groups[order]) != 0)) if len(order) else []
    for at, end in zip(first, np.append(first[1:], len(order)), strict=True) if len(order) else ():
        mine = order[at:end]
        mine = mine[np.argsort(-(exact[mine] @ unit(exact[mine].sum(axis=0))), kind="stable")]
        for lo in range(0, len(mine), CELL):
            part = mine[lo : lo + CELL]
            centre = unit(exact[part].sum(axis=0)) if len(part) > 1 else exact[part[0]]
            angle = float(np.arccos(np.clip(exact[part] @ centre, -1, 1)).max()) + SURE / 4
            yield {"gid": int(groups[mine[0]]), "members": len(mine), "total": int(n[part].sum()), "centre": centre.tobytes(), "angle": angle, "ids": ids[part].tobytes(), "ns": n[part].astype(np.int64).tobytes(), "vecs": exact[part].tobytes()}


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum())
    return x / size if size > 0 else x


def near_cells(pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs of cells (a, b, a_centre, a_angle, b_centre, b_angle) those that can link: a, b, and whether all of their points must."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("all", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(batch.num_rows, -1) for c in ("a_centre", "b_centre"))
            apart = np.arccos(np.clip((x * y).sum(axis=1), -1, 1))
            apart[batch.column("a").to_numpy() == batch.column("b").to_numpy()] = 0
            reach = batch.column("a_angle").to_numpy() + batch.column("b_angle").to_numpy()
            limit = float(np.arccos(least))
            keep = pa.array(apart - reach <= limit + SURE)
            yield record(schema, batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(apart + reach <= limit - SURE).filter(keep))

    return pairs.mapInArrow(run, "a bigint, b bigint, all boolean")


def compared_cells(pairs: DataFrame, least: float) -> DataFrame:
    """(id, n): for pairs of cells compared point by point, how many rows each point links with, itself among them."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() for c in ("a_ids", "a_ns", "a_vecs", "b_ids", "b_ns", "b_vecs")}
                x, y = (np.frombuffer(row[f"{c}_vecs"], np.float64).reshape(row[f"{c}_ids"].size // 8, -1) for c in "ab")
                hit = x @ y.T >= least
                out = [(row["a_ids"], hit @ np.frombuffer(row["b_ns"], np.int64))]
                if batch.column("a")[i] != batch.column("b")[i]:
                    out.append((row["b_ids"], np.frombuffer(row["a_ns"], np.int64) @ hit))
                for ids, n in out:
                    some = n > 0
                    yield record(schema, np.frombuffer(ids, np.int64)[some], n[some])

    return pairs.mapInArrow(run, "id bigint, n bigint")


def link_counts(cells: DataFrame, ties: DataFrame, least: float) -> DataFrame:
    """(id, n): rows that each point of tied groups, or of a group of several, links with; in the latter case itself among them."""
    slim = cells.select("gid", "cell", "members", "total", "centre", "angle")
    side = lambda c, frame: frame.select(F.col("gid").alias(f"{c}_gid"), *(F.col(x).alias(f"{c}_{x}" if x != "cell" else c) for x in ("cell", "total", "centre", "angle")))
    own = side("a", slim.where("members > 1")).join(side("b", slim).withColumnRenamed("b_gid", "a_gid"), "a_gid").where("a <= b")
    other = ties.select(F.col("a").alias("a_gid"), F.col("b").alias("b_gid")).join(side("a", slim), "a_gid").join(side("b", slim), "b_gid")
    columns = ["a", "b", "a_centre", "a_angle", "b_centre", "b_angle"]
    near = materialize(near_cells(own.select(columns).unionByName(other.select(columns)), least), "vector-cell-pairs")
    # All points of both cells link: a cell's points each get the other cell's rows.
    sure = near.where("all")
    sure = sure.unionByName(sure.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "all")).join(slim.select(F.col("cell").alias("b"), "total"), "b")
    sure = sure.groupBy("a").agg(F.sum("total").alias("more")).join(cells.select(F.col("cell").alias("a"), "ids"), "a")
    many = lambda batches: (record(pa.schema([("id", pa.int64()), ("n", pa.int64())]), np.frombuffer(ids, np.int64), np.full(len(ids) // 8, n)) for b in batches for ids, n in zip(b.column("ids").to_pylist(), b.column("more").to_pylist(), strict=True))
    sure = sure.select("ids", "more").mapInArrow(many, "id bigint, n bigint")
    whole = lambda c: cells.select(F.col("cell").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("ids", "ns", "vecs")))
    unsure = compared_cells(near.where("not all").join(whole("a"), "a").join(whole("b"), "b"), least)
    return sure.unionByName(unsure).groupBy("id").agg(F.sum("n").alias("n"))


def unit_rows(vecs: pa.Array, dim: int) -> np.ndarray:
    """Vectors of ``dim`` components as vector_rows packs them, at length 1 in double precision."""
    vecs, out = vecs.to_pylist(), np.empty((len(vecs), dim))
    single = np.fromiter((len(v) == 4 * dim for v in vecs), bool, len(vecs))
    for kind, some in ((np.float32, single), (np.float64, ~single)):
        out[some] = np.frombuffer(b"".join(vecs[i] for i in np.flatnonzero(some)), kind).reshape(-1, dim)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def vector_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, the vector's length and its bytes, in single precision if that holds it exactly, else in double; null where it can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = np.array([np.nan] if x is None or None in x else x, np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    norm, single = (v * v).sum(), v.astype(np.float32)
                out.append((len(v), (single if (single == v).all() else v).tobytes()) if len(v) and np.isfinite(norm) and norm > 0 else (None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["vec_id", "dim", "vec"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id bigint, dim int, vec binary")


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of sorted batches that have one value of the keys, and that value."""
    for batch in batches:
        if batch.num_rows:
            values = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield tuple(values[lo].tolist()), batch.slice(lo, hi - lo)


def graph_rows(points: DataFrame, shards: int, least: float) -> DataFrame:
    """points (dim, shard, id, n, vec) with the group that each is in by its shard's graph, the group's size, and the point's links in the graph."""
    kinds = [("dim", pa.int32()), ("shard", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("gid", pa.int64()), ("members", pa.int64()), ("links", pa.binary())]
    schema = pa.schema(kinds)

    def built(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        ids, exact = np.concatenate([x.column("id").to_numpy() for x in parts]), np.concatenate([unit_rows(x.column("vec"), x.column("dim")[0].as_py()) for x in parts])
        graph = SmallWorld.build(exact.astype(np.float32), ids)
        groups = np.arange(len(ids))
        at, root = roots(*graph.ties(exact, least))
        groups[at] = root
        members, links, lo = np.bincount(groups)[groups], graph.edges(), 0
        for x in parts:
            some = slice(lo, lo + x.num_rows)
            yield record(schema, *(x.column(c) for c in ("dim", "shard", "id", "n", "vec")), ids[groups[some]], members[some], pa.array(links[some], pa.binary()))
            lo += x.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for key, part in runs(batches, "dim", "shard"):
            if key != at:
                yield from built(held)
                held, at = [], key
            held.append(part)
        yield from built(held)

    ordered = points.select("dim", "shard", "id", "n", "vec").repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "id")
    return ordered.mapInArrow(run, "dim int, shard int, id bigint, n bigint, vec binary, gid bigint, members bigint, links binary")


def cell_rows(points: DataFrame) -> DataFrame:
    """The cells of points (dim, gid, id, n, vec): gid, members, total, centre, angle, ids, ns, vecs."""
    schema = pa.schema([("dim", pa.int32()), ("gid", pa.int64()), ("members", pa.int64()), ("total", pa.int64()), ("centre", pa.binary()), ("angle", pa.float64()), ("ids", pa.binary()), ("ns", pa.binary()), ("vecs", pa.binary())])

    def cut(dim: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for c in cells_of(*columns):
            rows.append(c | {"dim": dim})
            size += len(c["vecs"])
            if size > CELL_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], 0
        for (dim,), part in runs(batches, "dim"):
            if held and dim != at:
                yield from cut(at, *held)
                held = []
            more = [part.column("id").to_numpy(), part.column("n").to_numpy(), unit_rows(part.column("vec"), dim), part.column("gid").to_numpy()]
            held, at = [np.concatenate(x) for x in zip(held, more, strict=True)] if held else more, dim
            # The last group may go on.
            end = int(np.searchsorted(held[3], held[3][-1]))
            yield from cut(at, *(x[:end] for x in held))
            held = [x[end:] for x in held]
        if held:
            yield from cut(at, *held)

    ordered = points.repartition("dim", "gid").sortWithinPartitions("dim", "gid", "id")
    return ordered.mapInArrow(run, "dim int, gid bigint, members bigint, total bigint, centre binary, angle double, ids binary, ns binary, vecs binary")


def near_duplicates(vectors: DataFrame, least: float = COSINE, shards: int = SHARDS, audits: list[dict] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    Two rows link where the cosine is ``least`` or more in double precision; rows of
    another length, and vectors that are null, zero or hold a null or non-finite
    component, link with nothing. Equal vectors link with each other, so rows that
    repeat count as links too. A row whose vec_id is null has no links and no component
    and is not kept. To ``audits`` each audit is added: its beam, the lowest similarity of
    the pairs it measured, how many there were, and the mean share of an audited point's
    pairs that its searches found.
    """
    rows = materialize(vector_rows(vectors), "vectors")
    points = materialize(rows.where("vec is not null and vec_id is not null").groupBy("dim", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-points")
    total, components_ = points.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(shards, -(-total // SHARD_ROWS), -(-12 * components_ // SHARD_BYTES))
    nodes = materialize(graph_rows(points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), shards, least), "vector-graphs")
    known = nodes.select("dim", "id", "gid", "members", "n", "vec")

    def searched(asks: DataFrame, rows: float, beam: int, audit: bool) -> DataFrame:
        """What asks about ``rows`` points or less find; each graph goes to as many blocks as they need."""
        schema = pa.schema([(c, pa.int64()) for c in (("id", "level", "true", "found") if audit else ("a", "b"))])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = held = graph = None
            for (*key, asking), part in runs(batches, "dim", "shard", "block", "asking"):
                if key != at:
                    at, held, graph = key, [], None
                columns = [part.column("id").to_numpy(), unit_rows(part.column("vec"), key[0]), part.column("gid").to_numpy()]
                if not asking:
                    held.append([*columns, part.column("links").to_pylist()])
                    continue
                if held:
                    ids, exact, groups = (np.concatenate([x[c] for x in held]) for c in range(3))
                    graph, held = SmallWorld.of(exact.astype(np.float32), [x for *_, links in held for x in links]), []
                if graph:
                    shard = Shard(graph, ids, exact, groups, columns[0], columns[2], columns[1], least)
                    found = shard.audit(beam) if audit else shard.links(beam)
                    yield record(schema, *(found[c].to_numpy() for c in schema.names))

        blocks = max(1, min(math.ceil(rows / FEW_ROWS), max(math.ceil(rows / BLOCK_ROWS), TASKS // shards)))
        copies = nodes.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("asking"), "id", "gid", "vec", "links")
        asks = asks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("asking"), "id", "gid", "vec", F.lit(None).cast("binary").alias("links"))
        dealt = copies.unionByName(asks).repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block")).sortWithinPartitions("dim", "shard", "block", "asking", "id")
        return materialize(dealt.mapInArrow(search, ", ".join(f"{c} bigint" for c in schema.names)), "vector-links")

    share = int(1e6 * max(AUDIT_SHARE, min(1.0, AUDIT / max(1, total))))
    sample = known.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) < share)
    beam = BEAM
    while total:
        told = recall(searched(sample, share * total / 1e6, beam, True), least) | {"beam": beam}
        if audits is not None:
            audits.append(told)
        if told["passed"] or beam >= total:
            break
        beam *= 2
    ties = materialize(searched(known, total, beam, False).distinct(), "vector-ties")
    # Cells are needed of groups of several, and of points that are tied to others.
    tied = ties.select(F.col("a").alias("gid")).unionByName(ties.select(F.col("b").alias("gid"))).distinct()
    cells = cell_rows(known.where("members > 1").unionByName(known.where("members = 1").join(tied, "gid", "left_semi").select(known.columns)))
    cells = materialize(cells.withColumn("cell", F.monotonically_increasing_id()), "vector-cells")
    counts = link_counts(cells, ties, least)
    labels = components(ties)
    own = known.join(counts.withColumnRenamed("n", "links"), "id", "left").join(labels.withColumnRenamed("id", "gid"), "gid", "left")
    # A point of a group of several was counted itself, with all its rows.
    links = F.coalesce("links", F.lit(0)) + F.when(F.col("members") > 1, 0).otherwise(F.col("n")) - 1
    own = own.select("id", "n", links.alias("n_links"), F.coalesce("component", "gid").alias("component"))
    named = materialize(known.select("id", "dim", "vec").join(own.where("n_links > 0 or component <> id"), "id").drop("id", "n"), "vector-known")
    out = rows.join(named, ["dim", "vec"], "left").withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def recall(audited: DataFrame, least: float) -> dict:
    """least, links and recall of an audit, and whether it passed. Measured are links, if there are AUDIT_LINKS of them or no less alike pairs; else nearest neighbours down to the first similarity at which there are as many, and what links there are."""
    per_query = audited.groupBy("level", "id").agg(F.sum("true").alias("true"), (F.sum("found") / F.sum("true")).alias("share"))
    levels = {r["level"]: (r["true"], r["share"]) for r in per_query.groupBy("level").agg(F.sum("true").alias("true"), F.avg("share").alias("share")).collect()}
    true, share = levels.get(0, (0, 1.0))
    ok = share >= RECALL
    if true < AUDIT_LINKS and len(levels) > (0 in levels):
        level = next((k for k in range(1, STEPS + 1) if levels.get(k, (0, 0))[0] >= AUDIT_LINKS), max(levels))
        true, share = levels[level]
        return {"least": least - level * STEP, "links": true, "recall": share, "passed": ok and share >= RECALL_NEAREST}
    return {"least": least, "links": true, "recall": share, "passed": ok}

"""N-gram Jaccard join by R-trees over count vectors.

A document is the set of its word shingles. Shingle hashes are dealt into groups; the
counts by group are a point, and no two documents can share more shingles than the sum
of the smaller of their counts. A packed R-tree keeps of every node the largest count
by group and the smallest size, so the same sum bounds all pairs of two nodes. Nodes are
rows of tables: pairs of branches are joined first, then the pages of the pairs whose
bound is large enough, then the points inside two pages. What is left is compared word
by word.

One tree over everything doesn't prune: a node of a hundred unlike documents has
counts everywhere. So the root is split by the shingles that a similar pair must have
in common: of two similar sets, each ordered from rare to frequent shingles, the
beginnings share one (the prefix rule of set-similarity joins). The documents that
share such a shingle are one tree; trees of the same documents are one.

A tree's documents are first compared with one of them, then, a few rounds, each with
the likeliest of another component, at last all pairs of different components that the
bounds leave. Most groups of near copies are one component by then, and nodes that lie
in one component aren't compared, so a group costs about as many comparisons as it has
members, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import LOWER_TABLE, MIX_BYTES, Words, binary_parts, materialize, mix, record, segments, shuffle_parts, signed
from .substring import unpack

SHINGLE = 5
PERCENT = 80
#: Coordinates of a count vector.
GROUPS = 256
#: Documents of a page, and points of a node inside it.
PAGE = 512
FANOUT = 16
#: Documents whose shingles a task holds at once.
AT_ONCE = 1000
#: Counters of how frequent shingles are: 16 for every text, no more than 2**24 of one byte.
COUNTERS = 16
MOST_BITS = 24
#: Counters of one row; the table of counts is written in such slices.
SLICE = 1 << 16
#: Bytes of text that are compared at once.
COMPARED = 1 << 22
#: Rounds in which each document is compared with its likeliest partner, before all that are left are.
ROUNDS = 2
_SEED = np.uint64(0xA0761D6478BD642F)


def least_shared(a, b, percent: int = PERCENT):
    """The fewest shingles in common: percent * union <= 100 * intersection."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts, sorted within each text, and where each text's begin."""
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(n)), n)
    start = np.repeat(words.first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    found = words.runs(start, np.minimum(start + size, words.first[owner + 1]))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(n) + 1))


def sets_of(texts: list[bytes], size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, distinct hashes, where each text's begin); a very long text is read in parts."""
    for row, end, data, offsets in binary_parts(pa.array(texts, pa.binary())):
        if end == row + 1 and len(data) > 2 * MIX_BYTES:
            parts = [np.zeros(0, np.uint64)]
            for part, _ in segments(texts[row], size - 1):
                piece = np.frombuffer(part, np.uint8)
                parts.append(shingle_sets(Words(piece, np.array([0, len(piece)])), size)[0])
            found = np.unique(np.concatenate(parts))
            yield row, end, found, np.array([0, len(found)])
        else:
            yield row, end, *shingle_sets(Words(data, offsets), size)


def text_rows(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, th (a hash of the text as it is), digest and compressed bytes of every row's text, A-Z lower-cased; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [(x or b"").translate(LOWER_TABLE) for x in batch.column(2).to_pylist()]
            digests = pa.array([hashlib.blake2b(x, digest_size=20).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(map(squeeze, texts), pa.binary())], names=["doc_id", "th", "digest", "packed"])

    return docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, "doc_id bigint, th bigint, digest binary, packed binary")


def set_sizes(texts: DataFrame, size: int, bits: int) -> DataFrame:
    """(key, n) of every text (key, packed): its number of distinct shingles, told apart by their words. Rows without key hold counts of shingles by counter: slice, counts."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            texts = unpack(batch.column(1))
            n = np.array([len(x) for x in exact_sets(texts, size)], np.int64)
            for _, _, sets, _ in sets_of(texts, size):
                places, many = np.unique(sets >> np.uint64(64 - bits), return_counts=True)
                counts[places.astype(np.int64)] += many.astype(np.uint32)
            none = [None] * batch.num_rows
            yield record(schema, batch.column(0), n, none, none)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for i in range(0, 1 << bits, SLICE):
            if counts[i : i + SLICE].any():
                yield record(schema, [None], [None], [i // SLICE], [squeeze(counts[i : i + SLICE].tobytes())])

    return texts.select("key", "packed").mapInArrow(run, "key bigint, n bigint, slice int, counts binary")


def frequencies(counted: DataFrame, bits: int) -> np.ndarray:
    """For each counter a byte that grows with its count: 2**bits bytes, whatever the size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                more = np.frombuffer(zstandard.decompress(packed), np.uint32)
                total[i] = total.get(i, 0) + more.astype(np.float64)
        grades = [np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(grades, pa.binary())], names=["slice", "grades"])

    out = np.zeros(1 << bits, np.uint8)
    slices = counted.where("slice is not null").select("slice", "counts").repartition("slice")
    for row in slices.mapInArrow(add, "slice int, grades binary").collect():
        part = np.frombuffer(row["grades"], np.uint8)
        out[row["slice"] * SLICE : row["slice"] * SLICE + len(part)] = part
    return out


def beginnings(sets: np.ndarray, at: np.ndarray, grades: np.ndarray, bits: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, short) of each text's beginning, from rare to frequent.

    Two similar sets share at least ``least_shared`` shingles, so the smaller one's short
    beginning and the larger one's whole beginning have one in common.
    """
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    grade = grades[(sets >> np.uint64(64 - bits)).astype(np.int64)]
    order = np.lexsort((sets, grade, owner))
    place, n = np.arange(len(sets)) - at[owner], n[owner]
    keep = place < n - -(-percent * n // 100) + 1
    return owner[keep], sets[order][keep], (place < n - least_shared(n, n, percent) + 1)[keep]


def beginning_blocks(texts: DataFrame, size: int, percent: int, blocks: int, grades: np.ndarray, bits: int) -> DataFrame:
    """Beginnings of (key, packed), packed by block of shingles: the texts in it, their sizes, how many entries each has, and the entries."""
    schema = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("shingles", pa.binary()), ("short", pa.binary())])
    shared = texts.sparkSession.sparkContext.broadcast(grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            keys, sizes, held = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64), []
            for row, end, sets, at in sets_of(unpack(batch.column(1)), size):
                sizes[row:end] = np.diff(at)
                who, what, short = beginnings(sets, at, shared.value, bits, percent)
                held.append((row + who, what, short))
            who, what, short = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
            block = (mix(what) % np.uint64(blocks)).astype(np.int32)
            order = np.lexsort((who, block))
            who, what, short, block = who[order], what[order], short[order], block[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            out = [[], [], [], [], [], []]
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(block)), strict=True):
                if a < b:
                    some, counts = np.unique(who[a:b], return_counts=True)
                    row = int(block[a]), keys[some].tobytes(), sizes[some].tobytes(), counts.astype(np.uint32).tobytes(), what[a:b].tobytes(), np.packbits(short[a:b]).tobytes()
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield record(schema, *out)

    return texts.select("key", "packed").mapInArrow(run, "block int, keys binary, sizes binary, counts binary, shingles binary, short binary")


def trees(blocks: DataFrame, percent: int) -> DataFrame:
    """(tree, key, n, short): the texts that share a shingle of their beginnings, once for all shingles with the same texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = [np.frombuffer(x, np.uint32) for x in pdf["counts"]]
        short = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: c.sum()] for x, c in zip(pdf["short"], counts, strict=True)])
        counts = np.concatenate(counts)
        keys, sizes = (np.repeat(np.frombuffer(b"".join(pdf[c]), np.int64), counts) for c in ("keys", "sizes"))
        what = np.frombuffer(b"".join(pdf["shingles"]), np.uint64)
        order = np.lexsort((keys, what))
        what, keys, sizes, short = what[order], keys[order], sizes[order], short[order] > 0
        first = np.flatnonzero(np.append(True, what[1:] != what[:-1]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(what))))
        # Only texts that can be similar to one whose short beginning has the shingle.
        least = np.minimum.reduceat(np.where(short, sizes, np.iinfo(np.int64).max), first)
        most = np.maximum.reduceat(np.where(short, sizes, 0), first)
        keep = (sizes >= least[of]) & (sizes * percent <= most[of] * 100)
        keep &= np.bincount(of[keep], minlength=len(first))[of] > 1
        of, keys, sizes, short = of[keep], keys[keep], sizes[keep], short[keep]
        if not len(of):
            return pd.DataFrame({"tree": of, "key": keys, "n": sizes, "short": short})
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        many = np.diff(np.append(at, len(of)))
        name = np.add.reduceat(mix(mix(keys.view(np.uint64) ^ _SEED) + short), at)
        once = np.zeros(len(at), bool)
        once[np.unique(name, return_index=True)[1]] = True
        name, keep = np.repeat(name, many), np.repeat(once, many)
        return pd.DataFrame({"tree": signed(name[keep]), "key": keys[keep], "n": sizes[keep], "short": short[keep]})

    return blocks.groupBy("block").applyInPandas(run, "tree bigint, key bigint, n bigint, short boolean").groupBy("tree", "key", "n").agg(F.max("short").alias("short"))


def exact_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The texts' shingles as numbers that are equal only where all their words are."""
    names: dict[bytes, int] = {}
    ids = []
    for text in texts:
        parts, skip = [], 0
        for part, _ in segments(text, 0):
            words = part.split()
            parts.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
        ids.append(np.concatenate(parts))
    lengths = np.array([len(x) for x in ids])
    run, have = np.concatenate(ids) if ids else np.zeros(0, np.int64), 1
    while have < size:
        step = min(have, size - have)
        a, b = run[:-step], run[step:]
        run, have = np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1], have + step
    short: dict[bytes, int] = {}
    out, at = [], 0
    for x, n in zip(ids, lengths.tolist(), strict=True):
        out.append(np.unique(run[at : at + n - size + 1]) if n >= size else np.array([-1 - short.setdefault(x.tobytes(), len(short))] if n else [], np.int64))
        at += n
    return out


def linked_pairs(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Which of the pairs (a, b) of keys are links, by their words."""
    left = pairs.hint("merge").join(texts.select(F.col("key").alias("a"), F.col("packed").alias("pa")), "a")
    both = left.hint("merge").join(texts.select(F.col("key").alias("b"), F.col("packed").alias("pb")), "b").select("a", "b", "pa", "pb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def similar(packed: list[tuple[bytes, bytes]]) -> list[bool]:
        at: dict[bytes, int] = {}
        where = [(at.setdefault(x, len(at)), at.setdefault(y, len(at))) for x, y in packed]
        sets = exact_sets(unpack(pa.array(list(at), pa.binary())), size)
        shared = [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in where]
        return [100 * k >= percent * (len(sets[i]) + len(sets[j]) - k) > 0 for k, (i, j) in zip(shared, where, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            keep, at = [], 0
            while at < len(packed):
                end, held = at, 0
                while end < len(packed) and held < COMPARED:
                    held += sum(map(zstandard.frame_content_size, packed[end]))
                    end += 1
                keep += similar(packed[at:end])
                at = end
            keep = pa.array(keep, pa.bool_())
            yield record(schema, batch.column(0).filter(keep), batch.column(1).filter(keep))

    return both.mapInArrow(run, "a bigint, b bigint")


def first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """For each text of (tree, key, n) one pair (a, b): with the first text of most of its trees, if their sizes are close enough."""
    first = members.groupBy("tree").agg(F.min(F.struct("key", "n")).alias("f"))
    near = members.join(first, "tree").where(F.col("key") > F.col("f.key")).where(F.greatest("n", "f.n") * percent <= F.least("n", "f.n") * 100)
    counts = near.groupBy("key", F.col("f.key").alias("first")).agg(F.count("*").alias("many"))
    return counts.groupBy("key").agg(F.max_by("first", F.struct("many", "first")).alias("b")).select(F.col("key").alias("a"), "b")


def count_vectors(sets: np.ndarray, at: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Points: how many of each text's shingles fall in each group."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.bincount(text * groups + (sets % np.uint64(groups)).astype(np.int64), minlength=(len(at) - 1) * groups).reshape(-1, groups).astype(np.int32)


def squeezed(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.tobytes(), 1)


def spread(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.int32)


def points(texts: DataFrame, size: int) -> DataFrame:
    """key, packed, n and counts of texts (key, packed)."""
    schema = pa.schema([("key", pa.int64()), ("packed", pa.binary()), ("n", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            counts, n = [], []
            for _, _, sets, at in sets_of(unpack(batch.column(1)), size):
                counts += map(squeezed, count_vectors(sets, at))
                n += np.diff(at).tolist()
            yield record(schema, batch.column(0), batch.column(1), n, counts)

    return texts.select("key", "packed").mapInArrow(run, "key bigint, packed binary, n bigint, counts binary")


class Page:
    """Points of one tree, packed by component and size; nodes of FANOUT points keep their largest counts and smallest size."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, component: np.ndarray, short: np.ndarray, counts: np.ndarray):
        order = np.lexsort((keys, sizes, component))
        self.keys, self.sizes, self.component, self.short, self.counts = keys[order], sizes[order], component[order], short[order], counts[order]
        cuts = np.arange(0, len(keys), FANOUT)
        self.high, self.least = np.maximum.reduceat(self.counts, cuts, axis=0), np.minimum.reduceat(self.sizes, cuts)
        first, last = self.component[cuts], np.append(self.component[cuts[1:] - 1], self.component[-1:])
        self.one = np.where(first == last, first, -1)

    def near(self, other: Page, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions here and there of different components that can be similar, and how much; with itself, each pair once."""
        for i in range(len(self.least)):
            bound = np.minimum(self.high[i], other.high).sum(axis=1) >= least_shared(self.least[i], other.least, percent)
            bound &= (self.one[i] != other.one) | (self.one[i] < 0)
            if self is other:
                bound[:i] = False
            a = slice(i * FANOUT, (i + 1) * FANOUT)
            for j in np.flatnonzero(bound):
                b = slice(j * FANOUT, (j + 1) * FANOUT)
                n, m = self.sizes[a, None], other.sizes[None, b]
                shared = np.minimum(self.counts[a, None], other.counts[None, b]).sum(axis=2)
                ok = (shared >= least_shared(n, m, percent)) & (self.component[a, None] != other.component[None, b]) & (np.maximum(n, m) * percent <= np.minimum(n, m) * 100)
                ok &= ((n <= m) & self.short[a, None]) | ((m <= n) & other.short[None, b])
                if self is other and i == j:
                    ok &= np.triu(np.ones(ok.shape, bool), 1)
                x, y = np.nonzero(ok)
                if len(x):
                    yield x + a.start, y + b.start, (shared / (n + m))[x, y]

    def pairs(self, other: Page, percent: int = PERCENT, best: bool = False) -> pa.RecordBatch:
        """(a, b, share) of keys that can be similar, with ``best`` only each key's most similar one as b."""
        none = np.zeros(0, np.int64)
        if best:
            top = [(np.zeros(len(p.keys)), np.full(len(p.keys), -1)) for p in (self, other)]
            if self is other:
                top[1] = top[0]
            for x, y, share in self.near(other, percent):
                for (value, partner), mine, keys in ((top[0], x, other.keys[y]), (top[1], y, self.keys[x])):
                    order = np.argsort(share, kind="stable")
                    better = order[share[order] > value[mine[order]]]
                    value[mine[better]], partner[mine[better]] = share[better], keys[better]
            found = [(p.keys[partner >= 0], partner[partner >= 0], value[partner >= 0]) for p, (value, partner) in zip((self, other)[: 1 + (self is not other)], top, strict=False)]
        else:
            found = [(np.maximum(self.keys[x], other.keys[y]), np.minimum(self.keys[x], other.keys[y]), share) for x, y, share in self.near(other, percent)]
        return record(PAIRS, *(np.concatenate([none, *c]) for c in (zip(*found, strict=True) if found else ((), (), ()))))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("share", pa.float64())])


def chosen(pairs: DataFrame, best: bool) -> DataFrame:
    """Distinct (a, b) with a > b, with ``best`` only the most similar b of each a."""
    if best:
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal values in the first ``width`` columns."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(max(0, batch.num_rows - 1), bool)
        for i in range(width):
            column = batch.column(i).to_numpy()
            new |= column[1:] != column[:-1]
        cuts = np.append(0, np.flatnonzero(new) + 1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        held = batch.slice(cuts[-1]) if batch.num_rows else None
    if held is not None:
        yield held


def page_of(rows: pa.RecordBatch) -> Page:
    """A page of rows with columns key, n, component, short and counts."""
    get = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
    return Page(get("key"), get("n"), get("component"), get("short"), np.stack([spread(x) for x in rows.column("counts").to_pylist()]))


def pairs_in_pages(members: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b, share) of keys in trees that are one page: tree, key, n, component, short, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 1):
            page = page_of(rows)
            yield page.pairs(page, percent, best)

    rows = members.select("tree", "key", "n", "component", "short", "counts").repartition("tree").sortWithinPartitions("tree")
    return rows.mapInArrow(run, "a bigint, b bigint, share double")


NODE = ["tree", "step", "one"]


def pages(members: DataFrame, percent: int) -> DataFrame:
    """Pages of (tree, key, n, short, component, counts) with their bounds: tree, step, one, page, lo, short_lo, hi, top and the points.

    A page has texts of about one size (step): similar sets are at most one step apart.
    Large components have pages of their own (one; -1 for the others).
    """
    step = F.floor(F.log("n") / F.log(F.lit(101 / percent)))
    cells = members.withColumn("step", step).groupBy("tree", "step", "component").agg(F.count("*").alias("held"))
    one = F.when(F.col("held") > PAGE, F.col("component")).otherwise(-1)
    cells = materialize(cells.withColumn("one", one), "jaccard-cells")
    parts = cells.groupBy(*NODE).agg(F.ceil(F.sum("held") / PAGE).alias("parts"))
    placed = members.withColumn("step", step).join(cells.drop("held"), ["tree", "step", "component"]).join(parts, NODE)
    part = F.pmod(F.when(F.col("one") < 0, F.xxhash64("component")).otherwise(F.xxhash64("key")), F.col("parts"))
    keys = [*NODE, "part"]
    placed = placed.select(*NODE, part.alias("part"), "key", "n", "component", "short", "counts").repartition(*keys).sortWithinPartitions(*keys)
    kinds = [("tree", pa.int64()), ("step", pa.int64()), ("one", pa.int64()), ("lo", pa.int64()), ("short_lo", pa.int64()), ("hi", pa.int64()), ("top", pa.binary()), ("body", pa.binary())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 4):
            n, short = rows.column("n").to_numpy(), rows.column("short").to_numpy(zero_copy_only=False)
            top = np.maximum.reduce([spread(x) for x in rows.column("counts").to_pylist()])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            body = sink.getvalue().to_pybytes()
            yield record(pa.schema(kinds), *(rows.column(c).slice(0, 1) for c in NODE), [n.min()], [n[short].min() if short.any() else None], [n.max()], [squeezed(top)], [body])

    made = placed.mapInArrow(build, "tree bigint, step bigint, one bigint, lo bigint, short_lo bigint, hi bigint, top binary, body binary")
    return materialize(made.withColumn("page", F.monotonically_increasing_id()), "jaccard-pages")


def branches(pages: DataFrame) -> DataFrame:
    """The nodes above pages: those of one tree, step and large component."""
    schema = pa.schema([*((c, pa.int64()) for c in [*NODE, "lo", "short_lo", "hi"]), ("top", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            top = np.maximum.reduce([spread(x) for x in rows.column("top").to_pylist()])
            ends = [pa.array([f(rows.column(c)).as_py()], pa.int64()) for c, f in (("lo", pc.min), ("short_lo", pc.min), ("hi", pc.max))]
            yield record(schema, *(rows.column(c).slice(0, 1) for c in NODE), *ends, [squeezed(top)])

    rows = pages.select(*NODE, "lo", "short_lo", "hi", "top").repartition(*NODE).sortWithinPartitions(*NODE)
    made = rows.mapInArrow(build, "tree bigint, step bigint, one bigint, lo bigint, short_lo bigint, hi bigint, top binary")
    return materialize(made.withColumn("branch", F.monotonically_increasing_id()), "jaccard-branches")


def bounded(pairs: DataFrame, names: tuple[str, str], percent: int) -> DataFrame:
    """Pairs of nodes (names, lo, top and other_lo, other_top) whose summed minima are large enough."""
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            shared = np.array([np.minimum(spread(x), spread(y)).sum() for x, y in zip(a, b, strict=True)], np.int64)
            keep = pa.array(shared >= least_shared(batch.column(2).to_numpy(), batch.column(4).to_numpy(), percent), pa.bool_())
            yield record(schema, batch.column(0).filter(keep), batch.column(1).filter(keep))

    return pairs.select(*names, "lo", "top", "other_lo", "other_top").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def bounded_points(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of texts (key, n, counts) whose summed minima are large enough."""
    one = texts.select(F.col("key").alias("a"), F.col("n").alias("lo"), F.col("counts").alias("top"))
    two = texts.select(F.col("key").alias("b"), F.col("n").alias("other_lo"), F.col("counts").alias("other_top"))
    return bounded(pairs.join(one, "a").join(two, "b"), ("a", "b"), percent)


def pairs_of_pages(members: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b, share) of keys of different components in trees of many pages, by descent from branches to pages to points."""
    leaves = pages(members, percent)
    nodes = branches(leaves)
    other = nodes.select("tree", *(F.col(c).alias(f"other_{c}") for c in ("step", "one", "branch", "lo", "short_lo", "hi", "top")))
    apart = (F.col("one") < 0) | (F.col("one") != F.col("other_one"))
    # The smaller of a pair has the shingle in its short beginning.
    meet = (F.col("short_lo") <= F.col("other_hi")) | (F.col("other_short_lo") <= F.col("hi"))
    near = nodes.join(other, "tree").where((F.col("branch") <= F.col("other_branch")) & (F.abs(F.col("step") - F.col("other_step")) <= 1) & apart & meet)
    pairs = materialize(bounded(near, ("branch", "other_branch"), percent), "jaccard-branch-pairs")
    placed = materialize(leaves.join(nodes.select(*NODE, "branch"), NODE).select("branch", "page", "lo", "top"), "jaccard-placed")
    two = pairs.join(placed, "branch").join(placed.select(*(F.col(c).alias(f"other_{c}") for c in placed.columns)), "other_branch")
    two = two.where((F.col("branch") < F.col("other_branch")) | (F.col("page") <= F.col("other_page")))
    two = materialize(bounded(two, ("page", "other_page"), percent), "jaccard-page-pairs")
    both = two.join(leaves.select("page", "body"), "page").join(leaves.select(F.col("page").alias("other_page"), F.col("body").alias("other_body")), "other_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, body, next_page, next_body in zip(*(batch.column(c).to_pylist() for c in ("page", "body", "other_page", "other_body")), strict=True):
                one = page_of(next(iter(pa.ipc.open_stream(body))))
                other = one if page == next_page else page_of(next(iter(pa.ipc.open_stream(next_body))))
                yield one.pairs(other, percent, best)

    return both.select("page", "body", "other_page", "other_body").mapInArrow(run, "a bigint, b bigint, share double")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Documents link when percent * union <= 100 * intersection of their sets of ``size``
    lower-cased (A-Z) words; a text of fewer words is one shingle, one without words is
    empty and linked with nothing but its own copies' rows. component_id is the smallest
    doc_id reachable; rows that repeat a doc_id with other texts are linked by it too. A
    null doc_id links with nothing and has no component.
    """
    return labelled_rows(*text_links(docs, percent, size, text))


def near_copies(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, th, stays of every row with an id: of the texts that links reach from each other, the one with the smallest doc_id stays.

    Here a document is a row's id and text together, th being xxhash64 of the text: an id
    that stands for several texts links none of them. Of several such texts under the
    smallest id one stays, with all rows that repeat it.
    """
    equal, rows, sizes, links = text_links(docs, percent, size, text)
    labels = components(links).select(F.col("id").alias("first"), "component")
    named = equal.select("key", "doc_id", "first").join(labels, "first", "left").join(sizes.select("key", "n"), "key").join(rows.select("key", "th"), "key")
    # Texts without words are linked with nothing: a row of their own each.
    named = named.select("doc_id", "th", F.when(F.col("n") > 0, F.coalesce("component", "first")).otherwise(F.col("key")).alias("group"))
    named = materialize(named, "jaccard-named")
    least = named.groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("least"))
    return named.join(least, "group").select("doc_id", "th", ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))).alias("stays"))


def text_links(docs: DataFrame, percent: int, size: int, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with an id and the first row with an equal text (key, doc_id, first, least), all rows, their set sizes, and the links (a, b) between first rows."""
    spark = docs.sparkSession
    rows = materialize(text_rows(docs, text).withColumn("key", F.monotonically_increasing_id()), "jaccard-rows")
    equal = rows.where("doc_id is not null").groupBy("digest").agg(F.min("key").alias("first"), F.min("doc_id").alias("least"))
    equal = materialize(rows.select("key", "doc_id", "digest").join(equal, "digest").drop("digest"), "jaccard-equal")
    bits = min(MOST_BITS, max(16, (COUNTERS * rows.count()).bit_length()))
    counted = materialize(set_sizes(rows, size, bits), "jaccard-sizes")
    blocks = beginning_blocks(rows.where("doc_id is not null"), size, percent, 2 * shuffle_parts(spark), frequencies(counted, bits), bits)
    members = trees(blocks, percent).join(equal.select("key", "first"), "key").groupBy("tree", F.col("first").alias("key"), "n").agg(F.max("short").alias("short"))
    members = materialize(members, "jaccard-trees")
    # Texts are never broadcast: which side is small changes with the corpus, the plan shouldn't.
    texts = materialize(points(rows.join(members.select("key").distinct().hint("merge"), "key", "left_semi"), size), "jaccard-points")
    links = materialize(linked_pairs(bounded_points(first_pairs(members, percent), texts, percent), texts, percent, size), "jaccard-links")
    rounds = ROUNDS
    while True:
        open_ = open_trees(members, components(links))
        largest = open_.agg(F.max("held")).first()[0]
        if largest is None:
            break
        held, best = open_.join(texts.select("key", "counts"), "key"), rounds > 0
        pairs = pairs_in_pages(held.where(F.col("held") <= PAGE), percent, best)
        if largest > PAGE:
            pairs = pairs.unionByName(pairs_of_pages(held.where(F.col("held") > PAGE).drop("held"), percent, best))
        pairs = materialize(chosen(pairs, best), "jaccard-pairs")
        more = materialize(linked_pairs(pairs, texts, percent, size), "jaccard-links")
        links = links.unionByName(more)
        if not best:
            break
        rounds = rounds - 1 if not more.isEmpty() else 0
    return equal, rows, counted.where("key is not null"), materialize(links, "jaccard-links")


def open_trees(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(tree, key, n, short, component, held) of the trees whose texts aren't all of one component; held is how many they are."""
    named = members.join(labels.select(F.col("id").alias("key"), "component"), "key", "left").select("tree", "key", "n", "short", F.coalesce("component", "key").alias("component"))
    several = named.groupBy("tree").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")).where("lo < hi").select("tree", "held")
    return materialize(named.join(several, "tree"), "jaccard-open")


def labelled_rows(equal: DataFrame, rows: DataFrame, sizes: DataFrame, links: DataFrame) -> DataFrame:
    """Links between texts -> the smallest doc_id that each row's can reach.

    Ids of equal texts are linked to the least of them, and least ids where their texts are.
    """
    firsts = equal.where("key = first")
    of = lambda c: firsts.select(F.col("key").alias(c), F.col("least").alias(f"{c}_id"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    same = equal.where("doc_id <> least").join(sizes.where("n > 0"), "key", "left_semi").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    labels = components(materialize(between.unionByName(same), "jaccard-all"))
    known = rows.select("key", "doc_id").join(sizes.select("key", F.col("n").alias("n_shingles")), "key")
    named = known.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

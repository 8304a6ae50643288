"""Vector compression by product codes, whose codebooks are refined under adaptive distance bounds.

A vector of integers is cut into parts, and each part is replaced by the nearest entry
of its position's codebook. The codebooks are refined in rounds of assigning and
averaging, all in integers. Most assignments don't change from round to round, and
bounds show it without looking at all entries: each part keeps, as a table row written
once a round, its b closest entries in order with a lower bound of the distance to each
and one more bound below the distance to all others. When entries move, a bound falls by
how far its entry has moved, the outer one by the farthest move. A part whose own entry
is nearer than all bounds stays; one whose own entry is nearer than the outer bound is
compared with those of the b that are in doubt; only the rest is compared with all
entries. Comparisons that the bounds leave open are made in exact integers. How many
entries were in doubt sets the next round's b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialize, record

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: b of the first round, and the least and the most that it adapts to, as shares of the entries.
FIRST, LEAST, MOST = 1 / 8, 1 / 64, 1 / 4
#: The share of parts that the next b should hold all doubtful entries of.
COVERED = 0.9
#: Components beyond this have squares whose sums leave 64 bits.
LARGEST = 1 << 26
#: Distances computed at once.
AT_ONCE = 1 << 21
#: A group with more than this share of the rows is joined as one of at most 1 / HOT rows.
HOT = 1 / 1000
_ROW = [("vec_id", "bigint", pa.int64()), ("ints", "binary", pa.binary()), ("near", "binary", pa.binary()), ("low", "binary", pa.binary()), ("used", "binary", pa.binary()), ("error", "bigint", pa.int64())]


@dataclass
class Codes:
    """Rows (vec_id, label, code, error), the codebooks (parts x entries x components), and of each round its b and how many parts the bounds settled, a few comparisons did, or all entries did."""

    rows: DataFrame
    codebooks: np.ndarray
    rounds: list[dict] = field(default_factory=list)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and floor(scale * x) of every component, as bytes of 32-bit integers.

    Rows whose vector is null, empty or has a null or non-finite component aren't there.
    """
    schema = f"vec_id bigint, label {vectors.schema['label'].dataType.simpleString()}, ints binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            whole, offsets = column.values, column.offsets.to_numpy()
            values = whole.to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.isfinite(values)
            if whole.null_count:
                good &= whole.is_valid().to_numpy(zero_copy_only=False)
            bad = np.append(0, np.cumsum(~good))
            keep = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (offsets[1:] > offsets[:-1])
            scaled = np.floor(np.where(good, values, 0) * scale)
            if (np.abs(scaled) > LARGEST).any() and any((np.abs(scaled[offsets[i] : offsets[i + 1]]) > LARGEST).any() for i in np.flatnonzero(keep)):
                raise ValueError(f"a component beyond {LARGEST / scale:g}: its distances don't fit in 64 bits")
            scaled = np.clip(scaled, -LARGEST, LARGEST).astype("<i4")
            ints = [scaled[offsets[i] : offsets[i + 1]].tobytes() for i in np.flatnonzero(keep)]
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(ints, pa.binary())], names=["vec_id", "label", "ints"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    return rows.mapInArrow(run, schema)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries: in floating point where all sums are below 2**53, else in integers."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - entries[None, :, i]) ** 2
    return out


def below(value: np.ndarray) -> np.ndarray:
    """The next smaller number in single precision: rounding never lifts a lower bound."""
    return np.nextafter(value.astype(np.float32), np.float32(-np.inf))


class Bounds:
    """One part of some vectors: near[:, 0] is the entry of each, near[:, 1:] others with lower bounds low[:, 1:]; low[:, 0] is below the distance to all entries that aren't there."""

    def __init__(self, x: np.ndarray, near: np.ndarray, low: np.ndarray):
        self.x, self.near, self.low = x, near, low
        self.used = np.zeros(len(x), np.uint16)

    def search_all(self, entries: np.ndarray, rows: np.ndarray, b: int) -> None:
        """Compare with all entries and keep the b closest. Equal distances count as nearer for the lower entry."""
        k = len(entries)
        step = max(1, AT_ONCE // k)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            found = squares(self.x[some], entries)
            order = np.argsort(found, axis=1, kind="stable")[:, : b + 1]
            d = np.sqrt(np.take_along_axis(found, order, axis=1).astype(np.float64))
            self.near[some] = order[:, :1]
            self.low[some] = np.inf
            self.near[some, : min(b, k)] = order[:, :b]
            self.low[some, 1 : min(b, k)] = below(d[:, 1:b])
            self.low[some, 0] = below(d[:, b]) if k > b else np.inf

    def assign(self, entries: np.ndarray, moved: np.ndarray, b: int) -> np.ndarray:
        """Move every row to its nearest entry, entries having moved since the bounds were taken; their exact squared distances."""
        self.low[:, 1:] = below(self.low[:, 1:] - moved[self.near[:, 1:]])
        self.low[:, 0] = below(self.low[:, 0] - moved.max(initial=0))
        self.resize(b)
        own = ((self.x - entries[self.near[:, 0]]) ** 2).sum(axis=1)
        reach = np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-9
        open_ = self.low <= reach[:, None]
        everything = open_[:, 0].copy()
        self.used = np.minimum(open_[:, 1:].sum(axis=1), b).astype(np.uint16)
        self.used[everything] = len(entries) + 1
        open_[everything] = False
        rows, at = np.nonzero(open_[:, 1:])
        at += 1
        if len(rows):
            d = ((self.x[rows] - entries[self.near[rows, at]]) ** 2).sum(axis=1)
            self.low[rows, at] = below(np.sqrt(d.astype(np.float64)))
            order = np.lexsort((self.near[rows, at], d, rows))
            first = order[np.append(True, rows[order][1:] != rows[order][:-1])]
            r, j, d = rows[first], at[first], d[first]
            better = (d < own[r]) | ((d == own[r]) & (self.near[r, j] < self.near[r, 0]))
            r, j, d = r[better], j[better], d[better]
            self.near[r, 0], self.near[r, j] = self.near[r, j], self.near[r, 0]
            self.low[r, j] = below(np.sqrt(own[r].astype(np.float64)))
            own[r] = d
        rows = np.flatnonzero(everything)
        if len(rows):
            self.search_all(entries, rows, b)
            own[rows] = ((self.x[rows] - entries[self.near[rows, 0]]) ** 2).sum(axis=1)
        return own

    def resize(self, b: int) -> None:
        """Keep the b closest by their bounds; those that go are bounded by the outer bound from now on. New places stay empty until a search."""
        have = self.near.shape[1]
        if b < have:
            order = np.argsort(self.low[:, 1:], axis=1, kind="stable") + 1
            near, low = np.take_along_axis(self.near, order, axis=1), np.take_along_axis(self.low, order, axis=1)
            self.low[:, 0] = np.minimum(self.low[:, 0], low[:, b - 1 :].min(axis=1))
            self.near = np.hstack([self.near[:, :1], near[:, : b - 1]])
            self.low = np.hstack([self.low[:, :1], low[:, : b - 1]])
        elif b > have:
            self.near = np.hstack([self.near, np.repeat(self.near[:, :1], b - have, axis=1)])
            self.low = np.hstack([self.low, np.full((len(self.low), b - have), np.inf, np.float32)])


def assigned(state: DataFrame, codebooks: np.ndarray, moved: np.ndarray | None, b: int) -> DataFrame:
    """The state after assigning to codebooks (parts x entries x components) whose entries have moved so far; without ``moved`` the first assignment."""
    parts, k, width = codebooks.shape
    kind = np.uint8 if k <= 256 else np.uint32
    schema = pa.schema([(c, t) for c, _, t in _ROW])
    bounded = moved is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ints = batch.column(1).to_pylist()
            if any(len(v) != 4 * parts * width for v in ints):
                raise ValueError(f"vectors must all have {parts * width} components, a multiple of {parts}")
            x = np.frombuffer(b"".join(ints), "<i4").reshape(n, parts, width).astype(np.int64)
            if bounded:
                near = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(n, parts, -1).astype(np.int64)
                low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float32).reshape(n, parts, -1)
            done, error = [], np.zeros(n, np.int64)
            for p in range(parts):
                if bounded:
                    part = Bounds(x[:, p], near[:, p].copy(), low[:, p].copy())
                    error += part.assign(codebooks[p], moved[p], b)
                else:
                    part = Bounds(x[:, p], np.zeros((n, b), np.int64), np.zeros((n, b), np.float32))
                    part.search_all(codebooks[p], np.arange(n), b)
                    part.used[:] = k + 1
                    error += ((x[:, p] - codebooks[p][part.near[:, 0]]) ** 2).sum(axis=1)
                done.append(part)
            near = np.ascontiguousarray(np.stack([p.near for p in done], axis=1).astype(kind))
            low, used = np.stack([p.low for p in done], axis=1), np.stack([p.used for p in done], axis=1)
            yield record(schema, batch.column(0), batch.column(1), *([row.tobytes() for row in a] for a in (near, low, used)), error)

    columns = [c for c, _, _ in _ROW][: 4 if bounded else 2]
    return state.select(*columns, "label").transform(lambda df: _with_label(df, run))


def _with_label(rows: DataFrame, run) -> DataFrame:
    """run on all columns but the last, label, which is carried beside."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            for out in run(iter([inner])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(batch.num_columns - 1)], names=[*out.schema.names, "label"])

    kinds = ", ".join(f"{c} {t}" for c, t, _ in _ROW)
    return rows.mapInArrow(both, f"{kinds}, label {rows.schema['label'].dataType.simpleString()}")


def sums(state: DataFrame, parts: int, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the parts at each entry their number and sums, and how often each number of doubtful entries occurred.

    Each task adds up its own rows; what is shuffled and reaches the driver is as large as the codebooks.
    """
    kind = np.uint8 if k <= 256 else np.uint32
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, used = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64), np.zeros(k + 2, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(n * parts, width)
            near = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).reshape(n * parts, -1)
            at = near[:, 0].astype(np.int64) + np.tile(np.arange(parts) * k, n)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
            total[at[order][first]] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
            count += np.bincount(at, minlength=parts * k)
            used += np.bincount(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16), minlength=k + 2)
        hit = np.flatnonzero(count)
        yield record(schema, hit // k, hit % k, count[hit], list(total[hit]))
        hit = np.flatnonzero(used)
        yield record(schema, np.full(len(hit), -1), hit, used[hit], [[0] * width] * len(hit))

    partial = state.select("ints", "near", "used").mapInArrow(run, "part int, entry int, n bigint, s array<bigint>")
    added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    count, total, used = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64), np.zeros(k + 2, np.int64)
    for row in added.collect():
        if row["part"] < 0:
            used[row["entry"]] = row["n"]
        else:
            count[row["part"], row["entry"]], total[row["part"], row["entry"]] = row["n"], row["s"]
    return count, total, used


def next_b(used: np.ndarray, b: int, k: int) -> int:
    """The least b that would have held the doubtful entries of COVERED of the parts; parts that had to look at all entries ask for twice as many."""
    need = np.zeros(2 * b + 1, np.int64)
    need[: b + 1] = used[: b + 1]
    need[2 * b] += used[k + 1]
    covered = int(np.searchsorted(np.cumsum(need), COVERED * need.sum())) + 1
    return max(2, int(k * LEAST), min(covered, max(2, int(k * MOST))))


def fit_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codebooks and codes of vectors (vec_id, embedding, label); None where no row has a vector to code.

    Codebooks begin as the parts of the rows with the smallest ids, as many as there are
    entries (rows that repeat an id by their bytes, null ids last), then ``rounds`` times
    each part goes to its nearest entry and each entry that has parts becomes the floor of
    their mean. All vectors coded must have one length, a multiple of ``parts``.
    """
    state = materialize(integer_vectors(vectors, scale), "codes-integers")
    seeds = state.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    if not seeds:
        return None
    first = [np.frombuffer(r["ints"], "<i4").astype(np.int64) for r in seeds]
    if any(len(x) != len(first[0]) for x in first) or len(first[0]) % parts:
        raise ValueError(f"vectors must all have one length, a multiple of {parts}")
    codebooks = np.stack([x.reshape(parts, -1) for x in first], axis=1)
    k, width = codebooks.shape[1:]
    b, moved, told = max(2, int(k * FIRST)), None, []
    for r in range(rounds + 1):
        before = state
        state = materialize(assigned(state, codebooks, moved, b), "codes-state")
        forget(before)
        count, total, used = sums(state, parts, k, width)
        told.append({"round": r, "b": b, "settled": int(used[0]), "compared": int(used[1 : k + 1].sum()), "searched": int(used[k + 1])})
        if r == rounds:
            break
        new = np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], codebooks)
        moved = np.sqrt(((new - codebooks) ** 2).sum(axis=2).astype(np.float64)) * (1 + 1e-9)
        b = next_b(used, b, k) if r else b
        codebooks = new
    digits = 2 if k <= 256 else 8
    entry = F.hex(F.col("near"))
    rows = state.select("vec_id", "label", F.lower(F.concat(*[F.substring(entry, 1 + p * b * digits, digits) for p in range(parts)])).alias("code"), "error")
    return Codes(rows, codebooks, told)


def books_sha256(codebooks: np.ndarray) -> str:
    """Digest of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def decode(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes (.., code) -> also vector: the coded entries' middle values, back in the scale of the vectors. For codebooks of up to 256 entries."""
    parts = len(codebooks)
    schema = f"{', '.join(f'`{c}` {t}' for c, t in codes.dtypes)}, vector array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column(batch.schema.get_field_index("code")).to_pylist())), np.uint8).reshape(-1, parts)
            whole = np.concatenate([codebooks[p][at[:, p]] for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list((whole + 0.5) / scale), pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return codes.mapInArrow(run, schema)


def with_total(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """rows with the sum of ``value`` over rows of an equal key, nulls being one key.

    A key with more than HOT of all rows is one of at most 1 / HOT keys, which are sent to
    every task; the others' totals are joined by key, so none of them is large.
    """
    totals = materialize(rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(out), F.count("*").alias("_n")), "codes-totals")
    most = (totals.agg(F.sum("_n")).first()[0] or 0) * HOT
    hot = F.broadcast(totals.where(F.col("_n") > most).drop("_n"))
    on = F.col(key).eqNullSafe(F.col("_key"))
    many = rows.join(hot, on).drop("_key")
    few = rows.join(hot.drop(out), on, "left_anti").hint("merge").join(totals.where(F.col("_n") <= most).drop("_n"), on).drop("_key")
    return many.unionByName(few)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors (vec_id, embedding, label).

    Rows whose vector is null, empty, or holds null or non-finite components are left out;
    rows that repeat an id are coded each, a null id as any other, null labels are one
    label. Other columns aren't read. A table without vectors gives no rows. A component
    whose distances would leave 64 bits, or vectors of several lengths, raise an error.
    """
    found = fit_codes(vectors, parts, entries, rounds, scale)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    whole = with_total(found.rows, "label", "error", "label_error")
    return whole.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(found.codebooks)).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same with every part compared with every entry in every round."""
    steps = []
    for r in range(rounds + 1):
        far = "list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x)"
        steps.append(f"a{r} as materialized (select n, q, min({{'d': {far}, 'k': k}}) as best from p join c{r} c using (q) group by n, q)")
        if r < rounds:
            cells = f"select q, best.k as k, i, floor(sum(v) / count(*)) as m from (select a.q, a.best, unnest(p.x) as v, generate_subscripts(p.x, 1) as i from a{r} a join p using (n, q)) group by all"
            steps.append(f"c{r + 1} as materialized (select c.q, c.k, coalesce(m.x, c.x) as x from c{r} c left join (select q, k, list(m order by i) as x from ({cells}) group by q, k) m on m.q = c.q and m.k = c.k)")
    return f"""
with v as materialized (select row_number() over () as n, vec_id, label, list_transform(embedding, lambda y: floor({scale} * y::double)) as e from embeddings
      where len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
p as materialized (select n, q, e[q * len(e) // {parts} + 1:(q + 1) * len(e) // {parts}] as x from v, range({parts}) r(q)),
c0 as materialized (select q, k, x from p join (select n, row_number() over (order by vec_id nulls last) - 1 as k from v) using (n) where k < {entries}),
{', '.join(steps)},
o as (select n, string_agg(printf('%02x', best.k::int), '' order by q) as code, sum(best.d)::bigint as error from a{rounds} group by n),
h as (select sha256(string_agg(array_to_string(list_transform(x, lambda y: y::bigint), ','), ',' order by q, k)) as codebooks_sha256 from c{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from o join v using (n), h
"""

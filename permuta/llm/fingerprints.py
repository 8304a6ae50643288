"""MinHash fingerprints of texts: likeness, bands and near documents.

A text's shingles are runs of five words (A-Z lower-cased). A fingerprint holds, for each
of PERMUTATIONS universal hash functions (a * x + b) modulo a Mersenne prime, 16 bits of
the smallest value any shingle has; two texts agree in a component about as often as
their sets' Jaccard similarity. BANDS runs of components are keys that likely similar
texts share; what shares one is compared word by word before it counts.

A document meets its next one, in descending order of ids, in a sort by ranges: ranges
are chosen by a table of ids alone, then each text moves once, and the first text of a
range also goes to the end of the range before.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .jaccard import PERCENT, exact_sets, linked_pairs
from .shared import LOWER_TABLE, MIX_BYTES, Words, binary_parts, materialize, mix, record, segments, shuffle_parts, signed

SHINGLE = 5
PERMUTATIONS = 128
#: Keys of a fingerprint and components of each: texts that are 80 % alike share one with 99.8 % likelihood.
BANDS, ROWS = 21, 6
SEED = 1
_PRIME = np.uint64((1 << 31) - 1)
#: Shingles hashed at once: their values fit in a processor's cache.
CHUNK = 1 << 15
#: Bytes of text that a task holds decoded at once.
AT_ONCE = 1 << 22
#: Ranges of the sort for each shuffle partition.
RANGES = 4
#: Component values of a text without words.
_EMPTY = np.uint16(0xFFFF)


def hash_functions(permutations: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of universal hash functions, from a generator with a fixed seed."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, int(_PRIME), permutations, dtype=np.uint64), rng.integers(0, int(_PRIME), permutations, dtype=np.uint64)


def smallest(values: np.ndarray, first: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(texts, permutations): the least hash over each text's shingles values[first[i]:first[i + 1]]; the prime where it has none."""
    texts, a, b = len(first) - 1, *functions
    out = np.full((texts, len(a)), _PRIME, np.uint64)
    # 31 bits of the mixed hash: products with 31-bit multipliers stay below 2**62.
    x = values >> np.uint64(33)
    x[x == _PRIME] = 0
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        lo = int(np.searchsorted(first, at, side="right")) - 1
        cuts = first[lo:texts]
        cuts = np.maximum(cuts[cuts < at + len(part)], at) - at
        full = np.flatnonzero(np.diff(np.append(cuts, len(part))) > 0)
        for k in range(len(a)):
            y = part * a[k] + b[k]
            y = (y & _PRIME) + (y >> np.uint64(31))
            y = np.minimum(y, y - _PRIME)  # one more reduction: below the prime the difference wraps to a large number
            least = np.minimum.reduceat(y, cuts[full])
            out[lo + full, k] = np.minimum(out[lo + full, k], least)
    return out


def shingle_hashes(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and where each text's begin; a text of fewer words is one run."""
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.append(0, np.cumsum(n))
    owner = np.repeat(np.arange(len(n)), n)
    start = words.first[owner] + np.arange(first[-1]) - first[owner]
    return words.runs(start, np.minimum(start + size, words.first[owner + 1])), first


def signatures(texts: list[bytes], permutations: int = PERMUTATIONS, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """(texts, permutations) of 16 bits; a text without words has _EMPTY everywhere. Very long texts are read in parts."""
    functions = hash_functions(permutations, seed)
    out = np.full((len(texts), permutations), _PRIME, np.uint64)
    for row, end, data, offsets in binary_parts(pa.array(texts, pa.binary())):
        if end == row + 1 and len(data) > 2 * MIX_BYTES:
            for i, (part, last) in enumerate(segments(texts[row], size - 1)):
                piece = np.frombuffer(part, np.uint8)
                words = Words(piece, np.array([0, len(piece)]), lower=True)
                # The last part may hold no more than the words it shares with the part before.
                if i == 0 or not last or len(words.hash) >= size:
                    out[row] = np.minimum(out[row], smallest(*shingle_hashes(words, size), functions)[0])
        else:
            out[row:end] = smallest(*shingle_hashes(Words(data, offsets, lower=True), size), functions)
    return np.where(out == _PRIME, _EMPTY, (mix(out) & np.uint64(0xFFFF)).astype(np.uint16)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal components; a text without words is like another such text only."""
    blank = (a == _EMPTY).all(axis=-1) != (b == _EMPTY).all(axis=-1)
    return np.where(blank, 0.0, (a == b).mean(axis=-1))


def band_keys(prints: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands): a 64-bit key of each run of ``rows`` components, of its place too."""
    out = np.empty((len(prints), bands), np.uint64)
    for k in range(bands):
        key = np.full(len(prints), k + 1, np.uint64)
        for i in range(k * rows, (k + 1) * rows):
            key = mix(key ^ mix(prints[:, i].astype(np.uint64) + np.uint64(i)))
        out[:, k] = key
    return out


def edited(text: str, following: str) -> str:
    """The text's last half replaced by as much of the beginning of the text that follows, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def order_key(doc_id: int | None, th: int) -> tuple[bool, int, int]:
    """Sorts as descending ids do, null last; rows of one id by a hash of the text."""
    return doc_id is None, -(doc_id or 0), -th


def range_firsts(docs: DataFrame, ranges: int) -> list[tuple[bool, int, int]]:
    """The order key of the first row of each of so many ranges of rows, from ids and text hashes alone.

    What reaches the driver are three numbers a range. Rows alike in both columns may
    begin several ranges, so that no number of copies makes a range larger.
    """
    keys = docs.select("doc_id", "th", F.monotonically_increasing_id().alias("_row"))
    placed = keys.repartitionByRange(ranges, F.col("doc_id").desc_nulls_last(), F.col("th").desc(), "_row").select(F.struct("doc_id", "th").alias("k"), F.spark_partition_id().alias("part"))
    return sorted(order_key(*r["k"]) for r in placed.groupBy("part").agg(F.max("k").alias("k")).collect())


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """range, role, doc_id, th, packed: every row once with role 0, sorted in its range, and with role 1 a copy of the row that follows the range's last one."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    parts = shuffle_parts(docs.sparkSession)
    firsts = range_firsts(rows, RANGES * parts)
    schema = pa.schema([("range", pa.int32()), ("role", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, sent, turn = zstandard.ZstdCompressor(level=3).compress, set(), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, th, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, packed = order_key(doc_id, th), squeeze(raw)
                low, high = bisect_left(firsts, key), bisect_right(firsts, key)
                # Copies of one row that begin several ranges are dealt over them.
                turn += 1
                out.append((low + turn % (high - low) if high > low else high - 1, 0, doc_id, th, packed))
                for r in range(low, high):
                    if r not in sent:
                        sent.add(r)
                        out.append(((r - 1) % len(firsts), 1, doc_id, th, packed))
            if out:
                yield record(schema, *zip(*out, strict=True))

    placed = rows.mapInArrow(run, "range int, role int, doc_id bigint, th bigint, packed binary").repartition(parts, "range")
    return placed.sortWithinPartitions("range", "role", F.col("doc_id").desc_nulls_last(), F.col("th").desc())


def verified(a: bytes, b: bytes, size: int) -> float:
    """The exact Jaccard similarity of two texts' shingle sets, 0 where neither has words."""
    one, two = exact_sets([a, b], size)
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared / max(1, len(one) + len(two) - shared)


_OUT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("jaccard_edited", pa.float64()), ("jaccard_next", pa.float64())])


def fingerprint_rows(placed: DataFrame, permutations: int = PERMUTATIONS, size: int = SHINGLE) -> DataFrame:
    """Rows of with_next -> fingerprints of each text and its edited text, their likeness and, of those that share a band, their Jaccard similarity."""

    def flush(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [*(r[2] for r in rows), following]
        changed = [edited(a, b).encode() for a, b in zip(texts[:-1], texts[1:], strict=True)]
        raw = [t.encode() for t in texts]
        own, other = signatures(raw, permutations, size), signatures(changed, permutations, size)
        n = len(rows)
        to_edit, to_next = likeness(own[:n], other), likeness(own[:n], own[1:])
        keys, edit_keys = band_keys(own), band_keys(other)
        fold = lambda t: t.translate(LOWER_TABLE)
        exact = [[verified(fold(raw[i]), fold(t), size) if share else None for i, (t, share) in enumerate(zip(those, shares, strict=True))] for those, shares in ((changed, (keys[:n] == edit_keys).any(axis=1)), (raw[1:], (keys[:n] == keys[1:]).any(axis=1)))]
        digests = [hashlib.sha256(x).hexdigest() for x in changed]
        return record(_OUT, [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], digests, [x.tobytes() for x in own[:n]], [x.tobytes() for x in other], to_edit, to_next, *exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        rows: list[tuple] = []  # the last one's next text is still to come
        held, at, done = 0, None, True
        for batch in batches:
            for where, role, doc_id, th, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != at:
                    if rows:
                        raise RuntimeError("a range has no text after its last")
                    at, done = where, False
                if done or (role and not rows):
                    done = done or bool(role)
                    continue
                text = inflate(packed).decode()
                if rows and (role or held + len(text) > AT_ONCE):
                    yield flush(rows, text)
                    rows, held = [], 0
                if role:
                    done = True
                else:
                    rows.append((doc_id, th, text))
                    held += len(text)

    kinds = "doc_id bigint, th bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
    return placed.mapInArrow(run, kinds)


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited, jaccard_next of every row.

    The next document is the one with the next smaller doc_id, after the smallest the
    largest; ids that are null come last, rows that repeat an id stand by a hash of their
    texts, so equal rows in any order are the same. A lone document is its own next one. A
    null text is empty; texts without words have one fingerprint of their own, like no
    other. The Jaccard columns are null where the two fingerprints share no band. Other
    columns aren't read. An empty table gives no rows.
    """
    found = fingerprint_rows(with_next(docs, text), permutations, size)
    return found.drop("th").withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def near_documents(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, near_id of every row: the smallest doc_id reachable over verified links between texts whose fingerprints share a band.

    Equal texts are one. A band's texts are first compared with the first of them, then
    each with the first of every other component that the band still holds; links are
    those whose exact sets of shingles reach ``percent``. Texts without words are near
    their copies only. A null id has no near_id and joins nothing.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("packed", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [x.translate(LOWER_TABLE) for x in batch.column(1).to_pylist()]
            prints = signatures(texts, size=size)
            blank = (prints == _EMPTY).all(axis=1)
            keys = [[] if b else k for b, k in zip(blank, signed(band_keys(prints)).tolist(), strict=True)]
            yield record(schema, batch.column(0), [hashlib.blake2b(x, digest_size=20).digest() for x in texts], map(squeeze, texts), keys)

    made = rows.mapInArrow(run, "doc_id bigint, digest binary, packed binary, bands array<bigint>")
    made = materialize(made.withColumn("key", F.monotonically_increasing_id()), "prints")
    named = made.where("doc_id is not null")
    equal = materialize(named.groupBy("digest").agg(F.min("key").alias("first"), F.min("doc_id").alias("least")), "prints-equal")
    texts = named.select("key", "packed", "bands").join(equal.select(F.col("first").alias("key")).hint("merge"), "key", "left_semi")
    members = texts.select("key", F.explode(F.array_distinct("bands")).alias("band"))
    first = members.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(members.join(first, "band"), "prints-bands")
    wanted = texts.select("key", "packed").join(members.select("key").distinct().hint("merge"), "key", "left_semi")
    wanted = materialize(wanted, "prints-texts")
    pairs = members.where("key > head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    links = materialize(linked_pairs(pairs, wanted, percent, size), "prints-links")
    labels = components(links)
    placed = members.select("band", "key").join(labels.withColumnRenamed("id", "key"), "key", "left").select("band", "key", F.coalesce("component", "key").alias("component"))
    heads = placed.groupBy("band", "component").agg(F.min("key").alias("head")).select("band", F.col("component").alias("other"), "head")
    more = materialize(placed.join(heads, "band").where("component <> other").select(F.greatest("key", "head").alias("a"), F.least("key", "head").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "prints-pairs")
    links = links.unionByName(materialize(linked_pairs(more, wanted, percent, size), "prints-links"))
    near = components(links)
    groups = equal.select("digest", F.col("first").alias("id"), "least").join(near, "id", "left").select("digest", "least", F.coalesce("component", "id").alias("component"))
    groups = materialize(groups, "prints-groups")
    smallest_ids = groups.groupBy("component").agg(F.min("least").alias("near_id"))
    ids = groups.join(smallest_ids, "component").select("digest", "near_id")
    return named.select("doc_id", "digest").join(ids, "digest").select("doc_id", "near_id").unionByName(made.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("near_id")))

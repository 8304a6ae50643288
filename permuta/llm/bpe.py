"""Byte-level BPE encoding and decoding of whole texts.

Long texts are cut into overlapping chunks which are pre-tokenised in parallel. A
pre-token starting at a position depends on the text from there on only, so once
a chunk and its left neighbour have a boundary in common, the chunk's later
boundaries are those of the whole text. Pieces between such points are encoded on
their own and the ids are concatenated; decoding concatenates the ids' raw bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, materialize, named, plain, record

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10


@functools.cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the pre-tokens of a text start."""
    import regex

    return [m.start() for m in regex.finditer(pattern, text)]


def _digests(ids: list[int], enc) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


def encode_ids(texts: list[str], path: str, pattern: str) -> list[list[int]]:
    return [encoding(path, pattern).encode_ordinary(x) for x in texts]


def encode_texts(docs: DataFrame, path: str, pattern: str, keep: list[str], out: str = "digests", text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Encode column ``text`` of every row and decode the ids again.

    keep: columns carried along, but for those whose names the results have. out="ids"
    gives ids array<int> and decoded binary, out="digests" n_tokens, ids_sha256 and
    decoded_sha256. Rows that repeat stay as many, ids may be null. A null text is empty; an
    empty text has no ids. Texts of more than ``chunk`` characters are cut into
    chunks; where neighbours share no boundary inside the overlap (one pre-token
    longer than it), the whole text is encoded in one piece, so the ids never change.
    """
    taken = ("n_tokens", "ids_sha256", "decoded_sha256") if out == "digests" else ("ids", "decoded")
    keep = [c for c in keep if c.lower() not in taken]
    rows = docs.select(*named(keep), F.coalesce(F.col(text), F.lit("")).alias(hidden := fresh(keep, "text")[0]))
    result = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if out == "digests" else "ids array<int>, decoded binary"
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    short = _encode(rows.where(F.length(hidden) <= chunk), keep, f"{kept + ', ' if keep else ''}{result}", path, pattern, out)
    long = rows.where(F.length(hidden) > chunk)
    return short.unionByName(_long(long, keep, hidden, result, path, pattern, out, chunk, overlap))


def _encode(rows: DataFrame, keep: list[str], schema: str, path: str, pattern: str, out: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = (enc.encode_ordinary(x) for x in part.column(part.num_columns - 1).to_pylist())
                yield _row_batch([part.column(i) for i in range(len(keep))], keep, list(ids), enc, out)

    return plain(rows).mapInArrow(run, schema)


def _row_batch(kept: list, keep: list[str], ids: list[list[int]], enc, out: str) -> pa.RecordBatch:
    if out == "ids":
        return pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())], names=[*keep, "ids", "decoded"])
    n, a, b = ([*zip(*(_digests(x, enc) for x in ids), strict=True)]) or ((), (), ())
    return pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])


def _long(rows: DataFrame, keep: list[str], hidden: str, result: str, path: str, pattern: str, out: str, chunk: int, overlap: int) -> DataFrame:
    """Chunks of (text, number) -> boundaries near both ends -> cut points -> pieces -> ids."""
    row_key: Column = F.sha2(hidden, 256)
    keyed = materialize(rows.select(row_key.alias("_key"), F.col(hidden).alias("_text")).dropDuplicates(["_key"]), "bpe-long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's chunks in one pass over it: Spark's substring would walk from its start for each."""
        schema = pa.schema([("_key", pa.string()), ("_i", pa.int32()), ("_n", pa.int64()), ("_chunk", pa.string())])
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = range(0, len(text), chunk)
                yield record(schema, [key] * len(starts), list(range(len(starts))), [len(text)] * len(starts), [text[i : i + chunk + overlap] for i in starts])

    chunks = keyed.mapInArrow(cut, "_key string, _i int, _n bigint, _chunk string").repartition("_key", "_i")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_key", pa.string()), ("_i", pa.int32()), ("_head", pa.list_(pa.int64())), ("_tail", pa.list_(pa.int64()))])
        for batch in batches:
            head, tail = [], []
            for i, n, x in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                base, last = i * chunk, i * chunk + len(x) >= n
                found = [base + b for b in boundaries(x, pattern)]
                head.append([b for b in found if b < base + overlap])
                # The last two pre-tokens may touch the cut, so their boundaries are not trusted.
                tail.append([] if last else [b for b in found[:-2] if b >= base + chunk])
            yield record(schema, batch.column(0), batch.column(1), head, tail)

    found = materialize(chunks.mapInArrow(ends, "_key string, _i int, _head array<bigint>, _tail array<bigint>"), "bpe-ends")
    meet = found.alias("r").join(found.alias("l"), (F.col("r._key") == F.col("l._key")) & (F.col("r._i") == F.col("l._i") + 1))
    cuts = meet.select(F.col("r._key").alias("_key"), F.array_min(F.array_intersect("r._head", "l._tail")).alias("_cut"))
    per_text = cuts.groupBy("_key").agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"), F.max(F.col("_cut").isNull()).alias("_broken"))
    spans = keyed.select("_key", "_text").join(per_text, "_key", "left")
    points = F.when(F.coalesce("_broken", F.lit(False)), F.array().cast("array<bigint>")).otherwise(F.coalesce("_cuts", F.array().cast("array<bigint>")))
    edges = spans.select("_key", "_text", points.alias("_at"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_key", pa.string()), ("_i", pa.int32()), ("_text", pa.string())])
        for batch in batches:
            for key, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = [0, *cuts, len(text)]
                yield record(schema, [key] * (len(at) - 1), list(range(len(at) - 1)), [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])

    pieces = edges.mapInArrow(split, "_key string, _i int, _text string").repartition("_key", "_i")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_key", pa.string()), ("_i", pa.int32()), ("_ids", pa.list_(pa.int32()))])
        for batch in batches:
            yield record(schema, batch.column(0), batch.column(1), encode_ids(batch.column(2).to_pylist(), path, pattern))

    parts = pieces.mapInArrow(encode, "_key string, _i int, _ids array<int>")
    whole = parts.groupBy("_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_ids"))), lambda x: x["_ids"])).alias("_ids"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            yield _row_batch([batch.column(0)], ["_key"], batch.column(1).to_pylist(), enc, out)

    done = whole.select("_key", "_ids").mapInArrow(finish, f"_key string, {result}")
    names = [x.split()[0] for x in result.replace("array<int>", "array").split(", ")]
    key = fresh(keep, "key")[0]
    return rows.select(*named(keep), row_key.alias(key)).join(done.withColumnRenamed("_key", key), key).select(*named(keep), *names)

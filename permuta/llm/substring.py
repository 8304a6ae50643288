"""Removal of long word passages that an earlier document has too.

The graph is De Bruijn's over words: an edge is a run of WINDOW words. Consecutive
edges whose smallest k-mer (the minimizer) is the same form a path piece as they
are read, so equal passages give equal pieces whatever stands around them. Joins
on minimizers find pieces that repeat; a minimizer with one piece is a path without
branches and is settled whole, and only where pieces branch are they opened into
their edges again. Every repeat knows its source, the first place with the same words.
Joins then compact repeats that follow each other, in the document and in its source
alike, to long spans with the coordinates of both.

Pieces and edges are named by a 128-bit cryptographic digest of their words, so equal
names are equal words; the hashes that choose minimizers only decide where to cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import MIX_BYTES, Words, binary_parts, materialize, record, segments, signed

WINDOW = 50
KMER = 6
PIECE_EDGES = 45
#: Documents whose pieces a task holds at once.
AT_ONCE = 1000
KEY = ["doc_id", "th"]


def packed_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text, so rows that share an id stay apart) and the text's compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([squeeze(x or b"") for x in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=[*KEY, "packed"])

    return docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, "doc_id bigint, th bigint, packed binary")


def unpack(column: pa.Array) -> list[bytes]:
    inflate = zstandard.ZstdDecompressor().decompress
    return [inflate(x) for x in column.to_pylist()]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, in log(width) passes."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def normal_parts(texts: list[bytes], window: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, first word, bytes, offsets): words with one space between; very long texts in parts that share window - 1 words."""
    short: list[bytes] = []
    for i, text in enumerate(texts):
        if len(text) <= 2 * MIX_BYTES:
            short.append(b" ".join(text.split()))
            continue
        short.append(b"")
        base = 0
        for part, _ in segments(text, window - 1):
            words = part.split()
            data = np.frombuffer(b" ".join(words), np.uint8)
            yield i, i + 1, base, data, np.array([0, len(data)])
            base += len(words) - window + 1
    for row, end, data, offsets in binary_parts(pa.array(short, pa.binary())):
        yield row, end, 0, data, offsets


def names(words: Words, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Digests of the word runs begin[i]:end[i] of normal texts."""
    data = words.data.tobytes()
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(words.start[begin].tolist(), words.end[end - 1].tolist(), strict=True)]


def read_pieces(words: Words, window: int = WINDOW, kmer: int = KMER, most: int = PIECE_EDGES) -> tuple[np.ndarray, ...]:
    """(text, first word in it, edges, minimizer, name) of every path piece of some texts."""
    n = len(words.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64), []
    at = np.arange(n - kmer + 1)
    smallest = sliding_min(words.runs(at, at + kmer), window - kmer + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(inside):
        return none, none, none, none.view(np.uint64), []
    value, owner = smallest[inside], text[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    offset = np.arange(len(inside)) - np.repeat(starts, np.diff(np.append(starts, len(inside))))
    starts = np.flatnonzero(offset % most == 0)
    edges = np.diff(np.append(starts, len(inside)))
    begin = inside[starts]
    return owner[starts], begin - words.first[owner[starts]], edges, value[starts], names(words, begin, begin + edges + window - 1)


def piece_table(docs: DataFrame, window: int, text: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("minimizer", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, end, base, data, offsets in normal_parts([x or b"" for x in batch.column(2).to_pylist()], window):
                owner, start, n, smallest, piece = read_pieces(Words(data, offsets), window)
                yield record(schema, ids[row:end][owner], th[row:end][owner], (base + start).astype(np.int32), n.astype(np.int32), signed(smallest), piece)

    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, th bigint, start int, n int, minimizer bigint, piece binary")


def open_edges(pieces: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """The single edges of some pieces, read again from their documents: doc_id, th, start, edge. A document asks for its own pieces only."""
    wanted = pieces.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("edge", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, end, base, data, offsets in normal_parts(unpack(batch.column(2)), window):
                words, part = Words(data, offsets), batch.column(3).slice(row, end - row)
                owner = np.repeat(np.arange(end - row), np.asarray(part.value_lengths()))
                flat = part.flatten()
                first, n = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("n")).astype(np.int64)
                owner, first = np.repeat(owner, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                # Of a very long text only the part's own edges; of a text that is read elsewhere none.
                at = first - base
                mine = (at >= 0) & (at + window <= np.diff(words.first)[owner])
                owner, first, at = owner[mine], first[mine], words.first[owner[mine]] + at[mine]
                yield record(schema, ids[row:end][owner], th[row:end][owner], first.astype(np.int32), names(words, at, at + window))

    return texts.join(wanted, KEY).select(*KEY, "packed", "spans").mapInArrow(run, "doc_id bigint, th bigint, start int, edge binary")


PLACE = ["doc_id", "th", "start"]


def compacted(repeats: DataFrame, window: int) -> DataFrame:
    """Repeats (doc_id, th, start, n, source) -> spans (doc_id, th, start, stop, source_id, source_th, source_start), as long as they can be.

    A repeat goes on where another begins at its last edge's successor with the source's
    successor as its source. Spans begin and end where nothing goes on; a document's
    spans of one source and shift are disjoint, so its k-th beginning has its k-th end.
    """
    path = [*KEY, "source_id", "source_th", "shift"]
    rows = repeats.select(*PLACE, (F.col("start") + F.col("n")).alias("end"), F.col("source.doc_id").alias("source_id"), F.col("source.th").alias("source_th"), (F.col("source.start") - F.col("start")).alias("shift"))
    rows = materialize(rows, "substring-repeats-placed")
    ends = rows.select(*path, F.col("end").alias("start"))
    begins = rows.join(ends, [*path, "start"], "left_anti").select(*path, "start")
    ends = rows.join(rows.select(*path, F.col("start").alias("end")), [*path, "end"], "left_anti").select(*path, "end")
    order = Window.partitionBy(*path)
    begins = begins.withColumn("k", F.row_number().over(order.orderBy("start")))
    ends = ends.withColumn("k", F.row_number().over(order.orderBy("end")))
    spans = begins.join(ends, [*path, "k"])
    return spans.select(*PLACE, (F.col("end") + window - 1).alias("stop"), "source_id", "source_th", (F.col("start") + F.col("shift")).alias("source_start"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The word spans [start, stop) whose windows all start in an earlier document too, and where: doc_id, th, start, stop, source_id, source_th, source_start."""
    place = F.min(F.struct(*PLACE)).alias("source")
    pieces = materialize(piece_table(docs, window, text), "substring-pieces")
    shared = pieces.groupBy("minimizer").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("piece") != F.max("piece")).alias("branches"))
    shared = materialize(shared.where("lo < hi").select("minimizer", "branches"), "substring-minimizers")
    found = materialize(pieces.join(shared, "minimizer"), "substring-repeats")
    paths = materialize(found.groupBy("minimizer", "piece").agg(place), "substring-paths")
    placed = found.join(paths, ["minimizer", "piece"]).where("branches or source.doc_id < doc_id").select(*PLACE, "n", "branches", "source")
    placed = materialize(placed, "substring-placed")
    whole = placed.where("source.doc_id < doc_id").select(*PLACE, "n", "source")
    edges = materialize(open_edges(placed.where("branches and source.doc_id = doc_id"), packed_texts(docs, text), window), "substring-edges")
    earliest = edges.groupBy("edge").agg(place, F.max("doc_id").alias("hi"))
    earliest = materialize(earliest.where("source.doc_id < hi").select("edge", "source"), "substring-earliest")
    single = edges.join(earliest, "edge").where("source.doc_id < doc_id").select(*PLACE, F.lit(1).alias("n"), "source")
    return compacted(whole.unionByName(single), window)


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", out: str = "digests") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (out="digests") or kept (out="text") of every row.

    A word goes if a window of ``window`` words over it also starts in a document of
    smaller doc_id; windows are judged on the input. Null and empty texts have no words,
    texts shorter than the window lose none. A row whose doc_id is null has no earlier
    documents and is none itself; rows that repeat both id and text lose the same words.
    """
    spans = repeated_spans(docs, window, text).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    digests = out == "digests"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            spans = batch.column(2)
            lengths = np.asarray(spans.value_lengths().fill_null(0))
            flat = spans.flatten()
            starts, stops, at = flat.field("start").to_pylist(), flat.field("stop").to_pylist(), 0
            for x, k in zip(unpack(batch.column(1)), lengths, strict=True):
                words, rest, last = x.split(), [], 0
                for i in range(at, at + k):
                    if starts[i] > last:
                        rest += words[last : starts[i]]
                    last = max(last, stops[i])
                at += k
                rest = rest + words[last:] if k else words
                n.append(len(words))
                removed.append(len(words) - len(rest))
                text = b" ".join(rest)
                kept.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = packed_texts(docs, text).join(spans, KEY, "left").select("doc_id", "packed", "spans")
    result = joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    return result.withColumnRenamed("kept", "kept_sha256") if digests else result

"""Shared pieces: a place every executor sees, and vectorised hashing of words.

A *word* is a maximal run of bytes other than space and 0x09-0x0D. A word's hash chains
a mixing step over its bytes, eight at a time; hashes of runs of words are sums over
the words' hashes, so any run costs O(1). Hashes only propose: whatever is removed or
linked by them is compared word by word before.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are taken apart at once; the arrays this needs are about thirty times as large.
MIX_BYTES = 1 << 19
_KEY = np.uint64(0x9E3779B97F4A7C15)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
LOWER_TABLE = _LOWER.tobytes()
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where none is named and the driver is the only machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing reads any more; other tables are left alone."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if re.search(r"-[0-9a-f]{32}$", folder.getName()) and str(folder.getParent()).split(":", 1)[-1].lstrip("/") == shared_dir(spark).split(":", 1)[-1].lstrip("/"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like the given ones that no column has, in any case."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        made = f"_{name}"
        while made in used:
            made = "_" + made
        out.append(made)
        used.add(made)
    return out


def named(names: list[str]) -> list[Column]:
    """Columns of these names, whatever signs the names hold."""
    return [F.col("`" + x.replace("`", "``") + "`") for x in names]


def plain(df: DataFrame) -> DataFrame:
    """df with names that map functions can read in place of those with dots or quotes; what such a function returns is named by its schema."""
    return df.toDF(*[f"_plain_{i}" if re.search(r"[.`]", c) else c for i, c in enumerate(df.columns)])


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, grown on demand."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_parts(column: pa.Array, most: int = MIX_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of about ``most`` bytes; null is empty."""
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def segments(text: bytes, overlap: int, most: int = MIX_BYTES) -> Iterator[tuple[bytes, bool]]:
    """Consecutive parts of a text that begin with the last ``overlap`` words of the part before; and whether it is the last.

    Parts are cut between words and are of about ``most`` bytes, longer only where ``overlap``
    words are. Every run of up to ``overlap + 1`` words lies whole in some part.
    """
    start, size = 0, most
    while start + size < len(text):
        gap = _GAP.search(text, start + size)
        if not gap:
            break
        part = text[start : gap.start()]
        head = part.rsplit(None, overlap)
        if len(head) <= overlap or not head[0]:
            size *= 2
            continue
        yield part, False
        start, size = start + len(head[0]), most
    yield text[start:], True


class Words:
    """Words of some texts laid end to end: where each starts and ends, of which text, and its hash.

    first[i] is the index of text i's first word, so text i has words first[i]:first[i + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        self.data = data
        inside = ~_SPACE[data]
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
            cuts = offsets[1:] - 1
            after[cuts[cuts >= 0]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = hash_words(data, self.start, self.end)
        self._sums: np.ndarray | None = None

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word runs start[i]:end[i]."""
        up, down = _powers(_WORD_BASE, len(self.hash) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(self.hash * up[: len(self.hash)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes start[i]:end[i], chained over eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    left = end - start
    out = mix(left.astype(np.uint64) ^ _KEY)
    rows, at = np.arange(len(start)), start
    while len(rows):
        piece = np.ascontiguousarray(eights[at]).view("<u8").ravel() & _MASKS[np.minimum(left, 8)]
        out[rows] = mix((out[rows] ^ mix(piece + _KEY)) + _KEY)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

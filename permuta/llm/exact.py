"""Exact deduplication against immutable snapshots.

A snapshot's digests are dealt into buckets and each bucket gets a static
binary-fuse filter. Digests of an incoming batch are grouped first, then screened
by the filter of their bucket; only positives are joined with the snapshot's exact
bucket. Rows whose digests agree are compared byte by byte with the row that stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER_TABLE, materialize, mix, named, plain, record, shuffle_parts

BUCKET_KEYS = 1 << 20
#: A group is dealt over one salt more for every so many rows, up to SALTS.
SALT_ROWS = 10_000
SALTS = 4096


def normalized(text: bytes | None) -> bytes:
    return (text or b"").translate(LOWER_TABLE)


def digest_rows(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and the SHA-256 of the normalised text (A-Z lower-cased, null is empty)."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(normalized(x)).digest() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.binary())], names=[*keep, "digest"])

    return plain(docs.select(*named(keep), F.col(text).cast("binary").alias("_text"))).mapInArrow(run, f"{schema}, digest binary")


class BinaryFuse:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, count: int, prints: np.ndarray):
        self.seed, self.segment, self.count, self.prints = seed, segment, count, prints

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64(self.seed))
        first = ((h >> np.uint64(32)) * np.uint64(self.count) >> np.uint64(32)).astype(np.int64)
        low = np.uint64(self.segment - 1)
        g = mix(h)
        a = first * self.segment + (g & low).astype(np.int64)
        b = (first + 1) * self.segment + ((g >> np.uint64(20)) & low).astype(np.int64)
        c = (first + 2) * self.segment + ((g >> np.uint64(40)) & low).astype(np.int64)
        return a, b, c, (h & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 1)
        segment = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
        count = max(1, int(np.ceil(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) / segment)) - 2) if n > 1 else 1
        for seed in range(1, 200):
            made = cls(seed, segment, count, np.zeros((count + 2) * segment, np.uint8))
            if made._fill(keys):
                return made
            count += max(1, count // 20)
        raise ValueError("no seed gives a filter")

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel in rounds: take every key that is alone in one of its places, then assign in reverse."""
        places = np.stack(self._places(keys)[:3])
        prints = self._places(keys)[3]
        alive, rounds = np.ones(len(keys), bool), []
        size = len(self.prints)
        while alive.any():
            left = np.flatnonzero(alive)
            flat = places[:, left].ravel()
            holders = np.bincount(flat, minlength=size)
            owner = np.zeros(size, np.int64)
            owner[flat] = np.tile(left, 3)
            alone = np.flatnonzero(holders == 1)
            taken, at = np.unique(owner[alone], return_index=True)
            if not len(taken):
                return False
            rounds.append((taken, alone[at]))
            alive[taken] = False
        for taken, at in reversed(rounds):
            self.prints[at] = 0
            a, b, c = places[:, taken]
            self.prints[at] = prints[taken] ^ self.prints[a] ^ self.prints[b] ^ self.prints[c]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        a, b, c, f = self._places(keys.astype(np.uint64))
        return self.prints[a] ^ self.prints[b] ^ self.prints[c] == f


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x[8:16] for x in digests), np.uint64).copy()


def _bucket(buckets: int) -> Column:
    return (F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter per bucket of distinct digests: (bucket, seed, segment, count, prints)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(_keys(pdf["digest"]))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [made.seed], "segment": [made.segment], "count": [made.count], "prints": [made.prints.tobytes()]})

    return groups.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, count int, prints binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Incoming groups and whether their bucket's filter may hold them; a bucket without a filter holds none."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:
            return left.assign(maybe=False).drop(columns="bucket")
        f = right.iloc[0]
        made = BinaryFuse(int(f["seed"]), int(f["segment"]), int(f["count"]), np.frombuffer(f["prints"], np.uint8))
        return left.assign(maybe=made.contains(_keys(left["digest"]))).drop(columns="bucket")

    keyed = groups.select(_bucket(buckets).alias("bucket"), "digest", "keep_id", "n")
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(run, "digest binary, keep_id bigint, n bigint, maybe boolean")


def group_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, digest) -> one row per digest with the largest doc_id and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))


def merge_batch(snapshot: DataFrame, batch: DataFrame, largest: int) -> DataFrame:
    """Groups of a snapshot and of a batch, the larger of ``largest`` rows -> groups of both, the batch screened by the snapshot's filters."""
    buckets = max(shuffle_parts(snapshot.sparkSession), -(-largest // BUCKET_KEYS))
    screened = materialize(screen(batch, build_filters(snapshot, buckets), buckets), "exact-screened")
    hits = screened.where("maybe").select(F.col("digest"), F.col("keep_id").alias("b_keep"), F.col("n").alias("b_n"))
    old = snapshot.join(hits, "digest", "left").select("digest", F.greatest("keep_id", "b_keep").alias("keep_id"), (F.col("n") + F.coalesce("b_n", F.lit(0))).alias("n"))
    false_hits = screened.where("maybe").join(snapshot.select("digest"), "digest", "left_anti")
    fresh = screened.where("not maybe").unionByName(false_hits)
    return old.unionByName(fresh.select("digest", "keep_id", "n"))


def exact_dedup(docs: DataFrame, is_snapshot: Column, text_hash: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, and with ``text_hash`` th, which is xxhash64 of the text and tells rows of one id apart.

    Rows where ``is_snapshot`` holds are the immutable snapshot, all others the incoming
    batch; the split changes the route a row takes, never the result. Null texts equal
    empty ones. A null doc_id is smaller than any other and is kept only where every row
    of its group has none; rows repeating the kept doc_id are all marked kept. An id may
    stand for several texts: rows are told apart by id and text.
    """
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.coalesce(is_snapshot, F.lit(False)).alias("old"))
    rows = materialize(digest_rows(marked, ["doc_id", "th", "old"]), "exact-digests")
    snapshot = materialize(group_digests(rows.where("old")), "exact-snapshot")
    batch = materialize(group_digests(rows.where("not old")), "exact-batch")
    merged = materialize(merge_batch(snapshot, batch, max(snapshot.count(), batch.count())), "exact-groups")
    groups = merged.where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), salts("n") - 1)))
    # A row doesn't know its group's size yet; the sizes of the few large groups are joined first, and split by Spark where skewed.
    large = merged.where(F.col("n") > SALT_ROWS).select("digest", salts("n").alias("salts"))
    salted = rows.select("doc_id", "th", "digest").join(large, "digest", "left").withColumn("salt", salt_of("doc_id", F.coalesce("salts", F.lit(1)))).drop("salts")
    joined = salted.join(groups, ["digest", "salt"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    found = joined.select("doc_id", "th", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    found = materialize(found, "exact-found")
    odd = materialize(mixed_digests(docs, found), "exact-odd")
    found = found if odd.isEmpty() else regrouped(docs, found, odd)
    return found if text_hash else found.drop("th")


def salts(rows: str) -> Column:
    return F.least(F.lit(SALTS), F.ceil(F.col(rows) / SALT_ROWS)).cast("int")


def salt_of(key: str, many: Column) -> Column:
    return F.pmod(F.hash(key), many).cast("int")


def with_texts(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """Rows of docs whose id and text hash are in rows (doc_id, th, ..; distinct), with their texts as ``same``."""
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), text.alias("same"))
    # Joined one way at all sizes: which side is small changes with the corpus, the plan shouldn't.
    return rows.hint("merge").join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).drop("id", "h")


def mixed_digests(docs: DataFrame, found: DataFrame) -> DataFrame:
    """text_sha256 of the groups whose texts aren't all the same bytes: empty unless SHA-256 collides.

    Only members of groups are read again. A group's text to compare with is sent once for
    each of its salts, so a large group is compared by many tasks.
    """
    members = found.where("group_size > 1").select("doc_id", "th", "group_size", "kept", "text_sha256").distinct()
    chosen = members.where("kept").groupBy("text_sha256").agg(F.min("th").alias("chosen"))
    members = members.join(chosen, "text_sha256").select("doc_id", "th", "group_size", "text_sha256", (F.col("kept") & (F.col("th") == F.col("chosen"))).alias("stands"))
    texts = with_texts(materialize(members, "exact-members"), docs, F.col("text").cast("binary"))
    first = texts.where("stands").dropDuplicates(["text_sha256"])
    first = first.select("text_sha256", F.col("same").alias("first"), F.explode(F.sequence(F.lit(0), salts("group_size") - 1)).alias("salt"))
    pairs = texts.where("not stands").withColumn("salt", salt_of("doc_id", salts("group_size"))).join(first, ["text_sha256", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            odd = pa.array([normalized(x) != normalized(y) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield record(pa.schema([("text_sha256", pa.string())]), batch.column(0).filter(odd))

    return pairs.select("text_sha256", "same", "first").mapInArrow(run, "text_sha256 string").distinct()


def regrouped(docs: DataFrame, found: DataFrame, odd: DataFrame) -> DataFrame:
    """Rows whose digest stands for more than one text are grouped by the text itself."""
    upper = "".join(map(chr, range(65, 91)))
    rows = found.join(odd, "text_sha256", "left_semi")
    texts = with_texts(rows.select("doc_id", "th").distinct(), docs, F.translate(F.coalesce(F.col("text"), F.lit("")), upper, upper.lower()))
    texts = texts.dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("id"), F.col("th").alias("h"), "same")
    split = rows.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).drop("id", "h")
    groups = split.groupBy(F.col("same").alias("text_of")).agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))
    again = split.join(groups, F.col("same") == F.col("text_of"))
    again = again.select("doc_id", "th", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256")
    return found.join(odd, "text_sha256", "left_anti").select(again.columns).unionByName(again)

"""Document quality by attention over passages.

Every passage of a document is encoded; gated attention, learned from the documents'
labels alone, weighs the passages' hidden representations, and the weighted sum is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .shared import LOWER_TABLE, MIX_BYTES, Words, binary_parts, hash_words, named, plain, segments

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 3000
PASSAGE_WORDS = 64
HIDDEN = 24
ATTENTION = 12
KINDS = 16
BUCKETS = 128
_KIND = np.full(256, 15, np.uint8)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"|", b"%$", b"&*#", b"'\"()[]{}", b"-_/\\", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)))):
    _KIND[np.frombuffer(_bytes, np.uint8)] = _kind


def encode_passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """One vector for each passage of ``size`` words, and each text's number of passages (1 at least).

    Square roots of the shares of pairs of neighbouring kinds of bytes and of words by
    BUCKETS of their lower-cased hash, then the words' length, the shares of distinct
    words, of words equal to the one before, of words that start with a capital, and how
    full the passage is.
    """
    words = Words(data, offsets)
    n = np.diff(words.first)
    count = np.maximum(1, -(-n // size))
    base = np.cumsum(count) - count
    total = int(count.sum())
    owner = np.repeat(np.arange(len(n)), n)
    passage = base[owner] + (np.arange(len(owner)) - words.first[owner]) // size
    kind = _KIND[data].astype(np.int64)
    at = np.cumsum(np.bincount(words.start, minlength=len(data))[: len(data)]) - 1
    of = np.where(at >= 0, passage[np.maximum(at, 0)], 0) if len(passage) else np.zeros(len(data), np.int64)
    pair = of[1:] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:]
    pairs = np.bincount(pair[at[1:] >= 0] if len(data) > 1 else pair[:0], minlength=total * KINDS * KINDS).reshape(total, -1)
    shares = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    held = np.bincount(passage, minlength=total)
    some = np.maximum(held, 1)
    bucket = (hash_words(np.frombuffer(LOWER_TABLE, np.uint8)[data], words.start, words.end) % np.uint64(BUCKETS)).astype(np.int64)
    lexical = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, -1)
    lexical = np.sqrt(lexical / some[:, None])
    length = np.bincount(passage, weights=words.end - words.start, minlength=total) / some
    order = np.lexsort((words.hash, passage))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][new], minlength=total) / some
    again = np.zeros(len(owner), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (passage[1:] == passage[:-1])
    again = np.bincount(passage, weights=again, minlength=total) / some
    capital = np.bincount(passage, weights=kind[words.start] == 1, minlength=total) / some
    return np.column_stack([shares, lexical, length / 8, distinct, again, capital, held / size]).astype(np.float32), count


def passages(texts: list[bytes], size: int = PASSAGE_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, passages, passages of each text); very long texts are encoded in parts of whole passages."""
    for row, end, data, offsets in binary_parts(pa.array(texts, pa.binary())):
        if len(data) <= 2 * MIX_BYTES or end > row + 1:
            yield row, end, *encode_passages(data, offsets, size)
            continue
        parts, rest = [], b""
        for text, last in segments(texts[row], 0):
            text = rest + text
            piece = np.frombuffer(text, np.uint8)
            start = Words(piece, np.array([0, len(piece)])).start
            whole = len(start) // size * size
            cut = len(text) if last or whole == len(start) else int(start[whole])
            if not len(start[:whole]) and not (last and (len(start) or not parts)):
                cut = len(text) if last else 0
            else:
                parts.append(encode_passages(piece[:cut], np.array([0, cut]), size)[0])
            rest = text[cut:]
        found = np.vstack(parts)
        yield row, end, found, np.array([len(found)])


@dataclass
class Model:
    mean: np.ndarray | None
    std: np.ndarray | None
    weights: dict[str, np.ndarray]
    share: float = 0.5

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(count), self.share)
        return _forward((x - self.mean) / self.std, count, self.weights)["p"]


def _forward(x: np.ndarray, count: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum(count) - count
    h = np.tanh(x @ w["we"] + w["be"])
    u, g = np.tanh(h @ w["wu"]), 1 / (1 + np.exp(-np.clip(h @ w["wg"], -30, 30)))
    e = (u * g) @ w["wa"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, cuts), count))
    a = e / np.repeat(np.add.reduceat(e, cuts), count)
    z = np.add.reduceat(h * a[:, None], cuts, axis=0)
    return {"h": h, "u": u, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["wo"] + w["bo"], -30, 30)))}


def gradients(x: np.ndarray, count: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean log loss of the documents' labels, by each weight."""
    cuts = np.cumsum(count) - count
    f = _forward(x, count, w)
    h, u, g, a, z = f["h"], f["u"], f["g"], f["a"], f["z"]
    d = ((f["p"] - y) / len(y)).astype(x.dtype)
    dz = d[:, None] * w["wo"]
    wide = np.repeat(dz, count, axis=0)
    da = (wide * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, cuts), count))
    dug = de[:, None] * w["wa"]
    du, dg = dug * g * (1 - u * u), dug * u * g * (1 - g)
    dh = (wide * a[:, None] + du @ w["wu"].T + dg @ w["wg"].T) * (1 - h * h)
    return {"we": x.T @ dh, "be": dh.sum(axis=0), "wu": h.T @ du, "wg": h.T @ dg, "wa": (u * g).T @ de, "wo": z.T @ d, "bo": d.sum()}


def fit(texts: list[bytes], y: np.ndarray, rounds: int = 400, rate: float = 0.01, penalty: float = 1e-3, seed: int = 7) -> Model:
    """Full-batch Adam on the log loss of the documents' labels; one class only gives its share for every text."""
    y = np.asarray(y, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(None, None, {}, float(y.mean()) if len(y) else 0.5)
    parts = list(passages(texts))
    x, count = np.vstack([p[2] for p in parts]).astype(np.float64), np.concatenate([p[3] for p in parts])
    mean, std = x.mean(axis=0), x.std(axis=0) + 0.05
    x = ((x - mean) / std).astype(np.float32)
    rng = np.random.default_rng(seed)
    shape = {"we": (x.shape[1], HIDDEN), "be": (HIDDEN,), "wu": (HIDDEN, ATTENTION), "wg": (HIDDEN, ATTENTION), "wa": (ATTENTION,), "wo": (HIDDEN,), "bo": ()}
    w = {k: (rng.normal(size=s) / np.sqrt(s[0]) if k[0] == "w" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    m, v = {k: np.zeros_like(q) for k, q in w.items()}, {k: np.zeros_like(q) for k, q in w.items()}
    for i in range(1, rounds + 1):
        grads = gradients(x, count, y, w)
        for k, q in grads.items():
            q = q + (penalty * w[k] if k[0] == "w" else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
    return Model(mean, std, w)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, most: int = SAMPLE) -> Model:
    sample: pd.DataFrame = labelled_sample(docs, labels, "quality", train, most)
    return fit([x.encode() for x in sample["text"]], sample["label"].to_numpy() > 0)


def score_quality(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep columns and score of every row; a null text is empty, and an empty text is one empty passage.

    Rows that repeat an id are scored each; a null id is an id like any other. ``keep``
    may hold any columns but one named score.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, x, count in passages(batch.column(len(keep)).to_pylist()):
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(model.score(x, count), pa.float64())], names=[*keep, "score"])

    return plain(docs.select(*named(keep), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))).mapInArrow(run, f"{schema}, score double")

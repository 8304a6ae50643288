"""Toxicity by a subsequence string kernel and a linear support vector machine.

The kernel counts the gapped subsequences that two strings share, each gap costing a
factor, so an insult keeps most of its weight when characters are put into it. Kernel
values to a few landmark strings, whitened (Nyström), are the features of a word. A
document is as toxic as its worst word; labels are the documents', so training
alternates between choosing each toxic document's witness and fitting the machine (a
multiple-instance machine).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .shared import named, plain

#: Labelled documents that the machine is fitted on, at most.
SAMPLE = 3000
LANDMARKS = 48
LENGTH = 4
DECAY = 0.5
REACH = 3
LONGEST = 24
BLOCK = 4096
CACHE = 100_000
#: Tokens whose features are found at once.
TOKENS = 1 << 15
SHORTEST = 3
#: Toxic documents that a landmark occurs in, at least; fewer of few: a share of them, but two.
SUPPORT = 8
SUPPORT_SHARE = 0.05
#: Documents not yet explained that a landmark of less than SUPPORT must add.
ADDED = 1.5
#: What a document that a landmark explains still counts for in the choice of further ones.
EXPLAINED = 0.3
#: Log odds from which a landmark is an example of its own.
SURE = 5.0
_INSIDE = re.compile(r"[^\w]+|_+")
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\n]{1,3}){3,}\w(?!\S)")
_CACHES: dict[str, dict[str, float]] = {}


def tokens_of(text: str) -> set[str]:
    """Distinct lower-cased tokens; letters that spaces or signs set apart are also joined."""
    low = text.lower()
    found = set(low.split())
    found.update(_INSIDE.sub("", m.group()) for m in _SPACED.finditer(low))
    return found


def windows(token: str) -> list[str]:
    """A token without the signs inside it, between marks of its ends; very long ones as overlapping windows."""
    marked = f"^{token if token.isalnum() else _INSIDE.sub('', token)}$"
    return [marked] if len(marked) <= LONGEST else [marked[i : i + LONGEST] for i in range(0, len(marked) - LONGEST // 2, LONGEST // 2)]


def codes(words: list[str]) -> np.ndarray:
    """Characters as numbers, short words filled up with zeros."""
    joined = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    n = np.array([len(x) for x in words], np.int64)
    out = np.zeros((len(words), int(n.max(initial=1))), np.int32)
    out[np.arange(out.shape[1]) < n[:, None]] = joined
    return out


def marked_codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all tokens, each without the signs inside it and between marks of its ends, as numbers one after the other; and how many each has."""
    flat = np.frombuffer("".join(tokens).encode("utf-32-le"), np.int32)
    owner = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))
    inside = np.zeros(int(flat.max(initial=0)) + 1, bool)
    found = np.flatnonzero(np.bincount(flat, minlength=1))
    inside[found] = [not _INSIDE.match(chr(c)) for c in found.tolist()]
    kept = np.flatnonzero(inside[flat])
    flat, owner = flat[kept], owner[kept]
    size = np.bincount(owner, minlength=len(tokens)) + 2
    end = np.cumsum(size)
    out = np.empty(int(size.sum()), np.int32)
    out[end - size], out[end - 1] = ord("^"), ord("$")
    out[np.arange(len(flat)) + 2 * owner + 1] = flat
    return out, size


def kernel(s: np.ndarray, t: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Weighted number of common subsequences of ``length`` characters of the rows of s and t.

    A subsequence weighs decay to the power of the characters skipped inside it, in both
    strings. The recurrence runs along the characters, all pairs of rows at once.
    """
    d, rows = np.float32(decay), len(s)
    t = np.where(t == 0, -1, t)
    total = np.zeros(rows, np.float32)
    # ends[p][j]: subsequences of p characters that end before j in t, decayed up to there
    ends, fresh = (np.zeros((t.shape[1] + 1, length, rows), np.float32) for _ in range(2))
    begun, t = np.ones((t.shape[1] + 1, 1, rows), np.float32), np.ascontiguousarray(t.T)
    for i in range(s.shape[1]):
        hits = (s[:, i] == t).astype(np.float32)
        total += (hits * ends[:-1, length - 1]).sum(axis=0)
        # Where p characters can go on to p + 1: from one to two everywhere, then where p have ended; all p at once.
        more = hits[:, None] * np.concatenate([begun, ends[:, 1:-1]], axis=1)[:-1]
        run = np.zeros((length - 1, rows), np.float32)
        for j in range(len(t)):
            run *= d
            run += more[j]
            fresh[j + 1, 1:] = run
        ends *= d
        ends += fresh
    return total


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    name: str = ""

    def __post_init__(self):
        if not self.landmarks:
            return
        self._codes = codes(self.landmarks)
        self._own = np.maximum(kernel(self._codes, self._codes), 1e-6)
        self._pairs = np.zeros((1 << 16, len(self.landmarks)), np.uint8)
        for i, x in enumerate(self._codes):
            x = x[x > 0]
            self._pairs[self._slot(x[:-1], x[1:]), i] = 1
        self._pairs[0] = 0
        # The landmarks that have each pair of characters, one after the other.
        slot, self._marks = np.nonzero(self._pairs)
        self._start = np.searchsorted(slot, np.arange((1 << 16) + 1))
        self._needed = np.maximum(1, np.array([(len(x) - 1) // 2 for x in self.landmarks]))

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a > 0) & (b > 0), (a * 40503 + b * 9973) & 0xFFFF, 0)

    def _near(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, landmark) with enough of the landmark's neighbouring characters at most REACH apart in the word."""
        count = np.zeros((len(s), len(self.landmarks)), np.uint8)
        for gap in range(1, min(REACH, s.shape[1] - 1) + 1):
            count += self._pairs[self._slot(s[:, :-gap], s[:, gap:])].sum(axis=1, dtype=np.uint8)
        return np.nonzero(count >= self._needed)

    def features(self, marked: list[str]) -> np.ndarray:
        """Share of each landmark's own kernel value that a string has; zero where too little of it can match."""
        out = np.zeros((len(marked), len(self.landmarks)), np.float32)
        order = np.argsort([len(x) for x in marked], kind="stable")
        for at in range(0, len(order), BLOCK):
            rows = order[at : at + BLOCK]
            s = codes([marked[i] for i in rows])
            word, mark = self._near(s)
            if len(word):
                out[rows[word], mark] = np.minimum(kernel(s[word], self._codes[mark]) / self._own[mark], 1.5)
        return out

    def token_features(self, tokens: list[str]) -> np.ndarray:
        """Features of tokens, the largest of a long one's windows."""
        return np.concatenate([self._some_features(tokens[i : i + TOKENS]) for i in range(0, len(tokens), TOKENS)] or [np.zeros((0, len(self.landmarks)), np.float32)])

    def _some_features(self, tokens: list[str]) -> np.ndarray:
        """As features() of windows(), but all tokens' characters are looked through at once, and the kernel runs along landmarks of one length at a time."""
        many = len(self.landmarks)
        chars, size = marked_codes(tokens)
        owner, first = np.repeat(np.arange(len(tokens)), size), np.cumsum(size) - size
        count = np.zeros(len(tokens) * many, np.int64)
        for gap in range(1, REACH + 1):
            slots = self._slot(chars[:-gap], chars[gap:])
            hit = np.flatnonzero(self._start[slots] < self._start[slots + 1])
            hit = hit[owner[hit] == owner[hit + gap]]
            start, n = self._start[slots[hit]], self._start[slots[hit] + 1] - self._start[slots[hit]]
            which = self._marks[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            count += np.bincount(np.repeat(owner[hit] * many, n) + which, minlength=len(count))
        word, mark = np.nonzero((count.reshape(-1, many) >= self._needed) & (size <= LONGEST)[:, None])
        out, length = np.zeros((len(tokens), many), np.float32), (self._codes > 0).sum(axis=1)
        order = np.lexsort((size[word], length[mark]))
        word, mark = word[order], mark[order]
        ends = np.searchsorted(length[mark], np.arange(1, length.max() + 2))
        for t in range(1, length.max() + 1):
            for at in range(ends[t - 1], ends[t], BLOCK):
                w, m = word[at : min(at + BLOCK, ends[t])], mark[at : min(at + BLOCK, ends[t])]
                place = np.arange(size[w].max())
                inside = place < size[w, None]
                s = np.where(inside, chars[np.where(inside, first[w, None] + place, 0)], 0)
                out[w, m] = np.minimum(kernel(s, self._codes[m, :t]) / self._own[m], 1.5)
        long = np.flatnonzero(size > LONGEST)
        if len(long):
            parts = [windows(tokens[i]) for i in long.tolist()]
            out[long] = np.maximum.reduceat(self.features([y for x in parts for y in x]), np.cumsum([0, *map(len, parts)])[:-1], axis=0)
        return out

    def margins(self, tokens: list[str]) -> np.ndarray:
        return self.token_features(tokens) @ self.weights + self.bias

    def score_texts(self, texts: list[str]) -> list[float]:
        """Probability of toxicity by the worst word. A worker remembers the tokens it has seen."""
        if self.weights is None:
            return [self.offset] * len(texts)
        if self.name not in _CACHES:
            _CACHES.clear()
        known = _CACHES.setdefault(self.name, {})
        if len(known) > CACHE:
            known.clear()
        tokens = [tokens_of(x) for x in texts]
        fresh = list(set().union(*tokens) - known.keys())
        known.update(zip(fresh, self.margins(fresh).tolist(), strict=True))
        worst = np.array([max(map(known.__getitem__, x), default=self.bias) for x in tokens])
        return (1 / (1 + np.exp(-(self.slope * worst + self.offset)))).tolist()


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int) -> dict[str, float]:
    """Strings that mark toxic documents, with their log odds; where none has support, those of single documents, by log odds alone in the end."""
    usual = max(2, min(SUPPORT, math.ceil(SUPPORT_SHARE * len(toxic))))
    for support, least in ((usual, 2.5), (2, 2.5), (1, 2.5), (1, 0.0)):
        if found := marking(toxic, clean, most, support, least):
            return found
    return {}


def marking(toxic: list[set[str]], clean: list[set[str]], most: int, support: int, least: float) -> dict[str, float]:
    """Beginnings of words, and whole words, that mark toxic documents; documents explained by earlier ones count less. With their log odds."""
    marked = [{windows(w)[0] for w in b} for b in toxic]
    a = {x: n for x, n in Counter(m for b in marked for m in b).items() if n >= support and len(x) > SHORTEST}
    longer = None
    for k in range(SHORTEST + 1, 11):
        # A beginning is frequent only if every shorter one is.
        counts = Counter(x for b in marked for x in {m[:k] for m in b if len(m) > k and (longer is None or m[: k - 1] in longer)})
        longer = {x for x, n in counts.items() if n >= support}
        a |= {x: counts[x] for x in longer}

    def strings(bag: set[str]) -> set[str]:
        return {x for m in bag for x in (m, *(m[:k] for k in range(SHORTEST + 1, 11))) if x in a}

    b = Counter(x for bag in clean for x in strings({windows(w)[0] for w in bag}))
    odds = {x: np.log((a[x] / len(toxic)) / ((b[x] + 0.5) / len(clean))) for x in a}
    good = {x for x, o in odds.items() if o > least}
    where = {x: set() for x in good}
    for i, g in enumerate(map(strings, marked)):
        for x in g & good:
            where[x].add(i)
    chosen, weight = [], np.ones(len(toxic))
    held = {x: np.fromiter(v, np.int64, len(v)) for x, v in where.items()}
    while held and len(chosen) < most:
        best = max(held, key=lambda x: (weight[held[x]].sum() * odds[x], len(x), x))
        if chosen and support < SUPPORT and weight[held[best]].sum() < min(ADDED, support):
            del held[best]
            continue
        chosen.append(best)
        weight[held.pop(best)] *= EXPLAINED
        held = {x: v for x, v in held.items() if not (x.startswith(best) or best.startswith(x))}
    return {x: odds[x] for x in chosen}


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 600, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weighted hinge loss with an L2 penalty, by full-batch Adam."""
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    weight = weight / weight.sum()
    for i in range(1, rounds + 1):
        inside = y * (x @ w) < 1
        g = penalty * w - (weight * y * inside) @ x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return w[:-1], float(w[-1])


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on smoothed labels (Platt)."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    weight = weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        q, g = weight * (p * (1 - p) + 1e-6), weight * (p - target)
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(g * margin).sum(), g.sum()]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def fit(sample: pd.DataFrame, landmarks: int = LANDMARKS, rounds: int = 3) -> Model:
    """A model from (text, label) rows, perhaps with weights; with one class only, or toxic texts without a word that is rarer in clean ones, every score is the toxic share."""
    one: dict[str, str] = {}
    bags = [{one.setdefault(w, w) for w in tokens_of(x)} for x in sample["text"]]
    y = sample["label"].to_numpy() > 0 if len(sample) else np.zeros(0, bool)
    weight = sample["weight"].to_numpy(float) if "weight" in sample else np.ones(len(y))
    toxic, clean = [b for b, k in zip(bags, y, strict=True) if k], [b for b, k in zip(bags, y, strict=True) if not k]
    odds = choose_landmarks(toxic, clean, landmarks) if toxic and clean else {}
    found = list(odds)
    if not found:
        return Model(offset=float(np.average(y, weights=weight)) if len(y) else 0.0)
    model = Model(found)
    gram = model.features(found).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    # Most words match no landmark by a tenth; all of those are row 0, a vector of zeros, while fitting.
    words = list(one)
    some, rows = np.zeros(len(words), bool), [np.zeros((1, len(found)), np.float32)]
    for lo in range(0, len(words), 1 << 14):
        part = model.token_features(words[lo : lo + (1 << 14)])
        hit = part.max(axis=1) > 0.1
        some[lo : lo + len(hit)] = hit
        rows.append(part[hit])
    raw = np.concatenate(rows)
    at = dict(zip(words, np.where(some, np.cumsum(some), 0).tolist(), strict=True))
    inside = [np.unique(np.fromiter((at[w] for w in b), np.int64, len(b))) for b in bags]
    x = raw @ whiten.astype(np.float32)
    marks = (gram @ whiten).astype(np.float32)[np.array([odds[m] for m in found]) > SURE]
    bad = np.unique(np.concatenate([b for b, k in zip(inside, y, strict=True) if not k]))
    bad = bad[raw[bad].max(axis=1) > 0]
    lift = raw.max(axis=1)
    for _ in range(rounds):
        best = [b[np.argmax(lift[b])] for b, k in zip(inside, y, strict=True) if k and len(b)]
        best = [i for i in best if raw[i].max() > 0.3]
        # A sure landmark may never be a witness beside stronger ones, so those are examples too.
        feats = np.vstack([x[best], marks, x[bad], np.zeros((1, x.shape[1]))])
        sign = np.concatenate([np.ones(len(best) + len(marks)), -np.ones(len(bad) + 1)])
        share = np.concatenate([np.full(len(best), 0.35 / max(1, len(best))), np.full(len(marks), 0.15 / max(1, len(marks))), np.full(len(bad) + 1, 0.5 / (len(bad) + 1))])
        w, model.bias = fit_machine(feats, sign, share)
        lift = x @ w + model.bias
    model.weights = (whiten @ w).astype(np.float32)
    model.name = "|".join(found) + w.tobytes().hex()[:32]
    worst = np.array([lift[b].max() if len(b) else model.bias for b in inside])
    model.slope, model.offset = fit_sigmoid(worst, y.astype(float), weight)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, most: int = SAMPLE) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", train, most, by_class=True))


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """keep columns and the score, as ``name``, of every row; null and empty texts score as texts without words.

    Rows that repeat an id are scored each; a null id is an id like any other. ``keep``
    may hold any columns but one called ``name``.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = model.score_texts(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(scores, pa.float64())], names=[*keep, name])
        pa.default_memory_pool().release_unused()

    return plain(docs.select(*named(keep), F.coalesce("text", F.lit("")).alias("_text"))).mapInArrow(run, f"{schema}, `{name}` double")

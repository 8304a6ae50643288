"""Token counts of whole texts by any of the three public tokenizer libraries.

Texts are cut where no token can reach across, equal pieces of a batch are encoded
once, and the batches handed to the library hold about the same number of bytes.
Only lengths leave the Arrow function.
"""

from __future__ import annotations

import functools
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import named, plain

BATCH_BYTES = 1 << 20
CACHE_ENTRIES = 250_000
_WIDE = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_COUNTS: dict[str, dict[str, int]] = {}


@functools.cache
def counter(path: str):
    """A function from texts to token counts, for a .json, .model or .tiktoken file."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    import public_tokenizers

    from .bpe import encoding

    own = encoding(path, public_tokenizers.PATTERN)
    return lambda texts: [len(own.encode_ordinary(x)) for x in texts]


def splits_at_spaces(path: str) -> bool:
    """Whether the file's pre-tokeniser always starts a token at a single space between two other characters.

    True for byte-level BPE without a leading-space rule of its own. Others are encoded whole.
    """
    if path.endswith(".tiktoken"):
        return True
    if not path.endswith(".json"):
        return False
    import json

    with open(path) as f:
        spec = json.load(f)
    level = spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and level.get("use_regex", True)
    return bool(plain and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])))


def safe_pieces(text: str) -> list[str]:
    """Cut before each single space that stands between two characters other than white space."""
    parts = _SAFE.split(text) if _WIDE.search(text) else text.split(" ")
    if len(parts) > 1 and not _WIDE.search(text) and (parts[0] == "" or parts[-1] == ""):
        parts = _SAFE.split(text)  # a space at an end of the text
    return [parts[0], *[" " + x for x in parts[1:]]] if parts[0] or len(parts) > 1 else []


def batches_by_bytes(texts: list[str], most: int) -> Iterator[list[str]]:
    batch, size = [], 0
    for x in texts:
        batch.append(x)
        size += len(x) if x.isascii() else len(x.encode())
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def count_texts(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Tokens of each text; equal pieces are encoded once and remembered by the worker up to CACHE_ENTRIES."""
    count = counter(path)
    if not splits_at_spaces(path):
        return [n for batch in batches_by_bytes(texts, batch_bytes) for n in count(batch)]
    known = _COUNTS.setdefault(path, {})
    pieces = [safe_pieces(x) for x in texts]
    seen = Counter()
    for x in pieces:
        seen.update(x)
    if len(known) > CACHE_ENTRIES:
        known.clear()
    for batch in batches_by_bytes([x for x in seen if x not in known], batch_bytes):
        known.update(zip(batch, count(batch), strict=True))
    return [sum(map(known.__getitem__, x)) for x in pieces]


def token_counts(docs: DataFrame, path: str, keep: list[str], text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """keep columns, n_bytes and n_tokens of column ``text``; a null text is empty and has 0 of both.

    Rows that repeat are counted each, whatever their id or none. ``keep`` may hold any
    columns but those two.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, widths, at = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 4 * batch_bytes:
                    size += widths[end]
                    end += 1
                counts = count_texts(texts[at:end], path, batch_bytes)
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), part.column(len(keep) + 1), pa.array(counts, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])
                at = end

    whole = F.coalesce(F.col(text), F.lit(""))
    return plain(docs.select(*named(keep), whole.alias("_text"), F.octet_length(whole).cast("bigint").alias("_bytes"))).mapInArrow(run, f"{schema}{', ' if keep else ''}n_bytes bigint, n_tokens bigint")

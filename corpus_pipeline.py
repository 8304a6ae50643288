"""A corpus pipeline in five stages, each written as Parquet and read again as the next one's input.

Toxic documents go, then all but one of equal texts, then all but one of each group
of near copies; sources are mixed to their target weights and the mix is encoded.
The two deduplication stages decide by doc_id and text together, so an id that stands
for two texts doesn't take one away with the other; rows that repeat both share one
decision. Every stage takes a table without rows and null texts, which are empty texts:
not toxic, equal to each other, near nothing, without words to mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permuta.llm import bpe, exact, jaccard, mixing, queries, toxicity
from permuta.llm.shared import materialize, named

#: No SQL: two stages learn or search in ways SQL can't express. tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels outside the held-out fold, doesn't call toxic."""
    model = toxicity.fit_toxicity(docs, queries.table(spark, sf_dir, "labels"), ~queries.held_out(F.col("doc_id"), 5, 0))
    return toxicity.score_toxicity(docs, model, docs.columns, "_toxicity").where("_toxicity < 0.5").select(*named(docs.columns))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the rows whose id and text hash are in dropped (doc_id, th); a null id is an id here."""
    gone = dropped.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_th"]), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id; a null id only where no other has the text."""
    return without(docs, exact.exact_dedup(docs, queries.older_half(docs), text_hash=True).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one with the smallest doc_id; a row without an id links with nothing and stays."""
    return without(docs, jaccard.near_copies(docs).where("not stays"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them; n_chars is that of the text taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its token counts and digests of ids and decoded bytes, without the texts."""
    import public_tokenizers

    keep = [c for c in docs.columns if c != "text"]
    return bpe.encode_texts(docs, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("source mixing", mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

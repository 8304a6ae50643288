"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, record

#: Links that one task joins at once.
CHUNK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id reachable) of some links, by hooking larger roots to smaller ones and pointer jumping."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        one, two = label[x], label[y]
        apart = one != two
        if not apart.any():
            return ids, ids[label]
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (label[label] != label).any():
            label = label[label]


def forests(edges: DataFrame, chunks: int) -> DataFrame:
    """Links (a, b) dealt into chunks -> links of each chunk's ids to its roots, a > b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.append(a, batch.column(0).to_numpy()), np.append(b, batch.column(1).to_numpy())
            if len(a) >= CHUNK:
                ids, root = roots(a, b)
                a, b = ids[ids != root], root[ids != root]
                if len(a) >= CHUNK // 2:
                    yield record(schema, a, b)
                    a, b = a[:0], b[:0]
        ids, root = roots(a, b)
        yield record(schema, ids[ids != root], root[ids != root])

    return edges.repartition(chunks).mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (id, component) of every id that has a link; component is the smallest id reachable.

    Chunks of links are first joined on their own; with one chunk that is the answer.
    Else two steps alternate until nothing changes: every vertex's larger neighbours are
    linked to its smallest neighbour, then its smaller ones are. Each step is one
    aggregate and one join on the vertex; a vertex with very many links is one key of a
    join, which Spark splits, and never gathers them in a list.
    """
    edges = links.where("a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    edges = materialize(edges, "components")
    chunks = max(1, -(-edges.count() // CHUNK))
    edges = materialize(forests(edges, chunks), "components")
    for _ in range(most_rounds if chunks > 1 else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-min")
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(large.where("a <> b").distinct(), "components")
        smallest = materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "components-min")
        # Finished when every vertex has one link and none leads to a vertex that has one itself.
        if smallest.where("n > 1").isEmpty() and edges.join(smallest.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        small = edges.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "components")
    else:
        if chunks > 1:
            raise RuntimeError("components did not settle")
    own = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(own)

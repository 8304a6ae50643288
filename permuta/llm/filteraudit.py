"""Interaction audit of a corpus's filters: what each one removes, alone and after the others.

Every document becomes a mask of the filters it fails, and documents are counted by part
and mask: with five filters a part has at most 32 cells, however many documents it
holds. A walk over all subsets of filters in Gray-code order toggles one filter a step;
each cell counts how many active filters it fails, and its documents join or leave the
survivors when that count leaves or reaches zero. The survivors of all subsets are
stored, and every order's steps are differences of two of them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

GAPS = "[\\x20\\x09-\\x0D]+"
#: Subsets double and orders multiply with each filter.
MOST_FILTERS = 8


def few_words(words: Column, text: Column) -> Column:
    return F.size(words) < 100


def repeated_words(words: Column, text: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def many_capitals(words: Column, text: Column) -> Column:
    capitals = F.length(text) - F.length(F.translate(text, "".join(map(chr, range(65, 91))), ""))
    return 100 * capitals.cast("bigint") > 10 * F.length(text)


def odd_signs(words: Column, text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Conditions under which a document fails, on its words and its text.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": repeated_words, "C": many_capitals, "D": odd_signs}
#: The filter of documents whose text an earlier document has.
COPIES = "E"


def failures(docs: DataFrame, part: str = "lang", filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, text: str = "text") -> DataFrame:
    """doc_id, part, mask and digest of every row: bit i of the mask is set where filter i fails.

    A null text is empty, a null part the empty string. All columns are made in one pass
    over the text, inside Spark's own expressions.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, GAPS), lambda w: w != "")
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("whole"), words.alias("words"))
    mask = sum((F.when(fails(F.col("words"), F.col("whole")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("whole", 256)).alias("digest"))


def with_copies(failed: DataFrame, bit: int) -> DataFrame:
    """failed (doc_id, digest, mask, ..) with ``bit`` set where a smaller doc_id has the same text.

    The smallest id of each text is one aggregate; a row keeps the bit off only where it
    has that id, so rows meet their text's smallest id by id and digest together and a
    text with very many copies is no key of the join. A null id has nothing smaller.
    """
    first = failed.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    joined = failed.join(first, ["doc_id", "digest"], "left")
    later = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return joined.withColumn("mask", (F.col("mask") + F.when(later, 1 << bit).otherwise(0)).cast("int")).drop("_first")


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask -> docs, good (labels.quality is 1) and toxic (labels.toxic is 1). Of several labels of a document the largest count."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = failed.select("doc_id", "part", "mask").join(known, "doc_id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return joined.groupBy("part", "mask").agg(F.count("*").alias("docs"), count("good"), count("toxic"))


def gray_walk(masks: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Survivors of every subset of n filters, (2**n, columns of counts), by toggling one filter a step."""
    fails = (masks[:, None] >> np.arange(n)) & 1 > 0
    states = np.zeros((1 << n, counts.shape[1]), np.int64)
    active, subset = np.zeros(len(masks), np.int64), 0
    alive = counts.sum(axis=0)
    states[0] = alive
    for i in range(1, 1 << n):
        k = (i & -i).bit_length() - 1  # the bit in which the Gray codes of i - 1 and i differ
        subset ^= 1 << k
        hit = fails[:, k]
        if subset >> k & 1:
            alive = alive - counts[hit & (active == 0)].sum(axis=0)
            active[hit] += 1
        else:
            active[hit] -= 1
            alive = alive + counts[hit & (active == 0)].sum(axis=0)
        states[subset] = alive
    return states


STEPS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def order_steps(states: np.ndarray, names: str) -> pd.DataFrame:
    """A row for every order of the filters and every step of it, all from the survivors of subsets."""
    n, everything = len(names), (1 << len(names)) - 1
    docs = states[:, 0]
    fails = [int(docs[0] - docs[1 << i]) for i in range(n)]
    alone = [int(docs[everything ^ 1 << i] - docs[everything]) for i in range(n)]
    rows, shapley = [], [0] * n
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            removed, good, toxic = (int(x) for x in states[before] - states[before | 1 << i])
            before |= 1 << i
            shapley[i] += removed
            rows.append(("".join(names[k] for k in order), step, int(docs[before]), removed, fails[i] - removed, alone[i], good, toxic, i))
    out = pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "i"])
    out["shapley"] = [shapley[i] for i in out.pop("i")]
    return out


def audit_cells(found: DataFrame, names: str) -> DataFrame:
    """Cells (part, mask, docs, good, toxic) -> the steps of every order in every part. A part is one group of at most 2**n cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        states = gray_walk(pdf["mask"].to_numpy(), pdf[["docs", "good", "toxic"]].to_numpy(np.int64), len(names))
        return order_steps(states, names).assign(part=pdf["part"].iloc[0])[[x.split()[0] for x in STEPS.split(", ")]]

    return found.groupBy("part").applyInPandas(run, STEPS)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, copies: str | None = COPIES, text: str = "text") -> DataFrame:
    """One row per part of docs (doc_id, text, part), order of the filters and step of it: the columns of STEPS.

    Documents of a part are counted as they stand in the table: rows that repeat an id are
    counted each, and with ``copies`` a further filter of that name fails where any smaller
    doc_id of the whole table has the identical text. Null texts are empty, null parts the
    empty string's, a null doc_id has no smaller one and no labels; other columns aren't
    read. A table without rows has no parts and gives none. Rows of labels without a
    doc_id, or of documents that aren't there, count nothing.
    """
    names = "".join(filters) + (copies or "")
    if len(set(names)) != len(filters) + bool(copies):
        raise ValueError("each filter needs a name of one letter of its own")
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    failed = materialize(failures(docs, part, filters, text), "audit-failures")
    if copies:
        failed = with_copies(failed, len(filters))
    return audit_cells(materialize(cells(failed, labels), "audit-cells"), names)


def audit_sql() -> str:
    """The same by brute force: every order's every step summed over the cells."""
    letters = FILTERS.keys() | {COPIES}
    listed = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(sorted(letters)))
    upper = "".join(map(chr, range(65, 91)))
    return f"""
with t as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by t) as least from t),
m as (select doc_id, part, (case when len(ws) < 100 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end
      + case when 100 * (length(t) - length(translate(t, '{upper}', ''))) > 10 * length(t) then 4 else 0 end
      + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end + case when least < doc_id then 16 else 0 end)::int as mask from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as docs, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by all),
f(x, b) as (values {listed}),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from f a, f b, f c, f d, f e
      where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step::int as step, bits[step]::int as bit, list_sum(bits[1:step - 1])::int as prior from o, range(1, 6) r(step)),
n as (select part, filter_order, step, bit, sum(case when mask & (coalesce(prior, 0) | bit) = 0 then docs else 0 end)::bigint as kept,
      sum(case when mask & coalesce(prior, 0) = 0 and mask & bit <> 0 then docs else 0 end)::bigint as removed,
      sum(case when mask & coalesce(prior, 0) <> 0 and mask & bit <> 0 then docs else 0 end)::bigint as redundant,
      sum(case when mask = bit then docs else 0 end)::bigint as unique_fails,
      sum(case when mask & coalesce(prior, 0) = 0 and mask & bit <> 0 then good else 0 end)::bigint as good_lost,
      sum(case when mask & coalesce(prior, 0) = 0 and mask & bit <> 0 then toxic else 0 end)::bigint as toxic_lost
      from s, c group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from n
"""

"""Rankings, features, ballots and result logs derived from the given tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permuta.sources.tables import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LETTERS = [chr(c) for c in [*range(0x61, 0x7B), *range(0xE0, 0x100)]]
ITEMS = 24
DIMS = 64
LANGS = ("de", "en", "es", "fr")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def uniform_sql(key: str) -> str:
    """hash_uniform as DuckDB SQL; key is a SQL text expression of seed:key."""
    return f"(('0x' || substr(md5({key}), 1, 8))::bigint / 4294967296.0::double)"


def normal_sql(seed: str, key: str) -> str:
    a, b = uniform_sql(f"'{seed}a:' || {key}"), uniform_sql(f"'{seed}b:' || {key}")
    return f"round(sqrt(-2 * ln(1 - {a})) * cos(2 * pi() * {b}), 9)"


def letters_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lang, counts): how often each of the 24 most frequent letters occurs in a document, letters in order of the alphabet.

    One pass counts all letters, in Arrow batches; the totals are those of the counts written.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    counted = materialize(docs.mapInArrow(count_letters, "id bigint, lang string, n array<int>"), "letters")
    totals = counted.agg(*[F.sum(F.col("n")[i]).alias(c) for i, c in enumerate(LETTERS)]).first().asDict()
    top = sorted(sorted((c for c in LETTERS if totals[c]), key=lambda c: (-totals[c], c.encode()))[:ITEMS], key=str.encode)
    counts = [F.struct(F.lit(c).alias("item"), F.col("n")[LETTERS.index(c)].alias("n")) for c in top]
    return counted.select("id", "lang", F.array(*counts).alias("counts"))


def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, text) -> the text's count of every letter of LETTERS."""
    place = np.full(0x100, len(LETTERS))
    place[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    for batch in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
        counts = []
        for text in batch.column(2).to_pylist():
            found = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            counts.append(np.bincount(place[found[found < 0x100]], minlength=len(LETTERS) + 1)[:-1].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.list_(pa.int32()))], names=["id", "lang", "n"])


def letter_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letter_orders(letters_wide(spark, sf_dir))


def letter_orders(wide: DataFrame) -> DataFrame:
    """(id, lang, item, pos): letters of every document by count, ties by letter."""
    ordered = F.array_sort(F.transform("counts", lambda s: F.struct((-s["n"]).alias("n"), s["item"].alias("item"))))
    return wide.select("id", "lang", F.posexplode(ordered).alias("pos", "s")).select("id", "lang", F.col("s.item").alias("item"), "pos")


LETTERS_SQL = """
ch as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]')) as item from documents),
top as (select item from ch group by item order by count(*) desc, item limit 24),
cnt as (select doc_id, item, count(*) as n from ch group by doc_id, item),
lr as (select d.doc_id as id, d.lang, t.item, (row_number() over (partition by d.doc_id order by coalesce(n, 0) desc, t.item) - 1)::int as pos
       from documents d cross join top t left join cnt c on c.doc_id = d.doc_id and c.item = t.item)"""


def letter_places() -> Column:
    """Positions of the letters of letters_wide, in order of the alphabet."""
    order = F.array_sort(F.transform("counts", lambda s, i: F.struct((-s["n"]).alias("n"), s["item"].alias("item"), i.alias("i"))))
    return F.transform(F.array_sort(F.transform(order, lambda s, p: F.struct(s["i"].alias("i"), p.alias("p")))), lambda s: s["p"])


def letter_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, label): positions of the letters, in order of the alphabet, and the language's number."""
    label = F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")).cast("int") - 1
    return letters_wide(spark, sf_dir).select("id", letter_places().alias("v"), label.alias("label")).where("label >= 0")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x array<double>, label): the vectors, of DIMS components."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("id", "label", F.posexplode("x").alias("feature", "x"))


WIDE_SQL = "w as (select vec_id as id, embedding::double[] as x, label from embeddings)"
FEATURES_SQL = f"f as (select vec_id as id, label, (i - 1)::int as feature, embedding[i]::double as x from embeddings, range(1, {DIMS + 1}) r(i))"
SCALER_SQL = f"{FEATURES_SQL}, sc as (select feature, avg(x) as mean, stddev_pop(x) as std from f where id % 5 <> 0 group by feature)"
Z_SQL = f"{SCALER_SQL}, z as (select id, label, feature, round(case when std > 1e-12 then (x - mean) / std else 0 end, 9) as x from f join sc using (feature))"


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, items, spent): each customer's part types, numbered from 1, by what was spent on them."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    types = part.select("p_type").distinct().withColumn("item", F.row_number().over(Window.orderBy("p_type")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    spent = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    spent = spent.groupBy("o_custkey", "p_type").agg(F.round(F.sum("v"), 2).alias("v")).join(types, "p_type")
    order = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "item")))
    wide = spent.groupBy(F.col("o_custkey").alias("id")).agg(F.transform(order, lambda s: s["item"]).alias("items"), F.round(F.sum("v"), 1).alias("spent"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return wide.join(customers, "id").select("id", "label", "items", "spent")


BALLOTS_SQL = """
ty as (select p_type, row_number() over (order by p_type)::int as item from (select distinct p_type from part)),
sp as (select o_custkey as id, item, round(sum(l_extendedprice * (1 - l_discount)), 2) as v
       from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join ty using (p_type) group by 1, 2),
b as (select sp.id, c_mktsegment as label, list(item order by v desc, item) as items, round(sum(v), 1) as spent from sp join customer on c_custkey = sp.id group by 1, 2)"""
N_TYPES = 6


def ballots_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, item, pos, weight): weight is 1."""
    return ballots(spark, sf_dir).select("id", "label", F.posexplode("items").alias("pos", "item"), F.lit(1).alias("weight"))


BALLOTS_LONG_SQL = BALLOTS_SQL + ", bl as (select id, label, unnest(items) as item, unnest(range(len(items)))::int as pos, 1 as weight from b)"


def user_ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, item, pos, n): each user's event types by count."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("item")).agg(F.count("*").alias("n"))
    return counts.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "item")) - 1)


USERS_SQL = """
ub as (select user_id as id, event_type as item, count(*) as n, (row_number() over (partition by user_id order by count(*) desc, event_type) - 1)::int as pos
       from events group by user_id, event_type)"""


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, method, n_train, level, error): the line items as if each were one run.

    The supplier's class is the dataset, the ship flag the method, the quantity's range
    the training size, and the discount the error.
    """
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat(F.lit("set"), (F.col("l_suppkey") % 7).cast("string")).alias("dataset"),
        F.concat("l_returnflag", "l_linestatus").alias("method"),
        (F.floor((F.col("l_quantity") - 1) / 10) * 100 + 100).cast("int").alias("n_train"),
        (F.col("l_linenumber") - 1).cast("int").alias("level"),
        (F.col("l_discount") * 5 + F.col("l_tax")).alias("error"),
    )


RESULTS_SQL = """
rs as (select 'set' || (l_suppkey % 7)::varchar as dataset, l_returnflag || l_linestatus as method, (floor((l_quantity - 1) / 10) * 100 + 100)::int as n_train,
       (l_linenumber - 1)::int as level, l_discount * 5 + l_tax as error from lineitem)"""

"""Sources, ranking construction, distances and consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permuta.functions import rankings as R
from permuta.operators import consensus, distance, features, sampling
from permuta.sources import io
from permuta.sources.tables import materialize, shared_path, table

from .fixtures import (
    BALLOTS_LONG_SQL,
    BALLOTS_SQL,
    DIMS,
    FEATURES_SQL,
    LETTERS_SQL,
    RESULTS_SQL,
    USERS_SQL,
    WIDE_SQL,
    ballots,
    ballots_long,
    features_long,
    letter_orders,
    letter_places,
    letter_positions,
    letter_rankings,
    letters_wide,
    query,
    uniform_sql,
    user_ballots,
)
from .fixtures import features as feature_rows


def text(column, name: str = "items"):
    """An array as comma-separated text."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(name)


# Sources and sinks


@query(f"with {BALLOTS_SQL} select array_to_string(items, ',') as items, count(*) as weight from b group by items")
def read_ballots(spark: SparkSession, d: str) -> DataFrame:
    """Ballots written as text files, one for each segment, and read again."""
    path = shared_path(spark, "ballots")
    rows = ballots(spark, d).groupBy("label", "items").agg(F.count("*").alias("n"))
    names = spark.range(6).select(F.lit(1).alias("part"), F.col("id").alias("at"), F.concat(F.lit("type "), (F.col("id") + 1).cast("string")).alias("value"))
    head = spark.createDataFrame([(0, 0, "6"), (2, 0, "summary")], "part int, at long, value string").unionByName(names)
    labels = rows.select("label").distinct()
    lines = rows.select("label", F.lit(3).alias("part"), F.lit(0).cast("long").alias("at"), F.concat_ws(",", F.col("n").cast("string"), text(F.col("items"))).alias("value"))
    whole = lines.unionByName(labels.join(F.broadcast(head)))
    # One writer for each segment, its lines sorted: the head first, then the ballots.
    whole.repartition("label").sortWithinPartitions("label", "part", "at", "value").select("label", "value").write.partitionBy("label").text(path)
    found = io.read_ballots(spark, path + "/label=*")
    return found.groupBy("items").agg(F.sum("weight").alias("weight")).select(text(F.col("items")), "weight")


@query(f"""with {USERS_SQL}, o as (select id, list(length(item)::varchar order by pos, length(item)) as k from ub group by id)
select array_to_string(k[greatest(1, len(k) - 4):], ',') as items, count(*) as n from (select case when len(k) < 5 then list_concat(['0', '1'], k) else k end as k from o where id % 10 <> 0) q group by 1""")
def read_orders(spark: SparkSession, d: str) -> DataFrame:
    """User ballots of five types written as an order file with comments and read again."""
    path = shared_path(spark, "orders")
    rows = user_ballots(spark, d).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.length("item").alias("k")))), lambda s: s["k"].cast("string")), " ").alias("v"))
    rows.select(F.concat(F.when(F.col("id") % 10 == 0, "# ").otherwise("0 1 "), F.col("v")).alias("value")).write.text(path)
    return io.read_orders(spark, path, 5).groupBy("items").agg(F.count("*").alias("n")).select(text(F.col("items")), "n")


@query(f"with {BALLOTS_SQL} select b.id, array_to_string(items, ',') as items, case when c_nationkey < 12 then 0 else 1 end as label from b join customer on c_custkey = b.id")
def attach_attributes(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return io.attach_attributes(ballots(spark, d).select("id", text(F.col("items"))), users, "id", "c_nationkey", 12).select("id", "items", "label")


LINES_ORDER = uniform_sql("'31:' || l_orderkey::varchar || ':' || l_linenumber::varchar")
USERS_ORDER = uniform_sql("'32:' || o_orderkey::varchar")


@query(f"""with a as (select row_number() over (order by {LINES_ORDER}, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as line, [l_partkey, l_suppkey, l_quantity::int] as items from lineitem),
b as (select row_number() over (order by {USERS_ORDER}, o_orderkey) - 1 as line, case when o_custkey < 50 then 0 else 1 end as label from orders)
select line, array_to_string(items, ',') as items, label from a join b using (line)""")
def attach_by_line(spark: SparkSession, d: str) -> DataFrame:
    """Line items and orders, each shuffled into text files of their own, with comments and blank lines, and paired by the numbers of their lines."""
    one, two = shared_path(spark, "lines"), shared_path(spark, "users")
    items = table(spark, d, "lineitem").withColumn("u", R.hash_uniform(31, F.col("l_orderkey"), F.col("l_linenumber"))).orderBy("u", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    words = F.concat_ws(" ", F.lit("0 3"), *[F.col(c).cast("int").cast("string") for c in ("l_partkey", "l_suppkey", "l_quantity")])
    items.select(F.explode(F.when(F.col("l_linenumber") == 7, F.array(F.lit("# a comment"), F.lit(""), words)).otherwise(F.array(words))).alias("value")).write.text(one)
    users = table(spark, d, "orders").withColumn("u", R.hash_uniform(32, F.col("o_orderkey"))).orderBy("u", "o_orderkey")
    users.select(F.concat_ws(" ", "o_orderstatus", F.col("o_custkey").cast("string"), F.lit("x")).alias("value")).write.text(two)
    return io.attach_by_line(spark, one, two, 1, 50, 3).select("line", text(F.col("items")), "label")


@query(f"""with {FEATURES_SQL}, l as (select vec_id as id, ['b', 'a', 'c'][(label % 3 + 1)::int] as name from embeddings), c as (select id, (dense_rank() over (order by name) - 1)::int as label_code from l)
select id, feature, x, label_code from f join c using (id)""")
def load_features(spark: SparkSession, d: str) -> DataFrame:
    """Features and class names written as two CSV files with headers and read again."""
    rows, data, labels = feature_rows(spark, d), shared_path(spark, "data"), shared_path(spark, "labels")
    rows.select("id", *[F.col("x")[i].alias(f"x{i}") for i in range(DIMS)]).write.option("header", True).csv(data)
    rows.select("id", F.element_at(F.array(F.lit("b"), F.lit("a"), F.lit("c")), F.col("label") % 3 + 1).alias("name")).write.option("header", True).csv(labels)
    found = io.read_features(spark, data, labels, "id", "name")
    return found.select(F.col("id").cast("bigint").alias("id"), F.posexplode("x").alias("feature", "x"), "label_code").select("id", "feature", "x", "label_code")


@query("select c_custkey, c_mktsegment, (dense_rank() over (order by c_mktsegment) - 1)::int as code from customer")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return io.label_encode(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "c_mktsegment", "code")


@query("select p_partkey, case when p_size <= 15 then 0 when p_size <= 35 then 1 else 2 end as label from part")
def bin_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", io.bin_label(F.col("p_size"), 15, 35).alias("label"))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    from .fixtures import result_rows

    return result_rows(spark, d).groupBy("dataset", "method", "n_train").agg(F.avg("error").alias("test_error_mean"), F.count("*").alias("n_sims"))


@query(f"with {RESULTS_SQL} select dataset, method, n_train::varchar as n_train, count(*)::varchar as n_sims, null::varchar as config from rs group by dataset, method, rs.n_train")
def append_results(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "results")
    rows = materialize(_logs(spark, d), "logs")
    for low in (True, False):
        io.append_results(rows.where((F.col("n_train") < 300) == low), path)
    return spark.read.option("header", True).csv(path).select("dataset", "method", "n_train", "n_sims", "config")


@query(f"with {RESULTS_SQL}, g as (select distinct dataset, method, n_train from rs) select dataset, method, count(*) as a, count(*) as b, 2::bigint as files from g group by dataset, method")
def read_results(spark: SparkSession, d: str) -> DataFrame:
    one, two = shared_path(spark, "results"), shared_path(spark, "results")
    rows = materialize(_logs(spark, d), "logs")
    io.append_results(rows, one)
    rows.select("dataset", "method", F.col("test_error_mean").alias("error_mean")).write.option("header", True).csv(two)
    found = io.read_results(spark, [one, two])
    return found.groupBy("dataset", "method").agg(F.count("test_error_mean").alias("a"), F.count("error_mean").alias("b"), F.countDistinct(F.regexp_extract("file", "results-[0-9a-f]+", 0)).alias("files"))


# Construction and reshaping


@query(f"with {WIDE_SQL} select id, array_to_string(list_transform(list_sort(list_transform(x, lambda v, i: {{'v': v, 'i': i}})), lambda s: s.i - 1), ',') as items from w")
def argsort_encode(spark: SparkSession, d: str) -> DataFrame:
    return feature_rows(spark, d).select("id", text(R.argsort_encode(F.col("x"))))


@query(f"with {WIDE_SQL} select id, array_to_string(list_transform(list_sort(list_transform(x, lambda v, i: {{'v': -v, 'i': i}})), lambda s: s.i), ',') as items from w")
def argsort_desc(spark: SparkSession, d: str) -> DataFrame:
    return feature_rows(spark, d).select("id", text(R.argsort_desc(F.col("x"))))


@query(f"with {FEATURES_SQL} select id, feature, (row_number() over (partition by id order by x desc, feature) - 1)::int as pos from f")
def row_rank(spark: SparkSession, d: str) -> DataFrame:
    return features.row_rank(features_long(spark, d))


@query(f"with {LETTERS_SQL} select id, string_agg(item, '' order by pos) as items from lr group by id")
def ranks_to_order(spark: SparkSession, d: str) -> DataFrame:
    order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"])
    return letter_rankings(spark, d).groupBy("id").agg(F.array_join(order, "").alias("items"))


@query(f"with {FEATURES_SQL}, r as (select id, feature, (row_number() over (partition by id order by x, feature) - 1)::int as pos from f) select id, string_agg(pos::varchar, ',' order by feature) as positions from r group by id")
def invert_ranking(spark: SparkSession, d: str) -> DataFrame:
    return feature_rows(spark, d).select("id", text(R.invert(R.argsort_encode(F.col("x"))), "positions"))


@query(f"with {FEATURES_SQL} select id, feature, (rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0::double) / (count(*) over (partition by feature)) as r from f")
def column_rank(spark: SparkSession, d: str) -> DataFrame:
    return features.column_rank(features_long(spark, d).select("id", "feature", "x"))


@query(f"with {BALLOTS_SQL} select id, array_to_string(list_concat(items, list_filter(range(1, 7), lambda x: not list_contains(items, x::int))::int[]), ',') as items from b")
def complete_partial(spark: SparkSession, d: str) -> DataFrame:
    return ballots(spark, d).select("id", text(R.complete_partial(F.col("items"), 6)))


@query(f"with {USERS_SQL} select id, item, pos, count(*) as copies from (select id, item, pos, unnest(range(n)) from ub) group by id, item, pos")
def expand_weights(spark: SparkSession, d: str) -> DataFrame:
    wide = user_ballots(spark, d).select("id", "item", "pos", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return wide.groupBy("id", "item", "pos").agg(F.count("*").alias("copies"))


@query(f"with {BALLOTS_SQL} select id, array_to_string(list_transform(items, lambda x: x - 1), ',') as items from b")
def reindex(spark: SparkSession, d: str) -> DataFrame:
    return ballots(spark, d).select("id", text(R.reindex(F.col("items"))))


@query("select distinct unnest(string_split(p_name, ' ')) as token from part")
def build_vocab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()


@query("""with t as (select p_partkey, unnest(string_split(p_name, ' ')) as token from part), v as (select token, (row_number() over (order by token) - 1)::int as code from (select distinct token from t))
select p_partkey, token, code from t join v using (token)""")
def remap_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))
    return io.label_encode(rows, "token").select("p_partkey", "token", "code")


@query(f"with {BALLOTS_SQL} select id, array_to_string(case when id % 2 = 1 then list_reverse(items) else items end, ',') as items from b")
def reverse_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ballots(spark, d).select("id", text(R.reverse_ranking(F.col("items"), F.when(F.col("id") % 2 == 1, -1).otherwise(1))))


@query(f"with {BALLOTS_SQL}, p as (select a.id, a.items as a, c.items as c from b a join b c on c.id = a.id + 1) select id, array_to_string(list_concat(list_filter(a, lambda x: not list_contains(c, x)), list_filter(c, lambda x: not list_contains(a, x))), ',') as items from p")
def sym_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(ballots(spark, d).select("id", F.col("items").alias("a")), "ballots")
    other = rows.select((F.col("id") - 1).alias("id"), F.col("a").alias("c"))
    return rows.join(other, "id").select("id", text(R.symmetric_difference(F.col("a"), F.col("c"))))


@query(f"""with {BALLOTS_SQL}, m as (select id, items, v from b, range(1, 7) r(v)), o as (select id, list(v::int order by {uniform_sql("'3:' || id::varchar || ':' || v::varchar")}, v) filter (not list_contains(items, v::int)) as more from m group by id)
select b.id, array_to_string(list_concat(items, coalesce(more, []))[1:5], ',') as items from b join o using (id)""")
def complement_order(spark: SparkSession, d: str) -> DataFrame:
    return ballots(spark, d).select("id", text(R.complement_order(F.col("items"), F.sequence(F.lit(1), F.lit(6)), 3, F.col("id"), 5)))


@query(f"with {BALLOTS_SQL} select id, v::int as item, (case when list_position(items, v::int) is null or list_position(items, v::int) > 4 then 0 else list_position(items, v::int) - 1 end)::int as pos from b, range(1, 7) r(v)")
def position_index(spark: SparkSession, d: str) -> DataFrame:
    wide = ballots(spark, d).withColumn("item", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return wide.select("id", "item", R.position_of(F.col("items"), F.col("item"), 4).alias("pos"))


@query(f"with {BALLOTS_SQL} select id, array_to_string(flatten(list_transform(items, lambda x: [x::varchar || '_1', x::varchar || '_2'])), ',') as items from b")
def expand_items(spark: SparkSession, d: str) -> DataFrame:
    return ballots(spark, d).select("id", text(R.expand_items(F.col("items"), 2)))


@query(f"with {BALLOTS_SQL} select id, array_to_string(list_concat(items, list_transform(range(10), lambda x: 0))[1:8]::int[], ',') as items from b")
def pad_vector(spark: SparkSession, d: str) -> DataFrame:
    return ballots(spark, d).select("id", text(R.pad_vector(F.col("items").cast("array<double>"), 8).cast("array<int>")))


def patterns(n: int) -> dict[int, list[int]]:
    """Named orderings of the items 0 .. n-1."""
    up, half = list(range(n)), n // 2
    low, high = up[:half], up[half:]
    by_two = [x for i in range(0, n, 2) for x in reversed(up[i : i + 2])]
    fold = [x for i in range((n + 1) // 2) for x in dict.fromkeys((i, n - 1 - i))]
    return dict(enumerate([
        up, up[::-1], up[1::2] + up[::2], up[::2] + up[1::2], up[::2][::-1] + up[1::2], up[::2] + up[1::2][::-1], fold, fold[::-1], low[::-1] + high[::-1], high + low, by_two, [x for p in zip(low, high) for x in p] + high[len(low):],
    ]))


PATTERN_SQL = ", ".join(f"({k}, {i}, {p})" for k, v in patterns(DIMS).items() for p, i in enumerate(v))


@query(f"""with {FEATURES_SQL}, r as (select id, feature as item, (row_number() over (partition by id order by x, feature) - 1)::int as pos from f), pt(proto, item, p) as (values {PATTERN_SQL}),
d as (select id, proto, sum(abs(pos - p))::bigint as distance from r join pt using (item) group by id, proto), o as (select *, row_number() over (partition by id order by distance, proto) as k from d)
select id, proto::int as proto, distance from o where k = 1""")
def match_pattern(spark: SparkSession, d: str) -> DataFrame:
    bank = spark.createDataFrame([(k, i, p) for k, v in patterns(DIMS).items() for p, i in enumerate(v)], "proto int, item int, pos int")
    return distance.nearest_prototype(_feature_ranking(spark, d), bank)


def _feature_ranking(spark: SparkSession, d: str) -> DataFrame:
    order = feature_rows(spark, d).select("id", "label", F.posexplode(R.argsort_encode(F.col("x"))).alias("pos", "item"))
    return order.select("id", "label", "item", "pos")


FR_SQL = f"{FEATURES_SQL}, r as (select id, label, feature as item, (row_number() over (partition by id order by x, feature) - 1)::int as pos from f)"


@query(f"""with {WIDE_SQL} select id, round(list_sum(list_transform(x, lambda v: sign(v) * ln(1 + abs(v)))), 6) as log, round(list_sum(list_transform(x, lambda v: sign(v) * sqrt(abs(v)))), 6) as sqrt,
round(list_sum(list_transform(x, lambda v: sign(v) * v * v)), 6) as square, round(list_sum(list_transform(x, lambda v: v * 0.01)), 6) as small, round(list_sum(list_transform(x, lambda v: v * 100)), 6) as large from w""")
def signed_transform(spark: SparkSession, d: str) -> DataFrame:
    total = lambda k: F.round(F.aggregate(R.signed_transform(F.col("x"), k), F.lit(0.0), lambda a, v: a + v), 6).alias(k)
    return feature_rows(spark, d).select("id", *map(total, ("log", "sqrt", "square", "small", "large")))


# Distances and joins: each document's letters against those of the next one


def _next(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.col("id") - 1)


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(letter_rankings(spark, d), "letters")
    return rows, _next(rows)


PAIR_SQL = LETTERS_SQL + ", m as (select a.id, a.item, b.pos - a.pos as motion from lr a join lr b on b.id = a.id + 1 and b.item = a.item)"


@query(f"with {PAIR_SQL} select id, item, motion from m")
def motion(spark: SparkSession, d: str) -> DataFrame:
    return distance.motions(*_pairs(spark, d), "id")


@query(f"with {PAIR_SQL} select id, sum(abs(motion))::bigint as distance from m group by id")
def footrule(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(letter_positions(spark, d).select("id", "v"), "letters")
    other = rows.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return rows.join(other, "id").select("id", R.footrule(F.col("v"), F.col("w")).cast("bigint").alias("distance"))


@query(f"with {PAIR_SQL} select id, sqrt(sum(motion * motion)::double) as l2, count(*) filter (motion <> 0) as l0 from m group by id")
def dist_l2_l0(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("motion")
    return distance.motions(*_pairs(spark, d), "id").groupBy("id").agg(F.sqrt(F.sum(m * m).cast("double")).alias("l2"), F.count_if(m != 0).alias("l0"))


@query(f"""with {BALLOTS_LONG_SQL}, g as (select a.id, v::int as item from b a join b c on c.id = a.id + 1, range(1, 7) r(v))
select g.id, sum(abs(coalesce(x.pos, 3.0) - coalesce(y.pos, 3.0)))::double as distance from g left join bl x on x.id = g.id and x.item = g.item left join bl y on y.id = g.id + 1 and y.item = g.item group by g.id""")
def dist_missing_center(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(ballots_long(spark, d).select("id", "item", "pos"), "ballots")
    return distance.missing_center(rows, _next(rows), "id", F.lit(6)).select("id", F.col("distance").cast("double").alias("distance"))


@query(f"""with {BALLOTS_LONG_SQL} select x.id, (round_even(0.5 * sum(case when y.pos is null then 6 - x.pos else 0 end), 0) + sum(coalesce(abs(y.pos - x.pos), 0)))::bigint as distance
from bl x left join bl y on y.id = x.id + 1 and y.item = x.item where x.id + 1 in (select id from b) group by x.id""")
def dist_deletion(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(ballots_long(spark, d).select("id", "item", "pos"), "ballots")
    other = _next(rows)
    return distance.deletion_penalty(rows.join(other.select("id").distinct(), "id", "left_semi"), other, "id", F.lit(6))


@query("""with recursive t as (select user_id as id, event_type as item, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as pos from events),
p as (select a.id, a.item, list({'d': abs(b.pos - a.pos), 'a': a.pos, 'b': b.pos} order by abs(b.pos - a.pos), a.pos, b.pos) as pairs from t a join t b on b.id = a.id + 1 and b.item = a.item group by a.id, a.item),
g(id, item, one, pairs) as (select id, item, pairs[1], list_filter(pairs, lambda x: x.a <> pairs[1].a and x.b <> pairs[1].b) from p
union all select id, item, pairs[1], list_filter(pairs, lambda x: x.a <> pairs[1].a and x.b <> pairs[1].b) from g where len(pairs) > 0)
select id, item, one.a as pos, one.b - one.a as motion from g""")
def motion_repeats(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("item"), (F.row_number().over(order) - 1).alias("pos"))
    rows = materialize(rows, "events")
    return distance.with_repeats(rows, _next(rows), "id")


@query(f"with {BALLOTS_LONG_SQL}, m as (select a.id, a.item, c.pos - a.pos as motion from bl a join bl c on c.id = a.id + 1 and c.item = a.item) select id, item, round_even(motion - avg(motion) over (partition by id), 0)::int as motion from m")
def motion_centered(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(ballots_long(spark, d).select("id", "item", "pos"), "ballots")
    return distance.centered(distance.motions(rows, _next(rows), "id"), "id")


BORDA_SQL = "c as (select lang, item, (row_number() over (partition by lang order by sum(pos) / count(*)::double, item) - 1)::int as p from lr where id % 5 <> 0 group by lang, item)"
NEAR_SQL = f"{LETTERS_SQL}, {BORDA_SQL}, d as (select id, lr.lang as label, c.lang as proto, sum(abs(pos - p))::bigint as distance from lr join c using (item) where id % 5 = 0 group by 1, 2, 3)"


def _prototypes(rows: DataFrame) -> DataFrame:
    train = rows.where("id % 5 <> 0").withColumn("weight", F.lit(1))
    return consensus.consensus_borda(train, "lang").select(F.col("lang").alias("proto"), "item", "pos")


@query(f"with {NEAR_SQL}, o as (select *, row_number() over (partition by id order by distance, proto) as k from d) select id, proto, distance from o where k = 1")
def nearest_prototype(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(letter_rankings(spark, d), "letters")
    return distance.nearest_prototype(rows.where("id % 5 = 0"), _prototypes(rows))


@query(f"with {NEAR_SQL} select id, proto as item, (row_number() over (partition by id order by distance, proto) - 1)::int as pos from d")
def rank_layer(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(letter_rankings(spark, d), "letters")
    return distance.rank_layer(rows.where("id % 5 = 0"), _prototypes(rows))


@query(f"""with {LETTERS_SQL}, p as (select a.id, a.item, a.pos as x, b.pos as y from lr a join lr b on b.id = a.id + 1 and b.item = a.item)
select p.id, count(*) filter ((p.x - q.x) * (p.y - q.y) < 0) as discordant from p join p q on p.id = q.id and p.item < q.item group by p.id""")
def kendall(spark: SparkSession, d: str) -> DataFrame:
    return distance.kendall(*_pairs(spark, d), "id")


@query(f"with {NEAR_SQL}, o as (select *, row_number() over (partition by id order by distance, proto) as k from d) select id, proto as predicted, label, proto = label as correct from o where k = 1")
def align_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(letter_rankings(spark, d), "letters")
    found = distance.nearest_prototype(rows.where("id % 5 = 0"), _prototypes(rows)).select("id", F.col("proto").alias("predicted"))
    return found.join(rows.where("pos = 0").select("id", F.col("lang").alias("label")), "id").withColumn("correct", F.col("predicted") == F.col("label"))


@query(f"with {NEAR_SQL}, o as (select *, row_number() over (partition by id order by distance, proto) as k from d) select avg((proto <> label)::int) as error from o where k = 1")
def error_rate(spark: SparkSession, d: str) -> DataFrame:
    return consensus.error_rate(align_predictions(spark, d), "predicted", "label")


@query(f"with {NEAR_SQL}, o as (select *, row_number() over (partition by id order by distance, proto) as k from d) select id, label, proto as predicted, distance from o where k = 1")
def letter_language(spark: SparkSession, d: str) -> DataFrame:
    """The language of every fifth document, by the nearest consensus of the others' letter rankings."""
    wide = letters_wide(spark, d)
    rows = wide.where("id % 5 = 0").select("id", F.col("lang").alias("label"), letter_places().alias("v"))
    found = distance.nearest_in_arrays(rows, _prototypes(letter_orders(wide)), ["label"])
    return found.select("id", "label", F.col("proto").alias("predicted"), "distance")


# Consensus, votes and measures


@query(f"with {LETTERS_SQL} select lang, item, pos, count(*) as votes from lr group by lang, item, pos")
def vote_matrix(spark: SparkSession, d: str) -> DataFrame:
    return consensus.vote_matrix(letter_rankings(spark, d).withColumn("weight", F.lit(1)), "lang")


@query(f"with {BALLOTS_LONG_SQL} select label, item, (row_number() over (partition by label order by sum(pos) / count(*)::double, item) - 1)::int as pos, sum(pos) / count(*)::double as mean from bl group by label, item")
def consensus_borda(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus_borda(ballots_long(spark, d), "label")


PRIOR_SQL = "pr as (select label, v::int as item, (v - 1)::int as pos from (select distinct label from b), range(1, 7) r(v))"


def _prior(rows: DataFrame) -> DataFrame:
    return rows.select("label").distinct().withColumn("item", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("pos", F.col("item") - 1)


@query(f"""with {BALLOTS_LONG_SQL}, {PRIOR_SQL}, a as (select label, item, pos, 1 as w from bl union all select label, item, pos, 1 from pr),
n as (select label, item, sum(pos * w) as n from a group by 1, 2), e as (select label, pos, sum(w) as d from a group by 1, 2), j as (select pr.label, pr.item, pr.pos as prior, n / d::double as mean from pr join n using (label, item) join e on e.label = pr.label and e.pos = pr.pos)
select label, item, (row_number() over (partition by label order by mean, prior) - 1)::int as pos, mean from j""")
def consensus_compat(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(ballots_long(spark, d), "ballots")
    return consensus.consensus_compat(rows, _prior(rows), "label")


@query(f"""with {BALLOTS_LONG_SQL}, {PRIOR_SQL}, a as (select label, item, pos, 0.5::double as w from bl union all select label, item, pos, 1.0::double from pr)
select label, item, (row_number() over (partition by label order by sum(pos * w) / sum(w), item) - 1)::int as pos, sum(pos * w) / sum(w) as mean from a group by label, item""")
def consensus_prior(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(ballots_long(spark, d), "ballots").withColumn("weight", F.lit(0.5))
    return consensus.consensus_with_prior(rows, _prior(rows), "label")


@query("with c as (select user_id as id, event_type as label, count(*) as n from events group by 1, 2), o as (select *, row_number() over (partition by id order by n desc, label) as k from c) select id, label from o where k = 1")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return consensus.majority_vote(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label")))


@query("select user_id as id, round(avg(value), 6) as prediction from events group by user_id")
def ensemble_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.round(F.avg("value"), 6).alias("prediction"))


@query(f"with {PAIR_SQL} select id, sum(abs(motion)) / count(*)::double as displacement from m group by id")
def mean_displacement(spark: SparkSession, d: str) -> DataFrame:
    return distance.motions(*_pairs(spark, d), "id").groupBy("id").agg((F.sum(F.abs("motion")) / F.count("*")).alias("displacement"))


@query("select l_returnflag, l_linestatus, count(l_tax) as n, round(avg(l_tax), 10) as mean, round(stddev_pop(l_tax), 10) as std, min(l_tax) as least, max(l_tax) as most, round(stddev_pop(l_tax) / sqrt(count(l_tax)), 10) as stderr from lineitem group by 1, 2")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return consensus.run_stats(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_tax")


@query(f"with {LETTERS_SQL} select a.id, avg((a.pos = b.pos)::int) as agreement from lr a join lr b on b.id = a.id + 1 and b.item = a.item group by a.id")
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.rank_agreement(*_pairs(spark, d), "id")


LANG_MOTION_SQL = LETTERS_SQL + ", m as (select a.id, a.lang, a.item, b.pos - a.pos as motion from lr a join lr b on b.id = a.id + 1 and b.item = a.item)"


def _lang_motions(spark: SparkSession, d: str) -> DataFrame:
    a, b = _pairs(spark, d)
    return distance.motions(a, b, "id").join(a.where("pos = 0").select("id", "lang"), "id")


def _average_sql(expr: str) -> str:
    return f"""with {LANG_MOTION_SQL}, p as (select lang, item, {expr} as motion from m group by lang, item)
select lang, item, motion, case when max(abs(motion)) over w > 0 then motion * count(*) over w / max(abs(motion)) over w else 0 end as scaled, (row_number() over (partition by lang order by abs(motion) desc, item) - 1)::int as place from p window w as (partition by lang)"""


@query(_average_sql("sum(motion) / count(*)::double"))
def motion_average(spark: SparkSession, d: str) -> DataFrame:
    return consensus.motion_average(_lang_motions(spark, d), "lang")


@query(_average_sql("median(motion)::double"))
def motion_median(spark: SparkSession, d: str) -> DataFrame:
    return consensus.motion_average(_lang_motions(spark, d), "lang", "median")


@query(f"""with {LANG_MOTION_SQL}, q as (select lang, item, motion, row_number() over (partition by lang, item order by count(*) desc, motion) as k from m group by lang, item, motion)
select lang, item, motion::double as motion from q where k = 1""")
def motion_mode(spark: SparkSession, d: str) -> DataFrame:
    return consensus.motion_average(_lang_motions(spark, d), "lang", "mode").select("lang", "item", "motion")


@query(f"with {PAIR_SQL} select item, sum(motion) / count(*)::double as motion from m group by item")
def item_motion_mean(spark: SparkSession, d: str) -> DataFrame:
    return distance.motions(*_pairs(spark, d), "id").groupBy("item").agg((F.sum("motion") / F.count("*")).alias("motion"))


@query("select min(c_acctbal) as least, max(c_acctbal) as most from customer")
def label_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"))


@query(f"with {BALLOTS_LONG_SQL} select x.item as a, y.item as b, avg((x.pos < y.pos)::int) as share from bl x join bl y on x.id = y.id and x.item < y.item group by 1, 2")
def pairwise_preference(spark: SparkSession, d: str) -> DataFrame:
    return consensus.pairwise_preference(materialize(ballots_long(spark, d), "ballots"))


@query(f"""with {LETTERS_SQL}, t as (select id, lang, item, pos from lr where id % 5 <> 0), {BORDA_SQL}, s as (select x.lang, x.item as a, y.item as b, avg((x.pos < y.pos)::int) as share from t x join t y on x.id = y.id and x.item < y.item group by 1, 2, 3)
select s.lang, count(*) as unanimous, count(*) filter ((share = 1 and p.p > q.p) or (share = 0 and p.p < q.p)) as violations from s join c p on p.lang = s.lang and p.item = a join c q on q.lang = s.lang and q.item = b where share in (0, 1) group by s.lang""")
def pareto_check(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(letter_rankings(spark, d).where("id % 5 <> 0").withColumn("weight", F.lit(1)), "letters")
    return consensus.pareto_check(consensus.pairwise_preference(rows, group="lang"), consensus.consensus_borda(rows, "lang"), "lang")


@query(f"""with {BALLOTS_LONG_SQL}, s as (select x.label, x.item as a, y.item as b, avg((x.pos < y.pos)::int) as share from bl x join bl y on x.id = y.id and x.item < y.item group by 1, 2, 3),
c as (select label, item, (row_number() over (partition by label order by sum(pos) / count(*)::double, item) - 1)::int as pos from bl group by label, item),
k as (select s.label, a, b, share > 0.5 as prefers, p.pos < q.pos as before from s join c p on p.label = s.label and p.item = a join c q on q.label = s.label and q.item = b)
select x.label as one, y.label as two, x.a, x.b from k x join k y on x.a = y.a and x.b = y.b and x.label < y.label and x.prefers = y.prefers and x.before <> y.before""")
def iia_witness(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of segments that agree on a pair of types but whose consensus orders it differently."""
    rows = materialize(ballots_long(spark, d), "ballots")
    pos = materialize(consensus.consensus_borda(rows, "label").select("label", "item", "pos"), "consensus")
    of = lambda c: pos.select("label", F.col("item").alias(c), F.col("pos").alias(f"_{c}"))
    known = consensus.pairwise_preference(rows, group="label").join(of("a"), ["label", "a"]).join(of("b"), ["label", "b"])
    known = materialize(known.select("label", "a", "b", (F.col("share") > 0.5).alias("prefers"), (F.col("_a") < F.col("_b")).alias("before")), "preferences")
    other = known.select(F.col("label").alias("two"), "a", "b", F.col("prefers").alias("_p"), F.col("before").alias("_o"))
    both = known.join(other, ["a", "b"]).where("label < two and prefers = _p and before <> _o")
    return both.select(F.col("label").alias("one"), "two", "a", "b")


@query(f"with {FEATURES_SQL}, g as (select id, x - lag(x) over (partition by id order by x) as g from f) select id, min(g) as margin from g group by id")
def stability_margin(spark: SparkSession, d: str) -> DataFrame:
    return consensus.smallest_gap(features_long(spark, d), "id", "x")


@query(f"with {NEAR_SQL}, g as (select id, distance, distance - lag(distance) over (partition by id order by distance) as g, row_number() over (partition by id order by distance) as k from d) select id, min(g) / 2.0::double as margin, max(distance) filter (k = 2) as bound from g group by id")
def certified_margin(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(letter_rankings(spark, d), "letters")
    found = materialize(distance.prototype_distances(rows.where("id % 5 = 0"), _prototypes(rows)), "distances")
    second = found.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("distance"))).where("_k = 2").select("id", F.col("distance").alias("bound"))
    return consensus.smallest_gap(found, "id", "distance").select("id", (F.col("margin") / 2.0).alias("margin")).join(second, "id", "left")


@query("""with v as (select event_id % 500 as id, (user_id % 3 = 0)::int as wrong from events), e as (select avg(wrong) as p, count(*) / count(distinct id)::double as k from v), m as (select id, avg(wrong) > 0.5 as bad from v group by id)
select round(exp(-2 * k * (0.5 - p) * (0.5 - p)), 9) as bound, (select avg(bad::int) from m) as observed from e""")
def ensemble_bound(spark: SparkSession, d: str) -> DataFrame:
    """How often a majority of voters of known error is wrong, against the bound."""
    votes = table(spark, d, "events").select((F.col("event_id") % 500).alias("id"), (F.col("user_id") % 3 == 0).cast("int").alias("wrong"))
    one = votes.agg(F.avg("wrong").alias("p"), (F.count("*") / F.countDistinct("id")).alias("k"))
    seen = votes.groupBy("id").agg((F.avg("wrong") > 0.5).cast("int").alias("bad")).agg(F.avg("bad").alias("observed"))
    return one.join(seen).select(F.round(F.exp(-2 * F.col("k") * (0.5 - F.col("p")) * (0.5 - F.col("p"))), 9).alias("bound"), "observed")


@query(f"with {BALLOTS_SQL} select label, max(len(items))::int as candidates, count(distinct array_to_string(items, ',')) as ballots, count(*) as total from b group by label having max(len(items)) >= 3 and count(distinct array_to_string(items, ',')) >= 50 and count(*) >= 100")
def eligible_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = ballots(spark, d).select("label", text(F.col("items"), "ballot"), F.size("items").alias("width"), F.lit(1).alias("weight"))
    return sampling.eligible_groups(rows, "label")

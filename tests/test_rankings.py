"""Golden values and properties of ranking functions, distances and consensus."""

import random

from pyspark.sql import functions as F

from permuta.functions import rankings as R
from permuta.operators import consensus, distance, features, perturb, sampling
from permuta.sources.tables import materialize, small


def one(spark, column, **arrays):
    """A column evaluated on one row of integer arrays."""
    rows = spark.range(1).select(*[F.array(*[F.lit(x) for x in v]).alias(k) if v is not None else F.lit(None).cast("array<int>").alias(k) for k, v in arrays.items()])
    return rows.select(column.alias("out")).first()["out"]


def long(spark, rankings, weight=1):
    rows = [(i, "g", item, pos, weight) for i, r in enumerate(rankings) for pos, item in enumerate(r)]
    return spark.createDataFrame(rows, "id long, grp string, item string, pos int, weight int")


def test_argsort_and_ties(spark):
    assert one(spark, R.argsort_encode(F.col("v")), v=[3, 1, 2, 1]) == [1, 3, 2, 0]
    assert one(spark, R.argsort_desc(F.col("v")), v=[3, 1, 7]) == ["3", "1", "2"]
    assert one(spark, R.argsort_encode(F.col("v")), v=None) is None


def test_row_rank_largest_first(spark):
    rows = spark.createDataFrame([(1, 0, 3.1), (1, 1, 0.5), (1, 2, 7.2)], "id long, feature int, x double")
    assert [r["pos"] for r in features.row_rank(rows).orderBy("feature").collect()] == [1, 2, 0]


def test_invert_is_its_own_inverse(spark):
    rng = random.Random(1)
    for _ in range(5):
        r = rng.sample(range(7), 7)
        assert one(spark, R.invert(R.invert(F.col("v"))), v=r) == r


def test_partial_and_difference(spark):
    assert one(spark, R.complete_partial(F.col("v"), 5), v=[3, 1]) == [3, 1, 2, 4, 5]
    assert one(spark, R.symmetric_difference(F.col("a"), F.col("b")), a=[1, 1, 2, 3], b=[3, 4, 4]) == [1, 1, 2, 4, 4]
    assert one(spark, R.position_of(F.col("v"), F.lit(9)), v=[5, 9]) == 1
    assert one(spark, R.position_of(F.col("v"), F.lit(8)), v=[5, 9]) == 0


def test_footrule_bounds(spark):
    n = 7
    up, down = list(range(n)), list(range(n))[::-1]
    assert one(spark, R.footrule(F.col("a"), F.col("b")), a=up, b=down) == n * n // 2
    swapped = one(spark, R.swap_neighbours(F.col("a"), F.array(F.lit(2))), a=up)
    assert swapped == [0, 1, 3, 2, 4, 5, 6]
    assert one(spark, R.footrule(F.col("a"), F.col("b")), a=up, b=swapped) == 2


def test_kendall_and_footrule_agree(spark):
    rng = random.Random(3)
    a, b = [rng.sample("abcdef", 6) for _ in range(10)], [rng.sample("abcdef", 6) for _ in range(10)]
    left, right = long(spark, a), long(spark, b)
    k = {r["id"]: r["discordant"] for r in distance.kendall(left, right, "id").collect()}
    f = {r["id"]: r["d"] for r in distance.motions(left, right, "id").groupBy("id").agg(F.sum(F.abs("motion")).alias("d")).collect()}
    for i, (x, y) in enumerate(zip(a, b)):
        expected = sum((x.index(p) - x.index(q)) * (y.index(p) - y.index(q)) < 0 for p in "abcdef" for q in "abcdef" if p < q)
        assert k[i] == expected and expected <= f[i] <= 2 * expected


def test_borda_golden(spark):
    rows = long(spark, ["ABC", "ABC", "BCA", "CBA"])
    found = {r["item"]: (r["pos"], r["mean"]) for r in consensus.consensus_borda(rows, "grp").collect()}
    assert found == {"A": (1, 1.0), "B": (0, 0.75), "C": (2, 1.25)}


def test_borda_depends_on_context(spark):
    pos = lambda r: {x["item"]: x["mean"] for x in consensus.consensus_borda(long(spark, r), "grp").collect()}
    one_, two = pos(["abc", "bca"]), pos(["acb", "bac"])
    assert one_["a"] > one_["b"] and two["a"] < two["b"]


def test_weight_equals_copies_and_partitions_do_not_matter(spark):
    weighted = long(spark, ["ABC"], 3).unionByName(long(spark, ["CBA"], 1))
    copies = long(spark, ["ABC", "ABC", "ABC", "CBA"])
    rows = lambda d: sorted(map(tuple, consensus.consensus_borda(d, "grp").collect()))
    assert rows(weighted) == rows(copies) == rows(copies.repartition(7))


def test_votes_tie_to_lowest(spark):
    rows = spark.createDataFrame([(1, x) for x in (2, 1, 1, 2)], "id long, label int")
    assert consensus.majority_vote(rows).first()["label"] == 1


def test_population_deviation(spark):
    rows = spark.createDataFrame([(i, 0, float(i)) for i in range(4)], "id long, feature int, x double")
    assert abs(features.fit_scaler(rows).first()["std"] - 1.1180339887) < 1e-9


def test_top_fraction_keeps_one_more(spark):
    rows = spark.createDataFrame([(1, str(i), i) for i in range(10)], "id long, item string, motion int")
    assert sampling.top_fraction(rows, "id", 0.5).count() == 6


def test_transforms_keep_ranks(spark):
    rows = spark.createDataFrame([(i, [random.Random(i).uniform(-3, 3) for _ in range(6)]) for i in range(8)], "id long, x array<double>")
    for kind in ("log", "sqrt", "small", "large"):
        same = rows.select(R.argsort_encode(F.col("x")).alias("a"), R.argsort_encode(R.signed_transform(F.col("x"), kind)).alias("b"))
        assert same.where("a <> b").count() == 0


def test_augment_keeps_items(spark):
    rows = spark.createDataFrame([(i, [1, 2, 3, 4, 5]) for i in range(6)], "id long, items array<int>")
    found = perturb.augment_swaps(rows, 3, 2, 5)
    assert found.count() == 24 and found.where("array_sort(items) <> array(1, 2, 3, 4, 5)").count() == 0
    assert found.where("copy = 0 and items <> array(1, 2, 3, 4, 5)").count() == 0


def test_deletion_penalty_rounds_half_to_even(spark):
    proto, row = long(spark, ["ABCD"]), long(spark, ["A"])
    # B, C and D are deleted: 3 + 2 + 1 = 6, half of it 3
    assert distance.deletion_penalty(proto, row, "id", F.lit(4)).first()["distance"] == 3


def test_splits_cover_everything(spark):
    rows = spark.range(97).select("id", (F.col("id") % 3).alias("label"))
    found = sampling.stratified_split(rows, "label", "id", 0.2, 1)
    assert found.count() == 97
    assert {r["label"]: r["n"] for r in found.where("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 6, 1: 6, 2: 6}


def test_nearest_in_arrays_equals_the_join_by_item(spark, monkeypatch):
    rng = random.Random(5)
    items = list("abcdefg")
    places = lambda: rng.sample(range(7), 7)
    data = [(i, f"k{i}", places()) for i in range(60)] + [(3, "again", places()), (99, None, list(range(7)))]
    bank = {p: places() for p in ("p", "q", "r", None)}
    bank["z"] = bank["p"]
    rows = spark.createDataFrame(data, "id long, kept string, v array<int>").repartition(3)
    prototypes = spark.createDataFrame([(p, c, k) for p, v in bank.items() for c, k in zip(items, v)], "proto string, item string, pos int").repartition(4)
    order = sorted(bank, key=lambda p: (p is not None, p))
    far = lambda v, p: sum(abs(a - b) for a, b in zip(v, bank[p]))
    wanted = {(i, k, p := min(order, key=lambda p: far(v, p)), far(v, p)) for i, k, v in data}
    found = distance.nearest_in_arrays(rows, prototypes, ["kept"])
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert set(map(tuple, found.collect())) == wanted and found.count() == len(data)
    assert distance.nearest_in_arrays(rows, prototypes.limit(0), ["kept"]).count() == 0
    monkeypatch.setattr(distance, "MOST_PROTOTYPES", 2)
    unique = rows.where("kept <> 'again' or kept is null")
    found = distance.nearest_in_arrays(unique, prototypes, ["kept"])
    assert set(map(tuple, found.collect())) == {x for x in wanted if x[1] != "again"}


def test_joins_of_written_tables_dont_broadcast_by_file_size(spark):
    """A table's files may be a hundredth of its rows in memory; only a side named for it is broadcast."""
    rows = spark.range(200).select("id", F.lit("a").alias("lang"), F.posexplode(F.array(F.lit("x"), F.lit("y"))).alias("pos", "item"))
    a = materialize(rows, "letters")
    b = a.withColumn("id", F.col("id") - 1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = [distance.motions(a, b, "id"), distance.kendall(a, b, "id"), consensus.rank_agreement(a, b, "id"), consensus.pairwise_preference(a.where("id % 5 <> 0"), group="lang")]
    for df in joined:
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    assert "BroadcastHashJoin" in plan(a.join(small(a.where("id < 3").select("id", F.col("pos").alias("p"))), "id"))
    assert distance.motions(a, b, "id").count() == 398

"""Streamed results equal batch results."""

import datetime as dt

from pyspark.sql import functions as F

from permuta import streaming
from permuta.operators import model


def run(spark, stream, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_predict_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, [(i + k) % 4 for k in range(4)]) for i in range(20)], "id long, v array<int>")
    rows.write.parquet(str(tmp_path / "in"))
    layers = {0: model.random_layers(model.Settings(seed=1, filters=(5,)), 4, 3)}
    found = run(spark, streaming.predict_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), layers), "predicted")
    assert sorted(found.collect()) == sorted(model.predict(rows, layers).collect())


def test_windowed_consensus(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    data = [(at(m), item, pos) for m, order in ((0, "ABC"), (1, "ACB"), (20, "CBA"), (59, "A")) for pos, item in enumerate(order)]
    rows = spark.createDataFrame(data, "ts timestamp, item string, pos int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streaming.windowed_sums(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "10 minutes", "5 minutes")
    found = streaming.consensus_of(run(spark, stream, "sums", "complete"))
    first = found.where(F.col("window.start") == "2024-01-01 00:00:00").orderBy("pos").collect()
    assert [r["item"] for r in first] == ["A", "B", "C"] and first[0]["mean"] == 0.0

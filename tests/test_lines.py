"""Line numbers of files read in splits."""

import pytest
from pyspark.sql import functions as F

from permuta.sources import io, lines


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_over_many_splits_and_files(spark, tmp_path, small_splits):
    wanted = {"a.txt": [f"line {i}" + " x" * (i % 40) for i in range(300)], "b.txt": ["", "one", "", "# two", ""], "c.txt": [], "d.txt": ["é" * 500, "z"]}
    for name, rows in wanted.items():
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
    read = spark.read.text(str(tmp_path))
    assert read.rdd.getNumPartitions() > 5
    found = lines.numbered_lines(spark, str(tmp_path)).collect()
    got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in found}
    assert len(found) == len(got) and got == {(n, i): v for n, rows in wanted.items() for i, v in enumerate(rows)}
    through = {r["line"]: r["value"] for r in lines.numbered_lines(spark, str(tmp_path), across=True).collect()}
    assert [through[i] for i in range(len(through))] == [v for n in sorted(wanted) for v in wanted[n]]
    kept = {r["line"]: r["value"] for r in lines.numbered_lines(spark, str(tmp_path / "b.txt"), F.col("value") != "").collect()}
    assert kept == {0: "one", 1: "# two"}


def test_pairs_are_cut_to_the_shorter_file(spark, tmp_path, small_splits):
    (tmp_path / "o").write_text("# head\n" + "".join(f"0 3 {i} {i + 1} {i + 2}\n\n" for i in range(90)))
    (tmp_path / "u").write_text("".join(f"user {i} more\n" for i in range(70)) + "short\n")
    found = {r["line"]: (r["items"], r["label"]) for r in io.attach_by_line(spark, str(tmp_path / "o"), str(tmp_path / "u"), 1, 30, 3).collect()}
    assert found == {i: ([i, i + 1, i + 2], int(i >= 30)) for i in range(70)}


def test_ballots_are_read_in_splits(spark, tmp_path, small_splits):
    (tmp_path / "one.soi").write_text("2\n1,Ann\n2,Bob\n40,40,9\n" + "".join(f"{i},1,2\n" for i in range(1, 60)) + "bad,line\n7\n5,2,0,1\n")
    (tmp_path / "two.soi").write_text("no count\n1,1\n")
    (tmp_path / "three.soi").write_text("1\nA\n1,1,1\n3,1\n")
    found = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["weight"], r["items"]) for r in io.read_ballots(spark, str(tmp_path)).collect())
    assert found == [("one.soi", 3 + i, i, [1, 2]) for i in range(1, 60)] + [("one.soi", 65, 5, [2, 1]), ("three.soi", 3, 3, [1])]

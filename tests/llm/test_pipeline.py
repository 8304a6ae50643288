"""The pipeline's stages against brute-force versions of their decisions, each on the rows it got."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from permuta.llm import bpe
from permuta.llm.queries import tokenizer_file
from tests.llm.test_operators import docs, exact_groups, jaccard_groups, mixed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with an insult, copies and near copies, and labels for some of it."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ba", "te", "mi", "so", "ku") for b in ("ra", "len", "tu", "ko", "pi")]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 90]))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = "lumpox"
        rows.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    for i in range(240, 280):
        j = rng.randrange(240)
        text = rows[j][1]
        rows.append((i, text.upper() if i % 2 else text + " ba", "s0"))
    rows += [(300, None, "s1"), (301, "", None)]
    path = tmp_path_factory.mktemp("tables")
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder, tmp_path):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "source mixing", "byte-level BPE"]
    before, seen = frame, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, folder).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == frame.columns
        seen[name] = ([(r["doc_id"], r["text"], r["source"]) for r in before.collect()], after.collect())
        before = after
    got, kept = seen["toxicity"]
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, t, _ in got if "lumpox" not in (t or "").lower())
    got, kept = seen["exact dedup"]
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, keep, _, _, _ in exact_groups([x[:2] for x in got]) if i == keep)
    got, kept = seen["n-gram Jaccard join"]
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, _, component in jaccard_groups([x[:2] for x in got]) if i == component)
    got, kept = seen["source mixing"]
    size, target = mixed([(i, t, s) for i, t, s in got])
    texts, taken = {i: t for i, t, _ in got}, {}
    for r in kept:
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        taken.setdefault(r["source"], {}).setdefault(r["doc_id"], []).append(len(r["text"].split()))
    for source, of in taken.items():
        assert sum(map(sum, of.values())) == int(target[source] + 1e-9)
        whole = int(target[source] // size[source])
        cut = [i for i, n in of.items() if sum(n) % len(texts[i].split())]
        assert len(cut) <= 1 and all(len(n) - (i in cut) in (whole, whole + 1) for i, n in of.items()), "whole epochs, and one document cut"
    got, kept = seen["byte-level BPE"]
    enc = bpe.encoding(tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = [(i, enc.encode_ordinary(t)) for i, t, _ in got]
    wanted = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (i, x), (_, t, _) in zip(ids, got)]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in kept) == sorted(wanted)


def test_stages_on_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    """Each stage gives no rows for none, and carries columns whose names operators use inside."""
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("_key", "_range", "_row", "_size", "_cut", "size", "taken", "n", "th", "packed", "digest", "key", "stays", "_gone_th", "dotted.name"):
        frame = frame.withColumn(name, F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, frame.limit(0), folder).count() == 0
        out = stage(spark, frame, folder)
        assert set(frame.columns) - {"text"} <= set(out.columns)
        assert out.where("_key = concat('x', doc_id) and size = _key and key = _key").count() == out.where("doc_id is not null").count() > 50


def test_run_gives_what_the_stages_give(spark, folder):
    once = corpus_pipeline.run(spark, folder)
    assert once.where("n_tokens is null").count() == 0 and once.count() > 100
    assert once.select(F.countDistinct("doc_id")).first()[0] > 100


def test_an_id_of_two_texts_loses_neither_with_the_other(spark, folder):
    """A copy under an id that also has a text of its own goes alone."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(5, "alpha text"), (7, "alpha text"), (5, "a unique text"), (None, "alpha TEXT"), (None, "of no one"), (9, words), (8, words + " more"), (9, "again a text of its own"), (9, words)]
    frame = docs(spark, rows)
    kept = corpus_pipeline.drop_copies(spark, frame, folder)
    wanted = [(None, "of no one"), (5, "a unique text"), (7, "alpha text"), (8, words + " more"), (9, "again a text of its own"), (9, words), (9, words)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(wanted, key=repr)
    kept = corpus_pipeline.drop_near_copies(spark, kept, folder)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([w for w in wanted if w != (9, words)], key=repr)


def test_rows_that_differ_in_a_map_only_stay_apart_in_the_mix(spark):
    rows = [(1, "a b c", "s", {"k": 1}, "x"), (1, "a b c", "s", {"k": 2}, "x"), (2, "d e", "t", None, "y"), (2, "d e", "t", None, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>, `a.b` string")
    found = corpus_pipeline.mix(spark, frame, "").collect()
    held = {}
    for r in found:
        key = (r["doc_id"], str(r["tags"]), r["a.b"])
        held[key] = held.get(key, 0) + len(r["text"].split())
    size, target = mixed([r[:3] for r in rows])
    assert set(held) >= {(1, "{'k': 1}", "x"), (1, "{'k': 2}", "x")} and sum(held.values()) == int(target["s"]) + int(target["t"])

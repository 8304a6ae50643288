"""Saved models: versioned tables and a manifest that is written last.

A version is a folder of tables (settings, banks, views). A line of the manifest names
it with each table's number of rows and a checksum of their contents; a version without
such a line was never finished and isn't seen. Loading compares what is there with
the manifest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permuta.operators.model import Layers, Settings, positions_of

TABLES = {
    "settings": "model int, settings string",
    "banks": "kind string, model int, layer int, filter int, positions array<int>",
    "views": "model int, row int, weights array<double>",
}
MANIFEST = "version long, folder string, note string, counts map<string,long>, sums map<string,string>"


def checked(table: DataFrame) -> tuple[int, str]:
    """Number of rows, and a sum of hashes of them that doesn't depend on their order."""
    row = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], str(row["s"] or 0)


def save(spark: SparkSession, path: str, banks: dict[str, dict[int, Layers]], settings: list[Settings], note: dict | None = None) -> int:
    """Write banks by kind (such as 'best'), their models' settings, histories and views, and a note with names or a training state; the version's number."""
    folder = f"{path}/{uuid.uuid4().hex}"
    plain = [(m, json.dumps(asdict(replace(s, view=None)))) for m, s in enumerate(settings)]
    cells = [(kind, m, at, f, positions_of(x)) for kind, models in banks.items() for m, layers in models.items() for at, layer in enumerate(layers) for f, x in enumerate(layer)]
    views = [(m, i, [float(v) for v in row]) for m, s in enumerate(settings) if s.view is not None for i, row in enumerate(s.view)]
    counts, sums = {}, {}
    for (name, schema), rows in zip(TABLES.items(), (plain, cells, views), strict=True):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")
        counts[name], sums[name] = checked(spark.read.schema(schema).parquet(f"{folder}/{name}"))
    version = max((r["version"] for r in versions(spark, path)), default=0) + 1
    line = spark.createDataFrame([(version, folder, json.dumps(note or {}), counts, sums)], MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def versions(spark: SparkSession, path: str) -> list:
    """Lines of the manifest, a few numbers for each version; none where nothing was saved."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    return sorted(spark.read.schema(MANIFEST).json(f"{path}/manifest").collect(), key=lambda r: r["version"])


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[str, dict[int, Layers]], list[Settings], dict]:
    """Banks by kind, settings and the note of a version, the last one if none is named. Raises where tables aren't as they were saved."""
    found = [r for r in versions(spark, path) if version in (None, r["version"])]
    if not found:
        raise FileNotFoundError(f"no saved model at {path}" + (f" with version {version}" if version else ""))
    line = found[-1]
    tables = {}
    for name, schema in TABLES.items():
        table = spark.read.schema(schema).parquet(f"{line['folder']}/{name}")
        if checked(table) != (line["counts"][name], line["sums"][name]):
            raise ValueError(f"{name} of version {line['version']} isn't what was saved")
        tables[name] = table.collect()
    views: dict[int, list] = {}
    for r in sorted(tables["views"], key=lambda r: (r["model"], r["row"])):
        views.setdefault(r["model"], []).append(r["weights"])
    settings = []
    for r in sorted(tables["settings"], key=lambda r: r["model"]):
        given = json.loads(r["settings"])
        given |= {k: tuple(given[k]) for k in ("filters", "fields") if k in given}
        settings.append(Settings(**given | {"view": np.array(views[r["model"]]) if r["model"] in views else None}))
    banks: dict[str, dict[int, dict]] = {}
    for r in sorted(tables["banks"], key=lambda r: (r["kind"], r["model"], r["layer"], r["filter"])):
        banks.setdefault(r["kind"], {}).setdefault(r["model"], {}).setdefault(r["layer"], []).append(r["positions"])
    out = {kind: {m: [np.array(layers[at], np.float32) for at in sorted(layers)] for m, layers in models.items()} for kind, models in banks.items()}
    return out, settings, json.loads(line["note"])

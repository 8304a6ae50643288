"""The rank network: layers of prototype rankings, trained by votes.

A model is a list of layers; a layer is an array (filters x items) of positions. One
training step is a map over batches of rows, with all models' layers sent along,
that emits two additive vectors per filter, the weighted sum of positions and of
weights per item. Their sums, a table as large as the models, give the new orders.
Views, simulations and grid points are models of the same job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permuta.functions.rankings import hash_uniform
from permuta.sources.tables import materialize, shared_path

from .consensus import consensus_borda, majority_vote
from .wide import by_task, merged

Layers = list[np.ndarray]
GATE = 0.01


@dataclass
class Settings:
    """One model: its layers' sizes, seed, rate, share of filters that vote, share of the training rows it sees, and its view of a row: weights (items x dimensions, and a last row that is added) whose sums are ranked, or None for the row itself.

    It may train for fewer steps than others of its job (steps), see each row once more
    with up to ``swaps`` neighbours exchanged, leave its last layer as it is (learn_last),
    and lower its rate by 0.7 every quarter of its steps or by ``decay`` every step.
    ``fields`` names how many items the filters of a layer see, from the first layer on;
    None, or no entry, is all of them.
    """

    seed: int = 0
    filters: tuple[int, ...] = (32,)
    rate: float = 0.5
    share: float = 0.5
    rows: float = 1.0
    label: str = ""
    view: np.ndarray | None = None
    steps: int | None = None
    swaps: int = 0
    learn_last: bool = True
    decay: float | None = None
    fields: tuple[int | None, ...] = ()
    history: list[float] = field(default_factory=list)


def within(order: np.ndarray, field_: int | None) -> np.ndarray:
    """Positions of a filter; with a receptive field of so many items, NaN for all that come after them."""
    out = order.astype(np.float32)
    if field_ is not None:
        out[out >= field_] = np.nan
    return out


def random_layers(settings: Settings, items: int, classes: int) -> Layers:
    """Uniform random orders for every filter, cut to its receptive field."""
    rng = np.random.default_rng(settings.seed)
    widths = [items if settings.view is None else settings.view.shape[1], *settings.filters, classes]
    fields = [*settings.fields, *[None] * (len(widths) - 1 - len(settings.fields))]
    if any(f is not None and f < 1 for f in fields):
        raise ValueError("a receptive field has one item at least")
    return [np.stack([within(rng.permutation(a), f) for _ in range(b)]) for a, b, f in zip(widths[:-1], widths[1:], fields, strict=True)]


def init_filters(spark, items: int, filters: int, seed: int, field_: int | None = None) -> DataFrame:
    """(filter, item, pos): random orders as a table, each from hashes of filter and item; with a receptive field, the first items of each."""
    grid = spark.range(items * filters).select((F.col("id") % items).cast("int").alias("item"), F.floor(F.col("id") / items).cast("int").alias("filter"))
    order = Window.partitionBy("filter").orderBy(hash_uniform(seed, F.col("filter"), F.col("item")), "item")
    made = grid.select("filter", "item", (F.row_number().over(order) - 1).alias("pos"))
    return made if field_ is None else made.where(F.col("pos") < field_)


def init_from_data(rows: DataFrame, filters: int, seed: int) -> DataFrame:
    """(filter, id, items): training rankings as filters, those first in hash order."""
    chosen = rows.select("id", "items", hash_uniform(seed, F.col("id")).alias("_u")).orderBy("_u", "id").limit(filters)
    return chosen.select((F.row_number().over(Window.orderBy("_u", "id")) - 1).alias("filter"), "id", "items")


def init_by_frequency(frequencies: DataFrame, filters: int, length: int, seed: int) -> DataFrame:
    """(filter, item, pos): items drawn without replacement, each with chance in proportion to frequency to the power 1/4."""
    wide = frequencies.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(filters - 1))))
    draw = -F.log(1 - hash_uniform(seed, F.col("filter"), F.col("item"))) / F.pow(F.col("n"), F.lit(0.25))
    order = Window.partitionBy("filter").orderBy("_d", "item")
    return wide.withColumn("_d", draw).withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < length).select("filter", "item", "pos")


def place(values: np.ndarray) -> np.ndarray:
    """Position of each column in the ascending order of its row, ties to the lower column."""
    order = np.argsort(values, axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(values.shape[1])[None, :], axis=1)
    return out.astype(np.float32)


def seen_by(rows: np.ndarray, view: np.ndarray | None) -> np.ndarray:
    """Positions in a view: those of the projected values in ascending order. A view of one row more than there are items adds it."""
    if view is None:
        return rows
    more = view[-1] if len(view) == rows.shape[1] + 1 else 0
    return place(np.round(rows @ view[: rows.shape[1]] + more, 6))


def swapped(rows: np.ndarray, chance: np.ndarray, most: int) -> np.ndarray:
    """Rows with 1 to ``most`` pairs of neighbouring positions exchanged one after the other, where depends on each row's chance alone."""
    out, n, width = rows.copy(), *rows.shape
    many = 1 + (chance * most).astype(int) % most
    at = np.arange(n)
    for k in range(most):
        place_ = ((chance * 7919.0 * (k + 1)) % 1 * (width - 1)).astype(int)
        doing = at[many > k]
        low, high = place_[doing, None], place_[doing, None] + 1
        part = out[doing]
        out[doing] = np.where(part == low, high, np.where(part == high, low, part))
    return out


def distances(rows: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """Footrule of every row and filter, by blocks of rows; missing positions stand in the middle. Filters with a receptive field count the motions of their own items, less the mean, rounded."""
    rows = np.where(np.isnan(rows), 0.5 * rows.shape[1], rows)
    if np.isnan(layer).any():
        return field_distances(rows, layer)
    out, step = np.zeros((len(rows), len(layer)), np.result_type(rows, layer)), max(1, (1 << 16) // len(layer))
    columns = np.ascontiguousarray(layer.T)
    # Sums of positions are exact in any order: an item after the other, on as many rows as stay in cache.
    for i in range(0, len(rows), step):
        apart = np.empty_like(out[i : i + step])
        for c, filters in enumerate(columns):
            np.abs(np.subtract(rows[i : i + step, c, None], filters, out=apart), out=apart)
            out[i : i + step] += apart
    return out


def field_distances(rows: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """Sums of centred motions of every row and filter over the filter's own items; the work is that of the fields, not of all items."""
    out = np.isnan(layer)
    sizes = (~out).sum(axis=1)
    items = np.argsort(out, axis=1, kind="stable")[:, : sizes.max()]
    own, some = np.take_along_axis(layer, items, axis=1), (sizes < layer.shape[1])[None, :, None]
    step, found = max(1, (1 << 22) // items.size), np.zeros((len(rows), len(layer)), np.float32)
    for i in range(0, len(rows), step):
        motion = rows[i : i + step][:, items] - own
        centred = np.where(some, np.round(motion - np.nanmean(motion, axis=2, keepdims=True)), motion)
        found[i : i + step] = np.nansum(np.abs(centred), axis=2)
    return found


def heading(rows: np.ndarray, filters: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | bool]:
    """Of rows and a filter each: the position every item would have by the row, its motion there, and whether the filter sees it; both are 0 where it doesn't.

    A filter of all items (``whole``) takes the row's positions. One with a receptive field
    moves by the motions less their mean, rounded, but not beyond its ends: what counts is
    the order of its own items, wherever in the row they stand.
    """
    motion = rows - filters
    if whole:
        return rows, motion, True
    seen = ~np.isnan(filters)
    some = ~seen.all(axis=1, keepdims=True)
    centred = np.where(some, np.round(motion - np.nanmean(motion, axis=1, keepdims=True)), motion)
    aim = np.where(some, np.clip(filters + centred, 0, seen.sum(axis=1, keepdims=True) - 1), rows)
    return np.where(seen, aim, 0), np.where(seen, centred, 0), seen


def forward(rows: np.ndarray, layers: Layers) -> tuple[list[np.ndarray], np.ndarray]:
    """Inputs of every layer, and the distances of the last."""
    inputs = [rows]
    for layer in layers[:-1]:
        inputs.append(place(distances(inputs[-1], layer)))
    return inputs, distances(inputs[-1], layers[-1])


def add_rows(total: np.ndarray, to: np.ndarray, values: np.ndarray) -> None:
    """Add each row of values (or one column for all of total's) to the row of total that ``to`` names, in their order: np.add.at, with its rounding, by counting with weights, which is many times faster."""
    index = np.concatenate([np.arange(len(total)), to])
    sums = lambda start, more: np.bincount(index, np.concatenate([start, more]), len(total))
    if values.shape[1] == 1 and (total == total[:, :1]).all():
        total[:] = sums(total[:, 0], values[:, 0])[:, None]
        return
    for c, more in enumerate(np.broadcast_to(values, (len(to), total.shape[1])).T):
        total[:, c] = sums(total[:, c], more)


def votes(rows: np.ndarray, labels: np.ndarray, chance: np.ndarray, layers: Layers, settings: Settings, batch: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per layer (sum of weight * position, sum of weight), both filters x items.

    A row votes if it is wrong, or by chance GATE. The true class's filter takes the last
    ranking; of the hidden filters the share with the largest motions takes its input,
    reversed where it has to move away, weighted by the motion. What remains of the
    motion, averaged, goes down a layer. Items that a filter doesn't see get no votes of it
    and pass no motion down.
    """
    inputs, last = forward(rows, layers)
    out = [(np.zeros(x.shape), np.zeros(x.shape)) for x in layers]
    active = (last.argmin(axis=1) != labels) | (chance < GATE)
    inputs, labels = [np.where(np.isnan(x[active]), 0.5 * x.shape[1], x[active]) for x in inputs], labels[active]
    if not len(labels):
        return out
    w = settings.rate / batch
    wholes = [not np.isnan(x).any() for x in layers]
    num, den = out[-1]
    aim, pull, seen = heading(inputs[-1], layers[-1][labels], wholes[-1])
    add_rows(num, labels, w * aim)
    add_rows(den, labels, w * (np.ones((len(labels), 1)) if seen is True else seen))
    for i in range(len(layers) - 2, -1, -1):
        n, f = pull.shape
        k = min(f, int(settings.share * f) + 1)
        top = np.argsort(-np.abs(pull), axis=1, kind="stable")[:, :k]
        strength = np.take_along_axis(pull, top, axis=1)
        width = layers[i].shape[1]
        num, den = out[i]
        down = np.zeros((n, width))
        for j in range(k):
            s, to = strength[:, j], top[:, j]
            taken = np.where(s[:, None] < 0, width - 1 - inputs[i], inputs[i])
            weight = np.abs(s)[:, None] * 2 * w
            aim, _, seen = heading(taken, layers[i][to], wholes[i])
            add_rows(num, to, weight * aim)
            add_rows(den, to, weight * seen)
            down += np.sign(s)[:, None] * heading(inputs[i], layers[i][to], wholes[i])[1]
        most = np.abs(down).max(axis=1, keepdims=True)
        pull = np.where(most > 0, down / np.maximum(most, 1e-9) * width * 0.25, 0)
    return out


def apply_votes(layer: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """New order of every filter's items by mean position, the old order counting once; a filter goes on to see the items that it saw."""
    return np.where(np.isnan(layer), np.float32(np.nan), place((layer + num) / (1 + den)))


def train_step(rows: DataFrame, models: dict[int, tuple[Settings, Layers]], step: int, batch: float, share: float = 1.0) -> dict[int, Layers]:
    """One step of all models on rows (id, v array of positions, label): a map and sums that meet in a tree. With a share below 1 a step sees a minibatch: of rows laid out by bucket(), the buckets it reads, of others those chosen by hash."""
    if share < 1:
        rows = rows.where(F.col("bucket").isin(chosen_buckets(step, share))) if "bucket" in rows.columns else rows.where(hash_uniform(f"batch{step}", F.col("id")) < share)
    sent = rows.sparkSession.sparkContext.broadcast({m: (s, layers) for m, (s, layers) in models.items()})

    def run(parts: Iterator[pd.DataFrame]) -> dict[tuple, np.ndarray]:
        total: dict[tuple, np.ndarray] = {}
        for pdf in parts:
            x, y, u, c = np.stack(pdf["v"].to_numpy()).astype(np.float32), pdf["label"].to_numpy(), np.stack(pdf["u"].to_numpy()), pdf["c"].to_numpy()
            for k, (m, (settings, layers)) in enumerate(sent.value.items()):
                seen = u[:, k] < settings.rows
                mine, labels, chance = seen_by(x[seen], settings.view), y[seen], c[seen]
                if settings.swaps:
                    mine, labels, chance = np.concatenate([mine, swapped(mine, u[seen, k], settings.swaps)]), np.tile(labels, 2), np.tile(chance, 2)
                for at, sums in enumerate(votes(mine, labels, chance, layers, settings, batch)):
                    part = np.concatenate([z.ravel() for z in sums])
                    total[m, at] = total[m, at] + part if (m, at) in total else part
        return total

    # Seeds of equal shares see equal rows; a column for each of them.
    known = rows.select("v", "label", F.array(*[hash_uniform(f"rows{s.seed}", F.col("id")) for s, _ in models.values()]).alias("u"), hash_uniform(f"gate{step}", F.col("id")).alias("c"))
    summed = merged(by_task(known, ["v", "label", "u", "c"], run, "model int, layer int"), ["model", "layer"]).collect()
    sent.destroy()
    found = {(r["model"], r["layer"]): np.frombuffer(r["data"], np.float64) for r in summed}
    out = {}
    for m, (settings, layers) in models.items():
        out[m] = []
        for at, layer in enumerate(layers):
            both = found.get((m, at))
            fixed = both is None or (at == len(layers) - 1 and not settings.learn_last)
            out[m].append(layer if fixed else apply_votes(layer, *both.reshape(2, *layer.shape)))
    return out


#: Buckets that rows are laid out in.
BUCKETS = 32


def bucket(rows: DataFrame) -> DataFrame:
    """rows laid out on disk in BUCKETS folders by a hash of the id, so that a minibatch reads its own folders only."""
    path = shared_path(rows.sparkSession, "buckets")
    placed = rows.withColumn("bucket", F.floor(hash_uniform("bucket", F.col("id")) * BUCKETS).cast("int"))
    placed.repartitionByRange("bucket", "id").write.partitionBy("bucket").parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path)


def chosen_buckets(step: int, share: float) -> list[int]:
    """A step's buckets: steps one after the other take all buckets in an order of their own, before any comes again."""
    many = max(1, round(share * BUCKETS))
    at = step * many
    order = np.random.default_rng(at // BUCKETS).permutation(BUCKETS)
    more = np.random.default_rng(at // BUCKETS + 1).permutation(BUCKETS)
    return sorted({int(x) for x in np.concatenate([order, more])[at % BUCKETS : at % BUCKETS + many]})


def predict(rows: DataFrame, models: dict[int, Layers], keep: list[str] = (), views: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(id, keep.., model, predicted) of rows (id, v), by models with views of their own or none; stateless, so a stream will do."""
    return predictions(rows, lambda: (models, views or {}), keep)


def predictions(rows: DataFrame, held: Callable[[], tuple[dict[int, Layers], dict[int, np.ndarray]]], keep: list[str]) -> DataFrame:
    """predict() by the models and views that tasks get from ``held``."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *keep))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if pdf.empty:
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
            models, views = held()
            for m, layers in models.items():
                yield pdf[["id", *keep]].assign(model=m, predicted=forward(seen_by(x, views.get(m)), layers)[1].argmin(axis=1).astype("int32"))

    return rows.select("id", "v", *keep).mapInPandas(run, f"{schema}, model int, predicted int")


def errors(rows: DataFrame, models: dict[int, Layers], views: dict[int, np.ndarray] | None = None) -> dict[int, float]:
    # Sent by name and taken back: thousands of steps would fill the disks with models.
    sent = rows.sparkSession.sparkContext.broadcast((models, views or {}))
    found = predictions(rows, lambda: sent.value, ["label"]).groupBy("model").agg(F.avg((F.col("predicted") != F.col("label")).cast("int")).alias("e")).collect()
    sent.destroy()
    return {r["model"]: r["e"] for r in found}


def views_of(settings: list[Settings]) -> dict[int, np.ndarray]:
    return {m: s.view for m, s in enumerate(settings) if s.view is not None}


def fit(train: DataFrame, valid: DataFrame, settings: list[Settings], items: int, classes: int, steps: int = 8, batch: float = 256.0, share: float = 1.0, every: int = 1, state: str | None = None) -> dict[int, Layers]:
    """Train all models together; each keeps the layers with the strictly lowest validation error, measured ``every`` so many steps.

    A step sees all rows or a minibatch of about a ``share`` of them, read by bucket where
    train was laid out by bucket(). The rate falls by 0.7 every quarter of a model's
    steps, or by its own decay. With ``state``, a folder, every measured step is saved
    there as a version, and a later call with the same arguments goes on after the last
    one: the result is the same as without the interruption.
    """
    from permuta.sources import artefacts

    spark = train.sparkSession
    views = views_of(settings)
    saved = artefacts.versions(spark, state) if state else []
    if saved:
        banks, before, note = artefacts.load(spark, state)
        if note["plan"] != plan_of(settings, items, classes, steps, batch, share, every):
            raise ValueError(f"{state} holds the training of other settings")
        models, best = banks["now"], banks["best"]
        for s, old in zip(settings, before, strict=True):
            s.history[:] = old.history
        first, least, rates = note["step"] + 1, dict(enumerate(note["least"])), dict(enumerate(note["rates"]))
    else:
        models = {m: random_layers(s, items, classes) for m, s in enumerate(settings)}
        best, first, rates = dict(models), 0, {m: s.rate for m, s in enumerate(settings)}
        measured = errors(valid, models, views)
        least = {m: measured.get(m, 2.0) for m in models}
    for step in range(first, steps):
        live = {m: s for m, s in enumerate(settings) if step < (s.steps or steps)}
        for m, s in live.items():
            own = s.steps or steps
            if s.decay is not None:
                rates[m] *= s.decay if step else 1
            elif step > 2 and step % max(2, own // 4) == 1:
                rates[m] *= 0.7
        models = models | train_step(train, {m: (replace(s, rate=rates[m]), models[m]) for m, s in live.items()}, step, batch, share)
        if step % every != every - 1 and step < steps - 1:
            continue
        for m, e in errors(valid, {m: models[m] for m in live}, views).items():
            settings[m].history.append(e)
            if e < least[m]:
                least[m], best[m] = e, models[m]
        if state:
            note = {"plan": plan_of(settings, items, classes, steps, batch, share, every), "step": step, "least": [least[m] for m in range(len(settings))], "rates": [rates[m] for m in range(len(settings))]}
            artefacts.save(spark, state, {"now": models, "best": best}, settings, note)
    return best


def plan_of(settings: list[Settings], *numbers) -> list:
    """What a training run is determined by, to compare runs with."""
    return [[str(replace(s, view=None, history=[])) + ("" if s.view is None else str(float(np.abs(s.view).sum()))) for s in settings], list(numbers)]


def fit_grid(train: DataFrame, valid: DataFrame, grid: list[Settings], items: int, classes: int, steps: int, batch: float, group: int = 64, keep: int = 15, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), views: list[np.ndarray] | dict[int, list[np.ndarray]] = (), share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Two phases over a grid of any size: (label, error) of every setting, and of the best ``keep`` again (label, rank, first_error, error, std, runs).

    Each setting trains for its own steps, those that name none for ``steps``. Settings
    train ``group`` at a time, the shortest first, so what a task holds doesn't grow with the
    grid. The first phase trains each setting once; the second, what is left of it, once for
    every seed, and with ``views`` as an ensemble of a model for each view that votes; views
    named by their dimensions are those of the settings whose own view has as many.
    """
    spark = train.sparkSession
    grid = [replace(s, steps=s.steps or steps) for s in grid]
    rows, order = [], sorted(range(len(grid)), key=lambda i: grid[i].steps)
    for at in range(0, len(grid), group):
        some = [grid[i] for i in order[at : at + group]]
        found = errors(valid, fit(train, valid, some, items, classes, some[-1].steps, batch, share), views_of(some))
        rows += [(i, grid[i].label, found.get(m)) for m, i in enumerate(order[at : at + group])]
    first = materialize(spark.createDataFrame(rows, "setting int, label string, error double"), "grid-first")
    left = first.orderBy(F.col("error").asc_nulls_last(), "setting").limit(keep).collect()
    several = lambda s: (views.get(s.view.shape[1]) if isinstance(views, dict) else views) or [s.view]
    runs = sorted(((k, r, seed) for k, r in enumerate(left) for seed in seeds), key=lambda x: grid[x[1]["setting"]].steps)
    again = []
    for _, r, seed in runs:
        s = grid[r["setting"]]
        again += [replace(s, seed=1000 * seed + v, view=w, history=[]) for v, w in enumerate(several(s))]
    size = max(1, len(again) // max(1, len(runs)))
    if any(len(several(s)) != size for s in grid if runs):
        raise ValueError("views of all dimensions are as many")
    votes_, step = None, max(size, group // size * size)
    for at in range(0, len(again), step):
        some = again[at : at + step]
        best = fit(train, valid, some, items, classes, some[-1].steps, batch, share)
        found = predict(valid, best, ["label"], views_of(some))
        run_of = F.floor((F.col("model") + at) / size).cast("int")
        # One vote of each of a run's views; its prediction is the class with most of them.
        counted = found.groupBy("id", "label", run_of.alias("run"), "predicted").agg(F.count("*").alias("n"))
        elected = counted.groupBy("id", "label", "run").agg(F.max_by("predicted", F.struct("n", -F.col("predicted"))).alias("predicted"))
        part = elected.groupBy("run").agg(F.avg((F.col("predicted") != F.col("label")).cast("int")).alias("error"))
        part = materialize(part, "grid-runs")
        votes_ = part if votes_ is None else votes_.unionByName(part)
    names = [(i, k + 1, r["label"], r["error"]) for i, (k, r, _) in enumerate(runs)]
    named = spark.createDataFrame(names, "run int, rank int, label string, first_error double")
    second = named if votes_ is None else named.join(votes_, "run").groupBy("label", "rank", "first_error").agg(F.avg("error").alias("error"), F.stddev_pop("error").alias("std"), F.count("*").alias("runs"))
    return first.select("label", "error"), second


def positions_of(filter_: np.ndarray) -> list[int | None]:
    """A filter's positions for a table, null for items that it doesn't see."""
    return [None if np.isnan(v) else int(v) for v in filter_]


def bank_table(spark, models: dict[int, Layers]) -> DataFrame:
    """(model, layer, filter, positions) of all models, for saving."""
    rows = [(m, at, f, positions_of(x)) for m, layers in models.items() for at, layer in enumerate(layers) for f, x in enumerate(layer)]
    return spark.createDataFrame(rows, "model int, layer int, filter int, positions array<int>")


def from_table(bank: DataFrame) -> dict[int, Layers]:
    out: dict[int, Layers] = {}
    for (m, _), part in bank.toPandas().sort_values(["model", "layer", "filter"]).groupby(["model", "layer"]):
        out.setdefault(int(m), []).append(np.stack(part["positions"].to_numpy()).astype(np.float32))
    return out


def rank_stack(rows: DataFrame, layers: Layers) -> DataFrame:
    """(id, v): positions of the last layer's filters, after all layers, in one pass over Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not pdf.empty:
                inputs, last = forward(np.stack(pdf["v"].to_numpy()).astype(np.float32), layers)
                yield pd.DataFrame({"id": pdf["id"], "v": list(place(last).astype(int))})

    return rows.select("id", "v").mapInPandas(run, "id bigint, v array<int>")


def fit_prototypes(train: DataFrame, label: str) -> DataFrame:
    """One consensus ranking per class: (proto, item, pos) of long rows with label, item, pos, weight."""
    return consensus_borda(train, label).select(F.col(label).alias("proto"), "item", "pos")


def ensemble(predictions: DataFrame) -> DataFrame:
    return majority_vote(predictions, "id", "predicted")

"""Column functions on rankings.

A ranking in wide form is an array of items, best first; its positions are an array
with the position of item i at index i. Items and positions count from 0. Ties go to
the lower item. Every function gives null for a null ranking.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "argsort_desc", "argsort_encode", "central_distance", "complement_order", "complete_partial", "expand_items", "footrule", "hash_normal",
    "hash_uniform", "invert", "l0_distance", "l2_distance", "motion", "pad_vector", "position_of", "reindex", "reverse_ranking", "signed_transform", "swap_neighbours", "symmetric_difference",
]


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone, so any task computes the same one."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_normal(seed: int | str, *keys: Column) -> Column:
    """A standard normal number by Box-Muller from two hash uniforms, rounded to 9 places."""
    u, v = hash_uniform(f"{seed}a", *keys), hash_uniform(f"{seed}b", *keys)
    return F.round(F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v), 9)


def _order(values: Column) -> Column:
    pairs = F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.transform(pairs, lambda s: s["i"])


def argsort_encode(values: Column) -> Column:
    """Indices of the values in ascending order."""
    return _order(values)


def argsort_desc(values: Column) -> Column:
    """Indices in descending order, counted from 1, as text."""
    return F.transform(_order(F.transform(values, lambda x: -x)), lambda i: (i + 1).cast("string"))


def invert(ranking: Column) -> Column:
    """Items in order <-> position of each item; its own inverse."""
    return _order(ranking)


def complete_partial(ranking: Column, n: Column | int) -> Column:
    """Append the candidates 1..n that are missing, ascending."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(ranking, F.array_sort(F.array_except(F.sequence(F.lit(1), n), ranking)))


def complement_order(ranking: Column, vocabulary: Column, seed: int, key: Column, field: int | None = None) -> Column:
    """Append missing vocabulary items in hash order, optionally only the first ``field`` items."""
    missing = F.array_sort(F.transform(F.array_except(vocabulary, ranking), lambda x: F.struct(hash_uniform(seed, key, x).alias("u"), x.alias("x"))))
    whole = F.concat(ranking, F.transform(missing, lambda s: s["x"]))
    return F.slice(whole, 1, field) if field else whole


def reindex(ranking: Column) -> Column:
    """Items counted from 1 -> from 0."""
    return F.transform(ranking, lambda x: x - 1)


def reverse_ranking(ranking: Column, magnitude: Column) -> Column:
    """Reversed where the magnitude is negative."""
    return F.when(magnitude < 0, F.reverse(ranking)).otherwise(ranking)


def symmetric_difference(a: Column, b: Column) -> Column:
    """Elements of a missing in b, then those of b missing in a, in order and with repeats."""
    return F.concat(F.filter(a, lambda x: ~F.array_contains(b, x)), F.filter(b, lambda x: ~F.array_contains(a, x)))


def position_of(ranking: Column, item: Column, field: int | None = None) -> Column:
    """Position of an item, 0 where it is absent or stands behind the receptive field."""
    at = F.array_position(ranking, item).cast("int") - 1
    return F.when((at < 0) | (at >= (field if field else F.size(ranking))), 0).otherwise(at)


def expand_items(ranking: Column, times: int) -> Column:
    """Each item as item_1 .. item_times."""
    return F.flatten(F.transform(ranking, lambda x: F.transform(F.sequence(F.lit(1), F.lit(times)), lambda k: F.concat_ws("_", x.cast("string"), k.cast("string")))))


def pad_vector(values: Column, n: int) -> Column:
    """First n values, filled up with zeros."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0).cast("double"), n)), 1, n)


def signed_transform(values: Column, kind: str) -> Column:
    """Order-preserving maps of every value: log, sqrt, square, small (x 0.01), large (x 100)."""
    maps = {
        "log": lambda x: F.signum(x) * F.log1p(F.abs(x)), "sqrt": lambda x: F.signum(x) * F.sqrt(F.abs(x)), "square": lambda x: F.signum(x) * x * x,
        "small": lambda x: x * 0.01, "large": lambda x: x * 100,
    }
    return F.transform(values, maps[kind])


def motion(a: Column, b: Column) -> Column:
    """Of two position arrays: how far each item moves from a to b."""
    return F.zip_with(a, b, lambda x, y: y - x)


def footrule(a: Column, b: Column) -> Column:
    """Sum of absolute motions of two position arrays."""
    return F.aggregate(motion(a, b), F.lit(0), lambda s, m: s + F.abs(m))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(motion(a, b), F.lit(0), lambda s, m: s + m * m).cast("double"))


def l0_distance(a: Column, b: Column) -> Column:
    return F.size(F.filter(motion(a, b), lambda m: m != 0))


def central_distance(a: Column, b: Column, size: int) -> Column:
    """Footrule where a missing item (null position) stands in the middle."""
    middle = F.lit(0.5 * size)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(y.cast("double"), middle) - F.coalesce(x.cast("double"), middle))), F.lit(0.0), lambda s, m: s + m)


def swap_neighbours(ranking: Column, swaps: Column) -> Column:
    """Swap positions (p, p + 1) for each p of ``swaps``, one after the other."""
    step = lambda r, p: F.concat(F.slice(r, F.lit(1), p), F.slice(r, p + 2, F.lit(1)), F.slice(r, p + 1, F.lit(1)), F.slice(r, p + 3, F.size(r)))
    return F.aggregate(swaps, ranking, lambda r, p: step(r, p))

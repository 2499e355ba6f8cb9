"""Set similarity as column expressions over the sizes of two sets and of their intersection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(both_empty: float, one_empty: float, n_a: Column, n_b: Column, value: Column) -> Column:
    return F.when((n_a == 0) & (n_b == 0), F.lit(both_empty)).when((n_a == 0) | (n_b == 0), F.lit(one_empty)).otherwise(value)


def jaccard(n_a: Column, n_b: Column, both: Column, empty: float = 1.0) -> Column:
    """|A ∩ B| / |A ∪ B|; two empty sets give `empty`."""
    return _ratio(empty, 0.0, n_a, n_b, both / (n_a + n_b - both))


def cosine(n_a: Column, n_b: Column, both: Column) -> Column:
    return _ratio(1.0, 0.0, n_a, n_b, both / F.sqrt(n_a.cast("long") * n_b))


def overlap(n_a: Column, n_b: Column, both: Column) -> Column:
    return _ratio(1.0, 0.0, n_a, n_b, both / F.least(n_a, n_b))


def dice(n_a: Column, n_b: Column, both: Column) -> Column:
    return _ratio(1.0, 0.0, n_a, n_b, 2 * both / (n_a + n_b))


#: Metrics of the sizes of two sets and of their intersection.
METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {"jaccard": jaccard, "cosine": cosine, "overlap": overlap, "dice": dice}
#: The metric of fingerprints.
SIMHASH = "simhash"


def register_metric(name: str, metric: Callable[[Column, Column, Column], Column]) -> None:
    """Adds a metric: a column of the sizes of two sets and of their intersection."""
    METRICS[name] = metric


def of_pairs() -> dict[str, Column]:
    """Every metric over pairs that have n_a, n_b, shared and hamming."""
    n_a, n_b, shared, hamming = map(F.col, ("n_a", "n_b", "shared", "hamming"))
    return {m: f(n_a, n_b, shared) for m, f in METRICS.items()} | {SIMHASH: _ratio(1.0, 0.0, n_a, n_b, 1 - hamming / 64)}


def of_arrays(name: str, a: Column, b: Column) -> Column:
    """A metric of two arrays of distinct items."""
    return METRICS[name](F.size(a), F.size(b), F.size(F.array_intersect(a, b)))


def residual(a: Column, b: Column) -> Column:
    """What only one of two arrays holds, and how many items both do."""
    return F.struct(F.array_except(a, b).alias("only_a"), F.array_except(b, a).alias("only_b"), F.size(F.array_intersect(a, b)).alias("shared"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """1 - Hamming / 64 of two fingerprints of sets of the given sizes."""
    return _ratio(1.0, 0.0, n_a, n_b, 1 - hamming(a, b) / 64)

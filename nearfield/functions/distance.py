"""Distances between vectors: column expressions, and numpy kernels for blocks of queries against blocks of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by which a metric can be asked for. Smaller is nearer for all; inner products are negated.
METRICS = {
    "euclidean": "l2", "l2": "l2",
    "euclidean_sqr": "l2sqr", "l2_sqr": "l2sqr", "l2sqr": "l2sqr",
    "inner_product": "ip", "dot": "ip", "ip": "ip", "mips": "ip",
    "cosine": "cosine", "angular": "cosine",
}


def parse_metric(name: str) -> str:
    try:
        return METRICS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown metric: {name!r}") from None


def dot_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(metric: str, a: Column, b: Column) -> Column:
    """In double precision, summed from left to right. A zero vector's cosine distance is 1."""
    metric = parse_metric(metric)
    if metric == "ip":
        return -dot_product(a, b)
    if metric == "cosine":
        norms = dot_product(a, a) * dot_product(b, b)
        return F.when(norms > 0, 1 - dot_product(a, b) / F.sqrt(norms)).otherwise(F.lit(1.0))
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total) if metric == "l2" else total


def block_distances(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(queries, rows) distances in double precision; differences are formed directly, so that equal vectors have 0."""
    metric = parse_metric(metric)
    q, b = q.astype(np.float64), b.astype(np.float64)
    if metric in ("ip", "cosine"):
        product = q @ b.T
        if metric == "ip":
            return -product
        norms = np.outer((q * q).sum(axis=1), (b * b).sum(axis=1))
        return np.where(norms > 0, 1 - product / np.sqrt(np.where(norms > 0, norms, 1)), 1.0)
    out = np.empty((len(q), len(b)))
    for k, row in enumerate(q):
        gap = b - row
        out[k] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(out) if metric == "l2" else out

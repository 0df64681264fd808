"""Kinds of graphs with typed parameters: what builds, stores, restores and grows them.

A kind is registered with its parameters' type and two functions. Parameters are stored with a graph and come back as the type they had, so that a restored graph is
grown without repeating them. A new kind needs no more than a dataclass and ``build``; ``grow`` if it can grow.
"""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from nearfield.operators import increments, insertion, refine
from nearfield.operators.insertion import Caps, Layered
from nearfield.plans.config import NetConfig
from nearfield.sources import snapshots


class Kind(NamedTuple):
    config: type
    build: Callable
    grow: Callable | None
    layered: bool


class Index(NamedTuple):
    """A built graph: its kind and parameters, edges (src, dst, dist) or a layered graph, and the vectors."""

    kind: str
    config: object
    graph: DataFrame | Layered
    vectors: DataFrame


KINDS: dict[str, Kind] = {}


def register(kind: str, config: type, build: Callable, grow: Callable | None = None, layered: bool = False) -> None:
    """``build(vectors, config)`` gives the graph, ``grow(graph, vectors, batch, config)`` the graph and the vectors with a batch."""
    if not dataclasses.is_dataclass(config):
        raise ValueError("the parameters of a kind are a dataclass")
    KINDS[kind] = Kind(config, build, grow, layered)


def as_json(config) -> dict:
    """Parameters as plain values, parameters inside them too."""
    if dataclasses.is_dataclass(config):
        return {f.name: as_json(getattr(config, f.name)) for f in dataclasses.fields(config)}
    return {k: as_json(v) for k, v in config._asdict().items()} if hasattr(config, "_asdict") else config


def from_json(kind: type, values: dict):
    """Parameters of a type from plain values; an error if one is missing or unknown."""
    hints = typing.get_type_hints(kind)
    names = [f.name for f in dataclasses.fields(kind)] if dataclasses.is_dataclass(kind) else list(kind._fields)
    if set(values) != set(names):
        raise ValueError(f"parameters of {kind.__name__} differ: {sorted(set(values) ^ set(names))}")
    nested = lambda t: dataclasses.is_dataclass(t) or hasattr(t, "_fields")
    return kind(**{n: from_json(hints[n], values[n]) if nested(hints[n]) else values[n] for n in names})


def _kind(name: str) -> Kind:
    if name not in KINDS:
        raise ValueError(f"unknown kind of graph: {name!r}")
    return KINDS[name]


def build(kind: str, vectors: DataFrame, config) -> Index:
    about = _kind(kind)
    if not isinstance(config, about.config):
        raise ValueError(f"a {kind} graph needs {about.config.__name__}")
    vectors = vectors.select("vid", "vec")
    return Index(kind, config, about.build(vectors, config), vectors)


def grow(index: Index, batch: DataFrame) -> Index:
    """The index with a batch (vid, vec) of new ids, by the parameters it was built with."""
    about = _kind(index.kind)
    if about.grow is None:
        raise ValueError(f"a {index.kind} graph cannot grow")
    graph, vectors = about.grow(index.graph, index.vectors, batch.select("vid", "vec"), index.config)
    return index._replace(graph=graph, vectors=vectors)


def save(index: Index, path: str) -> None:
    """The graph, its vectors and its parameters; metadata come last."""
    index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    if _kind(index.kind).layered:
        g = index.graph
        caps = getattr(index.config, "caps", None)
        snapshots.save_layered(g.layers, g.levels, g.entry, path, index.kind, caps and (caps.upper, caps.bottom), config=as_json(index.config))
    else:
        snapshots.save_graph(index.graph, path, index.kind, index.vectors.count(), config=as_json(index.config))


def restore(spark: SparkSession, path: str, kind: str) -> Index:
    about = _kind(kind)
    vectors = spark.read.parquet(f"{path}/vectors")
    if about.layered:
        layers, levels, found = snapshots.load_layered(spark, path, kind)
        graph = Layered(layers, levels, vectors, found["entry"], found["top"])
    else:
        graph, found = snapshots.load_graph(spark, path, kind)
    return Index(kind, from_json(about.config, found["parameters"]["config"]), graph, vectors)


@dataclasses.dataclass(frozen=True)
class KnnGraph:
    degree: int
    loops: int = 3
    triangles: int = 2
    routing: int = 2
    seed: int = 0


@dataclasses.dataclass(frozen=True)
class Convergent:
    degree: int
    alpha: float = 1.05
    shift: float = 0.0
    loops: int = 2
    triangles: int = 2
    routing: int = 1
    seed: int = 0


@dataclasses.dataclass(frozen=True)
class Stacked:
    net: NetConfig
    most: int
    caps: Caps = Caps()


@dataclasses.dataclass(frozen=True)
class Flagship:
    """A stacked graph whose levels are refined after each batch; the shift is in units of the net's bottom distance."""

    net: NetConfig
    most: int
    caps: Caps = Caps()
    shift: float = 0.0
    loops: int = 2
    triangles: int = 2
    routing: int = 2
    prefill: float = 1.0


def _flat(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "dist")


def _refining(config: Flagship) -> dict:
    return dict(shift=config.shift, rho=config.net.rho, loops=config.loops, triangles=config.triangles, routing=config.routing, prefill=config.prefill)


def _grown(graph: Layered) -> tuple[Layered, DataFrame]:
    return graph, graph.vectors


register("knn", KnnGraph, lambda vectors, c: _flat(refine.knn_graph(vectors, c.degree, c.loops, c.triangles, c.routing, c.seed)))
register(
    "convergent",
    Convergent,
    lambda vectors, c: _flat(refine.convergent_graph(vectors, c.degree, c.alpha, c.shift, c.loops, c.triangles, c.routing, c.seed)),
    lambda graph, vectors, batch, c: increments.add_vertices(graph, vectors, batch, c.degree, c.alpha),
)
register(
    "stacked",
    Stacked,
    lambda vectors, c: insertion.insert(insertion.empty(vectors), vectors, c.net, c.most, c.caps),
    lambda graph, vectors, batch, c: _grown(increments.add_layered(graph, batch, c.net, c.most, c.caps)),
    layered=True,
)
register(
    "flagship",
    Flagship,
    lambda vectors, c: increments.add_layered(insertion.empty(vectors), vectors, c.net, c.most, c.caps, _refining(c)),
    lambda graph, vectors, batch, c: _grown(increments.add_layered(graph, batch, c.net, c.most, c.caps, _refining(c))),
    layered=True,
)

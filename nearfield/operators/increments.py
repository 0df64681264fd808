"""Adding vectors to a built graph in batches: appended ids, rows for the new vertices, and edges back to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import compact, insertion, layered
from nearfield.operators.edges import truncate
from nearfield.operators.insertion import Caps, Layered, linked
from nearfield.operators.knn import knn
from nearfield.operators.probes import medoid
from nearfield.operators.refine import DIRECT
from nearfield.plans.config import NetConfig
from nearfield.sources.snapshots import cut


def appended(vectors: DataFrame, batch: DataFrame) -> DataFrame:
    """vid, vec of a batch (vec): ids go on after the greatest there is, in the order of the batch's rows.

    Each partition is numbered by itself, after the numbers of those before it; what is collected is a count for each partition.
    """
    first = (vectors.agg(F.max("vid")).first()[0] if vectors is not None else None)
    first = -1 if first is None else first
    if vectors is not None and not batch.isEmpty():
        sizes = {r[0] for r in batch.select(F.size("vec")).distinct().limit(3).collect()} | {r[0] for r in vectors.select(F.size("vec")).distinct().limit(3).collect()}
        if len(sizes) > 1:
            raise ValueError(f"vectors differ in dimension: {sorted(sizes)}")
    # ids of one partition follow each other from (partition << 33)
    marked = cut(batch.select("vec", F.monotonically_increasing_id().alias("_row")))
    part = F.shiftright("_row", 33)
    counts = sorted(tuple(r) for r in marked.groupBy(part.alias("part")).agg(F.count("*")).collect())
    before, rows = first + 1, []
    for part_id, n in counts:
        rows.append((part_id, before))
        before += n
    known = batch.sparkSession.createDataFrame(rows, "_part long, _first long")
    placed = marked.withColumn("_part", part).join(F.broadcast(known), "_part")  # a row for each partition
    return placed.select((F.col("_first") + F.col("_row") - F.shiftleft("_part", 33)).alias("vid"), "vec")


def add_vertices(edges: DataFrame, vectors: DataFrame, batch: DataFrame, degree: int, alpha: float = 1.05, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, vectors) with a batch (vid, vec) added: candidates of new vertices are found on the graph (up to ``DIRECT`` vertices by joining all) and among the batch.

    Only rows that get an edge back and overflow are pruned again; all others stay as they are.
    """
    width = width or 2 * degree
    every = cut(vectors.select("vid", "vec").unionByName(batch.select("vid", "vec")))
    asked = batch.select(F.col("vid").alias("qid"), "vec")
    near = knn(batch, asked, width, exclude_self=True).select("qid", "vid", "dist")
    if not edges.isEmpty():
        if vectors.count() <= DIRECT:
            found = knn(vectors, asked, width).select("qid", "vid", "dist")
        else:
            packed = cut(compact.pack(edges, vectors, degree))
            found = compact.searched(compact.from_one(asked, medoid(vectors).first().vid), packed, width)
            found = found.select("qid", F.explode("found").alias("one")).select("qid", "one.vid", "one.dist")
        near = near.unionByName(found)
    fresh = near.select(F.col("qid").alias("src"), F.col("vid").alias("dst"), "dist")
    return cut(truncate(linked(edges, every, fresh, degree, alpha), degree)), every


def add_layered(graph: Layered, batch: DataFrame, net: NetConfig, most: int, caps: Caps = Caps(), refine: dict | None = None) -> Layered:
    """A layered graph over nets with a batch (vid, vec) of new ids; the nets stay as they are, but for members of the batch that no centre covers.

    With ``refine`` (arguments of ``layered.refined``) the bottom is not linked by insertion: all levels are refined by supersteps that start
    from the rows there are, with random edges for the vertices of the batch.
    """
    if refine is None:
        return insertion.insert(graph, batch, net, most, caps)
    batch = cut(batch.select("vid", "vec"))
    grown = insertion.insert(graph, batch, net, most, caps, bottom=False)
    old = grown.layers if graph.top >= 0 else None
    layers, _, top = layered.refined(grown.vectors, grown.levels, caps.upper, caps.bottom, caps.alpha, old=old, fresh=batch.select("vid"), **refine)
    return grown._replace(layers=layers, top=top)


def add_hierarchical(graph: Layered, batch: DataFrame, ratio: float, most: int, caps: Caps = Caps(), seed: int = 0) -> Layered:
    """A layered graph over a random hierarchy with a batch (vid, vec) of new ids, each of which draws its own level."""
    draw = (F.pmod(F.xxhash64(F.lit(seed), "vid"), F.lit(1 << 52)) + 1) / float(1 << 52)
    rise = batch.select("vid", F.least(F.floor(F.log(draw) / F.log(F.lit(ratio))), F.lit(most)).cast("int").alias("highest_level"))
    return insertion.insert_wave(graph, batch, None, most, caps, rise=rise)

"""Compact graphs and search inside tasks.

A graph is packed to parts: each has the vectors of a range of vertices and their neighbour rows, all of one width, in flat arrays. Parts are rows of a table and
so are files. A task walks the beams of many queries at once over the parts it holds.

Where all parts are of a checked size they are broadcast, and the queries are searched where they lie, without a shuffle. Otherwise the frontier is routed: in
each round a query visits the parts that its open candidates and its unmeasured neighbours lie in, walks there as far as it can, and takes with it
the neighbours that lie elsewhere; a visit is one block of queries at one part, so that neither a part that all start from nor a query is one task.
A round follows a beam to the border of a part, not one step.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import block_distances, parse_metric
from nearfield.operators.cells import CELLS, placed
from nearfield.operators.evaluate import recall_at_k
from nearfield.operators.search import EXPAND
from nearfield.sources.snapshots import cut, released

#: Vertices of a part, queries of a block, and bytes of packed parts up to which they are broadcast.
PART, BLOCK, FEW_BYTES = 4096, 2048, 64 << 20
#: Numbers that a task holds for the vectors of one step.
HELD = 4 << 20
PACKED = "level int, part long, vertices long, width int, edges long, bytes long, content binary"
MET = pa.schema([("qid", pa.int64()), ("vid", pa.int64()), ("dist", pa.float64()), ("open", pa.bool_())])
FOUND = "array<struct<vid:long,dist:double,open:boolean>>"


class Part(NamedTuple):
    vid: np.ndarray  # ascending
    rows: np.ndarray  # neighbours, -1 at the end
    vec: np.ndarray


def pack(edges: DataFrame, vectors: DataFrame, width: int, level: int = 0, part: int | None = None, homes: DataFrame | None = None) -> DataFrame:
    """Parts of a graph (PACKED): the ``width`` nearest neighbours of each vertex. Vertices without edges have empty rows.

    Parts are ranges of vertices, or as ``homes`` (vid, part) says; see ``local_parts`` for such as a routed search seldom leaves.
    """
    part = part or PART
    if homes is None:
        count, most = vectors.agg(F.count("*"), F.max("vid")).first()
        step = max(part, part * ((most or 0) + 1) // max(count, 1))
        homes = vectors.select("vid", F.floor(F.col("vid") / step).cast("long").alias("part"))
    rows = edges.groupBy("src").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "dst"))), 1, width)["dst"].alias("row"))
    joined = vectors.select("vid", "vec").join(rows.withColumnRenamed("src", "vid"), "vid", "left").join(homes, "vid").select("vid", "vec", "row", "part")

    def flat(key, table):
        table = table.combine_chunks().sort_by("vid")
        vid, vec, row = (table[c].combine_chunks() for c in ("vid", "vec", "row"))
        sizes = np.asarray(pc.fill_null(pc.list_value_length(row), 0))
        out = np.full((len(vid), width), -1, dtype=np.int64)
        out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(row.flatten())
        flat_vec = np.asarray(vec.flatten(), dtype=np.float32).reshape(len(vid), -1)
        content = io.BytesIO()
        np.savez(content, vid=np.asarray(vid), rows=out, vec=flat_vec)
        size = 8 * len(vid) + out.nbytes + flat_vec.nbytes
        return pa.table({"level": pa.array([level], pa.int32()), "part": pa.array([key[0].as_py()]), "vertices": pa.array([len(vid)]), "width": pa.array([width], pa.int32()), "edges": pa.array([int(sizes.sum())]), "bytes": pa.array([size]), "content": pa.array([content.getvalue()], pa.binary())})

    return joined.groupBy("part").applyInArrow(flat, PACKED)


def local_parts(vectors: DataFrame, part: int | None = None) -> DataFrame:
    """vid, part: vertices by the cell of a net that they lie in; a cell of more than ``part`` vertices is several parts, by a hash."""
    size = part or PART
    n = vectors.count()
    rows, _ = placed(vectors, max(1, min(CELLS, -(-n // size))))
    count = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("many"))  # a row a cell
    named = rows.join(F.broadcast(count), "cell")
    return cut(named.select("vid", (F.col("cell").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("vid"), F.col("many"))).alias("part")))


def pack_layers(layers: DataFrame, levels: DataFrame, vectors: DataFrame, upper: int, bottom: int, top: int) -> DataFrame:
    """Parts of all levels of a layered graph."""
    out = None
    for level in range(top + 1):
        members = vectors.join(levels.where(F.col("highest_level") >= level).select("vid"), "vid", "left_semi")
        one = pack(layers.where(F.col("level") == level), members, upper if level else bottom, level)
        out = one if out is None else out.unionByName(one)
    return out


def save_packed(packed: DataFrame, path: str) -> None:
    """A folder of each level; parts are files by range."""
    packed.repartitionByRange("level", "part").write.mode("overwrite").partitionBy("level").parquet(path)


def load_packed(spark, path: str) -> DataFrame:
    return spark.read.schema(PACKED).parquet(path)


def unpacked(content: bytes) -> Part:
    with np.load(io.BytesIO(content)) as arrays:
        return Part(arrays["vid"], arrays["rows"], arrays["vec"])


class Held(NamedTuple):
    """Parts that a task holds: vertices by place; neighbours as places, -1 for none or elsewhere."""

    vid: np.ndarray
    near: np.ndarray
    ids: np.ndarray
    vec: np.ndarray

    def places(self, vid: np.ndarray) -> np.ndarray:
        if not len(self.vid):
            return np.full(np.shape(vid), -1)
        at = np.minimum(np.searchsorted(self.vid, vid), len(self.vid) - 1)
        return np.where(self.vid[at] == vid, at, -1)


def held(parts: list[Part]) -> Held:
    if not parts:
        return Held(np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1), np.float32))
    vid, ids, vec = (np.concatenate([p[k] for p in parts]) for k in range(3))
    if (np.diff(vid) < 0).any():
        order = np.argsort(vid)
        vid, ids, vec = vid[order], ids[order], vec[order]
    one = Held(vid, ids, ids, vec)
    return one._replace(near=one.places(ids))


def measured(metric: str, q: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Distances of each query (rows of q) to its own vectors (query, place, coordinate), rounded."""
    v = vec.astype(np.float64)
    if metric in ("ip", "cosine"):
        product = np.einsum("qd,qcd->qc", q, v)
        if metric == "ip":
            return np.round(-product, 6) + 0.0
        norms = (q * q).sum(axis=1)[:, None] * np.einsum("qcd,qcd->qc", v, v)
        return np.round(np.where(norms > 0, 1 - product / np.sqrt(np.where(norms > 0, norms, 1)), 1.0), 6) + 0.0
    gap = v - q[:, None, :]
    out = np.einsum("qcd,qcd->qc", gap, gap)
    return np.round(np.sqrt(out) if metric == "l2" else out, 6)


class State(NamedTuple):
    """Of each query its candidates from near to far: place (-1 for none), distance, whether still to be expanded."""

    place: np.ndarray
    dist: np.ndarray
    open: np.ndarray


def best(place: np.ndarray, dist: np.ndarray, open_: np.ndarray, width: int) -> State:
    """The nearest ``width`` of each row; of one that is there twice the closed one stays. Places are in the order of ids."""
    dist = np.where(place < 0, np.inf, dist)
    order = np.lexsort((open_, place, dist))
    place, dist, open_ = (np.take_along_axis(x, order, axis=1) for x in (place, dist, open_))
    again = np.zeros(place.shape, dtype=bool)
    again[:, 1:] = (place[:, 1:] == place[:, :-1]) & (place[:, 1:] >= 0)
    if again.any():
        dist = np.where(again, np.inf, dist)
        place = np.where(again, -1, place)
        order = np.lexsort((place, dist))
        place, dist, open_ = (np.take_along_axis(x, order, axis=1) for x in (place, dist, open_))
    place, dist, open_ = place[:, :width], dist[:, :width], open_[:, :width]
    if place.shape[1] < width:
        more = [(0, 0), (0, width - place.shape[1])]
        place, dist, open_ = np.pad(place, more, constant_values=-1), np.pad(dist, more, constant_values=np.inf), np.pad(open_, more)
    return State(place, dist, open_ & (place >= 0))


def entered(graph: Held, q: np.ndarray, places: np.ndarray, width: int, metric: str) -> State:
    dist = measured(metric, q, graph.vec[np.maximum(places, 0)]) if len(graph.vec) else np.full(places.shape, np.inf)
    return best(places, dist, places >= 0, width)


def walk(graph: Held, q: np.ndarray, state: State, width: int, metric: str, expand: int = EXPAND, stop: float | None = None, limit: np.ndarray | None = None, note: Callable | None = None) -> tuple[State, list[np.ndarray]]:
    """Expands the nearest open candidates of all queries, ``expand`` of each at a time, until none is open.

    With ``limit`` (a distance for each query) farther ones are not expanded. Also gives, round by round, (query, vid) of neighbours that lie elsewhere.
    ``note`` is called with queries, the place each candidate came from, and the place of the candidate, for those that a state took.
    """
    away: list[np.ndarray] = []
    near, ids = graph.near, graph.ids
    degree, d = near.shape[1], graph.vec.shape[1]
    step = max(1, HELD // max(1, min(expand, width) * degree * d))
    while True:
        if stop is not None:
            state = state._replace(open=state.open & (state.dist[:, :1] > stop))
        todo = state.open if limit is None else state.open & (state.dist <= limit[:, None])
        asking = np.flatnonzero(todo.any(axis=1))
        if not len(asking):
            return state, away
        for a in range(0, len(asking), step):
            who = asking[a : a + step]
            now = todo[who] & (np.cumsum(todo[who], axis=1) <= min(expand, width))
            row, col = np.nonzero(now)
            from_ = state.place[who][row, col]
            turn = np.arange(len(row)) - np.searchsorted(row, row)
            fresh = np.full((len(who), min(expand, width), degree), -1, dtype=np.int64)
            fresh[row, turn] = near[from_]
            if limit is not None:
                r, c = np.nonzero((near[from_] < 0) & (ids[from_] >= 0))
                if len(r):
                    away.append(np.stack([who[row[r]], ids[from_[r], c]], axis=1))
            fresh = fresh.reshape(len(who), -1)
            dist = measured(metric, q[who], graph.vec[np.maximum(fresh, 0)])
            after = best(np.concatenate([state.place[who], fresh], axis=1), np.concatenate([state.dist[who], dist], axis=1), np.concatenate([state.open[who] & ~now, fresh >= 0], axis=1), state.place.shape[1])
            if note is not None:
                taken = (fresh >= 0) & (fresh[:, :, None] == after.place[:, None, :]).any(axis=2) & ~(fresh[:, :, None] == state.place[who][:, None, :]).any(axis=2)
                r, c = np.nonzero(taken)
                origin = np.full((len(who), min(expand, width)), -1, dtype=np.int64)
                origin[row, turn] = from_
                note(who[r], origin[r, c // degree], fresh[r, c])
            state.place[who], state.dist[who], state.open[who] = after


def reachable(graph: Held, places: np.ndarray) -> np.ndarray:
    """All places that can be reached from some (sorted, -1 for none), these included, in order."""
    seen = np.zeros(len(graph.vid), dtype=bool)
    fresh = np.unique(places[places >= 0])
    while len(fresh):
        seen[fresh] = True
        ahead = np.unique(graph.near[fresh])
        ahead = ahead[ahead >= 0]
        fresh = ahead[~seen[ahead]]
    return np.flatnonzero(seen)


def complete(graph: Held, q: np.ndarray, places: np.ndarray, keep: int, metric: str) -> State:
    """What a walk whose state drops nothing ends with: of all that each query can reach the nearest ``keep``. Entries of many queries are often the same."""
    out = State(np.full((len(q), keep), -1), np.full((len(q), keep), np.inf), np.zeros((len(q), keep), dtype=bool))
    sets, of = np.unique(places, axis=0, return_inverse=True)
    for k, start in enumerate(sets):
        there, who = reachable(graph, start), np.flatnonzero(of.ravel() == k)
        step = max(1, HELD // max(1, len(there)))
        for a in range(0, len(who) if len(there) else 0, step):
            some = who[a : a + step]
            dist = np.round(block_distances(metric, q[some], graph.vec[there]), 6) + 0.0
            n = min(keep, len(there))
            last = np.partition(dist, n - 1, axis=1)[:, n - 1]
            for r, one in enumerate(some):
                near = np.flatnonzero(dist[r] <= last[r])
                near = near[np.argsort(dist[r, near], kind="stable")][:n]  # places are in the order of ids
                out.place[one, :n], out.dist[one, :n] = there[near], dist[r, near]
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each element of a list column, and its elements."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return np.repeat(np.arange(len(column)), sizes), np.asarray(column.flatten())


def _square(owner: np.ndarray, values: np.ndarray, n: int, fill) -> np.ndarray:
    """Ragged rows as a matrix."""
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.full((n, max(1, int(place.max(initial=0)) + 1)), fill, dtype=values.dtype if len(values) else np.int64)
    out[owner, place] = values
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _listed(owner: np.ndarray, n: int, vid: np.ndarray, dist: np.ndarray, open_: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(vid, pa.int64()), pa.array(dist, pa.float64()), pa.array(open_)], names=["vid", "dist", "open"])
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def _broadcastable(packed: DataFrame) -> list[Part] | None:
    """The parts, if they are few enough to be broadcast."""
    size = packed.agg(F.sum("bytes")).first()[0] or 0
    return None if size > FEW_BYTES else [unpacked(r.content) for r in packed.select("content").collect()]


def searched(asked: DataFrame, packed: DataFrame, width: int, metric: str = "l2", expand: int = EXPAND, stop: float | None = None, keep: int | None = None) -> DataFrame:
    """asked (qid, vec, entries: array of vids) with ``found``, the nearest ``width`` of each query (FOUND) in order, none of them open; of a state that drops nothing the nearest ``keep`` at least.

    ``found`` is a state that can go on: its vids are entries of a lower level, or of a wider search (see ``reopened``).
    """
    parse_metric(metric)
    parts = _broadcastable(packed)
    if parts is None:
        return _routed(asked, packed, width, parse_metric(metric), expand, stop)
    shared, metric = asked.sparkSession.sparkContext.broadcast(held(parts)), parse_metric(metric)

    def task(batches) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                q, (owner, vids) = _vectors(some.column(1)), _lists(some.column(2))
                places = np.sort(_square(owner, graph.places(vids), some.num_rows, -1), axis=1)
                if width >= len(graph.vid) and stop is None:
                    state = complete(graph, q, places, max(1, min(keep or width, len(graph.vid))), metric)
                else:
                    state, _ = walk(graph, q, entered(graph, q, places, width, metric), width, metric, expand, stop)
                row, col = np.nonzero(state.place >= 0)
                out = _listed(row, some.num_rows, graph.vid[state.place[row, col]] if len(row) else np.zeros(0, np.int64), state.dist[row, col], state.open[row, col])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), out], names=["qid", "vec", "found"])

    kind = asked.schema["vec"].dataType.simpleString()
    return asked.select("qid", "vec", "entries").mapInArrow(task, f"qid long, vec {kind}, found {FOUND}")


def pushes(asked: DataFrame, packed: DataFrame, width: int, metric: str = "l2", expand: int = EXPAND) -> DataFrame:
    """qid, src, vid, length: the edges along which a search's state took a candidate, and how long they are. The parts must be few enough to be broadcast."""
    parts = _broadcastable(packed)
    if parts is None:
        raise ValueError("pushes are traced on a graph or sample that can be broadcast")
    shared, metric = asked.sparkSession.sparkContext.broadcast(held(parts)), parse_metric(metric)

    def task(batches) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                q, (owner, vids), ids = _vectors(some.column(1)), _lists(some.column(2)), np.asarray(some.column(0))
                state, out = entered(graph, q, np.sort(_square(owner, graph.places(vids), some.num_rows, -1), axis=1), width, metric), []

                def note(who, src, dst):
                    length = measured(metric, graph.vec[src].astype(np.float64), graph.vec[dst][:, None, :])[:, 0] if len(src) else np.zeros(0)
                    out.append(pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(graph.vid[src]), pa.array(graph.vid[dst]), pa.array(length)], names=["qid", "src", "vid", "length"]))

                walk(graph, q, state, width, metric, expand, note=note)
                yield from out

    return asked.select("qid", "vec", "entries").mapInArrow(task, "qid long, src long, vid long, length double")


def push_profile(asked: DataFrame, packed: DataFrame, width: int, metric: str = "l2", expand: int = EXPAND) -> DataFrame:
    """level, pushes, mean_length of the edges that a search on one level took."""
    level = packed.agg(F.max("level")).first()[0]
    return pushes(asked, packed, width, metric, expand).agg(F.count("*").alias("pushes"), F.round(F.avg("length"), 6).alias("mean_length")).select(F.lit(level).alias("level"), "pushes", "mean_length")


def _routed(asked: DataFrame, packed: DataFrame, width: int, metric: str, expand: int, stop: float | None) -> DataFrame:
    packed = cut(packed.select("part", "content"))
    kind = asked.schema["vec"].dataType.simpleString()
    homes = cut(packed.mapInArrow(_members, "part long, vid long"))
    queries = cut(asked.select("qid", "vec"))

    def visit(key, graph, visits):
        visits, n = visits.combine_chunks(), visits.num_rows
        if not n or not graph.num_rows:
            return pa.table([[], [], [], []], schema=MET)
        graph = held([unpacked(c.as_py()) for c in graph["content"]])
        q, worst = _vectors(visits["vec"].combine_chunks()), np.asarray(visits["worst"].combine_chunks())
        owner, items = _lists(visits["todo"].combine_chunks())
        places = np.sort(_square(owner, graph.places(items), n, -1), axis=1)
        state = entered(graph, q, places, max(width, places.shape[1]), metric)
        state, away = walk(graph, q, state, width, metric, expand, stop, worst)
        row, col = np.nonzero(state.place >= 0)
        ids = np.asarray(visits["qid"].combine_chunks())
        found = pa.table({"qid": pa.array(ids[row]), "vid": pa.array(graph.vid[state.place[row, col]] if len(row) else np.zeros(0, np.int64)), "dist": pa.array(state.dist[row, col]), "open": pa.array(state.open[row, col])})
        if not away:
            return found
        pairs = np.unique(np.concatenate(away), axis=0)
        rest = pa.table({"qid": pa.array(ids[pairs[:, 0]]), "vid": pa.array(pairs[:, 1]), "dist": pa.nulls(len(pairs), pa.float64()), "open": pa.array(np.ones(len(pairs), dtype=bool))})
        return pa.concat_tables([found, rest])

    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "vid"))
    state = asked.sparkSession.createDataFrame([], "qid long, vid long, dist double, open boolean")
    todo = asked.select("qid", F.explode("entries").alias("vid")).distinct()
    old: list[DataFrame] = []
    while True:
        worst = state.groupBy("qid").agg(F.when(F.count("*") >= width, F.max("dist")).otherwise(F.lit(float("inf"))).alias("worst"))
        visits = todo.join(homes, "vid").groupBy("qid", "part").agg(F.collect_list("vid").alias("todo"))  # of one query: its open ones and their neighbours
        visits = cut(visits.join(worst, "qid", "left").select("part", "qid", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "todo"))
        # a part is copied as often as its visits need, and not at all without one
        many = cut(visits.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("many")))
        copies = packed.join(many, "part").select("part", "content", F.explode(F.sequence(F.lit(0), F.col("many").cast("int") - 1)).alias("block"))
        dealt = visits.join(many, "part").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("many")).cast("int")).join(queries, "qid")
        dealt = dealt.select("part", "block", "qid", "vec", "worst", "todo")
        met = cut(copies.groupBy("part", "block").cogroup(dealt.groupBy("part", "block")).applyInArrow(visit, "qid long, vid long, dist double, open boolean"))
        known = state.unionByName(met.where("dist IS NOT NULL")).groupBy("qid", "vid").agg(F.min("dist").alias("dist"), F.min("open").alias("open"))
        after = cut(known.withColumn("_rank", rank).where(F.col("_rank") <= width).drop("_rank"))
        opened = after.where("open") if stop is None else after.withColumn("_best", F.min("dist").over(Window.partitionBy("qid"))).where(F.col("open") & (F.col("_best") > stop))
        todo = opened.select("qid", "vid").unionByName(met.where("dist IS NULL").select("qid", "vid")).distinct()
        todo = cut(todo.join(after.where("NOT open").select("qid", "vid"), ["qid", "vid"], "left_anti"))
        released(*old)
        old, state = [visits, many, met, after, todo], after
        if todo.isEmpty():
            break
    lists = state.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("dist", "vid"))).alias("near"))  # ``width`` of each query
    listed = F.transform(F.coalesce("near", F.array().cast("array<struct<dist:double,vid:long>>")), lambda x: F.struct(x["vid"].alias("vid"), x["dist"].alias("dist"), F.lit(False).alias("open")))
    return queries.join(lists, "qid", "left").select("qid", F.col("vec").cast(kind).alias("vec"), listed.cast(FOUND).alias("found"))


def _members(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            vid = unpacked(batch.column(1)[k].as_py()).vid
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vid), batch.column(0)[k].as_py())), pa.array(vid)], names=["part", "vid"])


def with_entries(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """qid, vec, entries of queries (qid, vec) and entries (qid, vid), a few of each query."""
    lists = entries.groupBy("qid").agg(F.collect_set("vid").alias("entries"))
    rows = queries.select("qid", "vec").join(lists, "qid", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<long>")))
    return rows.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid")  # as many tasks as asked for, however few the bytes


def from_one(queries: DataFrame, entry: int) -> DataFrame:
    """qid, vec, entries: all queries from one vertex."""
    return queries.select("qid", "vec", F.array(F.lit(entry).cast("long")).alias("entries"))


def reopened(found: DataFrame) -> DataFrame:
    """What was found as entries of another search: of the next level, or of a wider one, whose candidates are open again."""
    return found.select("qid", "vec", F.col("found.vid").alias("entries"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """qid, rank, vid, dist of the k nearest found."""
    rows = found.select("qid", F.posexplode(F.slice("found", 1, k)).alias("pos", "one"))
    return rows.select("qid", (F.col("pos") + 1).alias("rank"), "one.vid", "one.dist")


def search_flat(asked: DataFrame, packed: DataFrame, k: int, width: int, metric: str = "l2", stop: float | None = None) -> DataFrame:
    """qid, rank, vid, dist of the k nearest found from asked (qid, vec, entries)."""
    if width < k:
        raise ValueError("the width of the search must be k at least")
    return ranked(searched(asked, packed, width, metric, stop=stop), k)


def search_until(asked: DataFrame, packed: DataFrame, k: int, width: int, truth: DataFrame, at_least: float = 0.9, metric: str = "l2") -> DataFrame:
    """As :func:`search_flat`, but recall is measured: against the true neighbours (qid, rank, vid) of all queries or of some. Below ``at_least`` the search
    goes on from what it found with twice the width, up to that of all vertices.
    """
    if width < k:
        raise ValueError("the width of the search must be k at least")
    n, last = packed.agg(F.sum("vertices")).first()[0] or 0, None
    while True:
        found = cut(searched(asked, packed, width, metric))
        released(*[last] * (last is not None))
        judged = ranked(found, k).join(truth.select("qid").distinct(), "qid", "left_semi")
        if width >= n or (recall_at_k(judged, truth, k).first()[0] or 0.0) >= at_least:
            return ranked(found, k)
        asked, width, last = reopened(found), 2 * width, found


def descended(asked: DataFrame, packed: DataFrame, top: int, width: int = 1, metric: str = "l2", stops: dict[int, float] | None = None, bottom: int = 1) -> DataFrame:
    """asked with the entries that walks of ``width`` down the levels from ``top`` to ``bottom`` end in; each level forks the state of the one above."""
    for level in range(top, bottom - 1, -1):
        stop = (stops or {}).get(level)
        stop = stop * stop if stop is not None and parse_metric(metric) == "l2sqr" else stop
        asked = reopened(searched(asked, packed.where(F.col("level") == level), width, metric, 1 if width == 1 else EXPAND, stop))
    return asked


def search_layered(queries: DataFrame, packed: DataFrame, entry: int, top: int, k: int, width: int, metric: str = "l2", stops: dict[int, float] | None = None) -> DataFrame:
    """Greedy walks down the upper levels, then a beam on the bottom, all in one stage where the parts are few."""
    if width < k:
        raise ValueError("the width of the search must be k at least")
    return search_flat(descended(from_one(queries, entry), packed, top, 1, metric, stops), packed.where("level = 0"), k, width, metric)


def search_layered_until(queries: DataFrame, packed: DataFrame, entry: int, top: int, k: int, width: int, truth: DataFrame, at_least: float = 0.9, metric: str = "l2", stops: dict[int, float] | None = None) -> DataFrame:
    """As :func:`search_layered`, but the beam on the bottom goes on as in :func:`search_until`."""
    return search_until(descended(from_one(queries, entry), packed, top, 1, metric, stops), packed.where("level = 0"), k, width, truth, at_least, metric)


def sizes(packed: DataFrame) -> DataFrame:
    """level, vertices, edges, bytes of a packed graph."""
    return packed.groupBy("level").agg(F.sum("vertices").alias("vertices"), F.sum("edges").alias("edges"), F.sum("bytes").alias("bytes"))

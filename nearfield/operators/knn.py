"""Exact neighbours of a query set, by blocks: each meeting of a block of queries with a block of rows is one matrix of distances.

Queries of a checked size are broadcast, and the rows are read where they lie: a task keeps the best of each query over all its
rows, so that only k rows a query and task are shuffled. More queries are dealt to parts, of which each is one task's: it gets its queries first
and then all rows, block by block, keeps the best of each query and gives k rows a query; neither side is collected.

Neighbours are looked for by a product in single precision whose error is bounded: it only says which pairs may be among the best, and these are measured in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import block_distances, parse_metric

#: Rows of a block; a meeting of two blocks is a matrix of at most QUERY_BLOCK * BASE_BLOCK distances.
QUERY_BLOCK, BASE_BLOCK = 512, 4096
#: Queries of a part; a task holds them, and what is found for them.
PART = 1 << 15
#: Pairs that are measured at once.
PAIRS = 1 << 16
#: Queries, bytes of their vectors, and results that a task keeps, up to which queries are broadcast.
FEW, FEW_BYTES, FEW_KEPT = 1 << 16, 64 << 20, 4 << 20
DIGITS = 6


MET = pa.schema([("qid", pa.int64()), ("vid", pa.int64()), ("dist", pa.float64())])
#: Ids, a matrix of vectors, and further columns.
Side = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def _side(columns: list) -> Side:
    ids, vectors, *more = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns)
    flat = np.asarray(vectors.flatten(), dtype=np.float32)
    return np.asarray(ids), flat.reshape(len(ids), -1 if len(flat) else 0), [np.asarray(c) for c in more]


def _rows(side: Side, a: int, b: int) -> Side:
    return side[0][a:b], side[1][a:b], [c[a:b] for c in side[2]]


def broadcast_side(queries: DataFrame, *more: str, kept: int = 1) -> Side | None:
    """The queries, if there are few enough to be broadcast."""
    found = queries.select("qid", "vec", *more).limit(FEW + 1).toArrow()
    if found.num_rows > FEW or found.nbytes > FEW_BYTES or found.num_rows * kept > FEW_KEPT:
        return None
    return _side(found.columns)


def _cut(vectors: DataFrame, id_col: str, more: tuple[str, ...], parts: int) -> DataFrame:
    """part, kind, content: queries (kind 0) by their part, or rows (kind 1) for all of ``parts``, in blocks."""
    columns, size = [id_col, "vec", *more], BASE_BLOCK

    def content(some: pa.Table) -> pa.Array:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, some.schema) as stream:
            stream.write_table(some.combine_chunks())
        return pa.array([out.getvalue().to_pybytes()], pa.binary())

    def rows(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            for a in range(0, table.num_rows, size):
                yield pa.RecordBatch.from_arrays([content(table.slice(a, size))], names=["content"])
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield from ready()
        if held:
            yield from ready()

    def asked(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.asarray(batch.column(len(columns)))
            for k in np.unique(part):
                some = pa.Table.from_batches([batch.take(pa.array(np.flatnonzero(part == k)))]).select(columns)
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), content(some)], names=["part", "content"])

    if id_col == "vid":
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        return vectors.select(*columns).mapInArrow(rows, "content binary").select(every.alias("part"), F.lit(1).alias("kind"), "content")
    dealt = vectors.select(*columns, F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("_part"))
    return dealt.mapInArrow(asked, "part int, content binary").select("part", F.lit(0).alias("kind"), "content")


def _uncut(content: bytes) -> Side:
    return _side(pa.ipc.open_stream(content).read_all().columns)


def meet(base: DataFrame, queries: DataFrame, more: list[str], start: Callable[[], Callable[[Side, Side], pa.RecordBatch | None]], ddl: str, held: Side | None) -> DataFrame:
    """What a task's function makes of each block of queries against each block of rows.

    ``start`` gives a fresh function for each task; if that has an attribute ``rest``, it is called at the task's end.
    """
    spark = queries.sparkSession
    if held is not None:
        shared = spark.sparkContext.broadcast(held)

        def by_rows(batches) -> Iterator[pa.RecordBatch]:
            step, asked = start(), shared.value
            for batch in batches:
                side = _side(batch.columns)
                for a in range(0, len(side[0]), BASE_BLOCK):
                    some = _rows(side, a, a + BASE_BLOCK)
                    for q in range(0, len(asked[0]), QUERY_BLOCK):
                        if (out := step(_rows(asked, q, q + QUERY_BLOCK), some)) is not None:
                            yield out
            if rest := getattr(step, "rest", None):
                yield from rest()

        rows = base.select("vid", "vec", *more)
        # many queries are much work for few rows: as many tasks as asked for, however few the bytes
        return (rows.repartition(_tasks(spark), "vid") if len(held[0]) > BASE_BLOCK else rows).mapInArrow(by_rows, ddl)
    tasks = _tasks(spark)
    parts = tasks * -(-queries.count() // (tasks * PART)) or tasks
    dealt = _cut(queries, "qid", tuple(more), parts).unionByName(_cut(base, "vid", tuple(more), parts))
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "kind").select("part", "kind", "content")

    def by_parts(batches) -> Iterator[pa.RecordBatch]:
        part, asked, some, step = None, [], [], None
        for batch in batches:
            for r in range(batch.num_rows):
                at, kind = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                if at != part:
                    if rest := getattr(step, "rest", None):
                        yield from rest()
                    part, asked, some, step = at, [], [], start()
                side = _uncut(batch.column(2)[r].as_py())
                if not kind:
                    asked.append(side)
                    continue
                if asked:
                    ids, vec = (np.concatenate([s[k] for s in asked]) for k in (0, 1))
                    other = [np.concatenate([s[2][k] for s in asked]) for k in range(len(more))]
                    some, asked = [_rows((ids, vec, other), q, q + QUERY_BLOCK) for q in range(0, len(ids), QUERY_BLOCK)], []
                for q in some:
                    if (out := step(q, side)) is not None:
                        yield out
        if rest := getattr(step, "rest", None):
            yield from rest()

    return dealt.mapInArrow(by_parts, ddl)


def _tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _allowed(q: Side, b: Side, d: np.ndarray, exclude_self: bool, within: float | None) -> np.ndarray:
    allowed = np.ones(d.shape, dtype=bool) if within is None else d <= within
    if exclude_self:
        allowed &= q[0][:, None] != b[0][None, :]
    for x, y in zip(q[2], b[2]):
        allowed &= x[:, None] == y[None, :]
    return allowed


def measured_pairs(metric: str, q: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of rows of q with rows of b, in double precision, rounded."""
    out = np.empty(len(rows))
    for a in range(0, len(rows), PAIRS):
        x, y = q[rows[a : a + PAIRS]].astype(np.float64), b[cols[a : a + PAIRS]].astype(np.float64)
        if metric in ("l2", "l2sqr"):
            gap = y - x
            d = np.einsum("ij,ij->i", gap, gap)
            out[a : a + PAIRS] = np.sqrt(d) if metric == "l2" else d
            continue
        product = np.einsum("ij,ij->i", x, y)
        if metric == "cosine":
            norms = np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)
            product = np.where(norms > 0, product / np.sqrt(np.where(norms > 0, norms, 1)), 0.0) - 1.0
        out[a : a + PAIRS] = -product
    return np.round(out, DIGITS) + 0.0


class _Factor:
    """A block's factor of such products, its squares and the largest of them."""

    def __init__(self, metric: str, x: np.ndarray, left: bool):
        with np.errstate(all="ignore"):
            if metric == "cosine":
                x = x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)), 1e-300)[:, None]
            self.square = np.einsum("ij,ij->i", x, x, dtype=np.float64)
            self.largest = self.square.max(initial=0.0)
            if metric in ("l2", "l2sqr"):
                x = np.concatenate([-2.0 * x, np.ones((len(x), 1))] if left else [x, self.square[:, None]], axis=1)
            elif left:
                x = -x
            self.value = x.astype(np.float32)


def marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true ones, of which there are few."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.nonzero(mask)
    eights = np.flatnonzero(flat.view(np.uint64))
    some, one = np.nonzero(flat.reshape(-1, 8)[eights])
    return np.divmod(eights[some] * 8 + one, mask.shape[1])


class Near:
    """Distances of blocks in single precision, up to ``error``: squares for l2 and l2sqr; those of ip and cosine as they are. With ``sign`` -1 large ones are the nearest."""

    def __init__(self, metric: str, q: _Factor, b: _Factor, sign: float = 1.0):
        self.squared, self.sign = metric == "l2", sign
        largest = max(q.largest, b.largest)
        #: Without it pairs are measured as they are: components are no numbers or very large.
        self.sound = bool(largest < 1e30)
        if not self.sound:
            return
        self.shift = q.square if metric in ("l2", "l2sqr") else np.full(len(q.square), 0.0 if metric == "ip" else 1.0)
        self.value = q.value @ b.value.T
        if sign < 0:
            self.value *= np.float32(sign)
        self.error = 4 * largest * (q.value.shape[1] + 8) * 2.0**-23 + 1e-30

    def limit(self, worst: np.ndarray) -> np.ndarray:
        """What the values of pairs are at most whose rounded keys are at most the worst ones."""
        key = worst + 2 * 10.0**-DIGITS
        if self.squared:
            key = np.where(key > 0, key * key, -(key * key))
            if self.sign > 0:
                key = np.maximum(key, 0.0)
        return np.nextafter((key - self.sign * self.shift + self.error).astype(np.float32), np.float32(np.inf))


class _Best:
    """The k least (key, vid) of each query over all blocks that a task has seen."""

    def __init__(self, k: int, metric: str, sign: float = 1.0, exclude_self: bool = False, within: float | None = None):
        self.k, self.metric, self.sign, self.exclude_self, self.within, self.found = k, parse_metric(metric), sign, exclude_self, within, {}
        self.factors: dict[bool, tuple] = {}

    def _factor(self, side: Side, left: bool) -> _Factor:
        """Made once for a block of rows that meets all blocks of queries."""
        if left not in self.factors or self.factors[left][0] is not side:
            self.factors[left] = side, _Factor(self.metric, side[1], left)
        return self.factors[left][1]

    def _dense(self, q: Side, b: Side, near: Near) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among the best, by what this block has."""
        k = min(self.k, len(b[0]))
        if not near.sound:
            d = np.round(block_distances(self.metric, q[1], b[1]), DIGITS) + 0.0
            allowed = _allowed(q, b, d, self.exclude_self, self.within)
            key = np.where(allowed, self.sign * d, np.inf)
            return np.nonzero(allowed & (key <= np.partition(key, k - 1, axis=1)[:, k - 1 : k]))
        allowed = _allowed(q, b, near.value, self.exclude_self, None)
        value = np.where(allowed, near.value, np.float32(np.inf))
        last = np.partition(value, k - 1, axis=1)[:, k - 1].astype(np.float64)
        # the worst key that the k-th may have
        worst = last + self.sign * near.shift + near.error
        if near.squared:
            worst = np.sign(worst) * np.sqrt(np.abs(worst)) if self.sign < 0 else np.sqrt(np.maximum(worst, 0.0))
        return np.nonzero(allowed & (value <= near.limit(worst)[:, None]))

    def _pairs(self, q: Side, b: Side, worst: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        near = Near(self.metric, self._factor(q, True), self._factor(b, False), self.sign)
        # of the farthest within a limit this block's may all lie beyond it
        near.sound &= self.sign > 0 or self.within is None
        if worst is None or not near.sound:
            return self._dense(q, b, near)
        rows, cols = marked(near.value <= near.limit(worst)[:, None])
        if len(rows) > 64 * self.k * len(q[0]):
            return self._dense(q, b, near)
        ok = q[0][rows] != b[0][cols] if self.exclude_self else np.ones(len(rows), dtype=bool)
        for x, y in zip(q[2], b[2]):
            ok &= x[rows] == y[cols]
        return rows[ok], cols[ok]

    def __call__(self, q: Side, b: Side) -> None:
        if not len(q[0]) or not len(b[0]):
            return
        was = self.found.get(int(q[0][0]))
        rows, cols = self._pairs(q, b, None if was is None else was[3])
        keys, vids = self.sign * measured_pairs(self.metric, q[1], b[1], rows, cols), b[0][cols]
        keep = np.ones(len(rows), dtype=bool) if self.within is None else self.sign * keys <= self.within
        if was is not None:
            keep &= keys <= was[3][rows]
        rows, keys, vids = rows[keep], keys[keep], vids[keep]
        if was is not None:
            if not len(rows):
                return
            rows, keys, vids = (np.concatenate(x) for x in zip((rows, keys, vids), was[:3]))
        order = np.lexsort((vids, keys, rows))
        rows, keys, vids = rows[order], keys[order], vids[order]
        starts = np.searchsorted(rows, np.arange(len(q[0])))
        place = np.arange(len(rows)) - starts[rows]
        keep = place < self.k
        worst = np.full(len(q[0]), np.inf)
        worst[rows[place == self.k - 1]] = keys[place == self.k - 1]
        self.found[int(q[0][0])] = (rows[keep], keys[keep], vids[keep], worst, q[0])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for rows, keys, vids, _, qid in self.found.values():
            yield pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.array(vids), pa.array(keys)], schema=MET)


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False, same: str | None = None, farthest: bool = False, within: float | None = None) -> DataFrame:
    """qid, rank, vid, dist: for each query the k smallest distances, ties by vid; all rows if there are fewer than k.

    base has vid, vec; queries have qid, vec, and a qid once. ``same`` names a column of both that must be equal; ``within`` is an
    inclusive limit of distance; ``farthest`` takes the largest instead. Distances are rounded to ``DIGITS`` and ranked so.
    """
    parse_metric(metric)
    if k <= 0:
        return queries.sparkSession.createDataFrame([], "qid long, rank int, vid long, dist double")
    more, sign = [same] if same else [], -1.0 if farthest else 1.0

    near = meet(base, queries, more, lambda: _Best(k, metric, sign, exclude_self, within), "qid long, vid long, dist double", broadcast_side(queries, *more, kept=k))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "vid"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.select("qid", "rank", "vid", (sign * F.col("dist") + 0.0).alias("dist"))


def range_join(base: DataFrame, queries: DataFrame, within: float, metric: str = "l2", exclude_self: bool = True) -> DataFrame:
    """qid, vid, dist of all pairs within an inclusive distance."""
    parse_metric(metric)

    def pairs(q: Side, b: Side) -> pa.RecordBatch | None:
        d = np.round(block_distances(metric, q[1], b[1]), DIGITS) + 0.0
        rows, cols = np.nonzero(_allowed(q, b, d, exclude_self, within))
        return pa.RecordBatch.from_arrays([pa.array(q[0][rows]), pa.array(b[0][cols]), pa.array(d[rows, cols])], schema=MET) if len(rows) else None

    return meet(base, queries, [], lambda: pairs, "qid long, vid long, dist double", broadcast_side(queries))


COUNTED = pa.schema([("qid", pa.int64()), ("n", pa.int64()), ("farthest", pa.float64())])


def range_counts(base: DataFrame, queries: DataFrame, within: float, metric: str = "l2", exclude_self: bool = True) -> DataFrame:
    """qid, n, farthest: how many rows lie within an inclusive distance of each query that has any, and the farthest of these."""
    parse_metric(metric)

    def count(q: Side, b: Side) -> pa.RecordBatch | None:
        d = np.round(block_distances(metric, q[1], b[1]), DIGITS) + 0.0
        allowed = _allowed(q, b, d, exclude_self, within)
        n = allowed.sum(axis=1)
        some = n > 0
        far = np.where(allowed, d, -np.inf).max(axis=1, initial=-np.inf)
        return pa.RecordBatch.from_arrays([pa.array(q[0][some]), pa.array(n[some]), pa.array(far[some])], schema=COUNTED) if some.any() else None

    met = meet(base, queries, [], lambda: count, "qid long, n long, farthest double", broadcast_side(queries))
    return met.groupBy("qid").agg(F.sum("n").alias("n"), F.max("farthest").alias("farthest"))

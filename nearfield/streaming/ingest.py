"""Structured Streaming into a growing graph: each micro-batch of vectors is appended and linked.

The state is a folder with a version of vectors and edges for each batch; a batch that is run again after a failure
writes its version anew, from the version before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.increments import add_layered, add_vertices, appended
from nearfield.operators.insertion import NO_EDGES, NO_LEVELS, Caps, Layered
from nearfield.plans.config import NetConfig

VECTORS, EDGES = "vid long, vec array<float>", "src long, dst long, dist double"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions in a folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    done = [s.getPath().getName() for s in store.listStatus(path) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "edges/_SUCCESS"))]
    return sorted(int(name) for name in done)


def read_version(spark: SparkSession, folder: str, version: int) -> tuple[DataFrame, DataFrame]:
    """(edges, vectors) of a version; of none, empty ones."""
    if version < 0:
        return spark.createDataFrame([], EDGES), spark.createDataFrame([], VECTORS)
    return spark.read.schema(EDGES).parquet(f"{folder}/{version}/edges"), spark.read.schema(VECTORS).parquet(f"{folder}/{version}/vectors")


def ingest_batch(batch: DataFrame, number: int, folder: str, degree: int, alpha: float = 1.05) -> None:
    """Adds one micro-batch (vec) to the last version before it and writes the next; edges are written last."""
    spark = batch.sparkSession
    before = max([v for v in versions(spark, folder) if v < number], default=-1)
    edges, vectors = read_version(spark, folder, before)
    fresh = appended(vectors, batch.select(F.col("vec").cast("array<float>").alias("vec")))
    edges, vectors = add_vertices(edges, vectors, fresh, degree, alpha)
    vectors.write.mode("overwrite").parquet(f"{folder}/{number}/vectors")
    edges.write.mode("overwrite").parquet(f"{folder}/{number}/edges")


def ingest(stream: DataFrame, folder: str, checkpoint: str, degree: int, alpha: float = 1.05, **trigger):
    """Starts a streaming query that adds every micro-batch of a stream with a column vec."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, number: ingest_batch(batch, number, folder, degree, alpha)).start()


def read_layered_version(spark: SparkSession, folder: str, version: int) -> Layered:
    """A version of a layered graph; of none, an empty one."""
    if version < 0:
        return Layered(spark.createDataFrame([], NO_EDGES), spark.createDataFrame([], NO_LEVELS), spark.createDataFrame([], VECTORS), -1, -1)
    read = lambda name, ddl: spark.read.schema(ddl).parquet(f"{folder}/{version}/{name}")
    entry, top = read("about", "entry long, top int").first()
    return Layered(read("edges", NO_EDGES), read("levels", NO_LEVELS), read("vectors", VECTORS), entry, top)


def ingest_layered_batch(batch: DataFrame, number: int, folder: str, net: NetConfig, most: int, caps: Caps = Caps(), refine: dict | None = None) -> None:
    """Adds one micro-batch (vec) to the last layered version before it and writes the next: vectors, levels, entry, and edges last."""
    spark = batch.sparkSession
    graph = read_layered_version(spark, folder, max([v for v in versions(spark, folder) if v < number], default=-1))
    fresh = appended(graph.vectors, batch.select(F.col("vec").cast("array<float>").alias("vec")))
    if not fresh.isEmpty():
        graph = add_layered(graph, fresh, net, most, caps, refine)
    about = spark.createDataFrame([(graph.entry, graph.top)], "entry long, top int")
    for name, table in (("vectors", graph.vectors), ("levels", graph.levels), ("about", about), ("edges", graph.layers)):
        table.write.mode("overwrite").parquet(f"{folder}/{number}/{name}")


def ingest_layered(stream: DataFrame, folder: str, checkpoint: str, net: NetConfig, most: int, caps: Caps = Caps(), refine: dict | None = None, **trigger):
    """Starts a streaming query that grows a layered graph by every micro-batch of a stream with a column vec."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, number: ingest_layered_batch(batch, number, folder, net, most, caps, refine)).start()

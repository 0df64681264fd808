"""Graphs on disk, the registry of built ones, and cuts of long lineages."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
EDGES = "src long, dst long, dist double"
LAYERS, LEVELS = f"level int, {EDGES}", "vid long, highest_level int"


_folders: set[str] = set()


def _scratch(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; below a temporary one, where that is unset, only on one machine. Deleted when the application ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        sc.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/graphs-{sc.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  the session has gone
        pass


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends there, lost executors cost nothing, and Spark knows the size."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a graph of this application alone, deleted when it ends."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def released(*cuts: DataFrame) -> None:
    """Deletes what ``cut`` wrote, once nothing reads it any more; other tables are left alone."""
    for df in cuts:
        if path := getattr(df, "cut_path", None):
            _delete(df.sparkSession, path)


def save_graph(edges: DataFrame, path: str, kind: str, vertices: int, **parameters) -> None:
    """Edges as Parquet and, when they are complete, one line of metadata."""
    spark = edges.sparkSession
    edges.select("src", "dst", "dist").write.mode("overwrite").parquet(f"{path}/edges")
    about = {"version": VERSION, "kind": kind, "vertices": vertices, "edges": spark.read.schema(EDGES).parquet(f"{path}/edges").count(), "parameters": parameters}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_graph(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, dict]:
    """Edges and metadata; an error if version, kind, number of edges or ids are not what the metadata say."""
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if about["version"] != VERSION or about["kind"] != kind:
        raise ValueError(f"not a {kind} graph of version {VERSION}: {about['kind']}, {about['version']}")
    edges = spark.read.schema(EDGES).parquet(f"{path}/edges")
    n, low, high = edges.agg(F.count("*"), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    if n != about["edges"] or n and not (0 <= low and high < about["vertices"]):
        raise ValueError("the snapshot is damaged: edges are missing or lead outside")
    return edges, about


def save_layered(layers: DataFrame, levels: DataFrame, entry: int, path: str, kind: str, caps: tuple[int, int] | None = None, **parameters) -> None:
    """A layered graph: level, src, dst, dist; vid, highest_level; the entry; capacities of upper and bottom rows, if there are any."""
    spark = layers.sparkSession
    layers.select("level", "src", "dst", "dist").write.mode("overwrite").parquet(f"{path}/layers")
    levels.select("vid", "highest_level").write.mode("overwrite").parquet(f"{path}/levels")
    stored = spark.read.schema(LEVELS).parquet(f"{path}/levels")
    vertices, top = stored.agg(F.count("*"), F.max("highest_level")).first()
    edges = spark.read.schema(LAYERS).parquet(f"{path}/layers").count()
    about = {"version": VERSION, "kind": kind, "vertices": vertices, "edges": edges, "top": top or 0, "entry": entry, "caps": caps, "parameters": parameters}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_layered(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame, dict]:
    """(layers, levels, metadata); an error if they do not agree: version, kind, counts, ids, levels, capacities or the entry."""
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if about["version"] != VERSION or about["kind"] != kind:
        raise ValueError(f"not a {kind} graph of version {VERSION}: {about['kind']}, {about['version']}")
    layers, levels = spark.read.schema(LAYERS).parquet(f"{path}/layers"), spark.read.schema(LEVELS).parquet(f"{path}/levels")
    n, low, high, most, apex = levels.agg(F.count("*"), F.min("vid"), F.max("vid"), F.max("highest_level"), F.max(F.when(F.col("vid") == about["entry"], F.col("highest_level")))).first()
    if n != about["vertices"] or n and (low < 0 or high >= n or most != about["top"] or apex != about["top"]):
        raise ValueError("the snapshot is damaged: vertices, levels or the entry are not what was saved")
    ends = layers.select("level", F.explode(F.array("src", "dst")).alias("vid")).join(levels, "vid", "left")
    outside = ends.where(F.coalesce((F.col("highest_level") < F.col("level")) | (F.col("level") < 0), F.lit(True)))
    if layers.count() != about["edges"] or not outside.isEmpty():
        raise ValueError("the snapshot is damaged: edges are missing or lead outside their level")
    if about["caps"]:
        upper, bottom = about["caps"]
        size = layers.groupBy("level", "src").agg(F.count("*").alias("n"))
        if not size.where(F.col("n") > F.when(F.col("level") > 0, upper).otherwise(bottom)).isEmpty():
            raise ValueError("the snapshot is damaged: a row is longer than its capacity")
    return layers, levels, about


def register(spark: SparkSession, registry: str, algorithm: str, parameters: dict, path: str) -> None:
    """Adds an entry; one of the same algorithm and parameters takes its place."""
    key = json.dumps(parameters, sort_keys=True)
    old = [tuple(r) for r in _entries(spark, registry) if (r.algorithm, r.parameters) != (algorithm, key)]
    spark.createDataFrame([*old, (algorithm, key, path)], "algorithm string, parameters string, path string").coalesce(1).write.mode("overwrite").json(registry)


def find(spark: SparkSession, registry: str, algorithm: str, parameters: dict) -> str | None:
    key = json.dumps(parameters, sort_keys=True)
    return next((r.path for r in _entries(spark, registry) if (r.algorithm, r.parameters) == (algorithm, key)), None)


def _entries(spark: SparkSession, registry: str) -> list:
    folder = spark._jvm.org.apache.hadoop.fs.Path(registry)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.schema("algorithm string, parameters string, path string").json(registry).collect()  # one row a built index

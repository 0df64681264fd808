"""Vector files and tables."""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, vec, label of the embeddings table."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), "label")


def parse_vecs(content: bytes, kind: str) -> np.ndarray:
    """Rows of an fvecs or ivecs file: each has its dimension (int32) and as many 4-byte values."""
    if kind not in ("fvecs", "ivecs"):
        raise ValueError(f"unsupported vector format: {kind}")
    if not content:
        return np.zeros((0, 0), np.float32 if kind == "fvecs" else np.int32)
    dim = int(np.frombuffer(content, "<i4", 1)[0])
    if dim <= 0:
        raise ValueError("a vector's dimension must be positive")
    if len(content) % (4 * (dim + 1)):
        raise ValueError("the file is truncated or malformed")
    rows = np.frombuffer(content, "<i4").reshape(-1, dim + 1)
    if (rows[:, 0] != dim).any():
        raise ValueError("vectors differ in dimension")
    return rows[:, 1:].copy().view("<f4") if kind == "fvecs" else rows[:, 1:].copy()


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, dimension) of the files below a path or glob; only the first four bytes of each are read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    top = hadoop.Path(path)
    store = top.getFileSystem(conf)
    found = [s for one in store.globStatus(top) or [] for s in (store.listStatus(one.getPath()) if one.isDirectory() else [one])]
    for status in found:
        if status.getPath().getName().startswith(("_", ".")):
            continue
        dim = 0
        if status.getLen():
            stream = store.open(status.getPath())
            head = [stream.read() for _ in range(4)]
            stream.close()
            dim = int.from_bytes(bytes(max(b, 0) for b in head), "little", signed=True) if min(head) >= 0 else 0
        out.append((status.getPath().toString(), status.getLen(), dim))
    if not found:
        raise ValueError(f"no vector file at {path}")
    return out


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """path, pos, vec of vector files, by place in the file. Files are cut to records of one length, so that a large one is read by many tasks."""
    if kind not in ("fvecs", "ivecs"):
        raise ValueError(f"unsupported vector format: {kind}")
    ddl = f"path string, pos long, vec array<{'float' if kind == 'fvecs' else 'int'}>"
    out = spark.createDataFrame([], ddl)
    for name, size, dim in _files(spark, path):
        if not size:
            continue
        if dim <= 0:
            raise ValueError("a vector's dimension must be positive")
        if size % (4 * (dim + 1)):
            raise ValueError("the file is truncated or malformed")

        def rows(records, name=name):
            while some := list(itertools.islice(records, 4096)):
                vectors = parse_vecs(b"".join(bytes(r) for r, _ in some), kind).tolist()
                yield from ((name, pos, vec) for (_, pos), vec in zip(some, vectors))

        records = spark.sparkContext.binaryRecords(name, 4 * (dim + 1)).zipWithIndex()
        out = out.unionByName(spark.createDataFrame(records.mapPartitions(rows), ddl, verifySchema=False))
    return out


def subset_of_range(vectors: DataFrame, start: int, count: int) -> DataFrame:
    """The vectors of ids start to start + count - 1; an error if some are not there."""
    rows = vectors.where(F.col("vid").between(start, start + count - 1))
    if start < 0 or count < 0 or rows.count() != count:
        raise ValueError(f"ids {start} to {start + count - 1} are not all there")
    return rows


def subset_of_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """pos and the vector of each row of ids (pos, vid), which may repeat; an error if one is not there."""
    rows = ids.select("pos", "vid").join(vectors, "vid", "left")
    if not rows.where("vec IS NULL").isEmpty():
        raise ValueError("some ids are not there")
    return rows


def read_dataset(spark: SparkSession, config: str, name: str) -> dict[str, DataFrame]:
    """base, query, gt and train (where they are named) of a data set in a JSON registry.

    ``{"root_dir": ..., "datasets": {name: {"dataset_dir": ..., "base_path": ..., "query_path": ..., "gt_path": ..., "train_path": ...}}}``;
    ``$HOME`` and ``~`` are replaced, and the kind of a file is its ending.
    """
    about = json.loads("\n".join(r.value for r in spark.read.text(config).collect()))  # a short file
    if name not in about.get("datasets", {}):
        raise ValueError(f"unknown data set: {name!r}")
    entry = about["datasets"][name]
    folder = os.path.join(about.get("root_dir", ""), entry.get("dataset_dir", ""))
    out = {}
    for key in ("base", "query", "gt", "train"):
        if file := entry.get(f"{key}_path"):
            place = os.path.expanduser(os.path.expandvars(os.path.join(folder, file)))
            out[key] = spark.read.parquet(place) if place.endswith(".parquet") else read_vecs(spark, place, place.rpartition(".")[2])
    missing = [k for k in ("base", "query", "gt") if k not in out]
    if missing:
        raise ValueError(f"the data set {name!r} names no {', '.join(missing)}")
    return out

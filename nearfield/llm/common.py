"""Helpers shared by the training-data operators: scratch tables, text chunks, word arrays."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space (space, tab to carriage return).
SPACE = " \t\n\x0b\x0c\r"
#: A task works on slices of about this many bytes of text, whatever the Arrow batch holds.
CHUNK_BYTES = 2 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this application below ``spark.checkpoint.dir``; in a temporary one, where that is unset, only on one machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/nearfield-{sc.applicationId}"


_registered: set[str] = set()


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _registered:
        return
    _registered.add(folder)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session has gone
            pass

    atexit.register(drop)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    _drop_at_exit(spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that no later step reads."""
    spark = tables[0].sparkSession
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns what a worker has freed to the system: workers are reused, and the next stage's task starts beside it."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def chunks(batches, column: int = 1, max_bytes: int = CHUNK_BYTES):
    """Slices record batches so that the text column of each slice holds about ``max_bytes``; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(size) // max_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)
    give_back()


def texts_of(column) -> pa.Array:
    return pc.fill_null(column, "")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, end to end, and per text where its words start (one more entry than texts)."""
    split = pc.ascii_split_whitespace(texts)
    flat, offsets = split.flatten(), np.asarray(split.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        offsets = before[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers, wrapping."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(64).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in SPACE]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64; those for usual slices are kept."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        made = []
        for factor in (_ODD, _BACK):
            row = np.full(size, factor, dtype=np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        _powers[size] = (made[0], made[1])
    return _powers[size]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (no nulls), end to end, and where each text's words start.

    A word's hash is a polynomial of its bytes, from differences of prefix sums, and mixed.
    """
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or ends[-1] == ends[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    n = len(data)
    inside = ~_BLANK[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[ends] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, back = _powers_to(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, ends)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each word the row it is of."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def n_words(text) -> "F.Column":
    """Number of words of a text column, in the JVM; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def to_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

"""Vectorised text hashing, shared scratch tables and the batch exchange.

Words are the maximal runs of bytes other than space and 0x09-0x0D.  All
hashing is done on whole Arrow buffers with numpy: a word's fingerprint is a
polynomial over random per-byte values, read off one running sum, so the cost
is a few array passes over the bytes and no Python object per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
BLOCK = 1 << 18
BATCH_BYTES = 8 << 20
SLICE_BYTES = 2 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _tables(seed: int):
    if seed not in _TABLES:
        rng = np.random.Generator(np.random.PCG64(1_000_003 + seed))
        values = rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
        base = int(rng.integers(1, 1 << 62)) * 2 + 1
        up = np.full(BLOCK + 1, base, dtype=np.uint64)
        down = np.full(BLOCK + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _TABLES[seed] = values, np.cumprod(up), np.cumprod(down), base
    return _TABLES[seed]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per row the index of its first word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprint of each byte range; memory is bounded by BLOCK."""
    values, up, down, base = _tables(seed)
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        at = int(starts[i])
        j = max(int(np.searchsorted(ends, at + BLOCK, "right")), i + 1)
        if int(ends[j - 1]) - at <= BLOCK:
            seg = data[at : ends[j - 1]]
            run = np.zeros(len(seg) + 1, dtype=np.uint64)
            np.cumsum(values[seg] * up[: len(seg)], out=run[1:])
            s = starts[i:j] - at
            out[i:j] = (run[ends[i:j] - at] - run[s]) * down[s]
        else:
            total, scale = 0, 1
            for k in range(at, int(ends[i]), BLOCK):
                seg = data[k : min(k + BLOCK, int(ends[i]))]
                total += int((values[seg] * up[: len(seg)]).sum(dtype=np.uint64)) * scale
                scale = scale * pow(base, BLOCK, 1 << 64) % (1 << 64)
            out[i] = total % (1 << 64)
            j = i + 1
        i = j
    return mix64(out)


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ordered combination of two fingerprint arrays."""
    return mix64(left * U64(0x9E3779B97F4A7C15) + right * U64(0xC2B2AE3D27D4EB4F))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most `limit` text bytes, or one row."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        if batch.num_rows == 0:
            continue
        _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(int(np.searchsorted(off, off[i] + limit, "right")) - 1, i + 1)
            yield batch.slice(i, j - i)
            i = j


def col(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def ids_of(column) -> list:
    return column.to_pylist()


def bit(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns, whatever their names, are left out."""
    return df.select(*names)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    Where no folder is configured a local session (as in tests) gets one, so that
    every later caller agrees on it; a cluster, whose machines would each use a
    folder of their own, gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    MADE.append(path)
    return path


#: Folders and (as table:name) tables that this process has made and not yet removed.
MADE: list[str] = []


def cleanup(spark: SparkSession) -> None:
    """Remove all intermediate folders and tables; call it once the results that read them are written."""
    while MADE:
        name = MADE.pop()
        if name.startswith("table:"):
            spark.sql(f"DROP TABLE IF EXISTS {name.removeprefix('table:')}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_blas_thread() -> None:
    """Keep numpy's products in this worker on one core; Spark runs a worker a core, and small products lose by threads."""
    import ctypes
    from pathlib import Path

    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

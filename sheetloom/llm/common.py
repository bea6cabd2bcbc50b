"""Shared plumbing: Arrow batch slicing, vectorised text hashing, checkpoints."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that a Python kernel holds at once (a longer single text is held whole).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only in local mode without one (tests) make a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ckpt"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most `limit` bytes of text, of one row at least."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def map_text(
    df: DataFrame,
    kernel: Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]],
    fields: list[T.StructField],
    keep: list[str],
    column: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """One output row per input row: the columns in `keep` (an output field of the same name replaces it), then `fields`."""
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in sliced(batches, column, limit):
            out = kernel(batch)
            cols = [batch.column(c) for c in keep] + [out[f.name] for f in fields]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


# Multiplicative hashing modulo 2**64 over prefix sums: the hash of any slice of a sequence costs two look-ups.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    p, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p[: len(codes)], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices [starts, ends) of the sequence behind `sums`, lengths included."""
    _, inv = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions in `data`) and n + 1 row bounds of the maximal runs of word bytes; no run crosses rows."""
    m = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, m[:-1]
        after[-1], after[:-1] = False, m[1:]
    starts = np.flatnonzero(m & (~before | first[:-1]))
    ends = np.flatnonzero(m & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes outside [\x20\x09-\x0D].
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of the positions 0..n-1 that lie in any [start, end)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed out of an operator's way, and the renaming that takes them back."""
    back = {f"__own_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def parts_for(df: DataFrame, floor: int = 1) -> int:
    """Shuffle partitions of the session, at least `floor`."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def stash(df: DataFrame) -> DataFrame:
    """Write a table (compressed, columnar) to the shared checkpoint folder and read it back: cuts lineage like cut().

    Shuffle files go when the driver's garbage collector finds their plans unused, so it is asked to look.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stash-{uuid.uuid4().hex}"
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(*tables: DataFrame) -> None:
    """Delete tables of stash() that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            if at.getName().startswith("stash-"):
                at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

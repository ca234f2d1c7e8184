"""What the training-data operators share: the shared folder, batching by bytes, and hashing of byte buffers."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from silexa.session import shared_folder

#: Python-side kernels look at this many text bytes at once, however large the Arrow batch is.
CHUNK_BYTES = 4 << 20


_BLANK = re.compile(rb"[\x20\x09-\x0D]")

#: With this setting a write leaves no shuffle files behind; it is on while an intermediate table is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; ``delete`` takes it away."""
    return f"{shared_folder(spark)}/silexa/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.silexa_path = path
    if _SCOPES:
        _SCOPES[-1].append(path)
    return out


class scratch:
    """A scope whose intermediate tables are deleted at its end, but for those that are kept because its result reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scratch:
        _SCOPES.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        _SCOPES[-1].remove(df.silexa_path)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(df.silexa_path)
        return df

    def drop(self, df: DataFrame) -> None:
        """Delete what nothing reads any more before the scope ends."""
        _SCOPES[-1].remove(df.silexa_path)
        delete(self.spark, df.silexa_path)

    def __exit__(self, *_) -> None:
        for path in _SCOPES.pop():
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of the caller's table has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each; one longer text is a chunk by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(lengths(values), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def spans_of(raw: bytes, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A text in stretches of about ``limit`` bytes, cut at a blank or a tab to carriage return."""
    at = 0
    while len(raw) - at > limit:
        cut = _BLANK.search(raw, at + limit)
        if not cut:
            break
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:]


def words_of(raw: bytes, limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text (what stands between blanks and tab to carriage return), about ``limit`` bytes at a time."""
    for span in spans_of(raw, limit):
        yield span.split()


def lengths(values: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buffer_of(values: pa.Array, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array (with ``pad`` zero bytes behind), and the n+1 offsets; null counts as empty."""
    size = lengths(values)
    offsets = np.concatenate([[0], np.cumsum(size)])
    joined = b"".join(x for x in values.cast(pa.binary() if not pa.types.is_large_string(values.type) else pa.large_binary()).to_pylist() if x)
    out = np.zeros(len(joined) + pad, dtype=np.uint8)
    out[: len(joined)] = np.frombuffer(joined, dtype=np.uint8)
    return out, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _POWERS:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            out.append(p)
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def powers(n: int) -> np.ndarray:
    """``n`` powers or more of the base of the range hashes."""
    return _powers(n)[0]


class RangeHash:
    """64-bit hashes of arbitrary ranges of one byte buffer, each in constant time, from prefix sums of a polynomial.

    Two independent byte maps (``salt``) give two hashes; together they make a 128-bit digest.
    """

    def __init__(self, data: np.ndarray, salt: int = 0):
        ranks = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(salt << 20))
        self.power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(ranks[data] * self.power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

"""Shared kernels: words of whole texts as flat byte arrays, 64-bit hashes of word runs, shared scratch tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and the controls 09 to 0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Most bytes of text a kernel holds at once, unless a single document is longer.
CHUNK = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser of full avalanche."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(256, dtype=np.uint64), 11)
#: Odd multipliers and their inverses modulo 2**64, for bytes, word runs, and a second hash of word runs.
BASES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASES[which]**i and its inverse for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size, out = max(1 << 16, n + n // 8), []
        for b in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = out[0], out[1]
        if size <= 4 * CHUNK:
            _powers[which] = have
    return have[0][:n], have[1][:n]


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A hash of each run values[start:end] that does not depend on where the run stands."""
    p, inverse = powers(which, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64), which)


class Words:
    """The words of several texts: bytes holds each word and one space; word i is bytes[at[i]:at[i+1]-1], of text doc[i]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        inside = ~SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        start = np.flatnonzero(first)
        word = np.cumsum(first, dtype=np.int64)[inside] - 1
        kept = buf[inside]
        self.n_docs = len(off) - 1
        self.bytes = np.full(len(kept) + len(start), 32, np.uint8)
        self.bytes[np.arange(len(kept)) + word] = LOWER[kept] if lower else kept
        self.at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=len(start)) + 1, out=self.at[1:])
        self.doc = np.searchsorted(off, start, "right") - 1
        self.begin = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    @property
    def hashes(self) -> np.ndarray:
        return runs(BYTE[self.bytes], self.at[:-1], self.at[1:] - 1, 0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and offsets.size else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `size` bytes of text each, with bytes and offsets."""
    if not batch.num_rows:
        return
    buf, off = flat(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_ = f"file://{tempfile.gettempdir()}/tessera-checkpoints"
        spark.conf.set("spark.checkpoint.dir", set_)
    return set_


_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def mark() -> int:
    """How many scratch tables there are, for release()."""
    return len(_written)


def release(before: int) -> None:
    """Deletes the scratch tables since mark() but the last, whose rows no longer need them."""
    gone, _written[before:-1] = _written[before:-1], []
    for spark, path in gone:
        delete(spark, path)


def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended  # noqa: BLE001
            return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fanout(df: DataFrame, bytes_: int, each: int) -> int:
    """Partitions for so many bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // each))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0

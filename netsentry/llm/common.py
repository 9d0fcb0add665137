"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows instead of the default 10,000: with whole texts in the
    rows, a batch is held by the JVM and by Python at once. A caller's own setting stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def release() -> None:
    """Give freed memory back to the system, which a reused Python worker else keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; other columns are never read."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage,
    survives lost executors, and is computed once however often it is used."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but ``own`` under a plain number, so that no name an operator
    makes can clash with it, and the function that brings the columns and names back."""
    names = docs.columns
    plain = [n if n in own else f"_{k}" for k, n in enumerate(names)]
    return docs.toDF(*plain), lambda out: out.select(*(F.col(p).alias(n) for p, n in zip(plain, names)))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def id_remainder(c: Column, n: int) -> Column:
    """crc32 of the id's text, modulo ``n``."""
    return F.crc32(c.cast("string")) % n


def utf8(text: str | None) -> bytes:
    """A text's UTF-8 bytes (null: empty)."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys (the splitmix finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(words: list[bytes], step: int = 1 << 16) -> np.ndarray:
    """A 64-bit key for each word, ``step`` words at a time."""
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(words), step):
        part = words[lo:lo + step]
        size = np.fromiter(map(len, part), np.int64, len(part))
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(part), np.uint8)
        at = np.arange(len(data), dtype=np.int64) - np.repeat(start, size)
        powers = _powers(int(size.max()))
        out.append(mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[at], start) + size.astype(np.uint64)))
    return np.concatenate(out)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct keys of the ``width``-word shingles; with fewer words,
    the whole sequence as one; without words, nothing."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    w = min(width, n)
    key = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        key = key * _ODD + hashes[k:n - w + 1 + k]
    return np.unique(mix(key))


def regroup(batches: Iterable[pa.RecordBatch], rows: int = 4096, size: int = 4 << 20,
            column: str = "text") -> Iterator[pa.Table]:
    """Arrow batches joined or split to at most ``rows`` rows, closed early
    once ``column`` holds ``size`` bytes: bounds what a task holds at once."""
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            held.append(part)
            n += part.num_rows
            held_bytes += part.column(part.schema.get_field_index(column)).get_total_buffer_size() * 512 // max(batch.num_rows, 512)
            if n >= rows or held_bytes >= size:
                yield pa.Table.from_batches(held)
                held, n, held_bytes = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
    del held
    release()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

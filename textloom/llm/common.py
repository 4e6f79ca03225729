"""Shared helpers: session settings, Arrow text access, vectorised words, tables in the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may carry to a Python worker; long texts make the second bound the one that counts.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
CHUNK_ROWS = 4096

_U = np.uint64
_MIX1, _MIX2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and by bytes, so that very long texts cannot exhaust a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for top in {re.sub(r"/part-[^/]*$", "", f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(conf).delete(path, True)


def released() -> None:
    """Give memory that Python, NumPy and Arrow hold but no longer use back to the system: the driver keeps it for the rest of the session otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, null texts as empty ones; every other column is left in storage."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte buffer and n + 1 offsets, without making Python strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def text_chunks(batch: pa.RecordBatch, limit: int = 2 << 20, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of about ``limit`` bytes and at most ``CHUNK_ROWS`` rows, whole texts each."""
    buf, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    n, i = len(off) - 1, 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1), i + CHUNK_ROWS)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    x = x ^ (x >> _U(30))
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


def _random_words(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U) * _GOLD) + _U(seed))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
_VALUE = _random_words(256, 12345)[LOWER]  # upper and lower case of A-Z share a value
_BASE = _U(0x2545F4914F6CDD1D)
_powers = np.ones(1, _U)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        p = np.full(size, _BASE, _U)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def words_of(buf: np.ndarray, off: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of maximal runs of bytes for which ``word_byte`` holds; no run crosses documents."""
    if not len(buf):
        e = np.empty(0, np.int64)
        return e, e, e
    m = word_byte[buf]
    s = m.copy()
    s[1:] &= ~m[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    s[first] = m[first]
    e = m.copy()
    e[:-1] &= ~m[1:]
    last = off[1:][off[:-1] < off[1:]] - 1
    e[last] = m[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased (A-Z) word: a polynomial of random byte values, then mixed."""
    if not len(starts):
        return np.empty(0, _U)
    lens = ends - starts
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    total = int(first[-1] + lens[-1])
    inside = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    at = inside + np.repeat(starts, lens)
    v = _VALUE[buf[at]]
    v *= _powers_to(int(lens.max()))[inside]
    return mix(np.add.reduceat(v, first) + lens.astype(_U) * _GOLD)


def beginning_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """``word_hashes`` of the words and, for each of ``sizes``, of the first bytes of those that are longer; each byte is taken once."""
    if not len(starts):
        return [np.empty(0, _U)] * (1 + len(sizes))
    lens = ends - starts
    first = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=first[1:])
    inside = np.arange(first[-1], dtype=np.int64)
    inside -= np.repeat(first[:-1], lens)
    at = inside + np.repeat(starts, lens)
    sums = np.zeros(len(at) + 1, _U)
    np.cumsum(_VALUE.take(buf.take(at)) * _powers_to(int(lens.max())).take(inside), out=sums[1:])  # differences hold modulo 2^64
    before = sums[first[:-1]]
    out = [mix(sums[first[1:]] - before + lens.astype(_U) * _GOLD)]
    for k in sizes:
        longer = np.flatnonzero(lens > k)
        out.append(mix(sums[first[longer] + k] - before[longer] + np.full(1, k, _U) * _GOLD))
    return out


def byte_class(spec: str) -> np.ndarray:
    """A table of 256 booleans from a bytes class such as ``0-9a-z\\x80-\\xff``."""
    rx = re.compile(b"[" + spec.encode("ascii") + b"]")
    return np.array([bool(rx.match(bytes([b]))) for b in range(256)])


#: Fixed by the contracts: words of the similarity join and of decontamination (after lower-casing A-Z).
SPACED_WORD = ~byte_class(r"\x20\x09-\x0d")
ALNUM_WORD = ~byte_class(r"\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f")

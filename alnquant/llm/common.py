"""Shared plumbing: tables in the cluster's shared folder and vectorised text hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK = 1 << 20  # bytes of text that one vectorised step handles at a time


# ---------------------------------------------------------------- shared tables


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a private one only where that is unset (tests, local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="alnquant-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(__import__("shutil").rmtree, root[7:], True)
    return root.rstrip("/")


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._alnquant_path = path
    return out


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """While tables of large rows are made: so many rows at most go to Python at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`save` that no later step reads."""
    for df in frames:
        path = getattr(df, "_alnquant_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def parts_for(df_bytes: int, spark: SparkSession, per: int = 24 << 20) -> int:
    """Shuffle partitions so that each holds about ``per`` bytes, and never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(df_bytes) // per))


def arrow_schema(ddl: str):
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_key() -> F.Column:
    return F.col("doc_id")


# ---------------------------------------------------------------- what a worker keeps between tasks

HELD: dict[str, object] = {}  # by operator: a function that frees what its tasks leave for the next ones
_holder = ""


def serve(operator: str = "") -> None:
    """Python workers outlive their tasks: when one turns to another operator, what the ones before left there goes."""
    global _holder, _POW, _INV
    if operator == _holder:
        return
    for name, free in HELD.items():
        if name != operator:
            free()
    _POW, _INV = np.ones(1, U64), np.ones(1, U64)
    _holder = operator
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- Arrow text as numpy


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the offsets of its rows (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, o - o[0]


def pieces(batches, column: str = "text", size: int = CHUNK, operator: str = ""):
    """Record batches cut at row boundaries so that each has about ``size`` bytes of text (one longer row stands alone)."""
    serve(operator)
    for b in batches:
        if not b.num_rows:
            continue
        _, o = text_buffer(b.column(column))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(o, o[at] + size, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


# ---------------------------------------------------------------- hashing

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = U64(0x9E3779B97F4A7C15)
_BI = U64(pow(int(_B), -1, 1 << 64))
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, kept from call to call."""
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POW = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, _B, U64))])
            _INV = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, _BI, U64))])
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64), so that every bit of the result depends on all of ``h``."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_WORD = np.ones(256, bool)  # words are runs of bytes other than these
SPACE_WORD[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = True):
    """(start, end, hash) of every word, and the offsets of each row's first word.  A word never crosses rows."""
    s, e, first = spans(buf, offs, table)
    return s, e, span_hash(buf, s, e, lower), first


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """(start, end) of every word, and the offsets of each row's first word."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = table[buf]
    cuts = offs[(offs > 0) & (offs < n)]
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, m[:-1]
    prev[cuts] = False
    nxt = np.empty(n, bool)
    nxt[-1], nxt[:-1] = False, m[1:]
    nxt[cuts - 1] = False
    s, e = np.flatnonzero(m & ~prev), np.flatnonzero(m & ~nxt) + 1
    return s, e, np.searchsorted(s, offs)


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hash of the bytes of each span."""
    pw, inv = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum((_BYTE[LOWER] if lower else _BYTE)[buf] * pw[: len(buf)], out=c[1:])
    return mix((c[e] - c[s]) * inv[s] + (e - s).astype(U64))


_GRAM = _rng.integers(0, 1 << 63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (the last k-1 positions are left out; rows are not looked at)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += h[j : j + n] * (_GRAM[j] if k <= 64 else U64(pow(int(_GRAM[0]), j + 1, 1 << 64)))
    return mix(out + U64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now rather than at some later garbage collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def rows_of(batches):
    """Rows of record batches as dictionaries, one at a time."""
    serve()
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]

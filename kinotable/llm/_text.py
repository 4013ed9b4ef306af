"""What the text operators share: byte-level word splitting over Arrow batches, and where tables are cut.

Words are found on UTF-8 bytes. Every byte of a code point above 0x7F is itself above 0x7F, so a class that holds all
of those code points and some ASCII ones splits bytes exactly as it splits characters.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z (after LOWER) and everything above ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

#: Text bytes that a vectorised step takes at once, unless one text alone is longer.
SLICE_BYTES = 1 << 19

#: Has Spark remove the shuffle files of a query once it is done, which else stay until the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: About how many bytes Python workers get at once, where short_batches() was called; Spark's own limit is 10,000 rows, whose texts the executor and its workers hold several times over.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Where settled tables go within passing().
_passing: ContextVar[str | None] = ContextVar("passing", default=None)

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its values; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words (runs of the bytes marked in `word`), and the number of words before each text; no word crosses texts."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = word[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from prefix sums of byte * base**position, shifted back to position 0 and mixed."""
    if len(_powers[0]) <= len(low):
        n = max(len(low) + 1, SLICE_BYTES + 1)
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(low)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that sums of hashes stay well spread."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, without copies, so that what is made of a piece stays small; in the end, memory that this made free goes back to the system, as the worker lives on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trimmed()


def trimmed() -> None:
    """Gives memory that this process doesn't use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. On one machine, as in tests, a folder of its own if that is unset; elsewhere an error."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def removed(spark: SparkSession, folder: str) -> None:
    """Removes a folder of whatever file system holds it, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Within it, settled tables go to a folder of their own, which is removed at the end: what they lead to must be written by then."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    token = _passing.set(folder)
    try:
        yield
    finally:
        _passing.reset(token)
        removed(spark, folder)


@contextlib.contextmanager
def restored(spark: SparkSession, key: str) -> Iterator[None]:
    """A setting of the session is put back at the end."""
    old = spark.conf.get(key, None)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """DataFrames that are made and run within it leave no shuffle files, so each runs once."""
    with restored(spark, _TIDY):
        spark.conf.set(_TIDY, "true")
        yield


def short_batches(spark: SparkSession) -> None:
    """Python workers get batches of about BATCH_BYTES from now on, or of one row, unless the session has a limit of its own. It stays set, as rows are made only when they are read."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def forgotten(df: DataFrame) -> None:
    """Removes what settled() or counted() wrote, of which nothing is read any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that no later step or lost executor computes them again."""
    return counted(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As settled(), with the number of rows, which the writing tasks count."""
    spark, seen = df.sparkSession, Observation()
    path = f"{_passing.get() or shared_folder(spark)}/{uuid.uuid4().hex}"
    with tidy(spark):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]

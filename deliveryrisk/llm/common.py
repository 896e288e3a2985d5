"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deliveryrisk.functions.materialize import ensure_checkpoint_dir

# The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor never repeats the work before it. While it is
    written, batches sent to Python tasks hold at most ``BATCH_BYTES``, so pairs
    of long texts do not fill an executor's memory.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Cut a batch of texts into row ranges of about ``most`` bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, n in enumerate(byte_lengths(texts).tolist()):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def sliced_texts(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """The row ranges of ``text_slices`` with their texts as UTF-8 bytes; null counts as empty."""
    for lo, hi in text_slices(texts):
        part = texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()
        yield lo, hi, [b"" if t is None else t for t in part]


def byte_lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        forth = np.full(size, _BASE, dtype=np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        forth[0] = back[0] = 1
        _POWERS[size] = (np.cumprod(forth, dtype=np.uint64), np.cumprod(back, dtype=np.uint64))
    return _POWERS[size]


class Words(NamedTuple):
    """Words of some texts joined by a space: where they lie, their hashes, and how many each text has."""

    buf: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def find_words(texts: list[bytes], gap: np.ndarray = _IS_SPACE) -> Words:
    """Words of the lower-cased texts with 64-bit hashes (a polynomial of random byte values, then mixed).

    ``gap`` marks the byte values between words; the space must be one of them.
    """
    buf = _LOWER[np.frombuffer(b" ".join(texts), dtype=np.uint8)]
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    edge = np.diff(np.concatenate(([True], gap[buf], [True])).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    forth, back = _powers(buf.size + 1)
    total = np.zeros(buf.size + 1, dtype=np.uint64)
    np.cumsum(_VALUE[buf] * forth[: buf.size], out=total[1:])
    hashes = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    text_end = np.cumsum(lengths + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(begin, text_end))))
    return Words(buf, begin, end, hashes, counts)

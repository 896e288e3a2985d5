"""Pack tokenised texts into sequences along a space-filling curve.

A text's counts of byte pairs, as hashed vector, are projected to ``DIMENSIONS``
numbers; the position of that point on a Hilbert curve is its key. Texts are range-sorted by
key, so neighbours on the curve lie together, and each range is cut into
sequences of ``LENGTH`` tokens in that order. The texts are tokenised once, in
their final place, and only texts are shuffled. Equal texts have equal keys;
the id's hash follows the key in the sort, so a large group of copies is dealt
to several ranges.

A range's last tokens form sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import mix, sliced_texts, table, text_slices

LENGTH = 1024
SEPARATOR = 0
DIMENSIONS = 4
BITS = 15
TOKENIZER = "byte_bpe_50k.tiktoken"
NAMED = "byte_bpe_50k.json"
# Texts with so much white space in a row go to the named tokenizer.
LONG_BLANK = 1000


def tokenizer_path() -> str:
    """The vocabulary of byte_bpe_50k.json as ranks, by which most texts are encoded four times as fast."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def named_tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(NAMED))


def sign_table() -> np.ndarray:
    """For every byte pair a fixed random bit in each dimension, two dimensions to a 64-bit number."""
    at = mix(np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    bits = [(at >> np.uint64(i)) & np.uint64(1) for i in range(DIMENSIONS)]
    return np.stack([bits[i] | bits[i + 1] << np.uint64(32) for i in range(0, DIMENSIONS, 2)])


_SIGNS = sign_table()


def points(texts: list[bytes]) -> np.ndarray:
    """Mean of the random bits over a text's byte pairs: its pair counts, projected; from 0 to 1."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n\n", dtype=np.uint8).astype(np.uint16)
    pair = (buf[:-1] << np.uint16(8)) | buf[1:]
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(lengths + 1) - lengths - 1
    found = []
    for table_ in _SIGNS:
        total = np.zeros(pair.size + 1, dtype=np.uint64)
        np.cumsum(table_[pair], out=total[1:])
        sums = total[begin + lengths] - total[begin]
        found += [sums & np.uint64(0xFFFFFFFF), sums >> np.uint64(32)]
    return np.stack(found, axis=1).astype(np.float64) / np.maximum(lengths, 1)[:, None]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows) with ``bits`` bits in each dimension.

    Skilling's transform: undo the rotations from the highest bit down, then
    interleave the bits of the Gray-coded axes.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(x.shape[0], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(x.shape[0], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Curve position of each text."""
    side = 1 << BITS
    return hilbert_keys(np.minimum(np.floor(points(texts) * side), side - 1))


def keyed(texts: pa.Array) -> pa.Array:
    parts = [curve_keys(values) for _, _, values in sliced_texts(texts)]
    return pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())


def encoder(path: str, named: str) -> Callable[[str], Sequence[int]]:
    """Function from a text to its ids in the tokenizer file ``named``.

    Ids come from the rank file ``path`` of the same vocabulary, but for texts in
    which the two differ: those that hold an added token of the file, which it
    matches in plain text too, and those with long white space, on which the
    faster library runs out of stack.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(named)
    added = [token.content for token in exact.get_added_tokens_decoder().values()]
    blank = re.compile(rf"\s{{{LONG_BLANK}}}")

    def encode(text: str) -> Sequence[int]:
        if any(token in text for token in added) or blank.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def tail_lengths(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_range(path: str, named: str, length: int = LENGTH):
    """Task function: pieces of the texts of one range, in order.

    Full sequences are written as they fill. The last, partial one is held back
    until the range ends and is then cut into powers of two. Sequence numbers
    start at the range's number times 2^40.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, named)
        sequence, filled = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []  # pieces of the sequence that is being filled, with their ids
        end = np.array([SEPARATOR], dtype="<u4").tobytes()

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            columns = list(zip(*pieces, strict=True)) if pieces else [[] for _ in names]
            kinds = [doc_type, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

        def closed(pieces: list[tuple]) -> list[tuple]:
            return [(d, s, len(ids) // 4, zlib.crc32(ids), n, q, o) for d, s, ids, n, q, o in pieces]

        doc_type = pa.int64()
        for batch in batches:
            ids_in = batch.column("doc_id")
            doc_type = ids_in.type
            column = batch.column("text")
            for lo, hi in text_slices(column):
                out: list[tuple] = []
                texts, ids = (c.slice(lo, hi - lo).to_pylist() for c in (column, ids_in))
                for doc, text in zip(ids, texts, strict=True):
                    coded = array("I", encode(text or "")).tobytes() + end
                    total, start = len(coded) // 4, 0
                    while start < total:
                        take = min(total - start, length - filled)
                        held.append((doc, start, coded[4 * start : 4 * (start + take)], total, sequence, filled))
                        start += take
                        filled += take
                        if filled == length:
                            out += closed(held)
                            held, filled, sequence = [], 0, sequence + 1
                yield rows(out)
        left = tail_lengths(filled)
        out, room, used = [], (left.pop(0) if left else 0), 0
        for doc, start, coded, total, _, _ in held:
            at, n = 0, len(coded) // 4
            while at < n:
                take = min(n - at, room - used)
                out.append((doc, start + at, coded[4 * at : 4 * (at + take)], total, sequence, used))
                at += take
                used += take
                if used == room:
                    sequence, used, room = sequence + 1, 0, (left.pop(0) if left else 0)
        if out:
            yield rows(closed(out))

    return run


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, named: str | None = None
) -> DataFrame:
    """Pieces of texts in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and has its separator only. Repeated rows and
    null ids are packed like any others. The number of ranges is that of the
    session's shuffle partitions.
    """
    spark = docs.sparkSession
    key = F.arrow_udf(keyed, "long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sorted_rows = (
        rows.withColumn("key", key("text"))
        .withColumn("deal", F.xxhash64("doc_id"))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "deal")
        .sortWithinPartitions("key", "deal")
        .select("doc_id", "text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return sorted_rows.mapInArrow(pack_range(path or tokenizer_path(), named or named_tokenizer_path()), schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Benchmark passages in training texts, found by an FM-index of each shard.

Words of the lower-cased texts become numbers of their shard, and every shard of
about ``SHARD_WORDS`` words gets an index (``phrase_index``), written as a row
of a table. A text longer than that is cut into pieces that overlap by a
window's length less one word, so no window is lost and no shard grows with a
text. Every window of ``WINDOW`` words of the benchmark is searched backwards in
every shard, its occurrences are located, and the words they cover are merged to
removal spans. Pairs of window and item are dealt to blocks of about ``BLOCK``;
a block is sent to the tasks, and every block searches the stored indexes, so
neither texts nor indexes are made anew for a larger benchmark.

Nothing is shuffled but the findings of cut texts; with more than one block,
those of all texts, which hold no text. Words are compared by 64-bit hashes.

Defined cases: null and empty texts have no words and no hits. An item without
words is never found; an item with fewer words than a window is one window.
Rows of one item_id are one item with the windows of all its rows; a null
item_id counts as one item and is written as the empty text. Equal documents
are found alike, every row is returned once, other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliveryrisk.llm import phrase_index
from deliveryrisk.llm.common import ascii_lower, find_words, free_name, stored, table

WINDOW = 10
SHARD_WORDS = 1 << 20
PIECE_BYTES = 4 << 20
BLOCK = 1 << 18
# Words are runs of these; A-Z is lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_GAP = np.ones(256, dtype=bool)
_GAP[ord("0") : ord("9") + 1] = False
_GAP[ord("A") : ord("Z") + 1] = False
_GAP[ord("a") : ord("z") + 1] = False
_GAP[128:] = False


# --- indexes of shards ---


class Piece(NamedTuple):
    """Word hashes of a text or of a piece of a long one; ``start`` words come before it."""

    row: int
    start: int
    last: bool
    words: np.ndarray


def slices(text: bytes) -> Iterator[bytes]:
    """A text cut between words, so that hashing a long one takes bounded memory."""
    lo = 0
    while len(text) - lo > PIECE_BYTES:
        hi = lo + PIECE_BYTES
        gaps = np.flatnonzero(_GAP[np.frombuffer(text, dtype=np.uint8, count=PIECE_BYTES, offset=lo)])
        while not gaps.size and hi < len(text):  # one very long word
            gaps = np.flatnonzero(_GAP[np.frombuffer(text, dtype=np.uint8, count=min(PIECE_BYTES, len(text) - hi), offset=hi)])
            gaps, hi = gaps + (hi - lo), hi + PIECE_BYTES
        if not gaps.size:
            break
        cut = lo + int(gaps[-1]) + 1
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def pieces(row: int, text: bytes) -> Iterator[Piece]:
    """A text's words in pieces of at most SHARD_WORDS, overlapping by a window less one word."""
    held, start = np.empty(0, dtype=np.uint64), 0
    for part in slices(text):
        held = np.concatenate((held, find_words([part], _GAP).hashes))
        while len(held) > SHARD_WORDS:
            yield Piece(row, start, False, held[:SHARD_WORDS])
            step = SHARD_WORDS - WINDOW + 1
            held, start = held[step:], start + step
    yield Piece(row, start, True, held)


def batch_pieces(row: int, texts: list[bytes]) -> Iterator[Piece]:
    """Pieces of consecutive rows, in order; short texts are hashed together."""
    lo = 0
    while lo < len(texts):
        if len(texts[lo]) > PIECE_BYTES:
            yield from pieces(row + lo, texts[lo])
            lo += 1
            continue
        hi, size = lo, 0
        while hi < len(texts) and size + len(texts[hi]) <= PIECE_BYTES:
            size += len(texts[hi])
            hi += 1
        found = find_words(texts[lo:hi], _GAP)
        edges = np.concatenate(([0], np.cumsum(found.counts)))
        for i in range(lo, hi):
            words = found.hashes[edges[i - lo] : edges[i - lo + 1]]
            if len(words) > SHARD_WORDS:
                yield from pieces(row + i, texts[i])
            else:
                yield Piece(row + i, 0, True, words)
        lo = hi


def shard_row(held: list[Piece], part: str) -> dict:
    """The index of some pieces with what is needed to name their words again."""
    hashes = np.concatenate([p.words for p in held])
    counts = np.array([len(p.words) for p in held], dtype=np.int64)
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(counts + 1) - 1
    numbers = np.zeros(len(hashes) + len(held), dtype=np.int64)
    is_word = np.ones(len(numbers), dtype=bool)
    is_word[ends] = False
    numbers[is_word] = ids + 1
    return {
        "part": part,
        "rows": [p.row for p in held],
        "starts": [p.start for p in held],
        "whole": [p.last and p.start == 0 for p in held],
        "counts": counts.tolist(),
        "vocabulary": vocabulary.tobytes(),
        "index": phrase_index.build(numbers, len(vocabulary)),
    }


SHARDS = pa.schema(
    [
        ("part", pa.string()),
        ("rows", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("whole", pa.list_(pa.bool_())),
        ("counts", pa.list_(pa.int64())),
        ("vocabulary", pa.binary()),
        ("index", pa.binary()),
    ]
)
SHARDS_DDL = (
    "part string, rows array<long>, starts array<long>, whole array<boolean>, counts array<long>, "
    "vocabulary binary, index binary"
)


def build_index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The stored indexes of a table of texts: a row for each shard, with the column ``key`` of its texts.

    A text is named by the task that read it and its number there, as they were
    written; no later scan numbers rows again.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        part, row = uuid.uuid4().hex, 0
        held: list[Piece] = []
        keys: list[pa.Array] = []
        first, words = 0, 0

        def flush() -> pa.RecordBatch:
            all_keys = pa.concat_arrays(keys)
            rows = pa.array([p.row - first for p in held], pa.int64())
            listed = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), all_keys.take(rows))
            found = pa.RecordBatch.from_pylist([shard_row(held, part)], schema=SHARDS)
            return found.append_column("keys", listed)

        for batch in batches:
            if not batch.num_rows:
                continue
            column = pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()
            keys.append(batch.column(0))
            for piece in batch_pieces(row, column):
                if held and words + len(piece.words) > SHARD_WORDS:
                    yield flush()
                    # keys of rows before the next piece's are not needed any more
                    rest = pa.concat_arrays(keys).slice(piece.row - first)
                    keys, first, held, words = [rest], piece.row, [], 0
                held.append(piece)
                words += len(piece.words)
            row += batch.num_rows
        if held:
            yield flush()

    return stored(docs.select(key, text).mapInArrow(run, f"{SHARDS_DDL}, keys array<{kind}>"))


# --- windows of the benchmark ---


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Different windows (arrays of words), each with an item that has it: columns words, item."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({WORD})"))
    listed = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words.alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    each = listed.where(n > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("words"))
    return each.distinct()


class Block(NamedTuple):
    """Windows as word hashes, padded with 0, with their lengths and their items (as runs of numbers)."""

    hashes: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    item: np.ndarray
    names: list[str]


def block_of(rows: list) -> Block:
    """Some windows with their items, for the tasks."""
    held: dict[tuple, list[str]] = {}
    for r in rows:
        held.setdefault(tuple(r["words"]), []).append(r["item"])
    lengths = np.array([len(w) for w in held], dtype=np.int64)
    found = find_words([" ".join(w).encode() for w in held], _GAP)
    hashes = np.zeros((len(held), WINDOW), dtype=np.uint64)
    hashes[np.arange(WINDOW) < lengths[:, None]] = found.hashes
    names, item = np.unique(np.array([i for items in held.values() for i in items], dtype=object), return_inverse=True)
    first = np.concatenate(([0], np.cumsum([len(items) for items in held.values()]))).astype(np.int64)
    return Block(hashes, lengths, first, item, names.tolist())


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    """All windows; about BLOCK pairs of window and item are on the driver at a time."""
    found = stored(windows(items, item_id, text))
    parts = max(1, -(-found.count() // BLOCK))
    dealt = F.pmod(F.xxhash64("words", "item"), F.lit(parts))
    for i in range(parts):
        rows = found.where(dealt == i).collect()
        if rows:
            yield block_of(rows)


# --- searching ---

FOUND_DDL = "part string, row long, whole boolean, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def occurrences(index: phrase_index.Index, vocabulary: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places in a shard where windows begin, and the numbers of these windows."""
    at = np.minimum(np.searchsorted(vocabulary, block.hashes), max(len(vocabulary) - 1, 0))
    known = (vocabulary[at] == block.hashes) if len(vocabulary) else np.zeros(block.hashes.shape, dtype=bool)
    inside = np.arange(WINDOW) < block.lengths[:, None]
    possible = (known | ~inside).all(axis=1)
    places, which = [], []
    for n in np.unique(block.lengths[possible]).tolist():
        some = np.flatnonzero(possible & (block.lengths == n))
        low, high = index.search(at[some, :n] + 1)
        many = high - low
        rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        places.append(index.locate(rows))
        which.append(np.repeat(some, many))
    if not places:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(which)


def searched(shard: dict, block: Block) -> Iterator[tuple[int, list, list[str]]]:
    """(piece, merged spans of words in the text, items) of every piece with hits."""
    vocabulary = np.frombuffer(shard["vocabulary"], dtype=np.uint64)
    counts = np.asarray(shard["counts"], dtype=np.int64)
    begin = np.cumsum(counts + 1) - counts - 1
    places, which = occurrences(phrase_index.load(shard["index"]), vocabulary, block)
    if not places.size:
        return
    # words covered by a window, then runs of them; ends of texts are never covered
    cover = np.zeros(int(begin[-1] + counts[-1]) + 2, dtype=np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + block.lengths[which], -1)
    edge = np.diff(np.concatenate(([False], np.cumsum(cover) > 0)).astype(np.int8), append=0)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(begin, lo, side="right") - 1
    hit = np.searchsorted(begin, places, side="right") - 1
    pairs = np.unique(hit * len(block.lengths) + which)
    piece, window = pairs // len(block.lengths), pairs % len(block.lengths)
    spans_from = np.searchsorted(owner, np.arange(len(counts) + 1))
    pairs_from = np.searchsorted(piece, np.arange(len(counts) + 1))
    for p in np.unique(owner).tolist():
        base = shard["starts"][p] - int(begin[p])
        s = slice(spans_from[p], spans_from[p + 1])
        spans = [{"start": a + base, "end": b + base} for a, b in zip(lo[s].tolist(), hi[s].tolist(), strict=True)]
        found = window[pairs_from[p] : pairs_from[p + 1]]
        items = np.unique(np.concatenate([block.item[block.first[w] : block.first[w + 1]] for w in found.tolist()]))
        yield p, spans, [block.names[i] for i in items.tolist()]


def search(shards: DataFrame, block: Block, every: bool) -> DataFrame:
    """Findings of one block of windows in all shards; with ``every`` also a row for each piece without any."""
    sent = shards.sparkSession.sparkContext.broadcast(block)
    kind = shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                shard = {name: one.column(name)[0].as_py() for name in SHARDS.names}
                found = {p: (spans, items) for p, spans, items in searched(shard, sent.value)}
                chosen = range(len(shard["rows"])) if every else sorted(found)
                rows = [
                    {
                        "part": shard["part"],
                        "row": shard["rows"][p],
                        "whole": shard["whole"][p],
                        "n_words": shard["starts"][p] + shard["counts"][p],
                        "spans": found.get(p, ([], []))[0],
                        "items": found.get(p, ([], []))[1],
                    }
                    for p in chosen
                ]
                if rows:
                    keys = one.column("keys").flatten().take(pa.array(list(chosen), pa.int64()))
                    yield pa.RecordBatch.from_pylist(rows, schema=FOUND).append_column("key", keys)

    return shards.mapInArrow(run, f"{FOUND_DDL}, key {kind}")


FOUND = pa.schema(
    [
        ("part", pa.string()),
        ("row", pa.int64()),
        ("whole", pa.bool_()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def merged(columns: DataFrame, kind: str) -> DataFrame:
    """One row for each text from the findings of its pieces and blocks."""

    def join(pieces_):
        import pandas as pd

        spans = sorted((s["start"], s["end"]) for row in pieces_["spans"] for s in row)
        out: list[list[int]] = []
        for a, b in spans:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        items = sorted({i for row in pieces_["items"] for i in row}, key=lambda i: i.encode())
        row = {
            "key": pieces_["key"].iloc[0],
            "n_words": pieces_["n_words"].max(),
            "spans": [{"start": a, "end": b} for a, b in out],
            "items": items,
        }
        return pd.DataFrame([row])

    schema = f"key {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    return columns.groupBy("part", "row").applyInPandas(join, schema)


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """For every row of docs: key, n_words, merged spans of hit words (start, end), items with occurring windows."""
    shards = build_index(docs, key, text)
    found, split = None, False
    for block in blocks(items, item_id, item_text):
        more = stored(search(shards, block, every=found is None))
        found, split = (more, False) if found is None else (found.unionByName(more), True)
    if found is None:
        found = stored(search(shards, block_of([]), every=True))
    kind = docs.schema[key].dataType.simpleString()
    columns = ["key", "n_words", "spans", "items"]
    # only a text in several pieces or blocks has anything to be merged
    alone = F.col("whole") if not split else F.lit(False)
    return found.where(alone).select(columns).unionByName(merged(found.where(~alone), kind).select(columns))


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with their hit words cut out of the text; other rows and columns stay as they are.

    Equal texts lose the same spans, so they are looked up by their digest, once
    for each different text with hits.
    """
    digest, spans = free_name(docs, "digest_"), free_name(docs, "spans_")
    named = docs.withColumn(digest, F.sha2(F.col(text).cast("binary"), 256))
    distinct = named.select(F.col(digest).alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
    found = find_leaks(distinct, items, "digest", "text", item_id, item_text).where(F.size("spans") > 0)
    leaks = stored(found.select(F.col("key").alias(digest), F.col("spans").alias(spans)))

    @F.pandas_udf("string")
    def cut(texts, spans_):
        import pandas as pd

        pairs = zip(texts, spans_, strict=True)
        return pd.Series([t if s is None else remove(t, [(x["start"], x["end"]) for x in s]) for t, s in pairs])

    joined = named.join(leaks, digest, "left")
    changed = F.when(F.col(spans).isNull(), F.col(text)).otherwise(cut(F.col(text), F.col(spans)))
    return joined.withColumn(text, changed).select(*docs.columns)


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of some spans and what stands between those words."""
    data, out, seen, done = text.encode(), [], 0, 0
    places: list[tuple[int, int]] = []
    offset = 0
    for part in slices(data):
        found = find_words([part], _GAP)
        lo = 0
        while lo < len(spans):
            a, b = spans[lo]
            if a >= seen + len(found.hashes) or b <= seen:
                lo += 1
                continue
            first, last = max(a - seen, 0), min(b - seen, len(found.hashes)) - 1
            places.append((offset + int(found.begin[first]), offset + int(found.end[last])))
            lo += 1
        seen += len(found.hashes)
        offset += len(part)
    for a, b in places:
        out.append(data[done:a])
        done = b
    return b"".join([*out, data[done:]]).decode()


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return leaks.select(
        F.col("key").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
  b AS (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
  i AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS words
    FROM b, LATERAL unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
  e AS (
    SELECT row, l.n, s, array_to_string(w[s : s + l.n - 1], ' ') AS words
    FROM d, (SELECT DISTINCT n FROM i) l, LATERAL unnest(range(1, len(w) - l.n + 2)) t(s)),
  o AS (SELECT e.row, e.s, e.n, i.item_id FROM e JOIN i ON i.n = e.n AND i.words = e.words),
  h AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS place FROM o) GROUP BY row),
  m AS (
    SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT row, coalesce(item_id::VARCHAR, '') AS item FROM o) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN m USING (row)
"""

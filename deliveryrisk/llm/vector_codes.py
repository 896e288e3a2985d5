"""Vector compression by product codes, with a trie over the distinct parts.

Components become integers and every vector is cut into ``PARTS`` equal parts.
Each position of a part has its own codebook, fitted by rounds of assignment and
averaging over all vectors. Equal parts are counted once: a part is written as a
key whose bytes sort like its integers, keys are counted inside each batch, sent
to ranges and summed there. So a very frequent vector costs one row for each
batch, and every range holds the sorted leaves of one piece of the trie.

A range is read in key order, the depth-first order of the trie. A node is a
prefix of a part; its distances to all entries are its parent's plus one
squared difference, computed once and shared by all leaves below. At a leaf the
smallest distance names the entry, and the part counts there with its weight.
Only the sums of the entries (positions x entries) reach the driver.

Integers saturate at +-``MOST``, so that errors fit a long; that is a component
of 32768 with the scale of 4096.

Defined cases: vectors that are null or hold null or non-finite components, or
whose length is not that of the smallest id's vector or no multiple of
``PARTS``, are dropped. A table without kept vectors gives no rows and an empty
codebook. Of repeated rows each counts and is coded. Fewer kept rows than
entries make a smaller codebook. A null id comes after all others; equal ids
are ordered by their vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import free_name, stored, table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
MOST = 1 << 27
# Totals of more labels than this are not broadcast but met by a salted join.
BROADCAST_LABELS = 1 << 16
SALTS = 32

SUMS = "position int, entry int, n long, sums array<long>"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of all components, a row for each vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64).reshape(-1, width)


def part_keys(values: np.ndarray) -> np.ndarray:
    """Position and integers of every part as bytes that sort alike: (vectors x PARTS) keys."""
    n, width = values.shape
    size = width // PARTS
    keys = np.empty((n, PARTS, 1 + 4 * size), dtype=np.uint8)
    keys[:, :, 0] = np.arange(PARTS, dtype=np.uint8)
    shifted = (values + (1 << 31)).astype(">u4").reshape(n, PARTS, size)
    keys[:, :, 1:] = np.frombuffer(shifted.tobytes(), dtype=np.uint8).reshape(n, PARTS, 4 * size)
    return keys.reshape(n * PARTS, -1)


def parts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and integers of keys."""
    numbers = np.ascontiguousarray(keys[:, 1:]).view(">u4").astype(np.int64) - (1 << 31)
    return keys[:, 0].astype(np.int64), numbers


def key_bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def distinct_parts(vectors: DataFrame, vector: str, width: int) -> DataFrame:
    """All different parts with their counts, in key order inside each range: columns key, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = part_keys(integers(batch.column(0), width))
            if len(keys):
                whole = np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").ravel()
                found, n = np.unique(whole, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.tobytes() for k in found], pa.binary()), pa.array(n, pa.int64())], ["key", "n"]
                )

    counted = vectors.select(vector).mapInArrow(count, "key binary, n long")
    ranges = counted.repartitionByRange("key").groupBy("key").agg(F.sum("n").alias("n"))
    return stored(ranges.sortWithinPartitions("key"))


def first_change(keys: np.ndarray) -> np.ndarray:
    """Trie level (0: the position) from which each sorted part leaves the path of the part before it."""
    position, numbers = parts_of(keys)
    rows = np.concatenate([position[:, None], numbers], axis=1)
    differs = rows[1:] != rows[:-1]
    level = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return np.concatenate(([0], level))


def leaf_distances(keys: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of sorted parts to all entries of their position's codebook.

    Goes down the trie level by level; ``node`` numbers each part's prefix, and
    a prefix gets its parent's distances plus one dimension's squares.
    """
    position, numbers = parts_of(keys)
    change = first_change(keys)
    heads = np.flatnonzero(change <= 0)
    node = np.cumsum(change <= 0) - 1
    distances = np.zeros((len(heads), books.shape[1]), dtype=np.int64)
    for d in range(numbers.shape[1]):
        opens = change <= d + 1
        heads = np.flatnonzero(opens)
        gap = numbers[heads, d][:, None] - books[position[heads], :, d]
        distances = distances[node[heads]] + gap * gap
        node = np.cumsum(opens) - 1
    return distances[node]


def entry_sums(keys: np.ndarray, weights: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and weighted sums of the parts that each entry is nearest to."""
    position, numbers = parts_of(keys)
    at = position * books.shape[1] + leaf_distances(keys, books).argmin(axis=1)
    n = np.zeros(PARTS * books.shape[1], dtype=np.int64)
    sums = np.zeros((PARTS * books.shape[1], numbers.shape[1]), dtype=np.int64)
    np.add.at(n, at, weights)
    np.add.at(sums, at, numbers * weights[:, None])
    return n, sums


def improved(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round over all distinct parts; unused entries stay."""
    width = 1 + 4 * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PARTS * books.shape[1], dtype=np.int64)
        sums = np.zeros((len(n), books.shape[2]), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                more = entry_sums(key_bytes(batch.column(0), width), batch.column(1).to_numpy(), books)
                n, sums = n + more[0], sums + more[1]
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used // books.shape[1], pa.int32()),
                pa.array(used % books.shape[1], pa.int32()),
                pa.array(n[used], pa.int64()),
                pa.array(sums[used].tolist(), pa.list_(pa.int64())),
            ],
            ["position", "entry", "n", "sums"],
        )

    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(books.shape[2])]
    found = parts.mapInArrow(run, SUMS).groupBy("position", "entry").agg(F.sum("n").alias("n"), *exact).collect()
    after = books.copy()
    for row in found:
        after[row.position, row.entry] = [int(row[f"s{i}"]) // row.n for i in range(books.shape[2])]
    return after


def first_entries(vectors: DataFrame, vec_id: str, vector: str) -> np.ndarray:
    """Codebooks from the parts of the smallest ids: (PARTS x entries x dimensions), or empty."""
    first = vectors.select(F.col(vec_id).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    rows = first.orderBy(F.col("i").asc_nulls_last(), "v").limit(ENTRIES).collect()
    width = len(rows[0].v) if rows else 0
    if width == 0 or width % PARTS:
        return np.empty((PARTS, 0, 0), dtype=np.int64)
    values = integers(pa.array([r.v for r in rows if len(r.v) == width], pa.list_(pa.float64())), width)
    return values.reshape(len(values), PARTS, -1).transpose(1, 0, 2).copy()


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Codebooks (PARTS x entries x dimensions of a part) after ``ROUNDS`` rounds over all usable vectors."""
    kept = vectors.where(usable(F.col(vector)))
    width = kept.select(F.min_by(F.size(vector), F.struct(F.col(vec_id).isNull(), F.col(vec_id), vector))).first()[0]
    kept = kept.where(F.size(vector) == F.lit(width))
    books = first_entries(kept, vec_id, vector)
    if books.size:
        parts = distinct_parts(kept, vector, PARTS * books.shape[2])
        for _ in range(ROUNDS):
            books = improved(parts, books)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers, by part, entry and position within the part, joined by commas."""
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def coded_values(vectors: pa.Array, books: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Codes and errors of a batch of vectors; equal parts of the batch are looked up once."""
    keys = part_keys(integers(vectors, PARTS * books.shape[2]))
    whole = np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").ravel()
    found, back = np.unique(whole, return_inverse=True)
    distances = leaf_distances(found.view(np.uint8).reshape(-1, keys.shape[1]), books)
    nearest = distances.argmin(axis=1)
    entry = nearest[back].reshape(-1, PARTS).astype(np.uint8)
    error = distances[np.arange(len(nearest)), nearest][back].reshape(-1, PARTS).sum(axis=1)
    return [row.tobytes().hex() for row in entry], error


def with_codes(vectors: DataFrame, books: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Usable vectors with all their columns, and code and error in new columns of free names.

    The new columns come last; where the frame already has a code or error its
    own stay and the new ones get underscores in front.
    """
    code, error, at = (free_name(vectors, c) for c in ("code", "error", "codes_"))
    kept = vectors.where(usable(F.col(vector)) & (F.size(vector) == PARTS * books.shape[2]))
    if not books.size:
        return kept.limit(0).withColumns({code: F.lit("").cast("string"), error: F.lit(0).cast("long")})

    @F.pandas_udf("code string, error long")
    def find(column):
        import pandas as pd

        codes, errors = coded_values(pa.array(column, pa.list_(pa.float64())), books)
        return pd.DataFrame({"code": codes, "error": errors})

    found = kept.withColumn(at, find(F.col(vector).cast("array<double>")))
    return found.withColumns({code: F.col(at)["code"], error: F.col(at)["error"]}).drop(at)


def decoded(coded: DataFrame, books: np.ndarray, code: str = "code", out: str = "decoded") -> DataFrame:
    """The vectors that codes stand for, in the scale of the input."""
    name = free_name(coded, out)
    flat = [[books[p, e].tolist() for e in range(books.shape[1])] for p in range(PARTS)]
    listed = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in entry]) for entry in book]) for book in flat])
    entry = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1 for p in range(PARTS)]
    return coded.withColumn(name, F.flatten(F.array(*[F.element_at(F.element_at(listed, p + 1), entry[p]) for p in range(PARTS)])))


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Errors summed over equal labels, nulls together, beside every row.

    Errors are summed inside each task first. Few totals are broadcast; more
    than ``BROADCAST_LABELS`` meet the rows by label and a salt, so one label of
    very many rows is dealt to ``SALTS`` tasks.
    """
    totals = stored(coded.groupBy(F.col(label).alias("l")).agg(F.sum("error").alias("label_error")))
    if totals.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(totals), F.col(label).eqNullSafe(F.col("l"))).drop("l")
    salted = totals.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64(*coded.columns), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col(label).eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s"))).drop("l", "s", "salt")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit(vectors)
    coded = stored(with_codes(vectors, books).select("vec_id", "label", "code", "error"))
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


def _op13_sql() -> str:
    """Every round written out: assignment by the smallest distance, then floors of the means."""
    near = """
  a{r} AS MATERIALIZED (
    SELECT q.vec_id, q.row, q.p, q.x, arg_min(c.e, [d, c.e]) AS e, min(d) AS d
    FROM parts q JOIN c{r} c USING (p),
    LATERAL (SELECT list_sum(list_transform(list_zip(q.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) t
    GROUP BY q.vec_id, q.row, q.p, q.x)"""
    move = """
  m{r} AS (
    SELECT p, e, list(floor_mean ORDER BY i) AS y
    FROM (SELECT p, e, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
          FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY p, e, i)
    GROUP BY p, e),
  c{s} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN m{r} m USING (p, e))"""
    rounds = ",".join(near.format(r=r) + "," + move.format(r=r, s=r + 1) for r in range(ROUNDS))
    return f"""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (
    SELECT vec_id, row, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
    FROM kept, range({PARTS}) t(p)),
  c0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS y FROM parts WHERE row <= {ENTRIES}),{rounds},{near.format(r=ROUNDS)},
  books AS (
    SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}),
  coded AS (
    SELECT vec_id, row, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
    FROM a{ROUNDS} GROUP BY vec_id, row)
SELECT coded.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), books
"""


OP13_SQL = _op13_sql()

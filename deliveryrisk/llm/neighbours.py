"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted by balanced k-means on a bounded sample (``SAMPLE``
vectors chosen by a hash of the id) and searched through an in-memory graph.
Every vector is posted to its nearest list and, near a boundary, to up to
``COPIES`` lists. A query probes the lists whose centroid is at most ``REACH``
further than its nearest one; distances to the posted vectors are exact.

The centroids, at most ``MOST_LISTS``, are all that is broadcast. Long lists,
such as that of a vector a third of all rows share, are dealt to blocks of
``BLOCK`` rows, and so are the queries of a list, so a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deliveryrisk.llm.common import stored, table
from deliveryrisk.llm.near_copies import groups_of

SAMPLE = 20_000
LEAST_LISTS = 4
MOST_LISTS = 4096
ROUNDS = 10
BALANCE = 0.05
DEGREE = 16
BEAM = 96
POST_BEAM = 24
ENTRIES = 16
COPIES = 4
BOUNDARY = 0.15
REACH = 0.35
BLOCK = 2048
TOP = 10


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def balanced_centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means whose assignment pays for lists above the mean size.

    Starts from vectors spread over the sample; an empty list takes the vector
    furthest from its centroid.
    """
    distinct = np.unique(sample, axis=0)
    k = min(k, distinct.shape[0])
    rng = np.random.default_rng(0)
    centroids = distinct[rng.choice(distinct.shape[0], k, replace=False)]
    mean, load = sample.shape[0] / k, np.ones(k)
    for _ in range(ROUNDS):
        own = np.empty(sample.shape[0], dtype=np.int64)
        gap = np.empty(sample.shape[0])
        for lo in range(0, sample.shape[0], 2048):
            d = square_distances(sample[lo : lo + 2048], centroids)
            typical = np.median(d.min(axis=1)) + 1e-12
            own[lo : lo + 2048] = (d + BALANCE * typical * (load - 1.0)).argmin(axis=1)
            gap[lo : lo + 2048] = d.min(axis=1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        filled = size > 0
        centroids = centroids.copy()
        centroids[filled] = total[filled] / size[filled, None]
        for empty, far in zip(np.flatnonzero(~filled), np.argsort(-gap), strict=False):
            centroids[empty] = sample[far]
        load = np.minimum(size / mean, 8.0)
    return np.unique(centroids, axis=0)


def centroid_graph(centroids: np.ndarray) -> np.ndarray:
    """Neighbours of every centroid: its nearest ones and some at random, for long steps."""
    k = centroids.shape[0]
    near = min(DEGREE - 4, k - 1)
    rng = np.random.default_rng(1)
    links = rng.integers(0, k, size=(k, DEGREE))
    for lo in range(0, k, 1024):
        d = square_distances(centroids[lo : lo + 1024], centroids)
        d[np.arange(d.shape[0]), np.arange(lo, lo + d.shape[0])] = np.inf
        if near:
            links[lo : lo + 1024, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
    return links


def graph_search(index: tuple, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of the centroid graph for many vectors at once: nearest ids and distances.

    Each step expands every vector's nearest unexpanded candidate. A row ends
    when its beam holds expanded candidates only.
    """
    centroids, links = index
    n, k = vectors.shape[0], centroids.shape[0]
    beam = min(beam, k)
    entry = np.unique(np.linspace(0, k - 1, min(ENTRIES, k)).astype(np.int64))
    norms = (centroids * centroids).sum(1)

    def distance(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        dot = np.einsum("rd,rmd->rm", vectors[rows], centroids[ids])
        return np.maximum(norms[ids] - 2.0 * dot + (vectors[rows] ** 2).sum(1)[:, None], 0.0)

    every = np.arange(n)
    ids = np.full((n, beam), -1, dtype=np.int64)
    d = np.full((n, beam), np.inf)
    open_ = np.zeros((n, beam), dtype=bool)
    seen = np.zeros((n, k), dtype=bool)
    start = np.tile(entry, (n, 1))
    take = min(beam, entry.size)
    first = distance(every, start)
    order = np.argsort(first, axis=1)[:, :take]
    ids[:, :take] = np.take_along_axis(start, order, 1)
    d[:, :take] = np.take_along_axis(first, order, 1)
    open_[:, :take] = True
    seen[:, entry] = True
    active = every
    while active.size:
        waiting = np.where(open_[active], d[active], np.inf)
        best = waiting.argmin(axis=1)
        more = np.isfinite(waiting[np.arange(active.size), best])
        active, best = active[more], best[more]
        if not active.size:
            break
        open_[active, best] = False
        step = links[ids[active, best]]
        fresh = ~seen[active[:, None], step]
        seen[active[:, None], step] = True
        reach = np.where(fresh, distance(active, step), np.inf)
        # the same centroid twice among the links counts once
        by_id = np.argsort(step, axis=1, kind="stable")
        ranked = np.take_along_axis(step, by_id, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, by_id[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        reach[twice] = np.inf
        all_d = np.hstack([d[active], reach])
        all_ids = np.hstack([ids[active], step])
        all_open = np.hstack([open_[active], np.isfinite(reach)])
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        d[active] = np.take_along_axis(all_d, order, 1)
        ids[active] = np.take_along_axis(all_ids, order, 1)
        open_[active] = np.take_along_axis(all_open, order, 1) & np.isfinite(d[active])
    return ids, np.sqrt(d)


def vectors_of(column: pa.Array) -> np.ndarray:
    """A batch of equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def list_rows(index, beam: int, most: int, keep):
    """Task function: (id, list, primary, vector) for the lists that ``keep`` leaves each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                ids, d = graph_search(index.value, vectors_of(batch.column("vector")), beam)
                ids, d = ids[:, :most], d[:, :most]
                stay = keep(ids, d, index.value[0]) & (ids >= 0)
                row, rank = np.nonzero(stay)
                at = pa.array(row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").take(at),
                        "list": pa.array(ids[row, rank]),
                        "primary": pa.array(rank == 0),
                        "vector": batch.column("vector").take(at),
                    }
                )

    return run


def boundary_lists(ids: np.ndarray, d: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest list, and others about as near unless a chosen one lies closer to them than the vector."""
    stay = d <= (1.0 + BOUNDARY) * d[:, :1]
    stay[:, 0] = True
    chosen = [stay[:, 0]]
    for j in range(1, ids.shape[1]):
        for i in range(j):
            gap = np.sqrt(((centroids[ids[:, i]] - centroids[ids[:, j]]) ** 2).sum(1))
            stay[:, j] &= ~(chosen[i] & (gap < 0.5 * d[:, j]))
        chosen.append(stay[:, j])
    return stay


def near_lists(sizes: np.ndarray, typical: float, top: int):
    """Lists within the reach of the nearest, and as many more as hold ``top`` candidates."""

    def keep(ids: np.ndarray, d: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        held = np.where(ids >= 0, sizes[ids], 0)
        before = np.cumsum(held, axis=1) - held
        near = d <= d[:, :1] + REACH * np.maximum(d[:, :1], typical)
        return near | (before <= top)

    return keep


def best_of_blocks(top: int):
    """Task function: the nearest vectors of one block for every query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["list", "qb", "bb"]):
            side = rows.column("side").to_numpy()
            ids = rows.column("id").to_numpy()
            vectors = vectors_of(rows.column("vector").combine_chunks())
            q, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not (q.size and b.size):
                continue
            b = b[np.argsort(ids[b], kind="stable")]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for one in q:
                d = ((vectors[b] - vectors[one]) ** 2).sum(axis=1)
                d[ids[b] == ids[one]] = np.inf
                # ids are in order, so a stable sort gives ties to the smaller one
                best = np.argsort(d, kind="stable")[:top]
                best = best[np.isfinite(d[best])]
                found.append((np.full(best.size, ids[one]), ids[b[best]], np.sqrt(d[best])))
            query, vec, score = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_pydict({"query_id": query, "vec_id": vec, "score": score})

    return run


def dealt(postings: DataFrame, probes: DataFrame, parts: int) -> DataFrame:
    """Postings and probes of each list in blocks that meet pairwise."""
    n_b = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("kb"))
    n_q = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("kq"))
    # one row for a list: at most MOST_LISTS rows
    ways = F.broadcast(n_b.join(n_q, "list"))
    deal = F.xxhash64("id", "list")
    every_q = F.explode(F.sequence(F.lit(0), F.col("kq") - 1))
    every_b = F.explode(F.sequence(F.lit(0), F.col("kb") - 1))
    q = probes.join(ways, "list").select(
        "list", "id", "vector", F.lit(0).alias("side"), F.pmod(deal, F.col("kq")).cast("int").alias("qb"), every_b.alias("bb")
    )
    b = postings.join(ways, "list").select(
        "list", "id", "vector", F.lit(1).alias("side"), every_q.alias("qb"), F.pmod(deal, F.col("kb")).cast("int").alias("bb")
    )
    return q.unionByName(b).repartition(parts, "list", "qb", "bb").sortWithinPartitions("list", "qb", "bb", "side")


def nearest(
    vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", top: int = TOP
) -> DataFrame:
    """The ``top`` nearest vectors found for every row that ``queries`` selects, the row itself left out.

    Columns query_id, rank, vec_id, score: Euclidean distance in double
    precision, ties to the smaller id. Vectors that are null, zero, hold null or
    non-finite components, have no id, or are not as long as most of the sample
    take no part. Rows that repeat an id and vector count once; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    kind = "id long, list long, primary boolean, vector array<double>"
    rows = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"), queries.alias("asks")
    )
    chosen = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.array([len(v) for v in chosen["vector"].to_pylist()])
    length = int(np.bincount(lengths).argmax())
    sample = np.array([v for v in chosen["vector"].to_pylist() if len(v) == length])
    rows = rows.where(F.size("vector") == length)
    lists = int(np.clip(np.sqrt(rows.count()), LEAST_LISTS, MOST_LISTS))
    centroids = balanced_centroids(sample, lists)
    links = centroid_graph(centroids)
    index = spark.sparkContext.broadcast((centroids, links))
    typical = float(np.median(graph_search((centroids, links), sample[:2048], 8)[1][:, 0]))
    postings = stored(rows.select("id", "vector").mapInArrow(list_rows(index, POST_BEAM, COPIES, boundary_lists), kind).distinct())
    sizes = np.zeros(centroids.shape[0], dtype=np.int64)
    for r in postings.where("primary").groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    asks = rows.where("asks").select("id", "vector").distinct()
    probes = stored(asks.mapInArrow(list_rows(index, BEAM, BEAM, near_lists(sizes, typical, top)), kind))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt(postings.drop("primary"), probes.drop("primary"), parts)
    found = blocks.mapInArrow(best_of_blocks(top), "query_id long, vec_id long, score double").distinct()
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 100 == 0)

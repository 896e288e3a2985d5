"""N-gram Jaccard self-join by count vectors.

A text's set holds its distinct word shingles. Shingles are hashed to
``DIMENSIONS`` groups; the group counts are a point. Two sets share at most the
sum of the smaller counts, so a pair (or a pair of a point and a tree node,
taken with the node's largest counts) whose sum is below the needed overlap is
pruned. Surviving pairs are verified on whole texts.

Distribution. In one tree over all points, counts concentrate and high nodes
prune nothing. Points are therefore first dealt to cells: shingles are also
hashed to more groups than linked sets can differ in, so linked sets agree
fully in more than ``spare`` groups. A cell is one group with its content. Each
set leaves out half of ``spare`` cells with the fewest shingles (a cell of none
or one says little), and then as many of the cells that most sets have. As all
sets rank a common cell alike, linked sets still share a cell, and a set that
shares few cells has none left. No link is lost.

Large groups of copies. Copies inside a task are folded at once, copies of other
tasks by their fingerprints before cells are compared: otherwise all cells of a
set that occurs twice would count as shared. The smallest set of a cell is its hub. First every set is compared with the smallest of its
hubs, then with the smallest that lies in another component; a group of near
copies collapses without listing its pairs. Then only cells that still
hold several components are searched: the sets outside the cell's largest
component against all of it, in blocks of at most ``BLOCK`` points, each an
R-tree. Sets already known to be connected are not compared.

Crowds. Texts that resemble each other just below the threshold pass the bound in
numbers that grow with the square of their group. A block with several pairs for
each text in them therefore sends on the texts, once each, and not the pairs: one task
compares their whole sets and returns the links that join components, fewer than
there are texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deliveryrisk.llm.common import find_words, free_name, mix, sliced_texts, stored, table
from deliveryrisk.llm.exact_dedup import bit_blocks, filter_bits, in_blocks
from deliveryrisk.llm.graph import components

DIMENSIONS = 256
MOST_COUNT = 65535
GROWTH = 1.5
SPARE_SHARE = 0.15
BLOCK = 512
FANOUT = 16
LEAST = 6
# Shingles of a part of a crowd, about; a task compares two parts at most.
CROWD = 1 << 19
# Pairs for each text of a block from which on it is a crowd; fewer are cheaper as pairs, which cells may share.
DENSE = 4
# Numbers of an incidence matrix.
MATRIX = 1 << 22
PAIR_OR_CROWD = "a long, b long, cell long, qb int, bb int, part int, label long"
WORD_BITS = 64
WORDS = 512


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts, text by text, and how many each text has.

    A text of fewer words than ``width`` has its whole sequence as one shingle.
    """
    w = find_words(texts)
    counts = w.counts
    begin = np.cumsum(counts) - counts
    wide = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(counts.size), wide)
    at = np.arange(owner.size) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(begin, wide)
    size = np.minimum(counts, width)[owner]
    h = size.astype(np.uint64)
    padded = np.concatenate([w.hashes, np.zeros(width, np.uint64)])
    for i in range(width):
        nxt = np.where(i < size, padded[at + i], np.uint64(0))
        h = h * np.uint64(0x9E3779B97F4A7C15) + nxt
    h = mix(h)
    _, first = np.unique(mix(h + owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True)
    first.sort()
    return h[first], np.bincount(owner[first], minlength=counts.size)


def needed(total, percent: int):
    """Least overlap of linked sets whose sizes add up to ``total``."""
    return -(-percent * total // (100 + percent))


def classes(percent: int, upto: int) -> np.ndarray:
    """Lower bounds of the size classes up to a size."""
    bounds = [1]
    while bounds[-1] <= upto:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * GROWTH)))
    return np.array(bounds, dtype=np.int64)


def cell_groups(most: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of groups for sets of at most ``most`` shingles, and half of those that linked sets can spare."""
    differ = 2 * most * (100 - percent) // (100 + percent)
    groups = np.ceil((differ + 1) / (1 - SPARE_SHARE)).astype(np.int64)
    return groups, (groups - differ - 1) // 2


def sums_by(place: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """64-bit wrapping sums of hashes by place, exact for up to 2^21 hashes a place."""
    low = np.bincount(place, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
    high = np.bincount(place, (h >> np.uint64(32)).astype(np.float64), minlength=size)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def cells_of(sets: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys of sets, set by set, and how many each set has.

    A set that may link to the next size class has that class's cells too.
    """
    keys, owners = [], []
    bounds = classes(percent, int(sizes.max(initial=1)) * 2)
    own = np.searchsorted(bounds, sizes, side="right") - 1
    begin = np.cumsum(sizes) - sizes
    scattered = mix(sets + np.uint64(0x2545F4914F6CDD1D))
    for up in (0, 1):
        takes = np.flatnonzero((sizes > 0) & ((up == 0) | (100 * sizes >= percent * bounds[np.minimum(own + 1, bounds.size - 1)])))
        if not takes.size:
            continue
        level = own[takes] + up
        groups, spare = cell_groups(bounds[level + 1] - 1, percent)
        n = sizes[takes]
        row = np.repeat(np.arange(takes.size), n)
        at = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[takes], n)
        offset = np.cumsum(groups) - groups
        group = ((scattered[at] >> np.uint64(32)) * groups[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        place = offset[row] + group
        total = int(groups.sum())
        content = sums_by(place, mix(sets[at] + np.uint64(0x94D049BB133111EB)), total)
        count = np.bincount(place, minlength=total)
        owner = np.repeat(np.arange(takes.size), groups)
        number = np.arange(total) - np.repeat(offset, groups)
        # cells with the fewest shingles go; ties by group number
        order = np.lexsort((number, count, owner))
        rank = np.empty(total, dtype=np.int64)
        rank[order] = number
        stay = rank >= spare[owner]
        salt = mix((level[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64))
        key = mix(content + salt + count.astype(np.uint64))[stay]
        # the last bit tells apart the two classes whose cells a set can have
        keys.append(key & ~np.uint64(1) | (level[owner[stay]] & 1).astype(np.uint64))
        owners.append(takes[owner[stay]])
    if not keys:
        return np.empty(0, np.uint64), np.zeros(sizes.size, np.int64)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return key[order], np.bincount(owner, minlength=sizes.size)


def spare_cells(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of its most common cells that each set can leave out, in its even and its odd class."""
    bounds = classes(percent, int(sizes.max(initial=1)) * 2)
    own = np.maximum(np.searchsorted(bounds, sizes, side="right") - 1, 0)
    spare = [cell_groups(bounds[own + up + 1] - 1, percent)[1] for up in (0, 1)]
    odd = own % 2 == 1
    return np.where(odd, spare[1], spare[0]), np.where(odd, spare[0], spare[1])


def prints_of(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprints of sets."""
    owner = np.repeat(np.arange(sizes.size), sizes)
    one = mix(sums_by(owner, mix(sets + np.uint64(1)), sizes.size) + sizes.astype(np.uint64))
    two = mix(sums_by(owner, mix(sets * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(7)), sizes.size))
    return one.view(np.int64), two.view(np.int64)


def describe(width: int, percent: int):
    """Task function: set size, fingerprint, point and cells of every text.

    A set seen before in the task refers to that row and has no cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            ids = batch.column("row_").to_pylist()
            for lo, hi, texts in sliced_texts(batch.column("text")):
                sets, sizes = shingle_sets(texts, width)
                even, odd = spare_cells(sizes, percent)
                one, two = prints_of(sets, sizes)
                first = []
                for r, a, b, n in zip(ids[lo:hi], one.tolist(), two.tolist(), sizes.tolist(), strict=True):
                    first.append(seen.setdefault((a, b), r) if n else r)
                fresh = np.array(first, dtype=np.int64) == np.array(ids[lo:hi], dtype=np.int64)
                kept = np.repeat(fresh, sizes)
                some = np.where(fresh, sizes, 0)
                keys, n_keys = cells_of(sets[kept], some, percent)
                owner = np.repeat(np.arange(hi - lo), sizes)
                place = owner * DIMENSIONS + (sets >> np.uint64(56)).astype(np.int64)
                point = np.bincount(place, minlength=(hi - lo) * DIMENSIONS).reshape(hi - lo, DIMENSIONS)
                # a count beyond the type would lower the bound: such a point bounds nothing
                point[point.max(axis=1) > MOST_COUNT] = MOST_COUNT
                point = point.astype("<u2")
                offsets = pa.array(np.concatenate(([0], np.cumsum(n_keys))).astype(np.int32))
                yield pa.RecordBatch.from_pydict(
                    {
                        "row_": pa.array(ids[lo:hi], pa.int64()),
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                        "n": pa.array(sizes.astype(np.int64)),
                        "one": pa.array(one),
                        "two": pa.array(two),
                        "first_": pa.array(first, pa.int64()),
                        "even": pa.array(even),
                        "odd": pa.array(odd),
                        "point": pa.array([p.tobytes() if f else None for p, f in zip(point, fresh, strict=True)], pa.binary()),
                        "cells": pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64))),
                    }
                )

    return run


class Tree:
    """R-tree of count vectors: packed by size, each node with its largest counts and smallest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        self.levels = [(points[self.order], sizes[self.order])]
        while self.levels[-1][1].size > FANOUT:
            top, least = self.levels[-1]
            edge = np.arange(0, least.size, FANOUT)
            self.levels.append((np.maximum.reduceat(top, edge), np.minimum.reduceat(least, edge)))

    def search(
        self, points: np.ndarray, sizes: np.ndarray, percent: int, wanted: Callable | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose overlap bound reaches the needed overlap.

        ``wanted`` tells which pairs to bound, all if it is not given.
        """
        top = self.levels[-1][1].size
        query = np.repeat(np.arange(sizes.size), top)
        node = np.tile(np.arange(top), sizes.size)
        for depth in range(len(self.levels) - 1, -1, -1):
            most, least = self.levels[depth]
            if depth == 0 and wanted is not None:
                asked = wanted(query, self.order[node])
                query, node = query[asked], node[asked]
            keep = []
            for part in np.array_split(np.arange(query.size), query.size // 16384 + 1):
                q, t = query[part], node[part]
                bound = np.minimum(points[q], most[t]).sum(axis=1, dtype=np.int64)
                keep.append(bound >= needed(sizes[q] + least[t], percent))
            keep = np.concatenate(keep)
            query, node = query[keep], node[keep]
            if depth:
                below = self.levels[depth - 1][1].size
                query = np.repeat(query, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < below
                query, node = query[inside], node[inside]
        return query, self.order[node]


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys; each group is bounded by its makers."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def points_in(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, DIMENSIONS)


def least_cells(column: pa.ChunkedArray) -> np.ndarray:
    """The ascending cells that rows bring along, ``LEAST`` a row; the last one repeats where there are fewer."""
    lists = column.combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    at = offsets[:-1, None] + np.arange(LEAST)
    return values[np.minimum(at, offsets[1:, None] - 1)]


def meets_here(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """Whether pairs are bounded in this cell, from the smallest cells of their sets."""
    found = []
    for part in np.array_split(np.arange(len(a)), len(a) // 16384 + 1):
        shared = (a[part][:, :, None] == b[part][:, None, :]).any(axis=2)
        least = np.take_along_axis(a[part], shared.argmax(axis=1)[:, None], axis=1)[:, 0]
        found.append(~shared.any(axis=1) | (least == cell))
    return np.concatenate(found)


def crowd_parts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a crowd and the number of the part pair they belong to, each row in as many as there are other parts.

    Parts hold ``CROWD`` shingles, about; a crowd of one part is compared as a whole.
    """
    part = np.unique((np.cumsum(sizes) - sizes) // CROWD, return_inverse=True)[1]
    if not part.size or part.max() == 0:
        return np.arange(part.size), part
    x, y = np.triu_indices(part.max() + 1, 1)
    row, pair = np.nonzero((part[:, None] == x) | (part[:, None] == y))
    return row, pair


def search_blocks(percent: int):
    """Task function: pairs of one cell block that pass the bound and lie in different components.

    side is 0 for a query, 1 for a set of the cell's main component, 2 for any
    other. Two sets outside the main one meet twice, once as each other's
    query; the one with the larger number asks. Where there are more than ``DENSE``
    pairs a set, the sets are returned as a crowd: a, without b, with block, part and label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["cell", "qb", "bb"]):
            side = rows.column("side").to_numpy()
            ids, label = rows.column("row_").to_numpy(), rows.column("label").to_numpy()
            sizes, points = rows.column("n").to_numpy(), points_in(rows.column("point"))
            least, cell = least_cells(rows.column("least")), rows.column("cell")[0].as_py()
            q, b = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
            if not q.size or not b.size:
                continue

            def wanted(query: np.ndarray, point: np.ndarray) -> np.ndarray:
                i, j = q[query], b[point]
                asks = np.flatnonzero((label[i] != label[j]) & ((side[j] == 1) | (ids[i] > ids[j])))
                return asks[meets_here(least[i[asks]], least[j[asks]], cell)]

            i, j = Tree(points[b], sizes[b]).search(points[q], sizes[q], percent, wanted)
            i, j = q[i], b[j]
            if not i.size:
                continue
            one, two = np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])
            # a query that asks and is asked stands in the block twice
            crowd = np.concatenate([i, j])
            crowd = crowd[np.unique(ids[crowd], return_index=True)[1]]
            row, part = crowd_parts(sizes[crowd])
            if one.size <= DENSE * row.size:
                n, none = one.size, pa.nulls(one.size, pa.int64())
                found = [pa.array(one), pa.array(two), none, *[pa.nulls(n, pa.int32())] * 3, none]
            else:
                at, n = crowd[row], row.size
                block = [pa.repeat(rows.column(k)[0], n) for k in ("cell", "qb", "bb")]
                found = [pa.array(ids[at]), pa.nulls(n, pa.int64()), *block, pa.array(part.astype(np.int32)), pa.array(label[at])]
            yield pa.RecordBatch.from_arrays(found, ["a", "b", "cell", "qb", "bb", "part", "label"])

    return run


def overlaps(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Size of the intersection of every two sets, from products of incidence matrices of shared shingles."""
    owner = np.repeat(np.arange(sizes.size), sizes)
    _, at, count = np.unique(sets, return_inverse=True, return_counts=True)
    shared = count > 1
    inside = shared[at]
    owner, at = owner[inside], (np.cumsum(shared) - 1)[at[inside]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((sizes.size, sizes.size))
    width = max(1, MATRIX // sizes.size)
    for lo in range(0, int(shared.sum()), width):
        piece = slice(*np.searchsorted(at, [lo, lo + width]))
        holds = np.zeros((sizes.size, width), dtype=np.float32)
        holds[owner[piece], at[piece] - lo] = 1
        both += holds @ holds.T
    return both.astype(np.int64)


def joining(links: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of links, as many as connect what all of them and equal labels connect."""
    own = label.copy()
    one, two = [], []
    for i in range(own.size):
        others = np.flatnonzero(links[i])
        while (others := others[own[others] != own[i]]).size:
            one.append(i)
            two.append(others[0])
            own[own == own[others[0]]] = own[i]
    return np.array(one, dtype=np.int64), np.array(two, dtype=np.int64)


def with_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches with shingle sets, as lists of hashes, in place of texts."""
    for batch in batches:
        names = [x for x in batch.schema.names if x != "text"]
        for lo, hi, texts in sliced_texts(batch.column("text")):
            sets, sizes = shingle_sets(texts, width)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(x).slice(lo, hi - lo) for x in names], lists], [*names, "set"])


def link_crowds(width: int, percent: int):
    """Task function: of the links between whole texts of a crowd, as many as join its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(with_sets(batches, width), ["cell", "qb", "bb", "part"]):
            ids, label = rows.column("a").to_numpy(), rows.column("label").to_numpy()
            lists = rows.column("set").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            both = overlaps(lists.flatten().to_numpy(), sizes)
            i, j = joining(both >= needed(sizes[:, None] + sizes[None], percent), label)
            if i.size:
                yield pa.RecordBatch.from_pydict({"a": np.maximum(ids[i], ids[j]), "b": np.minimum(ids[i], ids[j])})

    return run


def within_bound(percent: int):
    """Whether the points of two sets allow a link."""

    def run(pa_: pa.Array, pb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        total = na.to_numpy() + nb.to_numpy()
        keep = []
        a, b = pa_.to_pylist(), pb.to_pylist()
        for lo in range(0, len(a), 4096):
            x, y = (np.frombuffer(b"".join(v[lo : lo + 4096]), dtype="<u2").reshape(-1, DIMENSIONS) for v in (a, b))
            keep.append(np.minimum(x, y).sum(axis=1, dtype=np.int64) >= needed(total[lo : lo + 4096], percent))
        return pa.array(np.concatenate(keep) if keep else np.zeros(0, bool), pa.bool_())

    return F.arrow_udf(run, "boolean")


def linked(width: int, percent: int):
    """Whether two whole texts link, from their exact shingle sets."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for lo, hi, texts in sliced_texts(left):
            for a, b in zip(texts, right.slice(lo, hi - lo), strict=True):
                (x, nx), (y, ny) = shingle_sets([a], width), shingle_sets([b.as_py().encode()], width)
                both = np.intersect1d(x, y, assume_unique=True).size
                out.append(bool(100 * both >= percent * (nx[0] + ny[0] - both)))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def prints_udf(width: int):
    def run(texts: pa.Array) -> pa.Array:
        ones, twos = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, _, values in sliced_texts(texts):
            one, two = prints_of(*shingle_sets(values, width))
            ones.append(one)
            twos.append(two)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(ones)), pa.array(np.concatenate(twos))], ["one", "two"])

    return F.arrow_udf(run, "one long, two long")


def texts_of_rows(rows: DataFrame, described: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Stored texts (row_, text) of the listed rows.

    Only texts whose id may belong to a listed row are read into the shuffle: a
    filter of bits over these ids, at most 32 MB, keeps the others out. Texts
    are found by their set's fingerprint, one text for each fingerprint.
    """
    wanted = stored(described.select("row_", "doc_id", "one", "two").join(rows, "row_"))
    bits = filter_bits(wanted.count())
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    passed = texts.where(in_blocks(slot, bit_blocks(wanted.select(slot.alias("slot")), bits)))
    found = passed.select("text", prints_udf(width)("text").alias("p")).select("text", "p.one", "p.two")
    prints = wanted.select("one", "two").distinct()
    found = found.join(prints, ["one", "two"]).groupBy("one", "two").agg(F.any_value("text").alias("text"))
    return stored(wanted.drop("doc_id").join(found, ["one", "two"]).select("row_", "text"))


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole texts link; ``texts`` has row_ and text."""
    a = texts.withColumnsRenamed({"row_": "a", "text": "text_a"})
    b = texts.withColumnsRenamed({"row_": "b", "text": "text_b"})
    both = stored(pairs).join(b, "b").join(a, "a")
    return stored(both.where(linked(width, percent)("text_a", "text_b")).select("a", "b"))


def bounded(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a > b) that the count vectors allow."""
    points = described.where("point is not null").select("row_", "n", "point")
    a = points.withColumnsRenamed({"row_": "a", "n": "na", "point": "pa"})
    b = points.withColumnsRenamed({"row_": "b", "n": "nb", "point": "pb"})
    both = pairs.join(a, "a").join(b, "b")
    sized = both.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return sized.where(within_bound(percent)("pa", "pb", "na", "nb")).select("a", "b")


def listed_cells(cells: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for all listed cells and for few others.

    A filter of bits, about 16 a cell and at most 32 MB: blocks of ``WORDS``
    numbers of ``WORD_BITS`` bits, which rows read without decoding. With more
    cells more rows pass; none is missed.
    """
    bits = filter_bits(cells.count())

    def place(cell: Column) -> Column:
        return F.pmod(F.xxhash64(cell), F.lit(bits))

    slot = F.col("slot")
    words = cells.select(place(F.col("cell")).alias("slot")).groupBy(F.shiftright(slot, 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("word")
    )
    every = cells.sparkSession.range(bits // WORD_BITS).join(words, "id", "left")
    blocks = every.groupBy(F.floor(F.col("id") / WORDS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("w")
    )
    whole = blocks.select("block", F.col("w.word").alias("w")).agg(
        F.array_sort(F.collect_list(F.struct("block", "w"))).alias("b")
    )
    filled = whole.select(F.col("b.w").alias("blocks")).scalar()

    def test(cell: Column) -> Column:
        at = place(cell)
        block = F.get(filled, F.shiftright(at, 15).cast("int"))
        word = F.get(block, F.shiftright(at, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int"))
        return F.getbit(word, at.bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")) == 1

    return test


def equal_sets(described: DataFrame) -> DataFrame:
    """Stored pairs (a, b): rows with cells, and the smallest other row of an equal set."""
    own = described.where("size(cells) > 0").select("row_", "one", "two")
    least = own.groupBy("one", "two").agg(F.min("row_").alias("b"), F.max("row_").alias("top")).where("b <> top")
    pairs = own.join(least.drop("top"), ["one", "two"]).where("row_ <> b")
    return stored(pairs.select(F.col("row_").alias("a"), "b"))


def without_rows(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose row_ is not listed as a. A filter of bits lets most pass; only the others meet the list in a join."""
    bits = filter_bits(listed.count())

    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    may = in_blocks(slot("row_"), bit_blocks(listed.select(slot("a").alias("slot")), bits))
    rest = rows.where(may).join(listed.select(F.col("a").alias("row_")), "row_", "left_anti")
    return rows.where(~may).unionByName(rest)


def link_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (row_, doc_id, n, component) of docs (doc_id, text, row_); component is a row_."""
    described = stored(
        docs.mapInArrow(
            describe(width, percent),
            f"row_ long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, one long, two long, "
            "first_ long, even long, odd long, point binary, cells array<long>",
        )
    )
    equal = equal_sets(described)
    with_cells = described.where("size(cells) > 0").select("row_", "cells")
    placed = without_rows(with_cells, equal).select("row_", F.explode("cells").alias("cell"))
    heat = stored(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("heat")).where("heat > 1"))
    placed = placed.where(listed_cells(heat)(F.col("cell")))  # most cells hold one set
    spare = described.where("size(cells) > 0").select("row_", "even", "odd")
    odd = F.col("cell").bitwiseAND(1) == 1
    by_heat = Window.partitionBy("row_", odd).orderBy(F.desc("heat"), "cell")  # the cells of one set
    ranked = placed.join(heat, "cell").join(spare, "row_").withColumn("rank", F.row_number().over(by_heat))
    kept = stored(ranked.where(F.col("rank") > F.when(odd, F.col("odd")).otherwise(F.col("even"))).select("cell", "row_"))
    hubs = kept.groupBy("cell").agg(F.min("row_").alias("hub"), F.max("row_").alias("top")).where("hub <> top")
    members = stored(kept.join(hubs.drop("top"), "cell"))
    texts = texts_of_rows(members.select("row_").distinct(), described, docs.select("doc_id", "text"), width)

    def check(pairs: DataFrame) -> DataFrame:
        return verify(bounded(pairs, described, percent), texts, width, percent)

    first = members.groupBy(F.col("row_").alias("a")).agg(F.min("hub").alias("b")).where("a <> b")
    links = check(first)
    label = components(links)
    own = label.withColumnsRenamed({"node": "row_", "component": "own"})
    other = label.withColumnsRenamed({"node": "hub", "component": "other"})
    apart = F.coalesce("own", "row_") != F.coalesce("other", "hub")
    stars = members.join(own, "row_", "left").join(other, "hub", "left").where(apart)
    second = stars.groupBy(F.col("row_").alias("a")).agg(F.min("hub").alias("b")).where("a <> b")
    links = stored(links.unionByName(check(second)))
    node = components(links).withColumnsRenamed({"node": "row_", "component": "label"})
    labelled = stored(
        members.join(node, "row_", "left").select("cell", "row_", F.coalesce("label", "row_").alias("label"))
    )
    mixed = labelled.groupBy("cell").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("cell")
    counts = labelled.join(mixed, "cell").groupBy("cell", "label").agg(F.count(F.lit(1)).alias("c"))
    facts = counts.groupBy("cell").agg(
        F.sum("c").alias("all"), F.max(F.struct("c", F.col("label").alias("l"))).alias("most")
    )
    ways = facts.select(
        "cell",
        F.col("most.l").alias("main"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("kb"),
        F.ceil((F.col("all") - F.col("most.c")) / BLOCK).cast("int").alias("kq"),
    )
    open_rows = stored(labelled.join(ways, "cell"))
    least = open_rows.groupBy("row_").agg(F.slice(F.array_sort(F.collect_set("cell")), 1, LEAST).alias("least"))
    deal = F.xxhash64("row_", "cell")
    queries = open_rows.where("label <> main").select(
        "cell", "row_", "label", F.lit(0).alias("side"), F.pmod(deal, F.col("kq")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("bb"),
    )
    base = open_rows.select(
        "cell", "row_", "label", F.when(F.col("label") == F.col("main"), 1).otherwise(2).alias("side"), F.explode(F.sequence(F.lit(0), F.col("kq") - 1)).alias("qb"),
        F.pmod(deal, F.col("kb")).cast("int").alias("bb"),
    )
    points = described.where("point is not null").select("row_", "n", "point").join(least, "row_")
    blocks = queries.unionByName(base).join(points, "row_")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "cell", "qb", "bb").sortWithinPartitions("cell", "qb", "bb", "side")
    passed = stored(
        dealt.select("cell", "qb", "bb", "side", "row_", "label", "n", "point", "least").mapInArrow(
            search_blocks(percent), PAIR_OR_CROWD
        )
    )
    more = verify(passed.where("b is not null").select("a", "b").distinct(), texts, width, percent)
    block = ["cell", "qb", "bb", "part"]
    crowds = passed.where("b is null").drop("b").join(texts.withColumnRenamed("row_", "a"), "a")
    met = crowds.repartition(parts, *block).sortWithinPartitions(*block).select(*block, "a", "label", "text")
    more = more.unionByName(stored(met.mapInArrow(link_crowds(width, percent), "a long, b long")))
    found = components(links.unionByName(more).unionByName(equal))
    ends = found.withColumnsRenamed({"node": "first_", "component": "end"})
    return described.select("row_", "doc_id", "n", "first_").join(ends, "first_", "left").select(
        "row_", "doc_id", "n", F.coalesce("end", "first_").alias("component")
    )


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Component of every text: columns doc_id, n_shingles, component_id, and row_ and first_row to tell rows apart.

    Texts link when 100 x the intersection of their shingle sets reaches
    ``percent`` x the union. component_id is the smallest id reachable by links,
    the text's own included (null ids are never the smallest; a component of
    null ids has none). Texts without words link with nothing; equal texts and
    repeated rows link. Rows are numbered in the one scan that describes them.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row_"))
    found = stored(link_components(rows, width, percent))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_").alias("row"))
    least = found.groupBy("component").agg(F.min(order).alias("first"))
    return found.join(least, "component").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("first.id").alias("component_id"),
        "row_",
        F.col("first.row").alias("first_row"),
    )


def drop_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows that stay, with all their columns: of each component one row with the smallest id.

    Rows that go are named by a key that lies in the data, id and text digest,
    never by their place, so that later scans may read ``docs`` in other pieces.
    A filter of bits over these keys lets most texts pass straight through; the
    others meet the keys in a join. Where rows repeat the id and the text of the
    row that stays, any one of them stays.
    """
    key = F.struct(
        F.col(doc_id).isNull().alias("none"),
        F.col(doc_id).alias("id"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("digest"),
    )
    name = free_name(docs, "key__")
    found = near_copies(docs.select(key.alias(name), F.col(text)), name, text, width, percent)
    stays = F.col("row_") == F.col("first_row")
    seen = found.groupBy(F.col("doc_id").alias(name)).agg(F.max(stays).alias("stays"), F.max(~stays).alias("goes"))
    gone = stored(seen.where("goes").select(name, "stays"))
    keyed = docs.withColumn(name, key)

    def listed(keys: DataFrame) -> Column:
        bits = filter_bits(keys.count())
        slot = F.pmod(F.xxhash64(name), F.lit(bits))
        return in_blocks(slot, bit_blocks(keys.select(slot.alias("slot")), bits))

    may_go = listed(gone)
    rest = keyed.where(may_go).join(gone.select(name), name, "left_anti")
    kept = keyed.where(~may_go).select(*docs.columns).unionByName(rest.select(*docs.columns))
    repeated = gone.where("stays").select(name)
    if repeated.isEmpty():
        return kept
    row = F.any_value(F.struct(*docs.columns)).alias("row")
    one = keyed.where(listed(repeated)).join(repeated, name).groupBy(name).agg(row)
    return kept.unionByName(one.select("row.*"))


def op1_near_copies(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_copies(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")

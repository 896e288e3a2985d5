"""Log probability of texts by a unigram base and by logistic context mixing.

A text is coded as its lower-cased words, each followed by a terminator, and an
end symbol. Every byte is eight binary decisions. ``PREDICTORS`` hashed-context
bit predictors (orders 0 to 4 and the whole word so far) give a probability
each; a weight vector chosen by a gate (bit position and how often the long
contexts were seen) mixes them in the logistic domain, weights learnt online
by gradient steps, and an adaptive table over the mixed probability refines the
result. Contexts reach across words: those of orders 1 to 4 take the bytes
before the word's start as well, end symbols before the first word. A byte after
the first ``ORDERS`` of a word has its contexts within the word, so its
probability depends on the word alone; the first ones depend on the ``ORDERS``
bytes before the word too. The distinct units of both kinds are words, of which
the bytes after the first ones are coded, and junctions, the bytes on both sides
of a word's start (or of the end symbol). Every byte of a text belongs to one
unit, so all statistics come from the distinct units with their counts in
training texts, and a text's bits are the sum over its units.

Scale. Units are counted over all texts, with how often training texts hold
them. Context counts are a table of (context, byte, count) that grows with the
corpus; contexts are 64-bit hashes and share no slot. Each distinct unit is
scored once: units are dealt to groups of about ``GROUP``. Counts of contexts
that only one group's units have come from these units; the counts of the others
are summed in buckets of context hashes and dealt to their groups as arrays. Only the contexts that most groups share (at most
``HEAD_COUNTS`` counts), the ``HEAD`` most frequent words with their counts
and scores and the ``HEAD_JUNCTIONS`` most frequent junctions with their scores are
broadcast. Counts and scores of all other units reach the texts by a join on
hashes, from rows of distinct units per text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import _IS_SPACE, _powers, _VALUE, Words, crc_mod, find_words, mix, sliced_texts, stored, table

ORDERS = 4
PREDICTORS = ORDERS + 2
SLOTS = 1 << 20
HEAD = 1 << 17
HEAD_JUNCTIONS = 1 << 20
GROUP = 1 << 15
BUCKET_GROUPS = 8
DEAL_ENTRIES = 1 << 20
HEAD_COUNTS = 1 << 21
PRIOR = 0.4
BUCKETS = 33
GATES = 8 * 9
RATE = 0.1
MOST_WORDS = 400_000
MOST_JUNCTIONS = 1 << 21
LEARN_WORDS = 1024
END = b"\n"
END_HASH = np.uint64(0x0A0A0A0A0A0A0A0A)


# Stretched probabilities and confidences of all slots by predictor, weights by gate, refinement by bit and
# bucket. A plain tuple, so that workers can read it without importing this module.
Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def words_as_symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of listed words with their terminators, and the number of symbols of each."""
    coded = [w if w == END else w + b" " for w in words]
    lengths = np.fromiter((len(w) for w in coded), dtype=np.int64, count=len(coded))
    return np.frombuffer(b"".join(coded), dtype=np.uint8), lengths


def junctions(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Junctions of some texts as numbers, and the text of each.

    The highest bytes are the ``ORDERS`` before a word's start or before the end symbol, the lowest the first
    ``ORDERS`` symbols from there on, zero after a terminator. Before a text there are end symbols.
    """
    length = w.end - w.begin
    n = w.counts.size
    text = np.repeat(np.arange(n), w.counts)
    begin = np.cumsum(length + 1) - (length + 1) + (ORDERS + 1) * text + ORDERS
    size = np.bincount(text, length + 1, minlength=n).astype(np.int64) + ORDERS + 1
    end = np.cumsum(size) - 1
    coded = np.full(size.sum() + ORDERS, END[0], dtype=np.uint8)
    coded[begin + length] = 32
    coded[np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)] = w.buf[~_IS_SPACE[w.buf]]
    at = np.sort(np.concatenate((begin, end)), kind="stable")
    key, open_ = np.zeros(at.size, dtype=np.uint64), np.ones(at.size, dtype=bool)
    for k in range(-ORDERS, ORDERS):
        byte = coded[at + k]
        key = (key << np.uint64(8)) | np.where(open_, byte, np.uint8(0))
        if k >= 0:
            open_ &= (byte != 32) & (byte != END[0])
    return key, np.repeat(np.arange(n), w.counts + 1)


def unit_symbols(word: bytes, start: int) -> bytes:
    """Symbols of a word (start 0) with its terminator, or of a junction's bytes, whose word begins at ``start``."""
    if not start:
        return word + b" "
    ends = [e for e in (word.find(b" ", start), word.find(END, start)) if e >= 0]
    return word[: min(ends) + 1] if ends else word


def coded(words: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Coded symbols of a group's units, how many each unit has, and their context hashes for each predictor.

    Without a column ``start`` all symbols of the words are coded, each word by itself.
    """
    listed = words.column("word").to_pylist()
    if "start" not in words.column_names:
        symbols, lengths = words_as_symbols(listed)
        return symbols, lengths, contexts(symbols, lengths)
    start = words.column("start").to_numpy().astype(np.int64)
    listed = [unit_symbols(w, s) for w, s in zip(listed, start.tolist(), strict=True)]
    lengths = np.fromiter((len(w) for w in listed), dtype=np.int64, count=len(listed))
    symbols = np.frombuffer(b"".join(listed), dtype=np.uint8)
    taken = np.arange(symbols.size) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= ORDERS
    return symbols[taken], np.maximum(lengths - ORDERS, 0), [c[taken] for c in contexts(symbols, lengths, start)]


def contexts(symbols: np.ndarray, lengths: np.ndarray, start: np.ndarray | None = None) -> list[np.ndarray]:
    """Context hashes of every symbol for each predictor.

    ``start`` tells where in each unit the word begins (at 0 if not given); only the context of the whole word stops
    there, those of orders 1 to 4 reach back to the unit's begin.
    """
    n = symbols.size
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(n) - first
    context = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    found = [context]
    for k in range(1, ORDERS + 1):
        before = np.zeros(n, dtype=np.uint64)
        before[k:] = symbols[:-k].astype(np.uint64) + np.uint64(1)
        before[place < k] = 0
        context = (context ^ before) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        found.append(context)
    forth, back = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[symbols] * forth[:n], out=total[1:])
    if start is not None:
        first = first + np.minimum(np.repeat(start, lengths), place)
    found.append((total[:n] - total[first]) * back[first] + np.uint64(0x94D049BB133111EB))
    return found


def bit_slots(symbols: np.ndarray, context: np.ndarray, bit: int) -> np.ndarray:
    """Slots of one predictor for one bit of every symbol."""
    known = (symbols.astype(np.uint64) | np.uint64(256)) >> np.uint64(8 - bit)
    h = (context + known) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def bit_of(symbols: np.ndarray, bit: int) -> np.ndarray:
    return (symbols >> np.uint8(7 - bit)) & np.uint8(1)


def gate_of(confidence: np.ndarray, slots: list[np.ndarray], bit: int) -> np.ndarray:
    """Gate from the bit position and the confidences of order 3 and of the whole word."""
    return bit * 9 + 3 * confidence[3][slots[3]].astype(np.int64) + confidence[PREDICTORS - 1][slots[PREDICTORS - 1]]


def hashed_slots(symbols: np.ndarray, lengths: np.ndarray):
    """Slots of every predictor by bit, in tables of ``SLOTS`` slots."""
    found = contexts(symbols, lengths)
    return lambda bit: [bit_slots(symbols, c, bit) for c in found]


def log10_probabilities(model: Model, symbols: np.ndarray, lengths: np.ndarray, slots_at=None) -> np.ndarray:
    """log10 probability of each word; ``slots_at`` gives the slots of every predictor for a bit."""
    stretch, confidence, weights, refine = model
    slots_at = slots_at or hashed_slots(symbols, lengths)
    by_predictor = np.ascontiguousarray(weights.T)
    total = np.zeros(symbols.size, dtype=np.float64)
    for bit in range(8):
        slots = slots_at(bit)
        gate = gate_of(confidence, slots, bit)
        mixed = np.zeros(symbols.size, dtype=np.float32)
        for k in range(PREDICTORS):
            mixed += by_predictor[k][gate] * stretch[k][slots[k]]
        total += np.log(refined(refine, mixed, bit, bit_of(symbols, bit)))
    owner = np.repeat(np.arange(lengths.size), lengths)
    return np.bincount(owner, total, minlength=lengths.size) / math.log(10.0)


def buckets(mixed: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((mixed + 8.0) * (BUCKETS - 1) / 16.0), 0, BUCKETS - 1).astype(np.int64)


def squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -12.0, 12.0)))


def refined(refine: np.ndarray, mixed: np.ndarray, bit: int, outcome: np.ndarray) -> np.ndarray:
    """Probability of the outcome: mean of the mixed and the refined probability of a one."""
    p = 0.5 * (squash(mixed.astype(np.float64)) + refine[bit, buckets(mixed)])
    return np.where(outcome == 1, p, 1.0 - p)


def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and junctions of the texts of a task with their counts in training texts.

    The end symbol is one of the words. A junction has its number as hash and no word.
    """
    counts: Counter = Counter()
    held: set[bytes] = set()
    joined: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        words = [w for w in counts.keys() | held if w != END]
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            hashes = find_words([b" ".join(part)]).hashes
            yield batch_of(part, hashes, [counts[w] for w in part])
        if END in counts or END in held:
            yield batch_of([END], np.array([END_HASH]), [counts[END]])
        counts.clear()
        held.clear()

    def flush_junctions() -> Iterator[pa.RecordBatch]:
        for keys, n in joined:
            for lo in range(0, keys.size, 50_000):
                part = keys[lo : lo + 50_000]
                yield batch_of(pa.nulls(part.size, pa.binary()), part, n[lo : lo + 50_000])
        joined.clear()

    def batch_of(words, hashes: np.ndarray, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"hash": hashes.view(np.int64), "word": pa.array(words, pa.binary()), "n": pa.array(n, pa.int64())}
        )

    def gather() -> None:
        """Add up the counts of equal junctions."""
        if joined:
            keys, n = (np.concatenate(p) for p in zip(*joined, strict=True))
            kinds, place = distinct(keys)
            joined[:] = [(kinds, np.bincount(place, n, minlength=kinds.size).astype(np.int64))]

    for batch in batches:
        train = batch.column("train").to_pylist()
        for lo, hi, texts in sliced_texts(batch.column("text")):
            for text, learns in zip(texts, train[lo:hi], strict=True):
                (counts if learns else held).update(text.lower().split())
            keys, text = junctions(find_words(texts))
            kinds, place = distinct(keys)
            joined.append((kinds, np.bincount(place, np.array(train[lo:hi])[text], minlength=kinds.size).astype(np.int64)))
            learning = sum(train[lo:hi])
            if learning:
                counts[END] += learning
            else:
                held.add(END)
            if len(counts) + len(held) > MOST_WORDS:
                yield from flush()
            if sum(k.size for k, _ in joined) > 2 * MOST_JUNCTIONS:
                gather()
                if joined[0][0].size > MOST_JUNCTIONS:
                    yield from flush_junctions()
    yield from flush()
    gather()
    yield from flush_junctions()


def context_keys(found: list[np.ndarray]) -> list[np.ndarray]:
    """64-bit keys of the contexts of every symbol for each predictor, different for each predictor."""
    return [mix(c + np.uint64(k * 0xD1342543DE82EF95 % (1 << 64))) for k, c in enumerate(found)]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and the place of each value among them; only the different ones are sorted."""
    code, kinds = pd.factorize(values)
    order = np.argsort(kinds)
    place = np.empty(kinds.size, dtype=np.int64)
    place[order] = np.arange(kinds.size)
    return kinds[order], place[code]


def context_codes(words: pa.Table) -> tuple[np.ndarray, ...]:
    """Contexts and codes of a group's units.

    Contexts, sorted; place of the context x 256 + byte, sorted; how often training texts have these;
    the code of every symbol for each predictor, as a place among the codes; the symbols, and how many each unit has.
    """
    symbols, lengths, found = coded(words)
    weight = np.repeat(words.column("n").to_numpy(), lengths).astype(np.float64)
    used, place = distinct(np.concatenate(context_keys(found)))
    codes, at = distinct(place * 256 + np.tile(symbols, PREDICTORS))
    n = np.bincount(at, np.tile(weight, PREDICTORS), minlength=codes.size)
    return used, codes, n, at.reshape(PREDICTORS, -1), symbols, lengths


def lists_of(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.zeros(sizes.size + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def context_counts(buckets: int) -> object:
    """Group function: contexts of a group's words with how often each byte follows in training words.

    Contexts are dealt to buckets by their highest bits; a row holds a group's contexts of one bucket. A context
    without counts has one entry of count zero.
    """

    def run(words: pa.Table) -> pa.Table:
        used, codes, n, *_ = context_codes(words)
        context = codes >> 8
        first = np.concatenate(([True], context[1:] != context[:-1]))
        stays = (n > 0) | (first & (np.bincount(context, n)[context] == 0))
        context, byte, n = used[context[stays]], (codes[stays] & 255).astype(np.int16), n[stays].astype(np.int64)
        bucket = ((context >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        kinds, sizes = np.unique(bucket, return_counts=True)
        columns = {"context": pa.array(context.view(np.int64)), "byte": pa.array(byte), "n": pa.array(n)}
        part = np.full(kinds.size, words.column("part")[0].as_py(), dtype=np.int32)
        return pa.table({"bucket": kinds, "part": part} | {k: lists_of(sizes, v) for k, v in columns.items()})

    return run


def add_counts(rows: pa.Table) -> pa.Table:
    """Contexts of a bucket that several groups have, with these groups and the sums of their counts."""
    held = {k: rows.column(k).combine_chunks() for k in ("context", "byte", "n")}
    sizes = np.diff(held["context"].offsets.to_numpy())
    part = np.repeat(rows.column("part").to_numpy().astype(np.int64), sizes)
    keys, byte, n = (held[k].flatten().to_numpy() for k in ("context", "byte", "n"))
    used, place = distinct(keys)
    pairs, _ = distinct(place * (1 << 31) + part)
    users = np.bincount(pairs >> 31, minlength=used.size)
    open_ = users > 1
    counted = open_[place] & (n > 0)
    codes, at = distinct(place[counted] * 256 + byte[counted])
    entries = np.bincount(codes >> 8, minlength=used.size)
    open_ &= entries > 0
    total = np.bincount(at, n[counted], minlength=codes.size).astype(np.int64)
    entry = pa.StructArray.from_arrays([pa.array((codes & 255).astype(np.int16)), pa.array(total)], ["byte", "n"])
    pairs = pairs[open_[pairs >> 31]]
    return pa.table(
        {
            "context": used[open_],
            "entries": lists_of(entries[open_], entry),
            "parts": lists_of(users[open_], pa.array((pairs & ((1 << 31) - 1)).astype(np.int32))),
        }
    )


def units_of(vocabulary: DataFrame, *more: str) -> DataFrame:
    return vocabulary.select(*[c for c in ("part", *more, "word", "start", "n") if c in vocabulary.columns])


def shared_counts(vocabulary: DataFrame) -> DataFrame:
    """Stored counts of the contexts of several groups: context, entries (byte, n), and parts."""
    groups = units_of(vocabulary).groupBy("part")
    buckets = max(1, -(-vocabulary.select("part").distinct().count() // BUCKET_GROUPS))
    kind = "bucket int, part int, context array<long>, byte array<short>, n array<long>"
    counts = groups.applyInArrow(context_counts(buckets), kind).groupBy("bucket")
    return stored(counts.applyInArrow(add_counts, "context long, entries array<struct<byte:short,n:long>>, parts array<int>"))


def deal_to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with their entries for each group that has them: one row for each group and piece of the rows."""
    for batch in batches:
        context, parts, entries = (batch.column(k) for k in ("context", "parts", "entries"))
        users, sizes = (np.diff(c.offsets.to_numpy()).astype(np.int64) for c in (parts, entries))
        piece = np.cumsum(users * sizes) // DEAL_ENTRIES
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            part = parts.slice(lo, hi - lo).flatten().to_numpy()
            byte, n = (c.to_numpy() for c in entries.slice(lo, hi - lo).flatten().flatten())
            order = np.argsort(part, kind="stable")
            row = np.repeat(np.arange(hi - lo), users[lo:hi])[order]
            size = sizes[lo:hi]
            first, size = (np.cumsum(size) - size)[row], size[row]
            at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            kinds, begin = np.unique(part[order], return_index=True)
            counts = np.diff(np.append(begin, row.size))
            held = np.add.reduceat(size, begin)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(kinds),
                    "context": lists_of(counts, pa.array(context.slice(lo, hi - lo).to_numpy()[row])),
                    "size": lists_of(counts, pa.array(size.astype(np.int32))),
                    "byte": lists_of(held, pa.array(byte[at])),
                    "n": lists_of(held, pa.array(n[at])),
                }
            )


def widest(shared: DataFrame) -> int:
    """Least number of groups of a context whose counts are broadcast."""
    sizes = shared.groupBy(F.size("parts").alias("p")).agg(F.sum(F.size("entries")).alias("n")).orderBy(F.desc("p")).collect()
    least, total = 1 << 31, 0
    for r in sizes:
        total += r["n"]
        if total > HEAD_COUNTS:
            break
        least = r["p"]
    return least


def flat(shared: DataFrame, *columns) -> DataFrame:
    rows = shared.select(*columns, "context", F.explode("entries").alias("e"))
    return rows.select(*[c for c in rows.columns if c != "e"], "e.byte", "e.n")


def head_arrays(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Contexts, sorted, with the start of each and the end of all, and their bytes, sorted, and counts."""
    context, byte, n = met_arrays(rows)
    order = np.lexsort((byte, context))
    used, first = np.unique(context[order], return_index=True)
    return used, np.append(first, order.size), byte[order].astype(np.uint8), n[order]


def within_head(head: tuple[np.ndarray, ...], used: np.ndarray) -> list[np.ndarray]:
    """Context, byte and count of the head for contexts in use."""
    context, first, byte, n = head
    if not context.size:
        return [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
    place = np.minimum(np.searchsorted(context, used), context.size - 1)
    place = place[context[place] == used]
    size = first[place + 1] - first[place]
    at = np.arange(size.sum()) + np.repeat(first[place] - np.cumsum(size) + size, size)
    return [np.repeat(context[place], size), byte[at].astype(np.int64), n[at]]


def group_tables(words: pa.Table, met: pa.Table, head: tuple[np.ndarray, ...]):
    """Symbols and lengths of a group's words, zeros and ones at the bits of every (context, byte), slots of the symbols.

    Contexts with counts in ``met`` or in the head take these, all others their counts in the group.
    """
    used, own, own_count, at, symbols, lengths = context_codes(words)
    context, byte, n = (np.concatenate(pair) for pair in zip(met_arrays(met), within_head(head, used), strict=True))
    place = np.searchsorted(used, context)
    alone = np.ones(used.size, dtype=bool)
    alone[place] = False
    codes = np.concatenate([place * 256 + byte, own])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    count = np.concatenate([n.astype(np.float64), np.where(alone[own >> 8], own_count, 0.0)])[order]
    mine = np.empty(codes.size, dtype=np.int64)
    mine[order] = np.arange(codes.size)
    mine = mine[place.size :]
    apart = codes[1:] ^ codes[:-1]
    total = np.bincount(codes >> 8, count)[own >> 8]
    zeros, ones = (np.empty((8, own.size), dtype=np.float32) for _ in range(2))
    for bit in range(8):
        change = np.concatenate(([True], (apart >> (8 - bit)) > 0))
        first, owner = np.flatnonzero(change), np.cumsum(change) - 1
        one = np.add.reduceat(count * ((codes >> (7 - bit)) & 1), first)[owner[mine]]
        zeros[bit], ones[bit] = total - one, one
        total = np.where((own >> (7 - bit)) & 1, one, total - one)
    return symbols, lengths, zeros.ravel(), ones.ravel(), lambda bit: [bit * own.size + s for s in at]


def met_arrays(met: pa.Table) -> list[np.ndarray]:
    if "size" in met.column_names:
        context, size, byte, n = (met.column(k).combine_chunks().flatten().to_numpy() for k in ("context", "size", "byte", "n"))
        context = np.repeat(context.view(np.uint64), size)
    else:
        context = met.column("context").to_numpy().view(np.uint64)
        byte, n = met.column("byte").to_numpy(), met.column("n").to_numpy()
    return [context, byte.astype(np.int64), n]


def stretched(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretch of each slot's probability, and its confidence: 0 unseen, 1 seen once or twice, 2 more."""
    zeros, ones = counts[..., 0, :], counts[..., 1, :]
    seen = zeros + ones
    return np.log((ones + PRIOR) / (zeros + PRIOR)), (seen > 0).astype(np.uint8) + (seen > 2)


def left_out(zeros: np.ndarray, ones: np.ndarray, symbols: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    """Stretch of each slot, by bit, without one occurrence of its own byte."""
    byte = np.zeros(zeros.shape[1], dtype=np.uint8)
    for s in slots:
        byte[s] = symbols
    found = np.empty(zeros.shape, dtype=np.float32)
    for bit in range(8):
        one = bit_of(byte, bit) == 1
        found[bit] = np.log((np.maximum(ones[bit] - one, 0) + PRIOR) / (np.maximum(zeros[bit] - ~one, 0) + PRIOR))
    return found


def learn_weights(head) -> object:
    """Group function: online mixing over the words of a group, each left out of its own counts once.

    Gives the group's weights with the mass of each gate, and the hits and ones
    of the refinement buckets.
    """

    def run(words: pa.Table, met: pa.Table) -> pa.Table:
        weights = np.full((PREDICTORS, GATES), 1.0 / 3.0)
        mass = np.zeros(GATES)
        hits = np.zeros(8 * BUCKETS * 2)
        if words.num_rows:
            all_symbols, all_lengths, zeros, ones, slots_at = group_tables(words, met, head.value)
            all_slots = slots_at(0)
            confidence = stretched(np.stack([zeros, ones]))[1].reshape(8, -1)
            zeros, ones = zeros.reshape(8, -1), ones.reshape(8, -1)
            inputs = left_out(zeros, ones, all_symbols, all_slots)
            times = np.repeat(words.column("n").to_numpy(), all_lengths)
            edges = np.concatenate(([0], np.cumsum(all_lengths)))[::LEARN_WORDS].tolist()
            edges = edges if edges[-1] == all_symbols.size else [*edges, all_symbols.size]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                symbols, n = all_symbols[lo:hi], times[lo:hi]
                slots = [s[lo:hi] for s in all_slots]
                order = np.log1p(n.astype(np.float64))
                for bit in range(8):
                    outcome = bit_of(symbols, bit)
                    gate = gate_of([confidence[bit]] * PREDICTORS, slots, bit)
                    known = [inputs[bit][s].astype(np.float64) for s in slots]
                    mixed = np.zeros(symbols.size)
                    for k in range(PREDICTORS):
                        mixed += weights[k][gate] * known[k]
                    cell = (bit * BUCKETS + buckets(mixed)) * 2 + outcome
                    hits += np.bincount(cell, n, minlength=hits.size)
                    error = (outcome - squash(mixed)) * order
                    share = np.bincount(gate, order, minlength=GATES)
                    for k in range(PREDICTORS):
                        step = np.bincount(gate, error * known[k], minlength=GATES)
                        weights[k] += RATE * step / np.maximum(share, 1.0)
                    mass += share
        kind = np.concatenate([np.zeros(GATES * PREDICTORS), np.ones(GATES), np.full(hits.size, 2)])
        place = np.concatenate([np.arange(GATES * PREDICTORS), np.arange(GATES), np.arange(hits.size)])
        value = np.concatenate([(weights * mass).T.ravel(), mass, hits])
        return pa.table({"kind": pa.array(kind.astype(np.int32)), "place": pa.array(place.astype(np.int32)), "value": value})

    return run


def fit(vocabulary: DataFrame, met: DataFrame, head) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and refinement, learnt from stored training units (part, word, start, n) and the counts they meet."""
    rows = (
        units_of(vocabulary).groupBy("part")
        .cogroup(met.groupBy("part"))
        .applyInArrow(learn_weights(head), "kind int, place int, value double")
        .groupBy("kind", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    weights, mass, hits = np.zeros(GATES * PREDICTORS), np.zeros(GATES), np.zeros(8 * BUCKETS * 2)
    for r in rows:
        (weights, mass, hits)[r["kind"]][r["place"]] = r["value"]
    weights = weights.reshape(GATES, PREDICTORS)
    mean = weights / np.maximum(mass, 1e-9)[:, None]
    mean[mass == 0] = 1.0 / 3.0
    hits = hits.reshape(8, BUCKETS, 2)
    centre = squash(np.linspace(-8.0, 8.0, BUCKETS))
    refine = (hits[..., 1] + 20.0 * centre) / (hits.sum(axis=2) + 20.0)
    return mean.astype(np.float32), refine


def score_words(learnt, head) -> object:
    """Group function: log10 probability of every word of a group."""

    def run(words: pa.Table, met: pa.Table) -> pa.Table:
        scores = np.zeros(0)
        if words.num_rows:
            symbols, lengths, zeros, ones, slots_at = group_tables(words, met, head.value)
            stretch, confidence = stretched(np.stack([zeros, ones]))
            model = ([stretch] * PREDICTORS, [confidence] * PREDICTORS, *learnt.value)
            scores = log10_probabilities(model, symbols, lengths, slots_at)
        return pa.table({"hash": words.column("hash"), "start": words.column("start"), "n": words.column("n"), "score": scores})

    return run


def scored_units(vocabulary: DataFrame) -> DataFrame:
    """Stored log10 probability of every distinct unit: hash, start, n, score; ``vocabulary`` has hash, word, start and n.

    A word's score is that of its symbols after the first ones, 0 if it has none.
    """
    sc = vocabulary.sparkSession.sparkContext
    groups = max(1, -(-vocabulary.count() // GROUP))
    vocabulary = vocabulary.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(groups)).cast("int"))
    longer = (F.col("start") > 0) | (F.octet_length("word") >= ORDERS)
    short = vocabulary.where(~longer).select("hash", "start", "n", F.lit(0.0).alias("score"))
    vocabulary = vocabulary.where(longer)
    shared = shared_counts(vocabulary)
    least = widest(shared)
    head = sc.broadcast(head_arrays(flat(shared.where(F.size("parts") >= least)).toArrow()))
    met = shared.where(F.size("parts") < least).mapInArrow(
        deal_to_parts, "part int, context array<long>, size array<int>, byte array<short>, n array<long>"
    )
    learnt = sc.broadcast(fit(vocabulary, met, head))
    words = units_of(vocabulary, "hash").groupBy("part").cogroup(met.groupBy("part"))
    return stored(words.applyInArrow(score_words(learnt, head), "hash long, start int, n long, score double").unionByName(short))


def score_texts(head) -> object:
    """Task function: sums over the units of each text; words and junctions outside the heads are listed for the join."""

    def found(kinds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each kind among sorted hashes, and whether it is there."""
        place = np.minimum(np.searchsorted(hashes, kinds), max(hashes.size - 1, 0))
        return place, hashes[place] == kinds if hashes.size else np.zeros(kinds.size, dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, head_logs, head_scores, near, near_scores = head.value
        for batch in batches:
            parts = [[] for _ in range(5)]
            rare: list[np.ndarray] = []
            times: list[np.ndarray] = []
            for lo, hi, texts in sliced_texts(batch.column("text")):
                w = find_words(texts)
                kinds, back = distinct(w.hashes)
                place, common = found(kinds, hashes)
                score = np.zeros(kinds.size)
                logs = np.zeros(kinds.size)
                if common.any():
                    score[common], logs[common] = head_scores[place[common]], head_logs[place[common]]
                keys, text = junctions(w)
                pairs, pair = distinct(keys)
                place, close = found(pairs, near)
                join = np.zeros(pairs.size)
                if close.any():
                    join[close] = near_scores[place[close]]
                owner = np.repeat(np.arange(hi - lo), w.counts)
                parts[0].append(w.counts + 1)
                words, starts = (np.bincount(o, v, minlength=hi - lo) for o, v in ((owner, score[back]), (text, join[pair])))
                parts[1].append(words + starts)
                parts[2].append(np.bincount(owner, common[back], minlength=hi - lo).astype(np.int64))
                parts[3].append(np.bincount(owner, logs[back], minlength=hi - lo))
                tail, far = ~common[back], ~close[pair]
                every = np.concatenate((kinds, pairs))
                keys = np.concatenate((owner[tail] * every.size + back[tail], text[far] * every.size + kinds.size + pair[far]))
                keys, n = np.unique(keys, return_counts=True)
                rare.append(every[keys % max(every.size, 1)].view(np.int64))
                times.append(n.astype(np.int32))
                parts[4].append(np.bincount(keys // max(every.size, 1), minlength=hi - lo).astype(np.int64))
            if not batch.num_rows:
                continue
            n_tokens, total, n_head, head_log, n_rare = (np.concatenate(p) for p in parts)
            offsets = pa.array(np.concatenate(([0], np.cumsum(n_rare))).astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                {
                    "row_": batch.column("row_"),
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(n_tokens.astype(np.int64)),
                    "score": pa.array(total),
                    "n_head": pa.array(n_head),
                    "head_log": pa.array(head_log),
                    "rare": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rare))),
                    "times": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times))),
                }
            )

    return run


def sorted_head(units: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, sorted, counts and scores of the most frequent units."""
    top = units.orderBy(F.desc("n"), "hash").limit(most).toArrow()
    hashes = top["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top["n"].to_numpy()[order], top["score"].to_numpy()[order]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: int = 1) -> DataFrame:
    """Base and mixing scores of every text.

    Learns from rows whose crc32(id as text) mod 5 is not ``fold``. Null texts
    count as empty: one end token. Rows are numbered in the one scan that scores
    them and keep their id there, so null ids and repeated rows each get their
    line. Without training rows the model is
    uniform and no token is known. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row_"))
    words = rows.select("text", (crc_mod("doc_id", 5) != fold).alias("train"))
    units = words.mapInArrow(count_units, "hash long, word binary, n long").groupBy("hash", "word").agg(F.sum("n").alias("n"))
    junction = F.col("word").isNull()
    vocabulary = stored(
        units.select(
            "hash",
            F.when(junction, F.unhex(F.lpad(F.hex("hash"), 16, "0"))).otherwise(F.col("word")).alias("word"),
            F.when(junction, F.lit(ORDERS)).otherwise(F.lit(0)).alias("start"),
            "n",
        )
    )
    facts = vocabulary.where("start = 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count(F.when(F.col("n") > 0, 1)).alias("v"),
        F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0)).alias("ends"),
    ).first()
    scored = scored_units(vocabulary)
    end_hash = int(END_HASH.astype(np.int64))
    is_word = (F.col("start") == 0) & (F.col("n") > 0) & (F.col("hash") != end_hash)
    hashes, n, word_scores = sorted_head(scored.where(is_word), HEAD)
    near, _, near_scores = sorted_head(scored.where("start > 0"), HEAD_JUNCTIONS)
    head = spark.sparkContext.broadcast((hashes, np.log10(n + 0.5), word_scores, near, near_scores))
    schema = f"row_ long, doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, score double, n_head long, head_log double, rare array<long>, times array<int>"
    sums = stored(rows.select("row_", "doc_id", "text").mapInArrow(score_texts(head), schema))
    rare = sums.select("row_", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    rare = rare.select("row_", F.col("w.rare").alias("hash"), F.col("w.times").alias("times"))
    # a count of zero contributes log10(0.5) like any other, so it gains nothing; junctions are no tokens
    tokens = F.when(F.col("start") == 0, F.col("n")).otherwise(0).alias("n")
    met = rare.join(scored.select("hash", tokens, "score"), "hash")
    gain = F.col("times") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))
    known = F.when(F.col("n") > 0, F.col("times")).otherwise(0)
    found = met.groupBy("row_").agg(
        F.sum(gain).alias("gain"), F.sum(known).alias("n_rare"), F.sum(F.col("times") * F.col("score")).alias("rare_score")
    )
    n, v, ends = facts["n"], facts["v"], facts["ends"]
    below = math.log10(n + 0.5 * (v + 1))
    half, end_log = math.log10(0.5), math.log10(ends + 0.5)
    unseen = F.col("n_tokens") - 1 - F.col("n_head")
    base = F.col("head_log") + F.lit(end_log) + unseen * half + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * below
    return (
        sums.drop("rare", "times")
        .join(found, "row_", "left")
        .select(
            "doc_id",
            (crc_mod("doc_id", 5) == fold).alias("held_out"),
            "n_tokens",
            (F.col("n_head") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
        )
    )


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Repair the structure of conversations at least cost, by prefix-doubling path ranking.

Rows of a conversation are kept, given another role or deleted, and empty turns
inserted, so that the initials of the roles become ``(s?(ua)+)?`` at least cost.
Layer i of a graph holds the four states that an output can be in when i rows
are done: nothing yet, after s, after u, after a. Every edit is an arc with a
cost and a letter. A pass from the end gives each node its cost to the end; arcs
that keep it are optimal. Nodes are then ranked by their least audit letters: by
the first letter, then, with ranks and pointers doubled, by the first 2, 4, 8,
... letters. Among optimal arcs the letter and the rank of its target select the
least path, which is read by its doubled pointers, all places at once. The arcs
of a node differ in their letters (a state admits one role), so equal beginnings
lead to the same node and one pointer a node is enough.

Spark orders the rows of all conversations in ranges, so no conversation, however
long, is sorted in one task; equal rows of a turn are counted before. A row is
reduced to one byte, bytes are gathered in segments and segments to conversations
(an audit has a letter for each row, so a conversation's bytes fit where its
audit does). Edits go back to the rows by segment. The repaired text is digested
as a stream of a conversation's rows, never held as a whole; a digest runs through
all of them, so that last pass of one conversation is one task's.

Defined cases: null roles, texts, ids and turns count as one space in roles, texts
and the damage key; a null id is a conversation of its own, null turns come first.
Rows of one turn are ordered by role, then text. A role is known by its first
letter; a role without s, u or a in front, or an empty one, is never kept and makes
a pair illegal. Conversations without rows after damage have zeros, an empty audit
and the digest of an empty text. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import stored, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SEGMENT = 1 << 12
# Rows ranked together; a longer conversation is solved in blocks of so many rows.
BLOCK = 1 << 15
NONE, BLANK, DUPLICATE, CUT = range(4)

# States: nothing yet, after s, after u, after a. The next state if a user or an
# assistant turn follows (only one of them can).
FOLLOWS = np.array([2, 2, 3, 2])
ROLE_OF = np.array([1, 1, 2, 1])
LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)
END, D, I, K, R = range(5)
FAR = 1 << 40


# --- rows ---


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage, equal ones of a turn counted: columns conv, turn, role, text, copies."""

    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    hurt = rows.withColumn("kind", kind).where("kind <> 0")
    return counted(
        hurt.select(
            F.col("conv_id").alias("conv"),
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(text_of("role")).alias("role"),
            text.alias("text"),
            F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
        )
    )


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, stored with their place ``at``, and without faults that need others."""
    spread = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    bare = F.rtrim("text", F.lit(SPACES))
    ends = F.substring(bare, -1, 1).isin(".", "!", "?")
    fault = F.when(bare == "", BLANK).when(ends, NONE).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    group = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    numbered = spread.withColumn("at", F.monotonically_increasing_id())
    return stored(
        numbered.withColumns(
            {"fault": fault, "initial": group, "digest": F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)}
        ).withColumn("segment", F.floor(F.col("at") / SEGMENT))
    )


def conversations_of(rows: DataFrame) -> DataFrame:
    """One row for each conversation: its segments in order, with their first places and row bytes."""
    firsts = rows.groupBy("conv", "digest").agg(F.min("at").alias("first")).select("first")
    again = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    marked = rows.select("conv", "segment", "at", "copies", "fault", "initial").join(firsts, F.col("at") == F.col("first"), "left")
    # a byte is 4 * initial + fault; further copies of a row are blank or duplicates
    byte = (F.col("initial") * 4 + again).cast("int")
    more = (F.col("initial") * 4 + F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)).cast("int")
    one = F.struct("at", byte.alias("byte"), more.alias("more"), "copies")
    segments = marked.groupBy("conv", "segment").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    bytes_of = F.transform(
        "rows", lambda r: F.concat(F.hex(r["byte"]), F.repeat(F.hex(r["more"]), (r["copies"] - 1).cast("int")))
    )
    packed = segments.select(
        "conv",
        F.struct(
            "segment",
            F.col("rows")[0]["at"].alias("first"),
            F.transform("rows", lambda r: r["copies"]).alias("copies"),
            F.array_join(bytes_of, "").alias("codes"),
        ).alias("s"),
    )
    return packed.groupBy("conv").agg(F.array_sort(F.collect_list("s")).alias("segments"))


# --- the graph ---


class Edits(NamedTuple):
    """Cost and audit of a conversation; ``ends`` counts the letters up to and with each row's own."""

    cost: int
    audit: np.ndarray
    ends: np.ndarray
    states: np.ndarray


def row_costs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of keeping a row and of another role, by state before it, and the state after keeping it."""
    initial, fault = codes >> 2, codes & 3
    extra = np.where(fault == CUT, TRUNCATED, 0)[:, None]
    must_go = ((fault == BLANK) | (fault == DUPLICATE))[:, None]
    states = np.arange(4)
    fits = (initial[:, None] > 1) & (ROLE_OF[states] == (initial - 1)[:, None])
    fits |= (initial[:, None] == 1) & (states == 0)
    keep = np.where(fits & ~must_go, extra, FAR)
    rerole = np.where(must_go, FAR, extra + REROLE) + np.zeros(4, dtype=np.int64)
    after = np.where((initial == 1)[:, None], 1, FOLLOWS)
    return keep, rerole, after


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs to the end if turns may be inserted first; a useful run of inserts visits no state twice."""
    for _ in range(3):
        cost = np.minimum(cost, INSERT + cost[:, FOLLOWS])
    return cost


END_COSTS = with_inserts(np.array([[0, FAR, FAR, 0]], dtype=np.int64))


class Layers(NamedTuple):
    """Conversations (or blocks of one) side by side: rows, and layers (a row's is the one before it)."""

    lengths: np.ndarray
    row: np.ndarray
    layer: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> Layers:
        before = np.cumsum(lengths) - lengths
        return Layers(lengths, before, before + np.arange(len(lengths)))


def costs_to_end(costs: tuple, layers: Layers, end: np.ndarray) -> np.ndarray:
    """Cost from every node (layer x state) to the end; ``end`` holds the costs at the last layers."""
    keep, rerole, after = costs
    lengths, row, layer = layers
    cost = np.empty((int(lengths.sum()) + len(lengths), 4), dtype=np.int64)
    cost[layer + lengths] = end
    by_length = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[by_length], -np.arange(int(lengths.max(initial=0))), side="left")
    for step, n in enumerate(live.tolist()):
        some = by_length[:n]
        back = lengths[some] - 1 - step
        r, at = row[some] + back, layer[some] + back
        then = cost[at + 1]
        kept = keep[r] + np.take_along_axis(then, after[r], axis=1)
        changed = rerole[r] + then[:, FOLLOWS]
        cost[at] = with_inserts(np.minimum(np.minimum(kept, changed), DELETE + then))
    return cost


def optimal_arcs(costs: tuple, layers: Layers, cost: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Targets of the optimal arcs of every node by letter D, I, K, R (-1: none).

    ``last`` tells which last layers are ends of conversations, where turns may
    still be inserted; elsewhere a last layer is the first one of the next block.
    """
    keep, rerole, after = costs
    lengths, row, layer = layers
    n = len(cost)
    state = np.arange(4)
    node = np.arange(4 * n).reshape(n, 4)
    final = np.zeros(n, dtype=bool)
    final[layer + lengths] = True
    rows_at = np.flatnonzero(~final)
    targets = np.full((4 * n, 4), -1, dtype=np.int64)
    here, then = cost[rows_at], cost[rows_at + 1]
    below = 4 * (rows_at[:, None] + 1)
    nodes = node[rows_at]
    best = {
        D: (DELETE + then, below + state),
        K: (keep + np.take_along_axis(then, after, axis=1), below + after),
        R: (rerole + then[:, FOLLOWS], below + FOLLOWS),
    }
    for letter, (value, target) in best.items():
        targets[nodes, letter - 1] = np.where(value == here, target, -1)
    open_ = ~final
    open_[(layer + lengths)[last]] = True
    at = np.flatnonzero(open_)
    grows = INSERT + cost[at][:, FOLLOWS] == cost[at]
    targets[node[at], I - 1] = np.where(grows, 4 * at[:, None] + FOLLOWS, -1)
    return targets


def doubled(pointer: np.ndarray, most: int) -> list[np.ndarray]:
    """Where every node's path leads after 1, 2, 4, ... letters, up to ``most``."""
    pointers, reach = [pointer], 1
    while reach < most:
        pointers.append(pointers[-1][pointers[-1]])
        reach *= 2
    return pointers


def least_arcs(targets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Letter and target of the arc that begins each node's least audit.

    Nodes are ranked by their least first letter, then by twice as many letters
    at a time: the rank so far, then the rank of the node reached so far. An end
    points at itself with a letter before all others, so a path that ends ranks
    before its continuations. Arcs are compared by letter, then by the rank of
    their target.
    """
    nodes = np.arange(len(targets))
    base = len(nodes) + R + 1
    ends = (targets < 0).all(axis=1)
    first = (targets >= 0).argmax(axis=1)
    rank = np.where(ends, END, first + D)
    pointer, reach, kinds = np.where(ends, nodes, targets[nodes, first]), 1, 0
    while reach < most:
        found, rank = np.unique(rank * base + rank[pointer], return_inverse=True)
        if len(found) == kinds:  # nothing was told apart by more letters, so nothing ever will be
            break
        pointer, reach, kinds = pointer[pointer], reach * 2, len(found)
    value = np.where(targets >= 0, np.arange(D, R + 1) * base + rank[targets], np.iinfo(np.int64).max)
    arc = value.argmin(axis=1)
    return np.where(ends, END, arc + D), np.where(ends, nodes, targets[nodes, arc])


def read_paths(letter: np.ndarray, pointers: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the least paths from some nodes, one after another, the nodes they leave, and their lengths."""
    count = [(letter != END).astype(np.int64)]
    for p in pointers[:-1]:
        count.append(count[-1] + count[-1][p])
    lengths = count[-1][starts]
    node = np.repeat(starts, lengths)
    place = np.arange(len(node)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for k, p in enumerate(pointers):
        node = np.where((place >> k) & 1, p[node], node)
    return letter[node], node, lengths


def least_paths(codes: np.ndarray, lengths: np.ndarray, end: np.ndarray, last: np.ndarray, first: np.ndarray):
    """Letters, the states they are written in, audit lengths, cost and last state for each conversation or block."""
    layers = Layers.of(lengths)
    costs = row_costs(codes)
    cost = costs_to_end(costs, layers, end)
    # three inserts at most before each row and at the end
    most = 4 * (int(lengths.max(initial=0)) + 1)
    letter, pointer = least_arcs(optimal_arcs(costs, layers, cost, last), most)
    pointers = doubled(pointer, most)
    starts = 4 * layers.layer + first
    letters, nodes, sizes = read_paths(letter, pointers, starts)
    return letters, nodes % 4, sizes, cost[layers.layer, first], pointers[-1][starts] % 4


def solve(conversations: list[np.ndarray]) -> list[Edits]:
    """Cheapest edits of some conversations, those of at most BLOCK rows together."""
    out: list[Edits | None] = [None] * len(conversations)
    short = [i for i, c in enumerate(conversations) if len(c) <= BLOCK]
    lo = 0
    while lo < len(short):
        hi, rows = lo, 0
        while hi < len(short) and (hi == lo or rows + len(conversations[short[hi]]) <= BLOCK):
            rows += len(conversations[short[hi]])
            hi += 1
        some = short[lo:hi]
        lengths = np.array([len(conversations[i]) for i in some], dtype=np.int64)
        codes = np.concatenate([conversations[i] for i in some])
        n = len(some)
        found = least_paths(codes, lengths, np.repeat(END_COSTS, n, axis=0), np.ones(n, bool), np.zeros(n, np.int64))
        letters, states, sizes, cost, _ = found
        edge = np.concatenate(([0], np.cumsum(sizes)))
        for j, i in enumerate(some):
            out[i] = edits(int(cost[j]), letters[edge[j] : edge[j + 1]], states[edge[j] : edge[j + 1]])
        lo = hi
    for i, c in enumerate(conversations):
        if out[i] is None:
            out[i] = solve_long(c)
    return out


def solve_long(codes: np.ndarray) -> Edits:
    """One long conversation: costs at the blocks' borders from the end, then the path block by block."""
    cuts = list(range(0, len(codes), BLOCK))
    borders = [END_COSTS]
    for lo in reversed(cuts):
        part = codes[lo : lo + BLOCK]
        cost = costs_to_end(row_costs(part), Layers.of(np.array([len(part)])), borders[-1])
        borders.append(cost[:1])
    borders.reverse()
    letters, states, state = [], [], np.zeros(1, np.int64)
    for n, lo in enumerate(cuts):
        part = codes[lo : lo + BLOCK]
        last = np.array([lo == cuts[-1]])
        more, before, _, _, state = least_paths(part, np.array([len(part)]), borders[n + 1], last, state)
        letters.append(more)
        states.append(before)
    return edits(int(borders[0][0, 0]), np.concatenate(letters), np.concatenate(states))


def edits(cost: int, letters: np.ndarray, states: np.ndarray) -> Edits:
    return Edits(cost, LETTERS[letters], np.flatnonzero(letters != I) + 1, states)


def row_tokens(found: Edits, n: int) -> list[str]:
    """What each row puts into the repaired text: u or a for an inserted turn, K, or U or A for a new role."""
    names = np.frombuffer(b"?ua", dtype=np.uint8)[ROLE_OF[found.states]]
    tokens = np.where(found.audit == ord("I"), names, found.audit)
    tokens = np.where(found.audit == ord("R"), names - 32, tokens).astype(np.uint8)
    edge = [0, *found.ends.tolist()]
    whole = tokens.tobytes().decode()
    out = [whole[a:b].replace("D", "") for a, b in zip(edge, edge[1:], strict=False)]
    if n and edge[-1] < len(whole):
        out[-1] += whole[edge[-1] :]
    return out


# --- Spark ---


def repaired(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and, for each segment, the tokens of its rows."""
    kind = conversations.schema["conv"].dataType.simpleString()
    fields = pa.schema(
        [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string()), ("edits", pa.list_(pa.struct([("segment", pa.int64()), ("first", pa.int64()), ("tokens", pa.list_(pa.string()))])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = batch.column(1).to_pylist()
            codes = [from_hex("".join(s["codes"] for s in segments)) for segments in listed]
            rows = [report(c, e, s) for c, e, s in zip(codes, solve(codes), listed, strict=True)]
            out = pa.RecordBatch.from_pylist(rows, schema=fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["conv", *fields.names])

    schema = (
        f"conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "edits array<struct<segment:long,first:long,tokens:array<string>>>"
    )
    return conversations.mapInArrow(run, schema)


def from_hex(digits: str) -> np.ndarray:
    """The numbers that hexadecimal digits (0-9, A-F) stand for."""
    b = np.frombuffer(digits.encode(), dtype=np.uint8).astype(np.int64)
    return (b & 15) + 9 * (b >> 6)


def report(codes: np.ndarray, found: Edits, segments: list[dict]) -> dict:
    fault, initial = codes & 3, codes >> 2
    pair = initial[:-1] * 4 + initial[1:]
    tokens = row_tokens(found, len(codes))
    listed, at = [], 0
    for s in segments:
        joined = []
        for n in s["copies"]:
            joined.append("".join(tokens[at : at + n]))
            at += n
        listed.append({"segment": s["segment"], "first": s["first"], "tokens": joined})
    return {
        "blank": int((fault == BLANK).sum()),
        "duplicate": int((fault == DUPLICATE).sum()),
        "truncated": int((fault == CUT).sum()),
        "illegal": int((~np.isin(pair, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))).sum()),
        "cost": found.cost,
        "audit": found.audit.tobytes().decode(),
        "edits": listed,
    }


def repaired_turns(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired turns: conv, at (place of the row they come from or stand by), lines in order."""
    pieces = solved.select(F.col("conv").alias("c"), F.explode("edits").alias("e")).select("c", "e.*")
    met = rows.join(pieces.withColumnRenamed("segment", "s"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    token = F.element_at("tokens", (F.col("at") - F.col("first") + 1).cast("int"))

    def line(t: Column) -> Column:
        return (
            F.when(t == "u", "user:").when(t == "a", "assistant:").when(t == "K", F.concat("role", F.lit(":"), "text"))
            .when(t == "U", F.concat(F.lit("user:"), "text")).otherwise(F.concat(F.lit("assistant:"), "text"))
        )

    steps = F.filter(F.split(token, ""), lambda t: t != "")
    return met.select("conv", "at", F.transform(steps, line).alias("lines")).where(F.size("lines") > 0)


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's lines joined by line feeds, streamed in order."""
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = "\n".join(lines).encode()
                if digest is not None and conv == held:
                    digest.update(b"\n" + text)
                    continue
                if digest is not None:
                    done.append((held, digest.hexdigest()))
                held, digest = conv, hashlib.sha256(text)
            if done:
                yield out(done, batch.column(0).type)
            key = batch.column(0).type
        if digest is not None:
            yield out([(held, digest.hexdigest())], key)

    def out(done: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], key), pa.array([s for _, s in done], pa.string())], ["conv", "sha"]
        )

    together = turns.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "lines")
    return together.mapInArrow(run, f"conv {kind}, sha string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every conversation its faults, edits and digest; and the repaired turns.

    The first frame has a row for every conv_id of the input, the second has
    ``lines`` (role:text) in the order of conv and at.
    """
    rows = ordered(damaged(conversations))
    solved = stored(repaired(conversations_of(rows)))
    turns = repaired_turns(rows, solved)
    spans = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv")
    gaps = spans.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = (
        conversations.select(F.col("conv_id").alias("conv"))
        .distinct()
        .unionByName(gaps, allowMissingColumns=True)
        .unionByName(solved.drop("edits"), allowMissingColumns=True)
        .unionByName(digests(turns), allowMissingColumns=True)
        .groupBy("conv")
        .agg(*[F.max(c).alias(c) for c in (*counts, "audit", "sha")])
    )
    return (
        found.select(
            F.col("conv").alias("conv_id"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        ),
        turns,
    )


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))[0]


# Row by row from the end: for each state the cheapest edits with the least audit, and their lines.
OP12_SQL = r"""
WITH RECURSIVE key AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations),
  kinds AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT)),
                  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
                                             lambda v, bit: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 20 AS kind
    FROM key),
  hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0),
  placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           count(*) OVER (PARTITION BY conv_id) AS n,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM hurt),
  faults AS (
    SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
           CASE WHEN bare = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed),
  rows_ AS (
    SELECT conv_id, i, c, text, role || ':' || text AS line, fault NOT IN ('blank', 'duplicate') AS stays,
           CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut
    FROM faults),
  walk AS (
    SELECT conv_id, max(i) AS i, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s0,
           {'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']} AS s1,
           {'c': 3::BIGINT, 'a': 'I', 't': ['assistant:']} AS s2, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s3
    FROM rows_ GROUP BY conv_id
    UNION ALL
    SELECT conv_id, i - 1,
           list_min(go0 || [{'c': v2.c + 3, 'a': 'I' || v2.a, 't': ['user:'] || v2.t}]),
           list_min(go1 || [{'c': v2.c + 3, 'a': 'I' || v2.a, 't': ['user:'] || v2.t}]), v2, v3
    FROM (
      SELECT conv_id, i, go0, go1,
             list_min([w2, {'c': w3.c + 3, 'a': 'I' || w3.a, 't': ['assistant:'] || w3.t}]) AS v2,
             list_min([w3, {'c': w2.c + 3, 'a': 'I' || w2.a, 't': ['user:'] || w2.t}]) AS v3
      FROM (
        SELECT conv_id, i,
               [{'c': s0.c + 4, 'a': 'D' || s0.a, 't': s0.t}] || to_u
                 || CASE WHEN stays AND c = 's' THEN [{'c': s1.c + cut, 'a': 'K' || s1.a, 't': [line] || s1.t}] ELSE [] END AS go0,
               [{'c': s1.c + 4, 'a': 'D' || s1.a, 't': s1.t}] || to_u AS go1,
               list_min([{'c': s2.c + 4, 'a': 'D' || s2.a, 't': s2.t}] || to_a) AS w2,
               list_min([{'c': s3.c + 4, 'a': 'D' || s3.a, 't': s3.t}] || to_u) AS w3
        FROM (
          SELECT w.*, r.c, r.line, r.stays, r.cut,
                 CASE WHEN NOT r.stays THEN []
                      WHEN r.c = 'u' THEN [{'c': s2.c + r.cut, 'a': 'K' || s2.a, 't': [r.line] || s2.t}]
                      ELSE [{'c': s2.c + r.cut + 3, 'a': 'R' || s2.a, 't': ['user:' || r.text] || s2.t}] END AS to_u,
                 CASE WHEN NOT r.stays THEN []
                      WHEN r.c = 'a' THEN [{'c': s3.c + r.cut, 'a': 'K' || s3.a, 't': [r.line] || s3.t}]
                      ELSE [{'c': s3.c + r.cut + 3, 'a': 'R' || s3.a, 't': ['assistant:' || r.text] || s3.t}] END AS to_a
          FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i)))),
  best AS (SELECT conv_id, s0 AS s FROM walk WHERE i = 0),
  facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit,
       sha256(coalesce(array_to_string(s.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
"""

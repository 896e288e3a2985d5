"""Exact copies of texts by two passes over a Bloom filter, with DataFrame functions only.

Pass one sets ``HASHES`` slots of a filter for every text hash and keeps the
slots that were hit more than once. Pass two tests every row: a row with a slot
hit once cannot have a copy and passes straight through. Only the rows that may
be repeated are shuffled, grouped by their full digest and marked.

The filter has a power of two of bits, about ``BITS_PER_ROW`` for a row and at
most ``MOST_BITS`` (32 MB when sent to the tasks). Beyond that size more rows
than needed are shuffled; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import SPACE_CLASS, free_name, stored, table

BITS_PER_ROW = 16
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 28
HASHES = 2
BLOCK = 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


def filter_bits(rows: int) -> int:
    wanted = max(LEAST_BITS, BITS_PER_ROW * max(rows, 1))
    return min(MOST_BITS, 1 << (wanted - 1).bit_length())


def slots(sha: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def repeated_slots(digests: DataFrame, sha: str, bits: int) -> Column:
    """Slots hit by more than one row, as an array of bit blocks (one value).

    A slot's count is summed in each task before it is shuffled, so a text
    that a third of all rows share costs one row for each task.
    """
    hits = digests.select(F.explode(F.array(*slots(F.col(sha), bits))).alias("slot"))
    # the two slots of one row may be the same, which only lets the row through
    often = hits.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bit_blocks(often.select("slot"), bits)


def bit_blocks(slots_: DataFrame, bits: int) -> Column:
    """A filter with the bits of a column ``slot`` set, as an array of bit blocks (one value)."""
    blocks = slots_.groupBy(F.floor(F.col("slot") / BLOCK).alias("block")).agg(
        F.bitmap_construct_agg(F.col("slot") % BLOCK).alias("bits")
    )
    every = slots_.sparkSession.range(0, max(1, bits // BLOCK), 1, 1).withColumnRenamed("id", "block")
    return (
        every.join(blocks, "block", "left")
        .agg(F.array_sort(F.collect_list(F.struct("block", "bits"))).alias("b"))
        .select(F.transform("b", lambda s: s["bits"]).alias("blocks"))
        .scalar()
    )


def in_blocks(slot: Column, filled: Column) -> Column:
    """Whether a slot's bit is set."""
    block = F.element_at(filled, (F.floor(slot / BLOCK) + 1).cast("int"))
    at = slot % BLOCK
    byte = F.conv(F.hex(F.substring(block, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False))


def may_repeat(sha: Column, bits: int, filled: Column) -> Column:
    """Whether all slots of a digest were hit more than once."""
    hit = F.lit(True)
    for s in slots(sha, bits):
        hit = hit & in_blocks(s, filled)
    return hit


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest, keep_id, group_size and kept of every row, with the rows' ids.

    Texts are equal when identical after each run of white space became one
    space; null counts as empty. The row with the smallest id stays; a null id
    comes after all others, and of rows that share the smallest id each is
    marked kept (``drop_copies`` keeps one of them). Only the columns doc_id,
    keep_id, group_size, kept and text_sha256 are returned.
    """
    digests = stored(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256")))
    bits = filter_bits(digests.count())
    filled = repeated_slots(digests, "text_sha256", bits)
    tested = digests.withColumn("may_repeat", may_repeat(F.col("text_sha256"), bits, filled))
    alone = tested.where(~F.col("may_repeat")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    rest = tested.where("may_repeat").drop("may_repeat")
    groups = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    marked = rest.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(marked)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; exactly one for each different text.

    Rows that may be repeated are reduced by their digest with the smallest id;
    among rows of one id any one stays, as they differ in other columns only.
    """
    sha = free_name(docs, "sha_")
    digests = stored(docs.select(digest(F.col(text)).alias("sha")))
    bits = filter_bits(digests.count())
    filled = repeated_slots(digests, "sha", bits)
    rows = docs.withColumn(sha, digest(F.col(text)))
    alone = rows.where(~may_repeat(F.col(sha), bits, filled))
    rest = rows.where(may_repeat(F.col(sha), bits, filled))
    # whole rows are reduced, in each task first, so no later scan has to find a row again
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))
    kept = rest.groupBy(sha).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return alone.select(*docs.columns).unionByName(kept.select("row.*"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


# The digest is written out because the SQL has to state the same white space.
OP3_SQL = r"""
WITH h AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""

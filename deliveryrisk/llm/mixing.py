"""Mix sources to target weights along a low-discrepancy schedule.

Slot t of the schedule maps the point frac(t / golden ratio) through the
cumulative weights to a source, so every stretch of the schedule holds the
sources in proportion. The texts of a source, in hashed order, form one line of
words that is cut into blocks of ``BLOCK`` words. Slots are ranked within their
source; rank j takes block j, starting again when the blocks are used up. A
source stops exactly at its target: surplus slots go, its last one is cut, and
slots the points did not reach are appended.

No source is handled in one task: texts are numbered in ranges of their hash,
slots in stretches of the schedule, and only range totals meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deliveryrisk.llm.common import WORD_CLASS, free_name, stored, table

BLOCK = 1024
STRETCH = 1 << 14
RANGE_ROWS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
GOLDEN = 0.6180339887498949


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS
) -> DataFrame:
    """Target of every source (columns source, source_size).

    Sources ordered by code point, null last, take the weights in turn and
    divide ``share`` of all words; a source stops at ``repeats`` times its size
    and the excess is shared again. Filling sources in the order of size by
    weight finds where that ends in one step. Windows run over sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    cap = (F.col("source_size") * repeats).cast("double")
    rows = sizes.withColumn("weight", w).withColumn("cap", cap)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "left": F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weights": F.sum("weight").over(after),
        }
    )
    full = F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight")
    rows = rows.withColumn("full", full)
    level = F.max(F.when(~F.col("full"), F.struct(F.col("weights"), F.col("left")))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("cap")).otherwise(level["left"] / level["weights"] * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def placed(rows: DataFrame, order: Column) -> DataFrame:
    """Start of every row in its source's line of words: columns source, size kept, ``start`` added.

    ``order`` is a text hash; its leading digits cut a source into ranges of
    about ``RANGE_ROWS`` rows.
    """
    n = rows.count()
    digits = 1
    while digits < 8 and 16**digits * RANGE_ROWS < n:
        digits += 1
    ranged = rows.withColumn("order_", order).withColumn("range_", F.substring("order_", 1, digits))
    totals = ranged.groupBy("source", "range_").agg(F.sum("size").alias("total_"))
    earlier = Window.partitionBy("source").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("source_r"),
        F.col("range_").alias("range_r"),
        F.coalesce(F.sum("total_").over(earlier), F.lit(0)).alias("offset_"),
    )
    inside = Window.partitionBy("source", "range_").orderBy("order_", "doc_id", "size", "row_")
    local = ranged.withColumn("start", F.sum("size").over(inside) - F.col("size"))
    on = F.col("source").eqNullSafe(F.col("source_r")) & (F.col("range_") == F.col("range_r"))
    return (
        local.join(offsets, on)
        .withColumn("start", F.col("start") + F.col("offset_"))
        .drop("order_", "range_", "source_r", "range_r", "offset_")
    )


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots of the mix: slot, source, rank, block, words.

    ``plan`` has source, source_size and target. Ranks count within stretches of
    ``STRETCH`` slots, moved by the totals of the stretches before.
    """
    spark = plan.sparkSession
    whole = F.round("target").cast("long")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    per_pass = F.floor(F.col("want") / F.col("source_size")).cast("long")
    quota = plan.where("source_size > 0").withColumn("want", whole).withColumn("blocks", blocks)
    quota = quota.withColumn(
        "slots", per_pass * F.col("blocks") + F.ceil((F.col("want") - per_pass * F.col("source_size")) / block).cast("long")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    quota = stored(
        quota.withColumns({"number": F.row_number().over(by_name), "upto": F.sum("slots").over(by_name)}).select(
            "source", "source_size", "want", "blocks", "slots", "number", "upto"
        )
    )
    total = quota.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("n")).first()["n"]
    # edges of the sources on the unit interval, one value for all slots
    edges = quota.agg(F.array_sort(F.collect_list("upto")).alias("e")).scalar()
    point = F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(1.0)) * total
    number = F.least(F.size(F.filter("edges", lambda e: e <= point)) + 1, F.size("edges"))
    drawn = spark.range(total).select(F.col("id").alias("slot"), edges.alias("edges"))
    drawn = drawn.select("slot", number.alias("number"))
    drawn = drawn.withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    counts = drawn.groupBy("number", "stretch").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("number").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("number", "stretch").orderBy("slot")
    ranked = (
        drawn.withColumn("r", F.row_number().over(within) - 1)
        .join(offsets, ["number", "stretch"])
        .select("slot", "number", (F.col("r") + F.col("before")).alias("rank"))
    )
    reached = quota.join(counts.groupBy("number").agg(F.sum("n").alias("got")), "number", "left").withColumn(
        "got", F.coalesce("got", F.lit(0))
    )
    missing = reached.where("got < slots").select(
        F.lit(None).cast("long").alias("slot"), "number", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank")
    )
    all_slots = ranked.unionByName(missing).join(quota, "number").where(F.col("rank") < F.col("slots"))
    b = F.col("rank") % F.col("blocks")
    length = F.least(F.lit(block), F.col("source_size") - b * block)
    last = F.col("want") - F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") - b * block
    return all_slots.select(
        F.coalesce("slot", F.lit(total) + F.col("rank")).alias("slot"),
        "source",
        "rank",
        b.alias("block"),
        F.least(length, last).alias("words"),
    )


def takings(rows: DataFrame, block: int = BLOCK, order: Column | None = None) -> DataFrame:
    """Words the mix takes of every row: adds source_size, target, start and the array ``takes``.

    ``rows`` needs doc_id, source and size, and ``row_`` to tell rows apart.
    ``takes`` has one number of words for each pass over the source, counted
    from the row's first word: a whole text has its size, the text where a
    source stops has less. The order defaults to md5 of the id.
    """
    rows = stored(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stored(targets(sizes))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) if order is None else order
    line = stored(placed(rows, key))
    slots = schedule(plan, block).groupBy("source", "block").agg(F.collect_list(F.struct("rank", "words")).alias("uses"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = (
        line.where("size > 0")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .withColumns(
            {
                "lo": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)),
                "hi": F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)),
            }
        )
    )
    s = slots.withColumnsRenamed({"source": "source_s", "block": "block_s"})
    on = F.col("source").eqNullSafe(F.col("source_s")) & (F.col("block") == F.col("block_s"))
    used = pieces.join(s, on).select(
        "row_",
        F.transform(
            F.array_sort("uses"), lambda u: F.greatest(F.least(u["words"], F.col("hi")) - F.col("lo"), F.lit(0))
        ).alias("got"),
    )

    def nth(i: int) -> Column:
        return F.sum(F.when(F.size("got") > i, F.element_at("got", F.lit(i + 1))).otherwise(0))

    taken = used.groupBy("row_").agg(F.array(*[nth(i) for i in range(MOST_REPEATS)]).alias("takes"))
    p = plan.withColumnRenamed("source", "source_p")
    out = line.join(p, F.col("source").eqNullSafe(F.col("source_p"))).drop("source_p")
    none = F.array(*[F.lit(0).cast("long") for _ in range(MOST_REPEATS)])
    return out.join(taken, "row_", "left").withColumn("takes", F.coalesce("takes", none))


def numbered(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        words_in(F.col(text)).alias("size"),
        F.monotonically_increasing_id().alias("row_"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: each text as often as the mix takes it, cut where a source stops.

    Null texts and texts without words have size 0 and are not taken. Rows are
    stored once with a number that tells them apart, so repeated rows and null
    ids are handled alike and both sides of the join read the same numbers.
    All columns are kept; the text of a cut row ends after its last taken word.
    """
    row, takes = free_name(docs, "row__"), free_name(docs, "takes__")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), F.col(row).alias("row_")
    )
    took = takings(rows).where("exists(takes, x -> x > 0)").select(F.col("row_").alias(row), "size", "takes")
    took = took.withColumnsRenamed({"size": f"size{takes}", "takes": takes})
    size, n = F.col(f"size{takes}"), F.col(f"n{takes}")
    out = docs.join(took, row).withColumn(f"n{takes}", F.explode(F.filter(takes, lambda x: x > 0)))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD_CLASS), F.lit(0)), F.lit(1), n.cast("int")), " ")

    return out.withColumn(text, F.when(n >= size, F.col(text)).otherwise(cut)).select(*docs.drop(row).columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = takings(numbered(docs, "doc_id", "text", "source"))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM s),
f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wts
  FROM w),
g AS (SELECT *, cap * wts <= lft * weight AS full_ FROM f),
lv AS (SELECT lft / wts AS level FROM g WHERE NOT full_ ORDER BY wts DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE (SELECT level FROM lv) * weight END AS target FROM g),
line AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id
           ROWS UNBOUNDED PRECEDING) - size AS at
  FROM d)
SELECT l.doc_id, l.size, t.source_size, t.target,
       CAST(greatest(0, least(l.size, round(t.target) - l.at))
          + greatest(0, least(l.size, round(t.target) - t.source_size - l.at)) AS BIGINT) AS taken
FROM line l JOIN t ON l.source IS NOT DISTINCT FROM t.source
"""

"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksum and range rules confirm them, and
words near a span move its score. Positions are found without Python: a text
split at the matches and the matches themselves give, by running sums of their
lengths, the code point where each match starts.

The patterns use possessive repeats and start only where a run of their
characters starts or where the last match ended. They match what the plain
patterns match, without recursion and without rescanning a long run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import free_name, table


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Luhn's check of a text of digits."""
    n = F.length(c)
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    doubled = F.array(*[F.lit(d) for d in double])

    def weight(i: Column) -> Column:
        d = F.substring(c, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, F.element_at(doubled, d + 1)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weight(i)) % 10 == 0


def is_ip(c: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return c.rlike(rf"^{part}(?:\.{part}){{3}}$")


def is_card(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))


def is_phone(c: Column) -> Column:
    return F.length(digits(c)).between(8, 15)


def is_iban(c: Column) -> Column:
    """Length and mod-97 check; the remainder is carried from character to character."""
    bare = F.replace(c, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        at = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(moved, i, F.lit(1))) - 1
        return (acc * F.when(at > 9, 100).otherwise(10) + at) % 97

    n = F.length(bare)
    return F.when(n.between(15, 34), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) == 1).otherwise(F.lit(False))


def is_ssn(c: Column) -> Column:
    return ~c.rlike("^(000|666|9)") & ~c.rlike("-00-") & ~c.rlike("0000$")


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``hint`` is a cheap test that a text can hold the kind at all; ``score`` is
    the score of a confirmed span, to which ``near`` adds if one of the
    ``words`` stands within ``WINDOW`` characters. Spans below ``least`` go.
    """

    name: str
    pattern: str
    hint: str
    confirmed: Callable[[Column], Column] | None
    score: float
    near: float
    words: str
    least: float = 0.0


WINDOW = 40
# Matches (of two characters at least) that a window can hold, and how many are summed at a time.
PAIRS = WINDOW // 2
CHUNK = 256
# Base kinds in the order in which results list them.
BASE = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"@",
        None,
        0.9,
        0.1,
        r"mail|contact|write|@",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        is_ip,
        0.6,
        0.3,
        r"\bip\b|address|host|server|login",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9]){15}",
        is_card,
        0.8,
        0.2,
        r"card|visa|master|credit|pay",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        is_phone,
        0.6,
        0.3,
        r"phone|call|tel|mobile|fax",
    ),
)
MORE = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
        is_iban,
        0.9,
        0.1,
        r"iban|account|bank|konto|cuenta|compte",
    ),
    # The bare form is common in other numbers, so it needs a word nearby.
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        is_ssn,
        0.3,
        0.5,
        r"ssn|social|security|tax",
        0.5,
    ),
)
KINDS = BASE + MORE
SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def ends(x: Column) -> Column:
    """The first and last ``WINDOW`` characters of a longer piece."""
    return F.when(F.length(x) > 2 * WINDOW, F.concat(F.left(x, F.lit(WINDOW)), F.right(x, F.lit(WINDOW)))).otherwise(x)


def chunk_sums(lengths: Column) -> Column:
    """Starts and ends of matches, counted from the start of their chunk of ``CHUNK`` matches, and its total length."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["n"]).alias("end"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(acc["all"], F.array(span)).alias("all"))

    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / CHUNK).cast("int"))
    return F.transform(numbers, lambda k: F.aggregate(F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)), start, step))


def placed(local: Column, found: Column) -> Column:
    """Start, end, number and text of every match: the chunks' starts, moved by the totals of the chunks before."""
    offsets = F.aggregate(
        local,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )
    moved = F.zip_with(
        local,
        offsets,
        lambda c, o: F.transform(c["all"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"))),
    )
    numbered = F.transform(F.flatten(moved), lambda s, i: F.struct(s["start"], s["end"], i.alias("i")))
    return F.zip_with(numbered, found, lambda s, hit: F.struct(s["start"], s["end"], s["i"], hit.alias("text")))


def scored(hits: Column, pairs: Column, between: Column, kind: Kind) -> Column:
    """Findings of confirmed matches, scored by the words near them.

    What stands near is put together from the neighbouring gaps and matches
    (``pairs``, each cut to its ends); a match has at least two characters, so
    ``PAIRS`` of them and their gaps fill the window.
    """

    def near(s: Column) -> Column:
        begin = F.greatest(s["i"] - PAIRS, F.lit(0))
        before = F.concat(F.array_join(F.slice(pairs, begin + 1, s["i"] - begin), ""), ends(F.element_at(between, s["i"] + 1)))
        after = F.array_join(F.slice(pairs, s["i"] + 2, F.lit(PAIRS + 1)), "")
        return F.lower(F.concat(F.right(before, F.lit(WINDOW)), F.lit(" "), F.left(after, F.lit(WINDOW)))).rlike(kind.words)

    def one(s: Column) -> Column:
        score = F.lit(kind.score) + F.when(near(s), kind.near).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"], s["end"], s["text"], score.alias("score"))

    return F.filter(F.transform(hits, one), lambda s: s["score"] >= kind.least).cast(SPAN)


def find(docs: DataFrame, text: str = "text", out: str = "findings", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add an array of findings (kind, start, end, text, score) to every row.

    Rows are handled one by one, without a shuffle, so nulls in other columns,
    ties and repeated rows change nothing. A null or empty text has no findings.
    Spans are in code points, the end exclusive, ordered by kind as listed and
    then by start. A column named ``out`` is replaced. Arrays are worked out once
    a row in columns of their own, as later steps use them for every match; time
    grows with a text's length.
    """
    whole = free_name(docs, "text_")
    held = {(k.name, part): free_name(docs, f"{k.name}_{part}_") for k in kinds for part in ("found", "between", "lengths", "local", "hits", "pairs")}

    def col(k: Kind, part: str) -> Column:
        return F.col(held[k.name, part])

    def add(df: DataFrame, part: str, value: Callable[[Kind], Column]) -> DataFrame:
        return df.withColumns({held[k.name, part]: value(k) for k in kinds})

    def lengths(k: Kind) -> Column:
        gaps = F.slice(col(k, "between"), F.lit(1), F.size(col(k, "found")))
        return F.zip_with(gaps, col(k, "found"), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n")))

    def hits(k: Kind) -> Column:
        every = placed(col(k, "local"), col(k, "found"))
        return F.filter(every, lambda s: k.confirmed(s["text"])) if k.confirmed else every

    def pairs(k: Kind) -> Column:
        return F.zip_with(
            col(k, "between"), col(k, "found"), lambda gap, hit: F.concat(ends(gap), F.coalesce(ends(hit), F.lit("")))
        )

    t = F.col(whole)
    none = F.expr("cast(array() as array<string>)")
    rows = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    rows = add(rows, "found", lambda k: F.when(t.rlike(k.hint), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none))
    rows = add(rows, "between", lambda k: F.when(F.size(col(k, "found")) > 0, F.split(t, k.pattern, -1)).otherwise(none))
    rows = add(rows, "lengths", lengths)
    rows = add(rows, "local", lambda k: chunk_sums(col(k, "lengths")))
    rows = add(rows, "hits", hits)
    rows = add(rows, "pairs", pairs)
    found = [scored(col(k, "hits"), col(k, "pairs"), col(k, "between"), k) for k in kinds]
    return rows.withColumn(out, F.concat(*found)).drop(whole, *held.values())


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Replace every finding by its kind in brackets; null stays null.

    Later starts first, so positions stay right; a finding inside or across one
    already replaced is left out of the replacement.
    """
    found = free_name(docs, "found_")
    base = find(docs, text, found, kinds)
    ordered = F.reverse(
        F.array_sort(F.transform(F.col(found), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    )

    def step(acc: Column, s: Column) -> Column:
        fits = s["end"] <= acc["edge"]
        cut = F.concat(
            F.substring(acc["text"], F.lit(1), s["start"]),
            F.lit("["), F.upper(s["kind"]), F.lit("]"),
            F.substr(acc["text"], s["end"] + 1),
        )
        return F.struct(
            F.when(fits, cut).otherwise(acc["text"]).alias("text"), F.when(fits, s["start"]).otherwise(acc["edge"]).alias("edge")
        )

    start = F.struct(F.col(text).alias("text"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("edge"))
    return base.withColumn(text, F.aggregate(ordered, start, step, lambda acc: acc["text"])).drop(found)


def joined(found: Column) -> Column:
    one = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", one)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs).select("doc_id", "findings")
    names = [k.name for k in BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda s: s["kind"].isin(names))
    return found.select(
        "doc_id", *[count(k) for k in names], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans")
    )

"""URL filters: host and path rules, else a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected
addresses, give a length-normalised log-likelihood difference. They learn from
the addresses that a rule decides. A fifth of those is held out to calibrate
the threshold, and the difference judges all addresses that no rule fits.

Counts are kept in hashed tables of a fixed size (``SLOTS`` pair and context
slots for each model, 8 MB in all), so what is broadcast never grows with the
number of addresses; counts come from all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import ascii_lower, free_name, mix, sliced_texts


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
ORDERS = 5
SLOTS = 1 << 19
STRENGTH = 2.0
BINS = 400
SPAN = 4.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(found), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    """The rule's host or a subdomain of it, with a path that starts with the rule's."""
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_columns(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; ties go to the first by text."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        hit = fits(r, host, path)
        rule = F.when(hit, F.lit(r.text)).otherwise(rule)
        verdict = F.when(hit, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def context_slots(urls: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Pair and context slots of every character for each order, and the address each belongs to."""
    pad = b"\0" * ORDERS
    flat = np.frombuffer(pad + pad.join(u + b"\n" for u in urls), dtype=np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(u) + 1 for u in urls), dtype=np.int64, count=len(urls))
    owner = np.repeat(np.arange(len(urls)), lengths)
    begin = np.concatenate(([0], np.cumsum(lengths + ORDERS)[:-1])) + ORDERS
    at = np.arange(owner.size) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin, lengths)
    context = np.full(at.size, 0x9E3779B97F4A7C15, dtype=np.uint64)
    pairs, contexts = [], []
    for k in range(ORDERS + 1):
        if k:
            context = (context ^ flat[at - k]) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        contexts.append((mix(context) & np.uint64(SLOTS - 1)).astype(np.int64))
        pairs.append((mix(context * np.uint64(31) + flat[at] + np.uint64(1)) & np.uint64(SLOTS - 1)).astype(np.int64))
    return pairs, contexts, owner


def log_likelihoods(urls: list[bytes], tables: np.ndarray) -> np.ndarray:
    """log likelihood difference, accepted less rejected, by character.

    ``tables`` has the shape (2 models, pair or context, SLOTS). The estimate of
    each order is drawn towards that of the order below.
    """
    pairs, contexts, owner = context_slots(urls)
    total = np.zeros(len(urls))
    for sign, (pair, context) in zip((1.0, -1.0), tables, strict=True):
        p = np.full(owner.size, 1.0 / 257.0)
        for k in range(ORDERS + 1):
            p = (np.minimum(pair[pairs[k]], context[contexts[k]]) + STRENGTH * p) / (context[contexts[k]] + STRENGTH)
        total += sign * np.bincount(owner, np.log(p), minlength=len(urls))
    return total / np.fromiter((len(u) + 1 for u in urls), dtype=np.int64, count=len(urls))


def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed counts of one task: rows (slot, n), at most four tables in all."""
    counts = np.zeros((2, 2, SLOTS), dtype=np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for lo, hi, texts in sliced_texts(batch.column("address")):
            for side in (0, 1):
                own = [t for t, s in zip(texts, label[lo:hi], strict=True) if s == side]
                if own:
                    pairs, contexts, _ = context_slots(own)
                    for k in range(ORDERS + 1):
                        counts[side, 0] += np.bincount(pairs[k], minlength=SLOTS)
                        counts[side, 1] += np.bincount(contexts[k], minlength=SLOTS)
    flat = counts.reshape(-1)
    for part in np.array_split(np.flatnonzero(flat), max(1, np.count_nonzero(flat) // 50_000)):
        if part.size:
            yield pa.RecordBatch.from_pydict({"slot": part, "n": flat[part]})


def fit(labelled: DataFrame) -> np.ndarray:
    """Count tables of the accepted (0) and rejected (1) addresses: columns address, label."""
    rows = labelled.mapInArrow(count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(4 * SLOTS, dtype=np.float32)
    flat[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return flat.reshape(2, 2, SLOTS)


def differences(df: DataFrame, model, address: str, out: str) -> DataFrame:
    """Add the length-normalised log-likelihood difference of an address column."""

    def run(texts: pa.Array) -> pa.Array:
        found = [log_likelihoods(values, model.value) for _, _, values in sliced_texts(texts)]
        return pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())

    score = F.arrow_udf(run, "double")
    return df.withColumn(out, score(F.col(address)))


def calibrate(scored: DataFrame) -> float | None:
    """Threshold with the best balanced accuracy on held-out addresses; None without both kinds.

    Works on a histogram of ``BINS`` bins, so only that many rows reach the driver.
    """
    bins = F.least(F.greatest(F.floor((F.col("diff") + SPAN) / (2 * SPAN / BINS)), F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(bins.alias("bin"), "label").agg(F.count(F.lit(1)).alias("n")).collect()
    found = np.zeros((2, BINS))
    for r in rows:
        found[int(r["label"]), int(r["bin"])] += r["n"]
    if not found.sum(axis=1).all():
        return None
    share = found / found.sum(axis=1, keepdims=True)
    below = np.cumsum(np.hstack([np.zeros((2, 1)), share]), axis=1)
    gain = below[1] - below[0]
    best = np.flatnonzero(gain == gain.max())
    return float(best[best.size // 2] * (2 * SPAN / BINS) - SPAN)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and score to addresses.

    The longest rule that fits decides. Without one, the address is allowed if
    its difference reaches the calibrated threshold; if the rules name no
    accepted or no rejected address, there is nothing to compare and it is
    allowed. score is null where a rule decided. Null or malformed addresses
    have empty host and path; repeated rows stay; clashing columns are replaced.
    """
    host, path, rule, verdict, address = (free_name(pages, n) for n in ("host_", "path_", "rule_", "verdict_", "addr_"))
    u = F.col(url)
    base = pages.withColumns({host: host_of(u), path: path_of(u)})
    r, v = rule_columns(F.col(host), F.col(path), rules)
    base = base.withColumns({rule: r, verdict: v, address: F.concat(F.col(host), F.col(path))})
    known = base.where(F.col(verdict).isNotNull()).select(
        F.col(address).alias("address"), (F.col(verdict) == "block").cast("long").alias("label")
    )
    held = F.pmod(F.crc32(F.col("address").cast("binary")), F.lit(5)) == 0
    model = pages.sparkSession.sparkContext.broadcast(fit(known.where(~held)))
    threshold = calibrate(differences(known.where(held), model, "address", "diff"))
    score = free_name(pages, "score_")
    open_address = F.when(F.col(verdict).isNull(), F.col(address))
    out = differences(base.withColumn(address, open_address), model, address, score)
    pick = F.lit("allow") if threshold is None else F.when(F.col(score) >= threshold, "allow").otherwise("block")
    final = {
        "host": F.col(host),
        "path": F.col(path),
        "rule": F.col(rule),
        "verdict": F.coalesce(F.col(verdict), pick),
        "score": F.when(F.col(verdict).isNull(), F.col(score)),
    }
    kept = [F.col(c) for c in pages.columns if c.lower() not in final]
    return out.select(*kept, *[c.alias(n) for n, c in final.items()])


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    from deliveryrisk.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")

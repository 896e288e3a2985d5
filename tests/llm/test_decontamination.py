"""Benchmark passages: the index against plain search, the operator against brute force and SQL."""

import hashlib
import re

import numpy as np
import pytest

from deliveryrisk.llm import decontamination, phrase_index
from deliveryrisk.llm.queries import oracle_sql, queries
from tests.llm.sql import same_rows

PATH = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items):
    """(words, hit places, items) of every document."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (it := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= it
        out.append((len(w), sorted(hit), sorted(found, key=str.encode)))
    return out


@pytest.mark.parametrize("kinds", [1, 2, 7, 5000])
def test_index_finds_all_places(kinds):
    rng = np.random.default_rng(kinds)
    texts = [rng.integers(1, kinds + 1, n).tolist() for n in (0, 1, 400, 30, 0, 900)] + [[1] * 70, [1] * 70]
    numbers = np.array([x for t in texts for x in [*t, 0]])
    order = phrase_index.suffix_order(numbers)
    ends = np.cumsum(numbers == 0)
    suffix = [[(0, x) if x else (-1, int(ends[i + j])) for j, x in enumerate(numbers[i:].tolist())] for i in range(len(numbers))]
    assert order.tolist() == sorted(range(len(numbers)), key=lambda i: suffix[i][: 1 + [s[0] for s in suffix[i]].index(-1)])
    index = phrase_index.load(phrase_index.build(numbers, kinds))
    for n in (1, 2, 5, 10):
        phrases = np.array([numbers[i : i + n] for i in range(len(numbers) - n) if numbers[i : i + n].all()])
        phrases = np.concatenate((phrases[:200], rng.integers(1, kinds + 1, (50, n))))
        low, high = index.search(phrases)
        for phrase, lo, hi in zip(phrases.tolist(), low.tolist(), high.tolist(), strict=True):
            want = [i for i in range(len(numbers) - n + 1) if numbers[i : i + n].tolist() == phrase]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


LONG = " ".join(f"w{i % 97}x" for i in range(300))
ITEMS = [(1, "One two THREE four, five six seven eight nine ten eleven."), (2, "short-item é"), (2, "other rows of two"), (None, LONG),
         (10, "One two three four five six seven eight nine ten"), (3, ""), (4, None), (5, "?! ..")]
DOCS = [None, "", "  \n", "one two three four five six seven eight nine ten", "x short item É short item é y", LONG + " tail " + LONG,
        "one  two\nthree\tfour.five-six:seven eight_nine ten eleven twelve", "OTHER rows, of two", "one two three four five six seven eight nine",
        "z" * 300_000, "short item é " * 2000, "one two three four five six seven eight nine ten eleven", "İ short item É"]


@pytest.mark.parametrize("shard_words, piece_bytes, block", [(1 << 20, 4 << 20, 1 << 18), (64, 100, 40), (25, 1000, 7)])
def test_leaks_equal_brute_force(spark, monkeypatch, shard_words, piece_bytes, block):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(decontamination, "PIECE_BYTES", piece_bytes)
    monkeypatch.setattr(decontamination, "BLOCK", block)
    rows = [(i, t, i, "spans") for i, t in enumerate(DOCS)] + [(3, DOCS[3], 3, ""), (None, DOCS[4], 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long, key string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.find_leaks(docs, items).collect()
    found = sorted(((-1 if r.key is None else r.key), r.n_words, [x for s in r.spans for x in range(s.start, s.end)], list(r["items"])) for r in got)
    texts = [t for _, t, _, _ in rows]
    want = [(-1 if k is None else k, *b) for (k, *_), b in zip(rows, brute(texts, ITEMS), strict=True)]
    assert found == sorted(want)
    for r in got:  # spans are merged
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_cut_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(DOCS)], "doc_id long, text string, digest_ string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for piece_bytes in (4 << 20, 50):
        monkeypatch.setattr(decontamination, "PIECE_BYTES", piece_bytes)
        out = decontamination.without_leaks(docs, items)
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert len(got) == len(DOCS)
        assert got[0] is None and got[2] == "  \n" and got[9] == DOCS[9] and got[8] == DOCS[8]
        assert got[3] == "" and got[4] == "x short item É  y" and words(got[5]) == [b"tail"] and got[6].strip() == "twelve"
    for (n, hit, _), t, i in zip(brute(DOCS, ITEMS), DOCS, range(len(DOCS)), strict=True):
        assert words(got[i]) == [w for j, w in enumerate(words(t)) if j not in set(hit)] and n >= len(hit)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_leaks(docs.limit(0), items).count() == 0
    none = decontamination.find_leaks(docs, items.limit(0)).collect()
    assert [(r.key, r.n_words, r.spans, r["items"]) for r in none] == [(1, 2, [], [])]


def test_query(spark):
    rows = queries()["op11_decontamination"](spark, PATH)
    same_rows(rows, oracle_sql()["op11_decontamination"], PATH, ["documents", "benchmark"])
    assert rows.where("contaminated").count() > 0
    none = hashlib.sha256(b"").hexdigest()
    assert all((r.items_sha256 == none) == (r.n_items == 0) for r in rows.collect())

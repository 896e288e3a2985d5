"""URL filters, neighbours, components and the pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deliveryrisk.llm import graph, neighbours, url_filter
from deliveryrisk.llm.queries import queries
from tests.llm import brute

PATH = "/root/testdata/sf0.001"


def split(url):
    """Host and path as the contract states them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min((tail.index(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:cut]


def rule_of(host, path):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    hits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(hits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    "https://A.Example.NET/en/x?q=1#f", "http://net", "http://net/", "http://x.net?/en/", "http://nonet/", "ftp://org/fr/",
    "http://É.ORG/fr/a", "a://b://net/", None, "", "no scheme", "http://", "http://example.com/de/x\ny", "http://a.org/de/", "http://z.com/" + "q" * 50_000,
]


def test_rules(spark):
    rows = [(i, u, "old", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "old", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score int")
    out = url_filter.judge(pages)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split(r.url)
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_rules_on_whole_table(spark):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{PATH}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in queries()["op10_url_filter"](spark, PATH).collect()}
    assert len(got) == len(pages)
    for i, u in pages:
        host, path = split(u)
        rule, verdict = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict


def test_models_tell_kinds_apart(spark):
    """Held-out addresses of two kinds, by the calibrated ratio."""
    rng = np.random.default_rng(0)
    good = [f"http://{rng.choice(['news', 'book', 'city'])}{rng.integers(1000)}.org/fr/{rng.choice(['story', 'essay'])}" for _ in range(300)]
    bad = [f"http://win-{rng.integers(10**6)}-cash.net/{rng.integers(10**6)}" for _ in range(300)]
    fresh = [("book77.edu/fr/essay", "allow"), ("win-12345-cash.com/98765", "block")]
    rows = [(i, u) for i, u in enumerate([*good, *bad, *[f"http://{u}" for u, _ in fresh]])]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[600 + i] for i in range(2)] == [v for _, v in fresh]


def brute_nearest(rows, top):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for n in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[n]) ** 2).sum(1))
        d[ids == ids[n]] = np.inf
        order = np.lexsort((ids, d))[:top]
        out[int(ids[n])] = [(int(ids[o]), float(d[o])) for o in order if np.isfinite(d[o])]
    return out


def test_neighbours_recall(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{PATH}/embeddings.parquet'").fetchall()
    want = brute_nearest(rows, 10)
    got = brute.by_key(queries()["op2_neighbours"](spark, PATH).orderBy("query_id", "rank").collect(), "query_id")
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        exact = {i: d for i, d in brute_nearest(rows, len(rows))[q]}
        assert [r.rank for r in got[q]] == list(range(1, 11))
        assert all(exact[r.vec_id] == pytest.approx(r.score, abs=1e-12) for r in got[q])
        hits += len({r.vec_id for r in got[q]} & {i for i, _ in near})
    assert hits / (10 * len(want)) >= 0.9


def test_neighbours_edges(spark):
    """Ties to the smaller id, unusable vectors, fewer candidates than asked, a vector many rows share."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    rng = np.random.default_rng(2)
    hot = [(i, [1.0] * 8) for i in range(3000)] + [(i, rng.normal(size=8).tolist()) for i in range(3000, 6000)]
    df = spark.createDataFrame(hot, "vec_id long, embedding array<double>").repartition(4)
    out = brute.by_key(neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect(), "query_id")
    assert [r.vec_id for r in out[200]] == list(range(10)) and [r.vec_id for r in out[0]] == list(range(1, 11))
    want = brute_nearest(hot, 10)
    hits = sum(len({r.vec_id for r in out[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(250, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5001 + i) for i in range(300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage on what the one before kept, checked against plain Python where it has one."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, PATH)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != "pack":
            assert docs.columns == before.columns
        if name == "exact_dedup":
            assert kept[name] == before.select("text").distinct().count()
        if name == "near_copies":
            rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
            assert kept[name] == len(set(brute.near_components(rows, 5, 80)))
    assert 100 < kept["near_copies"] <= kept["exact_dedup"] <= kept["quality"]
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{PATH}/labels.parquet'").fetchall())
    left = {r.doc_id for r in spark.read.parquet(str(tmp_path / "quality")).collect()}
    assert np.mean([i in left for i, q in labels.items() if q == 1]) > 0.95

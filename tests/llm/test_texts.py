"""Corpus operators against plain Python, with nulls, empty and long texts, ties and repeated rows."""

import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deliveryrisk.llm import exact_dedup, lm_scoring, mixing, near_copies, packing, pii, quality
from deliveryrisk.llm.queries import oracle_sql, queries
from tests.llm import brute

PATH = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, score double, findings string, row_ int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
NEAR = " ".join(f"n{i}" for i in range(200))
ROWS = [
    (1, "The cat sat on the mat.\nIt was a fine day."),
    (2, "the  cat sat\ton the mat. It was a fine day."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "mail a.b@c.de, x@y.z.w_d@e.f or call +49 (30) 123-4567; card 4111 1111 1111 1111 at 10.0.0.255 not 10.0.0.256"),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "word"),
    (10, "word"),
    (10, "word"),
    (None, "word"),
    (None, None),
    (11, NEAR),
    (12, NEAR + " end"),
    (13, NEAR.replace("n100", "m100")),
    (14, "é ü 你好 🙂 a@b.cc 🙂 1.2.3.4.5"),
    (15, "### $$$ %%%\n" * 30),
]


def frame(spark, rows=ROWS):
    full = [(i, t, None if i is None else f"s{i % 4}", 0.5, "x", 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The rows as a stored table, so that they are read in the same places each time."""
    path = str(tmp_path_factory.mktemp("docs") / "t")
    frame(spark).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "e")
    frame(spark, []).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{PATH}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def real(db):
    return db.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = queries()[name](spark, PATH)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    want = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall(), key=str)
    assert got == want


def test_exact_copies(docs):
    got = exact_dedup.mark_copies(docs).collect()
    want = {}
    for i, t in ROWS:
        want.setdefault(brute.digest(t), []).append(i)
    assert len(got) == len(ROWS)
    for r in got:
        group = want[r.text_sha256]
        assert r.doc_id in group and r.group_size == len(group)
        assert r.keep_id == min((i for i in group if i is not None), default=None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_copies_kept_rows(docs, empty):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(brute.digest(t) for _, t in kept) == sorted({brute.digest(t) for _, t in ROWS})
    assert {i for i, t in kept if t == "word"} == {9}
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.mark_copies(empty).count() == 0


def test_personal_data(docs, empty):
    for r in pii.find(docs, out="findings").select("text", "findings").collect():
        got = [(s.kind, s.start, s.end) for s in r.findings if s.kind in {k.name for k in pii.BASE}]
        assert got == brute.base_spans(r.text)
        assert all(s.text == r.text[s.start : s.end] for s in r.findings)
    assert pii.find(empty).count() == 0


def brute_near(text, start, end, words):
    import re

    return bool(re.search(words, (text[max(0, start - 40) : start] + " " + text[end : end + 40]).lower()))


def test_scores_of_nearby_words(spark):
    """Scores from pieces equal those from the text itself, also where many matches stand close together."""
    rng = np.random.default_rng(8)
    words = ["call", "a@b.co", "12", "1.2.3.4", "+1 (555) 010-9999", "x" * 39, "é", "server", "mail", "4111111111111111", "\n", "9", " ", "ip", "visa", "z" * 90]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(60)) for _ in range(60)] + ["a@b.co" * 30, "12 " * 300 + "visa 4111111111111111"]
    kinds = {k.name: k for k in pii.BASE}
    for r in pii.find(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        mine = [s for s in r.findings if s.kind in kinds]
        assert [(s.kind, s.start, s.end) for s in mine] == brute.base_spans(r.text)
        for s in mine:
            k = kinds[s.kind]
            want = k.score + (k.near if brute_near(r.text, s.start, s.end, k.words) else 0.0)
            assert s.score == pytest.approx(want), (s, r.text)


def test_many_matches_in_one_text(spark):
    """Time grows with the text, not with its square."""
    import time

    n = 40_000
    df = spark.createDataFrame([("a@b.co " * n,)], "text string")
    began = time.time()
    row = pii.find(df, kinds=pii.BASE[:1]).select(F.size("findings").alias("n"), F.col("findings")[n - 1]["start"].alias("s")).first()
    assert (row.n, row.s) == (n, 7 * (n - 1)) and time.time() - began < 60


def test_personal_data_of_whole_table(spark, real):
    import hashlib

    got = {r.doc_id: r for r in queries()["op7_pii"](spark, PATH).collect()}
    for i, t in real:
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_confirmed_and_context(spark):
    texts = [
        "my iban is GB82 WEST 1234 5698 7654 32 now",
        "my iban is GB82 WEST 1234 5698 7654 33 now",
        "ssn 123-45-6789",
        "part 123-45-6789",
        "1" * 5000 + "." + "a" * 50_000 + "@",
        "9" * 20_000,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kinds = [[s.kind for s in r.findings] for r in pii.find(df).collect()]
    assert kinds == [["iban"], [], ["ssn"], [], [], []]
    found = pii.redact(spark.createDataFrame([("to a@b.cc and c@d.ee",), (None,)], "text string")).collect()
    assert [r.text for r in found] == ["to [EMAIL] and [EMAIL]", None]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_near_copies(docs, width, percent):
    got = near_copies.near_copies(docs, width=width, percent=percent).collect()
    label = brute.near_components(ROWS, width, percent)
    groups = {}
    for (i, _), c in zip(ROWS, label, strict=True):
        groups.setdefault(c, []).append(i)
    want = sorted(
        (str(i), len(brute.shingles(t, width)), str(min((x for x in groups[c] if x is not None), default=None)))
        for (i, t), c in zip(ROWS, label, strict=True)
    )
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    kept = near_copies.drop_near_copies(docs, width=width, percent=percent)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_near_copies_of_many_kinds(spark, tmp_path):
    """Chains, a large group, a shared passage and small sets, against all pairs."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(60))
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):  # near copies of one text, at several distances
        w = list(base)
        for k in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            w[k] = f"x{rng.integers(1 << 30)}"
        rows.append(" ".join(w))
    for i in range(40):  # a chain whose ends do not link
        rows.append(" ".join(f"c{j}" for j in range(i * 2, i * 2 + 60)))
    for _ in range(60):
        rows.append(passage + " " + " ".join(f"y{rng.integers(1 << 30)}" for _ in range(int(rng.integers(5, 60)))))
    for n in range(1, 30):
        w = [f"s{j}" for j in range(n)]
        rows += [" ".join(w), " ".join([*w, "z"]), " ".join(w).upper()]
    docs = list(enumerate(rows))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, width=4, percent=85).collect()}
    want = brute.near_components(docs, 4, 85)
    assert [got[i] for i, _ in docs] == want
    assert len(set(want)) > 60 and max(map(want.count, set(want))) > 30


def test_near_copies_of_nothing(empty):
    assert near_copies.near_copies(empty).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    points = rng.poisson(2.0, size=(300, near_copies.DIMENSIONS))
    points[150:] = np.maximum(points[:150] + rng.integers(-1, 2, size=(150, near_copies.DIMENSIONS)) * (rng.random((150, near_copies.DIMENSIONS)) < 0.1), 0)
    sizes = points.sum(axis=1)
    i, j = near_copies.Tree(points, sizes).search(points, sizes, 80)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    bound = np.minimum(points[:, None], points[None]).sum(-1)
    want = bound >= near_copies.needed(sizes[:, None] + sizes[None], 80)
    assert got == set(zip(*np.nonzero(want), strict=True))


def test_pairs_meet_in_one_shared_cell():
    """Of the cells two sets share exactly one bounds their pair if it can be told, else all of them."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(-40, 40, size=int(rng.integers(1, 30)))) for _ in range(60)]
    sets += [s[rng.random(s.size) < 0.8] if s.size > 1 else s for s in sets]
    sets = [s if s.size else np.array([0]) for s in sets]
    least = near_copies.least_cells(pa.chunked_array([pa.array([s[: near_copies.LEAST].tolist() for s in sets])]))
    told = 0
    for a in range(len(sets)):
        for b in range(len(sets)):
            shared = np.intersect1d(sets[a], sets[b])
            meets = [c for c in shared.tolist() if near_copies.meets_here(least[a : a + 1], least[b : b + 1], c)[0]]
            known = np.intersect1d(sets[a][: near_copies.LEAST], sets[b][: near_copies.LEAST])
            assert meets == ([known[0]] if known.size else shared.tolist())
            told += known.size > 0
    assert told > 1000


def test_listed_cells_pass(spark):
    rng = np.random.default_rng(9)
    listed = np.unique(rng.integers(-(1 << 62), 1 << 62, size=20_000))
    other = rng.integers(-(1 << 62), 1 << 62, size=20_000)
    cells = spark.createDataFrame([(int(c),) for c in listed], "cell long")
    test = near_copies.listed_cells(cells)
    assert cells.where(test(F.col("cell"))).count() == listed.size
    others = spark.createDataFrame([(int(c),) for c in other], "cell long")
    assert others.where(test(F.col("cell"))).count() < 2500
    none = cells.where("false")
    assert cells.where(near_copies.listed_cells(none)(F.col("cell"))).count() == 0


def test_unlinked_texts_that_share_cells(spark, tmp_path):
    """A large group of texts that resemble each other just below the threshold, with some links among them."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for g in range(150):
        w = list(base)
        for k in rng.choice(120, size=int(rng.integers(1, 6)), replace=False):
            w[k] = f"g{g}_{k}"
        rows.append(" ".join(w))
    docs = list(enumerate(rows))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.read.parquet(str(tmp_path / "t"))).collect()}
    want = brute.near_components(docs, 5, 80)
    assert [got[i] for i, _ in docs] == want and 1 < len(set(want)) < 150


def test_base_scores(docs, empty):
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_scoring.score(docs).collect())
    want = sorted(
        (str(i), a, b, n, round(s, 6)) for (i, _), (a, b, n, s) in zip(ROWS, brute.base_scores(ROWS, 1), strict=True)
    )
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert lm_scoring.score(empty).count() == 0


def test_model_scores(spark, real):
    """A proper model: better than coding words letter by letter, and held-out texts cost more than seen ones."""
    got = queries()["op8_lm_scoring"](spark, PATH).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in real}
    cost = {h: -sum(r.score for r in got if r.held_out == h) / math.log10(2) / sum(size[r.doc_id] for r in got if r.held_out == h) for h in (True, False)}
    assert all(r.score < 0 for r in got)
    assert cost[False] <= cost[True] < 4.0


def test_words_add_up_to_one():
    """Probabilities of one byte, given the model's bits, add up to one."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, size=(lm_scoring.PREDICTORS, 2, lm_scoring.SLOTS)).astype(np.float32)
    stretch, confidence = lm_scoring.stretched(counts)
    refine = np.full((8, lm_scoring.BUCKETS), 0.4)
    weights = np.full((lm_scoring.GATES, lm_scoring.PREDICTORS), 0.3, dtype=np.float32)
    symbols = np.arange(256, dtype=np.uint8)
    p = lm_scoring.log10_probabilities((stretch, confidence, weights, refine), symbols, np.ones(256, dtype=np.int64))
    assert abs((10**p).sum() - 1.0) < 1e-6


def test_quality(spark, db):
    got = {r.doc_id: r for r in queries()["op5_quality"](spark, "/root/testdata/sf0.1").collect()}
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.1/labels.parquet'").fetchall()
    for outcome in (0, 1):
        own = [got[i] for i, q in labels if q == outcome and brute.held(i, 0)]
        assert all(r.held_out for r in own)
        assert np.mean([r.predicted == outcome for r in own]) > 0.95


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (15, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.with_quality(docs, model)
    assert out.columns == docs.columns and out.where("score between 0 and 1").count() == len(ROWS)
    assert quality.with_quality(empty, model).count() == 0
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.with_quality(docs, None).where("score = 0.5").count() == len(ROWS)


def test_line_chain_matches_enumeration():
    rng = np.random.default_rng(1)
    score, links, n = rng.normal(size=6), rng.normal(size=(2, 2)), 6
    total = np.zeros(n)
    mass = 0.0
    for bits in range(1 << n):
        s = [(bits >> i) & 1 for i in range(n)]
        p = math.exp(sum(score[i] * s[i] for i in range(n)) + sum(links[s[i], s[i + 1]] for i in range(n - 1)))
        mass += p
        total += p * np.array(s)
    forward, back = quality.passes(np.concatenate([score, score[:2]]), np.array([6, 2]), links)
    assert np.allclose(quality.sigmoid(forward + back)[:6], total / mass)


def pieces_by_row(got, rows):
    """Checks pieces against the texts' ids; texts of one id are told apart by their ids' checksums."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = []
    lengths = {(r.doc_id, r.start, r.length) for r in got}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = {(s, n) for d, s, n in lengths if d == i}
        want.append((i, ids, own))
    return want


def test_packing(spark, docs, empty, real):
    rows = [(i, t) for i, t in real]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    for i, ids, _ in pieces_by_row(got, rows):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    sequences = brute.by_key(got, "sequence_id")
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        n = sum(r.length for r in own)
        assert n <= 1024 and n & (n - 1) == 0
    edge = packing.pack(docs).collect()
    assert sum(r.length for r in edge if r.doc_id is None) == 3  # "word", its separator, and a null text's
    assert packing.pack(empty).count() == 0


def test_ids_of_the_named_tokenizer():
    """Added tokens in plain text, and long runs, on which the faster library fails."""
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(packing.named_tokenizer_path())
    encode = packing.encoder(packing.tokenizer_path(), packing.named_tokenizer_path())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endof text|>", " " * 1_000_000, "\n" * 1_000_000, "a" * 3000,
             "x" + "\u3000" * 5000 + "y", " \n" * 700 + "z", "1" * 3000, "!?" * 1500, "é " * 3000, " " * 999 + "a"]
    for t in texts:
        assert list(encode(t)) == named.encode(t, add_special_tokens=False).ids, t[:20]
    assert list(encode(texts[0])) == [31373, 220, 50256, 995]


def test_curve_visits_neighbours():
    cells = np.array([[x, y] for x in range(16) for y in range(16)])
    order = np.argsort(packing.hilbert_keys(cells, 4))
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_mix(spark, docs, empty):
    rows = [(i, (t, None if i is None else f"s{i % 4}")) for i, t in ROWS]
    sizes = {}
    for _, (t, s) in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.mix_targets(sizes)
    plan = mixing.targets(mixing.numbered(docs, "doc_id", "text", "source").groupBy("source").agg(F.sum("size").alias("source_size")))
    assert {r.source: r.target for r in plan.collect()} == pytest.approx(want)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    assert taken == {s: int(t + 0.5) for s, t in want.items()}
    assert mixing.mix(empty).count() == 0


def test_schedule_spreads_sources(spark):
    plan = spark.createDataFrame([("a", 40_000, 60_000.0), ("b", 40_000, 20_000.0), ("c", 10_000, 20_000.0)], "source string, source_size long, target double")
    rows = mixing.schedule(plan, 100).orderBy("slot").collect()
    assert {s: sum(r.words for r in rows if r.source == s) for s in "abc"} == {"a": 60_000, "b": 20_000, "c": 20_000}
    for lo in range(0, len(rows) - 100, 100):
        assert 56 <= sum(r.source == "a" for r in rows[lo : lo + 100]) <= 64


@pytest.mark.parametrize("kind", ["near", "mix", "score", "exact"])
def test_rows_read_in_other_pieces(spark, tmp_path, kind):
    """Later scans may cut the input differently than the scan that numbered its rows."""
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(40 + i % 7)) if i % 3 else NEAR, f"s{i % 4}") for i in range(60)]
    rows += rows[:6]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(12).write.parquet(path)
    df = spark.read.parquet(path)
    setting = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(setting)

    def read(made):
        """Rows of a plan made while each file is a piece of its own and read when files share pieces, and the reverse."""
        out = []
        for first, then in ((1 << 40, 0), (0, 1 << 40)):
            try:
                spark.conf.set(setting, str(first))
                plan = made()
                spark.conf.set(setting, str(then))
                out.append(sorted(map(tuple, plan.collect())))
            finally:
                spark.conf.set(setting, before)
        return out

    if kind == "near":
        want = sorted({(i, t, s) for i, t, s in rows if i % 3 or i == 0})
        assert all(got == want for got in read(lambda: near_copies.drop_near_copies(df)))
    elif kind == "exact":
        want = sorted({(i, t, s) for i, t, s in rows if i % 3 or i == 0})
        assert all(got == want for got in read(lambda: exact_dedup.drop_copies(df)))
        plan = exact_dedup.drop_copies(df)._jdf.queryExecution().toString()
        assert "monotonically_increasing_id" not in plan
    elif kind == "mix":
        for got in read(lambda: mixing.mix(df)):
            words = {}
            for _, t, s in got:
                words[s] = words.get(s, 0) + len(t.split())
            sizes = {}
            for _, t, s in rows:
                sizes[s] = sizes.get(s, 0) + len(t.split())
            assert words == {s: int(t + 0.5) for s, t in brute.mix_targets(sizes).items()}
    else:
        want = sorted((i, n) for (i, _, _), (n, *_) in zip(rows, brute.base_scores([r[:2] for r in rows], 1), strict=True))
        assert all(sorted((g[0], g[2]) for g in got) == want for got in read(lambda: lm_scoring.score(df)))


def test_contexts_share_no_slot(spark, monkeypatch):
    """Counts that each word of every group meets, against counting contexts as strings."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("abcd"), int(rng.integers(1, 9)))).encode() for _ in range(400)})
    rows = [(i, w, int(rng.integers(0, 4)), i % 5) for i, w in enumerate(words)]
    vocabulary = spark.createDataFrame(rows, "hash long, word binary, n long, part int")

    def symbol_contexts(word):
        coded = word + b" "
        for i in range(len(coded)):
            for k in range(lm_scoring.ORDERS + 1):
                yield i, k, coded[max(0, i - k) : i].rjust(k, b"\0"), coded[i]
            yield i, lm_scoring.PREDICTORS - 1, coded[:i], coded[i]

    exact = {}
    for _, w, n, _ in rows:
        for _, k, context, byte in symbol_contexts(w):
            counts = exact.setdefault((k, context), {})
            counts[byte] = counts.get(byte, 0) + n
    shared = lm_scoring.shared_counts(vocabulary)
    top = shared.where("size(parts) = 5").agg(F.sum(F.size("entries")).alias("n")).first()["n"]
    monkeypatch.setattr(lm_scoring, "HEAD_COUNTS", top)
    least = lm_scoring.widest(shared)
    head = lm_scoring.head_arrays(lm_scoring.flat(shared.where(F.size("parts") >= least)).toArrow())
    met = lm_scoring.flat(shared.where(F.size("parts") < least).withColumn("part", F.explode("parts")), "part").toArrow()
    assert head[2].size == top and met.num_rows > 0
    for part in range(5):
        mine = [r for r in rows if r[3] == part]
        table = pa.table({"word": pa.array([r[1] for r in mine], pa.binary()), "n": [r[2] for r in mine]})
        here = met.filter(pa.array(met.column("part").to_numpy() == part))
        _, _, zeros, ones, slots_at = lm_scoring.group_tables(table, here, head)
        at = 0
        for _, w, _, _ in mine:
            for i, k, context, byte in symbol_contexts(w):
                for bit in range(8):
                    same = {b: c for b, c in exact[k, context].items() if b >> (8 - bit) == byte >> (8 - bit)}
                    one = sum(c for b, c in same.items() if b >> (7 - bit) & 1)
                    slot = slots_at(bit)[k][at + i]
                    assert (zeros[slot], ones[slot]) == (sum(same.values()) - one, one)
            at += len(w) + 1


def test_shared_contexts_reach_groups_in_bounded_pieces(spark, monkeypatch):
    """A group meets the counts of its contexts in a few rows, not in one for each count; all counts arrive."""
    rows = [(i, f"{a}{b}".encode(), i % 3, i % 4) for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "ijklmnopqr")]
    vocabulary = spark.createDataFrame(rows, "hash long, word binary, n long, part int")
    shared = lm_scoring.shared_counts(vocabulary)
    want = sorted(map(tuple, lm_scoring.flat(shared.withColumn("part", F.explode("parts")), "part").collect()))
    monkeypatch.setattr(lm_scoring, "DEAL_ENTRIES", len(want) // 4)
    batches = shared.select("context", "entries", "parts").coalesce(1).toArrow().combine_chunks().to_batches()
    got = [b for batch in batches for b in lm_scoring.deal_to_parts([batch])]
    counts = []
    for r in (r for b in got for r in b.to_pylist()):
        at = [c for c, k in zip(r["context"], r["size"], strict=True) for _ in range(k)]
        counts += [(r["part"], c, b, n) for c, b, n in zip(at, r["byte"], r["n"], strict=True)]
    assert sorted(counts) == want and len(want) > 200
    assert sum(b.num_rows for b in got) <= 4 * (5 + len(batches))


def test_copies_of_other_tasks_share_no_cells(spark, monkeypatch):
    """Equal sets are linked by their fingerprints; their cells are not compared."""
    texts = [" ".join(f"w{i}_{k}" for k in range(60)) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    docs = docs.unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    seen = []
    test = near_copies.listed_cells
    monkeypatch.setattr(near_copies, "listed_cells", lambda cells: seen.append(cells.count()) or test(cells))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i + k: i for i in range(12) for k in (0, 100)}
    assert seen[0] < 24  # each set has more cells than that


def resembling(n):
    """Texts of one base that differ from it in one to eight words each: many link, the others nearly do."""
    rng = np.random.default_rng(11)
    texts = []
    for g in range(n):
        w = [f"b{i}" for i in range(240)]
        for k in rng.choice(240, size=int(rng.integers(1, 9)), replace=False):
            w[k] = f"g{g}_{k}"
        texts.append(" ".join(w))
    return texts


def test_crowds_leave_the_search_as_texts_not_as_pairs(monkeypatch):
    """What a block returns grows with its sets, and the links found connect what all pairs connect."""
    monkeypatch.setattr(near_copies, "CROWD", 8000)  # three parts
    texts = resembling(90)
    docs = pa.RecordBatch.from_pydict({"row_": pa.array(range(90)), "doc_id": pa.array(range(90)), "text": pa.array(texts)})
    (described,) = near_copies.describe(5, 80)([docs])
    rows = [
        {"cell": 1, "qb": 0, "bb": 0, "side": side, "label": r["row_"], "least": [1], **{k: r[k] for k in ("row_", "n", "point")}}
        for side in (0, 2)
        for r in described.to_pylist()
    ]
    found = [r for b in near_copies.search_blocks(80)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    assert len(found) <= 2 * 90
    assert len(found) == 2 * len({r["a"] for r in found}) and {r["part"] for r in found} == {0, 1, 2}
    crowds = [r | {"text": texts[r["a"]]} for r in sorted(found, key=lambda r: r["part"])]
    links = [r for b in near_copies.link_crowds(5, 80)([pa.RecordBatch.from_pylist(crowds)]) for r in b.to_pylist()]
    label = list(range(90))
    for r in links:
        one, two = label[r["a"]], label[r["b"]]
        label = [min(one, two) if x in (one, two) else x for x in label]
    assert label == brute.near_components(list(enumerate(texts)), 5, 80)
    assert len(links) < len(found) and 1 < len(set(label)) < 90


def test_components_when_all_pairs_go_by_crowds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_copies, "DENSE", 0)
    docs = list(enumerate(resembling(150)))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.read.parquet(str(tmp_path / "t"))).collect()}
    want = brute.near_components(docs, 5, 80)
    assert [got[i] for i, _ in docs] == want and 1 < len(set(want)) < 150


def test_contexts_reach_across_words():
    """Every byte of a text has its contexts in the whole text, though only distinct units are coded."""
    import pyarrow as pa

    texts = ["the cat  sat", "a of in cat", "", " sat\ncat THE cat a", "ab cd\0ef \0\0 verylongword a"]
    units = {}
    keys, owner = lm_scoring.junctions(lm_scoring.find_words([t.encode() for t in texts]))
    for key in keys.tolist():
        units[key.to_bytes(8, "big"), lm_scoring.ORDERS] = units.get((key.to_bytes(8, "big"), lm_scoring.ORDERS), 0) + 1
    for t in texts:
        for w in t.lower().encode().split():
            if len(w) >= lm_scoring.ORDERS:
                units[w, 0] = units.get((w, 0), 0) + 1
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in range(len(t.split()) + 1)]
    table = pa.table({"word": pa.array([u[0] for u in units], pa.binary()), "start": [u[1] for u in units], "n": list(units.values())})
    symbols, lengths, found = lm_scoring.coded(table)
    got, want = {}, {}
    for i, n in enumerate(np.repeat(list(units.values()), lengths).tolist()):
        for k, c in enumerate(found):
            at = (k, int(c[i]), int(symbols[i]))
            got[at] = got.get(at, 0) + n
    for t in texts:
        words = [w + b" " for w in t.lower().encode().split()] + [b"\n"]
        whole = np.frombuffer(b"\n" * lm_scoring.ORDERS + b"".join(words), dtype=np.uint8)
        reach = lm_scoring.contexts(whole, np.array([whole.size]))
        alone = lm_scoring.contexts(whole[lm_scoring.ORDERS :], np.array([len(w) for w in words]))[-1]
        for i in range(lm_scoring.ORDERS, whole.size):
            for k in range(lm_scoring.PREDICTORS):
                c = reach[k][i] if k <= lm_scoring.ORDERS else alone[i - lm_scoring.ORDERS]
                at = (k, int(c), int(whole[i]))
                want[at] = want.get(at, 0) + 1
    assert got == want


def test_order_of_words_changes_the_score(spark, monkeypatch):
    """The same words in another order are another text, also where units lie outside the heads."""
    rng = np.random.default_rng(4)
    line = [f"{a}{b}" for a in "klmrts" for b in ("ba", "do", "fe")]
    usual = [(i, " ".join(line[(i + j) % len(line)] for j in range(12))) for i in range(60)]
    shuffled = [(100 + i, " ".join(rng.permutation(t.split()).tolist())) for i, t in usual[:20]]
    docs = spark.createDataFrame(usual + shuffled, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    assert all(abs(got[i - 100].base_score - got[i].base_score) < 1e-9 for i, _ in shuffled)
    assert all(got[i - 100].score > got[i].score + 1.0 for i, _ in shuffled)
    monkeypatch.setattr(lm_scoring, "HEAD", 3)
    monkeypatch.setattr(lm_scoring, "HEAD_JUNCTIONS", 3)
    again = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    assert all(abs(again[i].score - got[i].score) < 1e-6 and again[i][:5] == got[i][:5] for i in got)

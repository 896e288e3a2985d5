"""Product codes: the trie against plain distances, the operator against brute force and SQL."""

import hashlib
import math

import numpy as np
import pytest

from deliveryrisk.llm import vector_codes
from deliveryrisk.llm.queries import oracle_sql, queries
from tests.llm.sql import same_rows

PATH = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def brute(rows):
    """Codebooks, and (id, code, error, label) of kept rows."""
    kept = [(i, v, y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    size = width // 8
    parts = [[[math.floor(4096 * x) for x in v[p * size : (p + 1) * size]] for _, v, _ in kept] for p in range(8)]
    books = [part[:16] for part in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(6):
        for p in range(8):
            groups = {}
            for x in parts[p]:
                groups.setdefault(near(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else y for e, y in enumerate(books[p])]
    out = []
    for n, (i, _, label) in enumerate(kept):
        found = [near(parts[p][n], books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    return books, out


def test_trie_distances():
    rng = np.random.default_rng(3)
    values = np.concatenate((rng.integers(-3, 3, (200, 24)), rng.integers(-vector_codes.MOST, vector_codes.MOST, (50, 24))))
    keys = np.unique(vector_codes.part_keys(values), axis=0)
    position, numbers = vector_codes.parts_of(keys)
    assert {(int(p), *x) for p, x in zip(position, numbers.tolist(), strict=True)} == {
        (p, *v[3 * p : 3 * p + 3]) for v in values.tolist() for p in range(8)
    }
    assert sorted(map(tuple, numbers[position == 2].tolist())) == list(map(tuple, numbers[position == 2].tolist()))
    books = rng.integers(-5, 5, (8, 16, 3))
    want = ((numbers[:, None, :] - books[position]) ** 2).sum(axis=2)
    assert (vector_codes.leaf_distances(keys, books) == want).all()


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.3, width).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize("n, width", [(60, 16), (9, 8), (40, 64)])
def test_codes_equal_brute_force(spark, n, width):
    many = vectors(n, width, n)
    rows = [(i, v, i % 3 if i % 4 else None) for i, v in enumerate(many)]
    rows += [(n + i, many[5], 1) for i in range(200)] + [(2, many[2], 2), (None, many[3], None)]  # a hot vector, repeats
    odd = [(-1, None, 1), (-2, [], 1), (-3, [None] * width, 1), (-4, [float("nan"), *many[0][1:]], 1), (-5, [float("inf")] * width, 1), (n + 999, many[0][:-1], 1)]
    books, want = brute(rows + odd)
    frame = spark.createDataFrame([(*r, "old", 7) for r in rows + odd], SCHEMA).repartition(5)
    found = vector_codes.fit(frame)
    assert found.tolist() == books
    coded = vector_codes.with_codes(frame, found)
    assert coded.columns == [*frame.columns, "_code", "_error"]
    got = [(r.vec_id, r._code, r._error, r.label) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    back = vector_codes.decoded(coded.select("vec_id", "_code"), found, "_code").first()
    assert back.decoded == [x / 4096 for p in range(8) for x in books[p][int(back._code[2 * p : 2 * p + 2], 16)]]


def test_label_errors(spark, monkeypatch):
    rows = [(i, i % 5 if i % 7 else None, "00", i * i) for i in range(100)]
    coded = spark.createDataFrame(rows, "vec_id long, label int, code string, error long")
    sums = {}
    for _, y, _, e in rows:
        sums[y] = sums.get(y, 0) + e
    for most in (1 << 16, 2):
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", most)
        got = vector_codes.with_label_error(coded)
        assert sorted((r.vec_id, r.label_error) for r in got.collect()) == [(i, sums[y]) for i, y, _, _ in rows]


def test_saturation_and_empty_tables(spark):
    huge = [3e38, -3e38] * 4
    frame = spark.createDataFrame([(1, huge, 0, "", 0), (2, [0.5] * 8, 0, "", 0)], SCHEMA)
    books = vector_codes.fit(frame)
    assert books[0, 0, 0] == vector_codes.MOST and books[1, 0, 0] == -vector_codes.MOST
    assert [r._error for r in vector_codes.with_codes(frame, books).collect()] == [0, 0]
    for none in (frame.limit(0), frame.where("vec_id = 9"), frame.selectExpr("vec_id", "slice(embedding, 1, 7) embedding", "label")):
        books = vector_codes.fit(none)
        assert vector_codes.with_codes(none, books).count() == 0
        assert vector_codes.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()


def test_query(spark):
    rows = queries()["op13_vector_codes"](spark, PATH)
    same_rows(rows, oracle_sql()["op13_vector_codes"], PATH, ["embeddings"])

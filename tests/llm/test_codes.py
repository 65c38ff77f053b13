import random

import numpy as np
import pytest

from lexmill.llm import codes
from lexmill.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_nearest(entries, q):
    d = ((q[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(-1) if q.shape[1] else np.zeros((len(q), len(entries)), object)
    return d.argmin(1), d.min(1)


def brute(rows, parts=8, entries=16, rounds=6):
    """rows (vec_id, whole numbers, label) in order of vec_id -> codes, errors, codebooks"""
    q = np.array([r[1] for r in rows]).reshape(len(rows), parts, -1)
    books = [q[:entries, p].copy() for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            index, _ = brute_nearest(books[p], q[:, p])
            for e in range(len(books[p])):
                if (index == e).any():
                    members = q[index == e, p]
                    books[p][e] = [int(s) // len(members) for s in members.sum(0)]
    found = [brute_nearest(books[p], q[:, p]) for p in range(parts)]
    code = ["".join(f"{found[p][0][i]:02x}" for p in range(parts)) for i in range(len(rows))]
    error = [int(sum(found[p][1][i] for p in range(parts))) for i in range(len(rows))]
    return code, error, books


@pytest.mark.parametrize("spread", [0, 1, 3, 50, 1 << 28])
def test_tree_equals_all_comparisons(spread):
    r = np.random.default_rng(spread)
    for n, width in ((1, 1), (2, 3), (16, 8), (16, 1), (200, 4)):
        entries = r.integers(-spread, spread + 1, (n, width))
        q = np.concatenate([r.integers(-spread, spread + 1, (300, width)), entries])
        index, best, _ = codes.Tree(entries).nearest(q)
        want, least = brute_nearest(entries, q)
        assert index.tolist() == want.tolist() and best.tolist() == least.tolist()


def test_tree_leaves_comparisons_out():
    r = np.random.default_rng(1)
    entries = r.integers(-1000, 1000, (256, 2))
    q = r.integers(-1000, 1000, (5000, 2))
    assert codes.Tree(entries).nearest(q)[2] < 0.25 * 256 * 5000


def test_roots_at_the_edges():
    x = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 31) ** 2 + 1, 94906267**2 - 1, 94906267**2])
    down, up = codes.roots(x)
    assert all(int(d) ** 2 <= int(v) < (int(d) + 1) ** 2 and (int(u) - 1) ** 2 < int(v) <= int(u) ** 2 or v == 0 for d, u, v in zip(down, up, x))


def vectors(r, n, dim=16):
    rows = [(i * 3, [r.choice([0.0, r.gauss(0, 0.2), -0.125]) for _ in range(dim)], r.choice([None, 1, 1, 2])) for i in range(n)]
    return [*rows, *[(i + 1, v, l) for i, v, l in rows[: n // 3]]]


def test_equals_brute_force(spark):
    rows = vectors(random.Random(1), 150)
    bad = [(-5, None, 1), (-4, [0.1] * 15 + [None], 1), (-3, [0.1] * 15 + [float("nan")], 1), (-2, [0.1] * 15 + [float("-inf")], None)]
    found = codes.compressed(spark.createDataFrame(rows + bad, SCHEMA).repartition(5)).collect()
    rows.sort()
    whole = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], l) for i, v, l in rows]
    code, error, books = brute(whole)
    sums = {}
    for (_, _, l), e in zip(whole, error):
        sums[l] = sums.get(l, 0) + e
    want = [(i, c, e, sums[l], codes.digest(books)) for (i, _, l), c, e in zip(whole, code, error)]
    assert sorted((r.vec_id, r.code.hex(), r.error, r.label_error, r.codebooks_sha256) for r in found) == sorted(want)
    assert codes.decoded(bytes(found[0].code), books).shape == (16,)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert codes.compressed(make([])).count() == 0
    assert codes.compressed(make([(1, None, 1)])).count() == 0
    # One of another length, one that can't be cut, a null vec_id, a repeated row, values too large for a long's square.
    rows = [(1, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [3e38] * 8, None), (None, [-3e38] * 8, 3), (4, [0.0] * 16, 1), (5, [0.0] * 7, 1)]
    found = codes.compressed(make(rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.error) for r in found) == [(False, 1, 0), (False, 1, 0), (False, 2, 0), (True, 0, 0)]
    large = [(i, [(-1.0) ** (i + j) * 7_000.0 * (i % 5) for j in range(64)], 1) for i in range(20)]
    code, error, _ = brute([(i, [int(4096 * x) for x in v], l) for i, v, l in large])
    assert sorted((r.vec_id, r.code.hex(), r.error) for r in codes.compressed(make(large)).collect()) == [(i, c, e) for i, (c, e) in enumerate(zip(code, error))]
    clashing = make([(i, [i / 7] * 8, 1) for i in range(40)]).selectExpr("*", "1 AS code", "2 AS `key.x`", "3 AS q")
    assert codes.compressed(clashing).exceptAll(codes.compressed(clashing.select("vec_id", "embedding", "label"))).isEmpty()
    with pytest.raises(ValueError):
        codes.train(codes.whole_numbers(make(rows)), entries=300)


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.vec_id, [int(np.floor(4096 * x)) for x in r.embedding], r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    code, error, books = brute(rows)
    found = sorted(Q.op11_vector_codes(spark, sf).collect())
    assert [(r.vec_id, r.code, r.error) for r in found] == [(i, c, e) for (i, _, _), c, e in zip(rows, code, error)]
    assert {r.codebooks_sha256 for r in found} == {codes.digest(books)}

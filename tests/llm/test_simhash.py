import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import simhash

SCHEMA = "doc_id long, text string, row int, fp string"


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def texts(r):
    base = [" ".join(r.choices(["the", "Of", "éa", "on", "thing", "ÀB", "x" * 30], k=60 + 20 * i)) for i in range(12)]
    out = [None, "", " \t\n", "one", "one two", "a b c d", "A b C D", "a\tb\x0bc  d"]
    for b in base:
        for _ in range(8):
            w = b.split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "new"
            out.append(" ".join(w))
    return out + base[:3] + ["word " * 3000]


def test_fingerprints_by_brute_force_and_over_parts(monkeypatch):
    for t in texts(random.Random(4)):
        assert simhash.fingerprint(t) == brute_fp(t)
    monkeypatch.setattr(simhash, "_CUT", 40)
    for t in texts(random.Random(5)):
        assert simhash.fingerprint(t) == brute_fp(t)


def test_embedding_bounds_the_distance(spark):
    r = random.Random(6)
    values = [r.getrandbits(64) for _ in range(300)] + [0, 2**64 - 1]
    rows = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    got = [int(np.int64(x.u).astype(np.uint64)) for x in rows.select(simhash.unary(F.col("fp")).alias("u")).collect()]
    counts = lambda v: [(v >> 2 * k & 3).bit_count() for k in range(32)]
    for v, u in zip(values, got):
        assert counts(v) == counts(u)
    for v, u, w, x in zip(values, got, values[1:], got[1:]):
        assert (u ^ x).bit_count() == sum(abs(a - b) for a, b in zip(counts(v), counts(w))) <= (v ^ w).bit_count()
    for g in (6, 7, 8):
        masks = [int(np.int64(m).astype(np.uint64)) for m in simhash.grid(g)]
        for _ in range(200):
            near = sum(1 << b for b in r.sample(range(64), 4))
            assert any(near & m == 0 for m in masks)


def test_components_match_brute_force(spark):
    r = random.Random(7)
    ts = texts(r)
    rows = [(1000 - i if i % 17 else None, t, i, "x") for i, t in enumerate(ts)] + [(3, ts[20], 0, "x")] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    fps = [brute_fp(t) for _, t, *_ in rows]
    group = brute_groups(fps)
    least = {g: min((d for (d, *_), h in zip(rows, group) if h == g and d is not None), default=None) for g in set(group)}
    want = sorted(str((d, f"{f:016x}", least[g])) for (d, *_), f, g in zip(rows, fps, group))
    for block in (simhash.BLOCK, 5):
        got = simhash.components_of(df, block=block)
        assert sorted(str((x.doc_id, x.fingerprint, x.component_id)) for x in got.collect()) == want
    left = simhash.survivors(df)
    assert left.columns == df.columns and left.count() == len(set(group))
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(v) for v in least.values())


def test_crowded_cells_and_long_chains(spark, monkeypatch):
    r = random.Random(8)
    centre, chain = r.getrandbits(64), [r.getrandbits(64)]
    near = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(150)}
    for k in range(40):
        chain.append(chain[-1] ^ (0b1111 << (4 * (k % 16))))
    fps = sorted(near | set(chain) | {r.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in fps], "fp long")
    for run, block in ((48, 10_000), (3, 20)):
        monkeypatch.setattr(simhash, "SMALL_RUN", run)
        roots = {x.v: x.root for x in simhash.connected(simhash.links(df, len(fps), block)).collect()}
        ids = [int(np.uint64(v).astype(np.int64)) for v in fps]
        got = [roots.get(v, v) for v in ids]
        want = brute_groups(fps)
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.components_of(df).count() == 0 and simhash.survivors(df).count() == 0

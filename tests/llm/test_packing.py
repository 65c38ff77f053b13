import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from lexmill.llm import packing

SCHEMA = "doc_id long, text string, length int"


def test_both_encoders_agree():
    fast, r = packing.Encoder(*packing.default_files()), random.Random(1)
    chars = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x180)]]
    texts = ["".join(r.choices(chars, k=60)) for _ in range(400)] + ["".join(r.choices(" \n\t ab1.'é", k=80)) for _ in range(400)] + [a + b for a in chars for b in " \n1a'"]
    for t in texts:
        assert not packing.BEYOND.search(t)
        assert fast(t).tolist() == fast.slow(t).tolist(), t
    for t in ("日本 語　", "a\x85b \x1c", "<|endoftext|>"):
        assert fast(t).tolist() == fast.slow(t).tolist()


def test_cut_gives_the_first_piece_the_rest():
    for n in (1, 5, 1023, 1024, 1025, 2048, 2500):
        ids = np.arange(n, dtype="<u4")
        got = packing.cut(ids)
        assert [p[0] for p in got] == list(range(-(-n // 1024)))
        assert got[0][2] == (n - 1) % 1024 + 1 and all(p[2] == 1024 for p in got[1:])
        assert [p[1] for p in got] == [sum(q[2] for q in got[:k]) for k in range(len(got))]
        assert [p[3] for p in got] == [zlib.crc32(ids[p[1] : p[1] + p[2]].tobytes()) for p in got]


def one_by_one(histogram, capacity):
    """Best-fit decreasing, piece by piece."""
    room = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [i for i, x in enumerate(room) if x >= length]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= length
            else:
                room.append(capacity - length)
    return len(room)


def test_plan_is_best_fit_or_better_and_complete():
    r = random.Random(2)
    for capacity, n in ((10, 40), (100, 300), (1024, 500)):
        for _ in range(6):
            h = Counter(r.randint(1, capacity) if r.random() < 0.7 else capacity // 3 + r.randint(0, 2) for _ in range(n))
            first = packing.best_fit(h, capacity)
            bins = packing.local_search(first, capacity)
            assert sum(first.values()) == one_by_one(h, capacity)
            assert -(-sum(a * k for a, k in h.items()) // capacity) <= sum(bins.values()) <= sum(first.values())
            held = Counter()
            for pattern, m in bins.items():
                assert 0 < sum(a * k for a, k in pattern) <= capacity
                held.update({a: k * m for a, k in pattern})
            assert held == h


def steps_left(bins, capacity):
    """Whether any pair of underfull bins has a step that adds to the sum of squared fills, by trying all."""
    every = [list(Counter(dict(p)).elements()) for p, n in bins.items() for _ in range(min(n, 2))]
    every = [b for b in every if sum(b) < capacity]
    choices = lambda b, most: [c for k in range(most + 1) for c in combinations(b, k)]
    for i, s in enumerate(every):
        for j, t in enumerate(every):
            if i != j and sum(t) >= sum(s):
                for a in choices(s, 2)[1:]:
                    for b in choices(t, 3 - len(a)):
                        much = sum(a) - sum(b)
                        if len(b) <= 2 and much > 0 and sum(t) + much <= capacity:
                            return True
    return False


def test_local_search_ends_where_no_step_is_left():
    r = random.Random(5)
    for capacity, n in ((20, 30), (100, 60), (1024, 80)):
        for _ in range(5):
            h = Counter(r.randint(capacity // 5, capacity * 3 // 5) for _ in range(n))
            bins = packing.local_search(packing.best_fit(h, capacity), capacity)
            assert not steps_left(bins, capacity)


def test_local_search_has_no_cap_on_steps_or_classes():
    r = random.Random(6)
    h = Counter(r.randint(300, 600) for _ in range(3000))
    first = packing.best_fit(h, 1024)
    found = packing.local_search(first, 1024)
    assert sum(found.values()) < sum(first.values())


def test_local_search_empties_bins_that_best_fit_leaves():
    start = Counter({((6, 1),): 1, ((5, 1), (3, 1)): 1, ((4, 1), (3, 1)): 1, ((5, 1), (4, 1)): 1})
    assert sum(packing.local_search(start, 10).values()) == 3


def check(rows, texts, capacity):
    encoder = packing.Encoder(packing.default_files()[0], None)
    want = Counter()
    for d, t in texts:
        ids = np.append(encoder(t or ""), 2).astype("<u4")
        want.update((d, *p) for p in packing.cut(ids, capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packs_documents(spark):
    r = random.Random(3)
    texts = [(i, " ".join(r.choices(["the", "ofthe", "éa", "x1", "\n"], k=r.choice([0, 1, 5, 40, 300])))) for i in range(150)]
    texts += [(7, None), (7, None), (None, ""), (None, "long " * 6000), (8, "日本語 text")]
    df = spark.createDataFrame([(d, t, 0) for d, t in texts], SCHEMA).repartition(5)
    for capacity in (1024, 64):
        rows = packing.pack_documents(df, capacity=capacity).collect()
        assert check(rows, texts, capacity) <= one_by_one(Counter(r.length for r in rows), capacity)


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0

import random

import numpy as np
import pytest

from lexmill.functions.similarity import Block, indel_ratio
from lexmill.operators.memory import similar_in


def near_copies(r, n):
    words = ["the", "pump", "runs", "of", "water", "é", "東京", "𝔸b", "at", "night", "valve", "-", "aa"]
    base = [" ".join(r.choices(words, k=r.randint(1, 14))) for _ in range(n)]
    out = ["", "a", *base]
    for b in base:
        t = list(b)
        for _ in range(r.randint(0, max(1, len(t) // 4))):
            i = r.randrange(len(t) + 1)
            r.choice([lambda: t.insert(i, r.choice("aeé ")), lambda: t and t.pop(min(i, len(t) - 1)), lambda: t.insert(0, t.pop() if t else "x")])()
        out.append("".join(t))
    return out


@pytest.mark.parametrize("threshold", [50.0, 80.0, 95.0])
def test_bounds_lose_nothing(threshold):
    r = random.Random(int(threshold))
    texts = near_copies(r, 120)
    block = Block(texts)
    for a in texts[::3]:
        want = {i: s for i, t in enumerate(texts) if (s := indel_ratio(a, t)) >= threshold}
        near, scores = similar_in(block, a, threshold)
        assert dict(zip(near.tolist(), scores.tolist())) == pytest.approx(want)


def test_bounds_rule_most_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    lines = [x for r in rows for x in (r.text or "").split("\n") if 100 <= len(x) <= 150]
    block, compared = Block(lines), 0
    for a in lines[::5]:
        compared += len(block.possible(a, np.ceil(0.4 * (len(a) + block.sizes) - 1e-9).astype(np.int64)))
    assert compared < 0.4 * len(lines) * len(lines[::5])


@pytest.mark.parametrize("threshold", [50.0, 80.0, 95.0])
def test_rare_letters_lose_nothing(threshold):
    r = random.Random(int(threshold) + 1)
    texts = near_copies(r, 80)
    texts += ["".join(r.choices("eeeeetttaoinshrdlué東𝔸", k=r.randint(0, 90))) for _ in range(80)]
    texts += [t + t[:3] for t in texts[-40:]] + ["", "", "\U0010ffff"]
    block = Block(texts)
    for a in texts[::3]:
        least = np.ceil(threshold * (len(a) + block.sizes) / 200.0 - 1e-9).astype(np.int64)
        some = block.possible(a, least)
        near = some[block.common_lengths(a, some) >= least[some]]
        assert set(near) <= set(block.reachable(a, some, least[some])) <= set(some)


def test_rare_letters_rule_nearly_all_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    lines = list({x for r in rows for x in (r.text or "").split("\n") if 200 <= len(x) <= 260})
    block, left, held = Block(lines), 0, 0
    for a in lines[::4]:
        least = np.ceil(0.4 * (len(a) + block.sizes) - 1e-9).astype(np.int64)
        some = block.possible(a, least)
        held, left = held + len(some), left + len(block.reachable(a, some, least[some]))
    assert left < 0.1 * held

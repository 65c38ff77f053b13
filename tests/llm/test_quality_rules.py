import re
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import kernels, quality_rules

SCHEMA = "doc_id long, text string, lang string, kept string"
LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
    marked = {k for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for k in range(j, j + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)


GOOD = "the quick brown fox jumps over a lazy dog while seven wizards brew potions in the quiet old tower near us".split()


def texts():
    out = [None, "", " \t\n", "one", "é" * 5000 + " ü", "ab " * 3000, "x" * 300 + " y\n" + "x" * 300 + " y", "a\n\na\n a\n<#|>&%$*"]
    for i in range(60):
        words = [GOOD[(i * 7 + k * (1 + i % 5)) % len(GOOD)] for k in range(20 + i)]
        out.append(" ".join(words))
    for i in range(20):
        out.append(" | ".join(f"Qz{(i * 31 + k) % 97}zz" for k in range(40)))
    return out


def brute_scores(rows, labels):
    """Means of log ratios over the words and pairs themselves; the library's differ where two share a bucket."""
    def found(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return words + list(zip(words, words[1:]))

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    raw, trusted = Counter(), Counter()
    for d, t, *_ in rows:
        raw.update(found(t))
        trusted.update(found(t) if d in good else ())
    n = sum(raw.values())
    share, before = sum(trusted.values()) / n, quality_rules.SMOOTHING * n / 65536
    return [np.mean([np.log((trusted[x] + before * share) / (raw[x] + before) / share) for x in f]) if (f := found(t)) else 0.0 for _, t, *_ in rows]


def test_measures_scores_and_verdicts(spark, monkeypatch):
    rows = [(i if i % 9 else None, t, "x", "clash") for i, t in enumerate(texts())] + [(10, texts()[10], "x", "clash")] * 2
    labels = [(i, int(i < 68), 0) for i in range(0, 88, 2)] + [(None, 1, 0), (2, 1, 0)]
    df, lab = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS)
    monkeypatch.setattr(kernels, "STEP_BYTES", 5000)
    got = quality_rules.judge(df, lab).collect()
    scores = brute_scores(rows, labels)
    want = sorted((str(d), *brute(t), round(s, 4)) for (d, t, *_), s in zip(rows, scores))
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.score) for r in got)
    assert [x[:-1] for x in found] == [x[:-1] for x in want]
    assert np.mean([abs(x[-1] - y[-1]) < 2e-4 for x, y in zip(found, want)]) > 0.9
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    left = quality_rules.accepted(df, lab)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    listed = [s for (_, t, *_), s in zip(rows, scores) if t and "|" in t and "Qz" in t]
    prose = [s for (_, t, *_), s in zip(rows, scores) if t and "wizards" in t]
    assert max(listed) < quality_rules.THRESHOLD < min(prose)


def test_buckets_grow_and_keep_scores_alike(spark, monkeypatch):
    assert quality_rules.n_buckets(0) == 1 << 16 < quality_rules.n_buckets(10**9) < quality_rules.n_buckets(10**12) <= 1 << 25
    rows = [(i, t, "x", "clash") for i, t in enumerate(texts())]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i < 68), 0) for i in range(0, 88, 2)], LABELS)
    few = {r.doc_id: r.kept for r in quality_rules.judge(df, lab).collect()}
    monkeypatch.setattr(quality_rules, "LEAST_BUCKETS", 1 << 19)
    assert {r.doc_id: r.kept for r in quality_rules.judge(df, lab).collect()} == few


def test_without_labels_and_empty(spark):
    df, none = spark.createDataFrame([(1, " ".join(GOOD) + " and more", "x", "y")], SCHEMA), spark.createDataFrame([], LABELS)
    row = quality_rules.judge(df, none).first()
    assert row.score == 0 and row.kept
    assert quality_rules.judge(df.limit(0), none).count() == 0 and quality_rules.accepted(df.limit(0), none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_words_of_random_bytes(seed):
    r = np.random.default_rng(seed)
    ts = ["".join(r.choice(list("ab \n\té|#"), r.integers(0, 200))) for _ in range(50)]
    m = quality_rules.measures([t.encode() for t in ts], None)
    assert [tuple(int(x[i]) for x in m) for i in range(50)] == [brute(t) for t in ts]

import re

import numpy as np

from lexmill.llm import rule_ensemble as rules

SCHEMA = "doc_id long, text string, label string, kinds int"
LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = max(1, len(words)), max(1, sum(map(len, words)))
    lines = text.split("\n")
    with_word = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    blocks = [range(i, min(i + 100, len(words))) for i in range(0, len(words), 100)]
    return {
        "log_words": np.log1p(len(words)),
        "word_chars": sum(map(len, words)) / n,
        "symbols": len(re.findall(r"[#*$%&|<>{}\[\]\\^~=_@]", text)) / chars,
        "upper": len(re.findall("[A-Z]", text)) / chars,
        "digits": len(re.findall("[0-9]", text)) / chars,
        "marks": len(re.findall("[!?;:\"'()]", text)) / chars,
        "foreign": sum(ord(c) > 127 for c in text) / chars,
        "same_lines": (len(with_word) - len(set(with_word))) / len(lines),
        "same_neighbours": sum(a == b for a, b in zip(words, words[1:])) / n,
        "kinds": sum(len({words[i] for i in b}) for b in blocks) / n,
        "kinds_of_pairs": sum(len({tuple(words[i : i + 2]) for i in b if i + 1 < len(words)}) for b in blocks) / n,
        "short_words": sum(len(w.encode()) <= 3 for w in words) / n,
        "line_words": len(words) / len(lines),
    }


def test_statistics_by_brute_force():
    r = np.random.default_rng(1)
    texts = ["", " ", "a", "a a\na a\n\n", "é" * 400] + [" ".join(r.choice(["the", "Of", "é", "a|b", "1", "x!\n"], r.integers(0, 350))) for _ in range(40)]
    for got, t in zip(rules.statistics([t.encode() for t in texts]), texts):
        for k, v in brute(t).items():
            assert abs(got[rules.STATISTICS.index(k)] - v) < 1e-9, (k, t)


def test_rules_are_the_paths_of_trees():
    described = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=14
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 9 <= 1.0E-4)
      Predict: 1.0
     Else (feature 9 > 1.0E-4)
      Predict: 0.0
    Else (feature 2 > 0.5)
     Predict: 0.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 3.25)
     Predict: 0.0
    Else (feature 0 > 3.25)
     Predict: 1.0
"""
    a, b, c, d = ("symbols", "<=", 0.5), ("same_neighbours", "<=", 1e-4), ("same_neighbours", ">", 1e-4), ("symbols", ">", 0.5)
    assert set(rules.rules_of(described)) == {(a,), (b, a), (c, a), (d,), (("log_words", "<=", 3.25),), (("log_words", ">", 3.25),)}


def test_learns_without_the_held_out_and_scores_everything(spark):
    good, bad = "the river runs over old stones while {} birds sing in tall trees", "### {} ### $$$ ### {} ||| ***"
    rows = [(i, (good if i % 3 else bad).replace("{}", f"w{i}"), "clash", 1) for i in range(300)]
    rows += [(None, None, "clash", 1), (500, "", None, 1), (7, rows[7][1], "clash", 1), (501, "word " * 20_000, "clash", 1)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 0, 0), (4, 1, 1), (502, None, 0)]
    df, lab = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, LABELS)
    got = rules.classify(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == int(r.doc_id % 3 > 0)
    assert any(r.held_out for r in got)
    one_kind = rules.classify(df, lab.where("quality = 1")).collect()
    assert all(r.predicted == 1 for r in one_kind)
    assert {r.score for r in rules.classify(df, lab.limit(0)).collect()} == {0.5}
    assert rules.classify(df.limit(0), lab).count() == 0


def same_windows(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(inside) / max(1, len(words))


def test_scores_by_brute_force(spark):
    """The score of every document, from the fitted rules and plainly counted statistics."""
    r = np.random.default_rng(4)
    good, bad = "the river runs over old stones while {} birds sing in tall trees and so on".split(), "### {} ||| $$$ *** Up A1 a a a".split()
    mixed = lambda share: " ".join(str(r.choice(good if r.random() < share else bad)) for _ in range(r.integers(5, 40)))
    texts = [mixed(0.6 if i % 3 else 0.4) for i in range(200)] + ["", "one", " ".join(good * 3), "a\na\nb"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], LABELS)
    ensemble = rules.fit(rules.labelled(df, labels))
    assert len(ensemble.weights) > 3
    want = {}
    for i, t in enumerate(texts):
        found = brute(t) | {"same_windows": same_windows(t)}
        total = ensemble.bias + sum(w for rule, w in ensemble.weights.items() if all(found[n] <= b if sign == "<=" else found[n] > b for n, sign, b in rule))
        want[i] = 1 / (1 + np.exp(-total))
    got = {x.doc_id: x for x in rules.classify(df, labels).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i].score - s) < 1e-9 and got[i].predicted == int(s >= 0.5) for i, s in want.items())


def test_odd_names(spark):
    df = spark.createDataFrame([(1, "some words", 2, 3.0)], "`doc.id` long, `the.text` string, `x.y` int, upper double")
    kept = rules.with_statistics(df, [rules.quoted("x.y"), rules.quoted("upper")], "the.text")
    assert kept.columns == ["x.y", *rules.STATISTICS] and kept.first()["x.y"] == 2 and kept.first()["upper"] == 0.0
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert rules.classify(df, labels, text="the.text", doc_id="doc.id").count() == 1

import random
import re

from pyspark.sql import functions as F

from lexmill.llm import licenses
from lexmill.llm import queries as Q
from lexmill.llm.licenses import NOTICES, PHRASES, Notice, Scanner

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return WORD.findall(lower(text))


def brute_base(text):
    words = words_of(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def least_edits(pattern, text):
    """Least edits between pattern and any part of text: all cells of the table, a row a character of text."""
    row = list(range(len(pattern) + 1))
    least = row[-1]
    for c in text:
        last, row = row, [0]
        for j, p in enumerate(pattern, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != c)))
        least = min(least, row[-1])
    return least


def damaged(r, text, edits):
    out = list(text)
    for _ in range(edits):
        i, letter = r.randrange(len(out)), r.choice("abcdefghij 123")
        r.choice([lambda: out.insert(i, letter), lambda: out.pop(i), lambda: out.__setitem__(i, letter)])()
    return "".join(out)


def corpus(r):
    noise = ["the", "license", "under", "version", "x", "mit", "2", "licensed", "東京", "permission", "commons", "v1"]
    fill = lambda k: " ".join(r.choices(noise, k=k))
    return [f"{fill(r.randint(0, 12))} {damaged(r, n.words, r.randint(0, n.edits + 2))} {fill(r.randint(0, 12))}" for n in NOTICES for _ in range(4)]


def test_pieces_find_every_notice_within_its_edits():
    r, scanner = random.Random(1), Scanner()
    for text in corpus(r):
        form = licenses.normal(text.encode())
        found = {(m.label, m.edits) for m in scanner.matches(form, told=False)}
        want = {(n.label, e) for n in NOTICES if (e := least_edits(n.words, form)) <= n.edits}
        assert {x for x, _ in found} == {x for x, _ in want}, text
        for label in {x for x, _ in want}:  # the best span has no more edits than the least
            assert min(e for x, e in found if x == label) == min(e for x, e in want if x == label), text


def test_base_and_words_equal_brute_force(spark):
    r = random.Random(2)
    odd = [" ", "\n", "-", " ", ".", "\x7f", "É", "under", "the", "MIT", "License", "cc", "BY", "nc", "apache license", "version", "2", "２"]
    texts = [None, "", " .", "cc by nc cc by-NC", "cc by nc" * 3, "Under the MIT license" + "!" * 3000 + "under  THE\nmit/license"]
    texts += ["".join(x + r.choice([" ", "", "-"]) for x in r.choices(odd, k=r.randint(1, 40))) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("i", F.monotonically_increasing_id())
    found = docs.select("i", licenses.scan(F.col("text")).alias("f")).orderBy("i").collect()
    assert [tuple(x.f)[:5] for x in found] == [brute_base(t) for t in texts]
    assert all(set(x.f.base_labels.split(",")) - {""} <= set(x.f.labels.split(",")) and 0 <= x.f.score <= 1 for x in found)


def labels(text):
    return licenses.found((text or "").encode(), Scanner())[5]


def test_telling_words_keep_licenses_apart():
    assert labels("Licensed under the Apache License, Version 1.0.") == ""
    assert labels("Licensed undr the Apahce Licence, Version 2.0.") == "apache-2"
    assert labels("licensed under the apache license version 2 0") == "apache-2"
    assert labels("Licensed under the GNU General Public License, version 2.") == "gpl-2"
    assert labels("Licensed under the GNU General Publik Licence, version 3.") == "gpl-3"
    assert labels("Licensed under the GNU Lesser General Public License version 3") == "lgpl-3"
    assert labels("Licensed under CC BY-NC 4.0") == "cc-by-nc"
    assert labels("Licenced under CC BY 4.0") == "cc-by"
    assert labels("licensed under cc by nd 4.0") == ""
    assert labels("relased under the mit licence") == "mit"
    assert labels("released under the mist license") == ""
    assert labels("the license of the version under review") == ""


def test_spans_are_places_in_the_text():
    text = "Ünder: RELEASED  under\tthe-MIT licence!! and later Released under  the MIT License"
    n_words, n_base, first, last, base, found, score, spans = licenses.found(text.encode(), Scanner())
    places = [x.split(":") for x in spans.split(",")]
    assert [(x, text[int(a) : int(b)], e) for x, a, b, e in places] == [
        ("mit", "RELEASED  under\tthe-MIT licence", "1"),
        ("mit", "Released under  the MIT License", "0"),
    ]
    assert (n_words, n_base, first, last, base, found, score) == (13, 1, 9, 9, "mit", "mit", 1.0)


def test_dense_pieces_and_long_texts(monkeypatch):
    monkeypatch.setattr(licenses, "_STEP", 64)
    piece = Scanner().notices[0].pieces()[0][1]
    text = (piece + " ") * 500 + "RELEASED UNDER THE MIT LICENSE " + "word " * 50_000
    n, n_base, *_, found, score, _ = licenses.found(text.encode(), Scanner())
    assert n == len(words_of(text)) and n_base == 1 and "mit" in found.split(",") and score == 1.0


def test_own_notices_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "made by acme and frends"), (2, None)], "doc_id long, text string")
    own = licenses.scan(F.col("text"), (Notice("acme", "made by acme and friends"),), {})
    assert [tuple(r) for r in docs.select("doc_id", own["labels"], own["n_base"]).orderBy("doc_id").collect()] == [(1, "acme", 0), (2, "", 0)]
    assert docs.limit(0).select(licenses.scan(F.col("text"))).count() == 0
    nothing = licenses.scan(F.col("text"), (), {})
    assert docs.select(nothing["labels"]).distinct().collect() == [("",)]


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = Q.op12_license_scan(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in found} == {i: brute_base(t) for i, t in docs.items()}
    named = {r.doc_id for r in found if r.labels}
    assert named == {i for i, t in docs.items() if re.search("[Ll]icensed under|[Rr]eleased under the MIT", t or "")}

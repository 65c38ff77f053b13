import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import fim
from lexmill.llm import queries as Q

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(r):
    odd = ["é", "東", "𝔸", "\n", " ", "<", "<S", "S>", ">", "abc", "Z", "1", "\x00", "​"]
    out = [None, "", "a", "é", "\n", "a<P>b", "<M>", "<S", "x" * 5000, "é" * 3000, "a1" * 3000]
    return out + ["".join(r.choices(odd, k=r.randint(1, 60))) for _ in range(600)]


def test_runs_hold_every_cut(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(fim, "_STEP", 7)  # characters and runs lie across steps
    for text in texts(r)[1:200]:
        runs, units = fim.Runs(text.encode()), UNIT.findall(text)
        assert runs.n == len(units)
        places = np.cumsum([0, *map(len, units)])
        assert [runs.place(c) for c in range(0, len(units) + 1, 1 + len(units) // 50)] == places[:: 1 + len(units) // 50].tolist()
        assert runs.place(len(units)) == len(text)


def test_equals_brute_force_and_restores(spark):
    rows = [(None if i == 5 else i - i // 7, t, 1) for i, t in enumerate(texts(random.Random(2)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut int").repartition(5)
    done = fim.transformed(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(map(str, (brute(i, t) for i, t, _ in rows)))
    assert sorted(str(tuple(r)[:6]) for r in done) == want
    assert sorted(r.back for r in done) == sorted(t or "" for _, t, _ in rows)
    assert {r.form for r in done} == {"plain", "psm", "spm"}


def test_other_shares_and_seeds(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
    assert fim.transformed(docs, rewritten=0).where("form <> 'plain'").isEmpty()
    assert fim.transformed(docs, rewritten=100, spm=100).where("form <> 'spm'").isEmpty()
    assert fim.transformed(docs, seed="2").exceptAll(fim.transformed(docs)).count() > 300


def test_kept_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "ab cd", 2, {"k": 1})], "doc_id long, text string, `cut.n` int, doc map<string,int>")
    kept = fim.rewritten(docs, rewritten=100, spm=0)
    assert kept.columns == docs.columns
    assert kept.first()["text"].startswith("<P>") and kept.first()["cut.n"] == 2 and kept.first()["doc"] == {"k": 1}
    assert fim.transformed(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "word, " * 400_000 + "é" * 100_000
    docs = spark.createDataFrame([(3, text)], "doc_id long, text string")
    assert tuple(fim.transformed(docs).first()) == brute(3, text)


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(str((*b[:5], sha(b[5]), sha(d.text or ""))) for d in docs for b in [brute(d.doc_id, d.text)])
    assert sorted(str(tuple(r)) for r in Q.op13_fill_in_middle(spark, sf).collect()) == want

"""Versions of stored tables, runs found by their files, replies of engines."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from lexmill.functions import replies
from lexmill.operators import glossary, stored
from lexmill.sources import runs, tables
from lexmill.sources.snapshots import Conflict, StoredTable


def numbers(spark, *ks):
    return spark.createDataFrame([(k, f"v{k}") for k in ks], "k int, v string")


def values(df):
    return sorted(r.k for r in df.collect())


def test_readers_keep_their_version(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.versions() == {}
    with pytest.raises(LookupError):
        table.read()
    assert table.write(numbers(spark, 1)) == 1
    first = table.read()
    assert table.write(numbers(spark, 1, 2)) == 2
    assert values(first) == [1] and values(table.read()) == [1, 2] and values(table.read(1)) == [1]
    assert table.forget(1) == [1] and sorted(table.versions()) == [2]
    assert values(StoredTable(spark, str(tmp_path / "t")).read()) == [1, 2]


def test_a_lost_race_is_seen_and_leaves_nothing(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"))
    table.write(numbers(spark, 1))
    table.write(numbers(spark, 1, 2), base=1)
    with pytest.raises(Conflict):
        table.write(numbers(spark, 1, 3), base=1)
    assert values(table.read()) == [1, 2]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2


def test_a_failed_write_leaves_no_version(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"))
    table.write(numbers(spark, 1))
    with pytest.raises(Exception, match="broken"):
        table.write(numbers(spark, 2).withColumn("v", F.raise_error(F.lit("broken"))))
    assert table.version() == 1 and values(table.read()) == [1]
    assert table.write(numbers(spark, 1, 2)) == 2


def test_writers_side_by_side_lose_no_row(spark, tmp_path):
    table, failed = StoredTable(spark, str(tmp_path / "t")), []
    table.write(numbers(spark, 0))

    def add(k):
        try:
            table.changed(lambda rows: rows.unionByName(numbers(spark, k)), tries=20)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    writers = [threading.Thread(target=add, args=(k,)) for k in range(1, 5)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and values(table.read()) == [0, 1, 2, 3, 4] and table.version() == 5


def test_schema_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    StoredTable(spark, path).write(numbers(spark, 1))
    later = StoredTable(spark, path, (lambda df: df.withColumn("w", F.lit("new")), lambda df: df.withColumnRenamed("w", "x")))
    assert [tuple(r) for r in later.read().collect()] == [(1, "v1", "new")] and later.read().columns == ["k", "v", "x"]
    later.write(later.read())
    assert later.read().columns == ["k", "v", "x"]
    with pytest.raises(ValueError, match="newer"):
        StoredTable(spark, path).read()


def test_concurrent_upserts_keep_ids(spark, tmp_path):
    columns = "id int, glossary_id int, source_term string, source_lang string, target_lang string, context string, target_term string"
    row = lambda term, target, *more: (*more, 1, term, "en", "de", "", target)
    table = StoredTable(spark, str(tmp_path / "g"))
    table.write(spark.createDataFrame([row("pump", "Pumpe", 7)], columns))
    new = lambda *rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], columns.removeprefix("id int, ") + ", seq int")
    threads = [threading.Thread(target=table.changed, args=(lambda old, n=n: glossary.upserted(old, new(row("pump", n), row(n, n))), 9)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = {r.source_term: r.id for r in table.read().collect()}
    assert found.keys() == {"pump", "a", "b"} and found["pump"] == 7 and sorted(found.values()) == [7, 8, 9]


def test_runs_by_their_files(spark, tmp_path):
    out, originals = tmp_path / "my out" / "deep", tmp_path / "originals"
    out.mkdir(parents=True)
    originals.mkdir()
    sheet = "segment,page,source,translation,checks\ns0,1,a,A,\ns1,1,b,,\n"
    for name in ("deck_en-ja_vote.review.csv", "deck_en-de_verify.review.csv", "lost_en-ja_vote.review.csv", "deck_en-ja_other.review.csv", "plan_b_de-en_vote.review.csv"):
        (out / name).write_text(sheet)
    for p in (out / "plan_b_de-en_vote.pdf", out / "deck_en-ja_vote.terms.csv", originals / "deck.pptx", originals / "plan_b.pdf", originals / "lost.pdf"):
        p.write_text("x")
    found = runs.discovered(runs.files(spark, str(tmp_path / "my out")), runs.files(spark, str(originals)))
    rows = sorted((r.run, r.name, r.src, r.tgt, r.kind, r.format, r.terms) for r in found.collect())
    assert rows == [("deck_en-de_verify", "deck", "en", "de", "verify", "pptx", False), ("deck_en-ja_vote", "deck", "en", "ja", "vote", "pptx", True), ("plan_b_de-en_vote", "plan_b", "de", "en", "vote", "pdf", False)]
    one = runs.reviews(spark, found.where("run = 'deck_en-ja_vote'"))
    segments = spark.createDataFrame([("s0",), ("s1",), ("s2",)], "seg_id string")
    assert [tuple(r) for r in tables.restored(segments, one).orderBy("seg_id").collect()] == [("s0", "A"), ("s1", None), ("s2", None)]
    assert runs.reviews(spark, found.limit(0)).count() == 0


def test_sheets_come_back_as_written(spark, tmp_path):
    rows = [("s0", "1", " a ", 'x "y",\n z ', ""), ("s1", "2", "", "\t", "b")]
    names = "segment string, page string, source string, translation string, checks string"
    tables.write_review(spark.createDataFrame(rows, names).coalesce(1), str(tmp_path / "r.review.csv"))
    back = spark.read.csv(str(tmp_path / "r.review.csv"), header=True, multiLine=True, escape='"').orderBy("segment").collect()
    assert [(r.segment, r.source or "", r.translation) for r in back] == [("s0", " a ", 'x "y",\n z '), ("s1", "", "\t")]
    term = spark.createDataFrame([("pump ", "Pumpe", "en", "de", "c", "", True, "low", "")], ", ".join(f"{c} {'boolean' if c == 'do_not_translate' else 'string'}" for c in tables.GLOSSARY))
    tables.write_glossary(term.coalesce(1), str(tmp_path / "g"))
    text = next((tmp_path / "g").glob("part*")).read_bytes().decode("utf-8")
    assert text.startswith("\ufeffsource_term,target_term,")
    assert tables.read_glossary(spark, str(tmp_path / "g")).first().source_term == "pump"


def whole_entries(text, ids):
    """The answers of a reply: all of valid JSON, else entry after entry up to where it breaks off."""
    out, at, decoder = {}, 0, json.JSONDecoder()
    try:
        found = json.loads(text)
        entries = found.get("translations") or [] if isinstance(found, dict) else []
    except ValueError:
        entries = []
        while (at := text.find("{", at)) >= 0:
            try:
                entry, end = decoder.raw_decode(text, at)
            except ValueError:
                at += 1
                continue
            if isinstance(entry, dict) and set(entry) == {"id", "text"}:
                entries.append(entry)
            at = end
    for e in entries:
        if e.get("id") in ids:
            out[e["id"]] = e.get("text") or None
    return [(i, out.get(i)) for i in ids]


def test_damaged_replies_against_plain_reading(spark):
    r = random.Random(2)
    rows = []
    for n in range(150):
        ids = [f"s{i}" for i in range(r.randint(1, 5))]
        texts = ["".join(r.choices(["a", '"', "\\", "}", "{", "é", "\n", " ", "\u2028", "]"], k=r.randint(0, 12))) for _ in ids]
        entries = [{"id": i, "text": t} for i, t in zip(ids, texts)] + ([{"id": ids[0], "text": "again"}] if n % 7 == 0 else []) + ([{"id": "zz", "text": "t"}] if n % 5 == 0 else [])
        whole = json.dumps({"translations": entries}, ensure_ascii=n % 2 == 0)
        kind = n % 4
        rows.append((n, ids, whole[: r.randint(0, len(whole))] if kind == 1 else f"<think>a {{}} b\n</think>\n{whole}\n" if kind == 2 else whole))
    long = json.dumps({"translations": [{"id": "a", "text": 'x\\n"y" ' * 100_000}, {"id": "b", "text": "é" * 300_000}, {"id": "c", "text": "cut"}]}, ensure_ascii=False)
    rows += [(906, ["a", "b", "c"], long[:-8]), (907, ["a", "b", "c"], long)]
    rows += [(900, ["a"], None), (901, ["a"], ""), (902, ["a"], "no"), (903, ["a"], "[]"), (904, ["a"], '{"translations": null}'), (905, [], "{}")]
    docs = spark.createDataFrame(rows, "n int, ids array<string>, reply string")
    strip = lambda t: t.split("</think>\n", 1)[-1].strip()
    found = {x.n: [tuple(a) for a in x.a] for x in docs.select("n", replies.answers(F.col("reply"), F.col("ids")).alias("a")).collect()}
    for n, ids, reply in rows:
        assert found[n] == whole_entries(strip(reply or ""), ids), (n, reply)
    strict = docs.where("n % 4 = 1 and n < 900").select(F.explode(replies.answers(F.col("reply"), F.col("ids"), salvage=False)).alias("a"))
    assert strict.where("a.text is not null").count() < docs.where("n % 4 = 1 and n < 900").select(F.explode(replies.answers(F.col("reply"), F.col("ids"))).alias("a")).where("a.text is not null").count()


def test_seeded_glossaries(spark):
    columns = "id int, glossary_id int, source_term string, source_lang string, target_lang string, context string, target_term string"
    names = spark.createDataFrame([(1, "own")], "id int, name string")
    terms = spark.createDataFrame([(4, 1, "pump", "en", "de", "", "Pumpe")], columns)
    seed = spark.createDataFrame([("fan", "en", "de", "", "Lüfter", 0), ("fan", "en", "de", "", "Ventilator", 1)], "source_term string, source_lang string, target_lang string, context string, target_term string, seq int")
    after, put = stored.seeded(names, terms, "default", seed)
    assert sorted(map(tuple, after.collect())) == [(1, "own"), (2, "default")]
    assert sorted((r.id, r.glossary_id, r.target_term) for r in put.collect()) == [(4, 1, "Pumpe"), (5, 2, "Ventilator")]
    again, same = stored.seeded(after, put, "default", seed.withColumn("target_term", F.lit("x")))
    assert again.count() == 2 and sorted(r.target_term for r in same.collect()) == ["Pumpe", "Ventilator"]

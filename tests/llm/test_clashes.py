"""Extra columns of any name and type pass through every operator and stage, and change nothing."""

import corpus_pipeline
import pytest

from lexmill.llm import chat, exact_dedup, langid, mixing, packing, pii, quality_rules, rule_ensemble, simhash, warc

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = "__row __sha __h __maybe __text __copy __copies __id __spans row doc sha order maybe copy copies key size fp first h hashes part kept score spans rank mix target label trusted".split()
MORE = ", ".join(f"{n} string" for n in NAMES) + ", `a.b` long, `c``d` string, m map<string,int>"
BASE = "the quick brown fox jumps over a lazy dog while seven wizards brew potions in the quiet old tower near us".split()


def rows():
    out = []
    for i in range(60):
        text = " ".join(BASE[(i * 7 + k * (1 + i % 5)) % len(BASE)] for k in range(24 + i % 30)) + f" mail{i % 9}@place.example"
        out.append((i, text, "en" if i % 2 else "de", f"s{i % 4}", len(text)))
    return [*out, *out[:5], (None, None, None, None, None), (7, "", "en", "s1", 0)]


@pytest.fixture(scope="module")
def tables(spark):
    plain = spark.createDataFrame(rows(), PLAIN)
    wide = spark.createDataFrame([(*r, *[f"{n}{i}" for n in NAMES], i, "tick", {"k": i}) for i, r in enumerate(rows())], f"{PLAIN}, {MORE}").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    return plain.repartition(3), wide, labels


def told(df):
    return sorted(map(str, df.collect()))


KEEP = {
    "accepted": lambda d, labels: quality_rules.accepted(d, labels),
    "exact": lambda d, _: exact_dedup.survivors(d),
    "near": lambda d, _: simhash.survivors(d),
    "mix": lambda d, _: mixing.mix(d),
    "sanitise": lambda d, _: pii.sanitise(d),
}


@pytest.mark.parametrize("name", KEEP)
def test_rows_are_kept_whole(tables, name):
    plain, wide, labels = tables
    got = KEEP[name](wide, labels)
    assert got.schema.simpleString() == wide.schema.simpleString()
    names = [c.split()[0] for c in PLAIN.split(", ")]
    assert told(got.select(*names)) == told(KEEP[name](plain, labels).select(*names))
    before = {r.n_chars: r for r in wide.collect()}
    mine = {r["a.b"]: r for r in wide.collect()}
    for r in got.collect():
        was = mine[r["a.b"]]
        assert r["m"] == was["m"] and r["c`d"] == "tick" and all(r[n] == was[n] for n in NAMES)
        assert name == "sanitise" or r.text == was.text
    assert before


TELL = {
    "judge": lambda d, labels: quality_rules.judge(d, labels),
    "assign": lambda d, _: exact_dedup.assignments(d),
    "components": lambda d, _: simhash.components_of(d).drop("row", "first"),
    "sample": lambda d, _: mixing.sample(d).drop("row"),
    "find": lambda d, _: pii.find(d).drop("row"),
    "pack": lambda d, _: packing.pack_documents(d).drop("sequence_id", "offset"),
    "identify": lambda d, _: langid.identify(d),
    "classify": lambda d, labels: rule_ensemble.classify(d, labels).select("doc_id", "held_out"),
}


@pytest.mark.parametrize("name", TELL)
def test_results_ignore_other_columns(tables, name):
    plain, wide, labels = tables
    assert told(TELL[name](wide, labels)) == told(TELL[name](plain, labels))


def test_turns_and_pages_with_other_columns(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (None, 0, "user", "lone")]
    more = ", n string, p0 string, said string, mark string, last string, `a.b` long"
    plain = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    wide = spark.createDataFrame([(*t, "a", "b", "c", "d", "e", 1) for t in turns], plain.schema.simpleString()[7:-1].replace(":", " ") + more)
    assert told(chat.format_chats(wide)) == told(chat.format_chats(plain))
    pages = [(1, "http://a", "<p>" + "x" * 200), (2, "http://b", "<p>" + "x" * 200), (3, None, None)]
    few = spark.createDataFrame(pages, "page_id long, url string, html string")
    many = spark.createDataFrame([(*p, "a", "b", 1) for p in pages], "page_id long, url string, html string, payload string, size string, `a.b` long")
    assert told(warc.round_trip(many)) == told(warc.round_trip(few))


def test_stages_keep_the_columns(spark, tables, tmp_path):
    _, wide, labels = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    wide.write.parquet(f"{tmp_path}/0")
    docs = spark.read.parquet(f"{tmp_path}/0")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1], 1):
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert told(corpus_pipeline.STAGES[k - 1][1](spark, docs.limit(0), str(tmp_path))) == []
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count() > 0

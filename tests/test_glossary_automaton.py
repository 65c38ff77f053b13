"""The automaton against one pattern a term, and the queries over whole tables against a plain loop."""

import random
import re

from pyspark.sql import functions as F

from lexmill import queries
from lexmill.functions import tags
from lexmill.operators import glossary, terms

TERM = "source_term string, target_term string, source_lang string, target_lang string, do_not_translate boolean, priority string, context string, term_seq int"


def plain_match(text, around, rows, src, tgt):
    """Every term's pattern over the whole text, longest term first."""
    held = []
    for source, target, a, b, keep, priority, context, seq in rows:
        find, instead = (source, source) if keep else (source, target) if (a, b) == (src, tgt) else (target, source) if (b, a) == (src, tgt) else ("", "")
        words = [k.strip().lower() for k in context.split(",") if k.strip()]
        if find:
            held.append((-len(find), not words, {"high": 0, "normal": 1, "low": 2}[priority], seq, find, instead, keep, words))
    taken, found = [], {}
    for *_, find, instead, keep, words in sorted(held, key=lambda t: t[:6]):
        if words and not any(k in around.lower() for k in words):
            continue
        if find.isascii():
            name = find.isupper() or any(c.isdigit() for c in find)
            pattern = re.compile(rf"(?<![A-Za-z0-9]){re.escape(find)}(?:s|es)?(?![A-Za-z0-9])", 0 if name else re.I)
        else:
            pattern = re.compile(re.escape(find))
        for m in pattern.finditer(text):
            if not any(m.start() < e and s < m.end() for s, e in taken):
                taken.append(m.span())
                found[find, instead, keep] = None
    return list(found)


def made_up(r):
    pieces = ["a", "A", "aa", "b", "s", "es", "K", "\u212a", "\u017f", "\u0130", "1", "-", " ", "é", "東", "京"]
    word = lambda k: "".join(r.choices(pieces, k=r.randint(1, k)))
    rows, seen = [], set()
    for i in range(120):
        t = (word(4), word(3), r.choice(["en", "en", "ja"]), r.choice(["ja", "ja", "en"]), r.random() < 0.15, r.choice(["low", "normal", "high"]), r.choice(["", "", "b, 東", "zz"]), i)
        if t[0].strip() and t[1].strip() and t[:1] not in seen:
            seen.add(t[:1])
            rows.append(t)
    rows += [(t[0], t[1] + "x", *t[2:5], "high", "a", 200 + i) for i, t in enumerate(rows[:30])]
    return rows, ["", *("".join(r.choices(pieces, k=r.randint(1, 30))) for _ in range(150)), "a" * 500, "aa " * 200]


def test_automaton_equals_patterns(spark):
    rows, texts = made_up(random.Random(3))
    held = spark.createDataFrame(rows, TERM)
    docs = spark.createDataFrame([(i, t, "ZZ" if i % 2 else None) for i, t in enumerate(texts)] + [(len(texts), None, None)], "i int, plain string, around string")
    for src, tgt in (("en", "ja"), ("ja", "en")):
        want = [plain_match(t, f"{t}\n{'ZZ' if i % 2 else ''}", rows, src, tgt) for i, t in enumerate(texts)] + [[]]
        for more in ({}, {"shard_bytes": 60}):
            found = glossary.with_hints(docs, held, src, tgt, "plain", "around", **more).orderBy("i").collect()
            assert [[tuple(h)[:3] for h in r.hints] for r in found] == want
    assert any(len(w) > 3 for w in want)
    nothing = glossary.with_hints(docs, held.limit(0), "en", "ja")
    assert nothing.where("size(hints) > 0").isEmpty() and nothing.count() == len(texts) + 1


def test_fifty_thousand_terms(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefg", k=r.randint(3, 6))) for _ in range(3000)]
    rows = [(" ".join(r.sample(words, 2)), f"t{i}", "en", "ja", False, "normal", "", i) for i in range(50_000)]
    texts = [" ".join(r.choices(words, k=5)) + ". " + r.choice(rows)[0] + " " + r.choice(rows)[0].upper() for _ in range(40)]
    found = glossary.with_hints(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, plain string"), spark.createDataFrame(rows, TERM), "en", "ja").orderBy("i").collect()
    few = [[row for row in rows if row[0] in t.lower()] for t in texts]
    assert [[tuple(h)[:3] for h in x.hints] for x in found] == [plain_match(t, t, f, "en", "ja") for t, f in zip(texts, few)]


def test_known_terms_are_not_mined_again(spark):
    texts = ["The chilled water plant runs at night", "Chilled water plants and heat recovery wheel", "the heat recovery wheel of AHU-12", "AHU-12 heat recovery wheel"]
    docs = spark.createDataFrame([(1, f"s{i}", t) for i, t in enumerate(texts)], "doc_id long, seg_id string, plain string")
    held = spark.createDataFrame([("chilled water plant", "x", "en", "ja", False, "normal", "", 0)], TERM)
    found = terms.mined(glossary.with_hints(docs, held, "en", "ja"), "en")
    assert {r.phrase for r in terms.maximal(found).collect()} == {"heat recovery wheel"}
    bare = terms.mined(docs.withColumn("hints", F.array().cast(glossary.HINT)), "en")
    assert "chilled water" in {r.phrase for r in bare.collect()}


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    held = [tuple(r) for r in queries.phrase_terms(spark, sf).select(*[c.split()[0] for c in TERM.split(", ")]).collect()]
    rows = queries.marked(spark, sf).select("seg_id", tags.strip_tags(F.col("source")).alias("plain")).collect()[::7]
    found = {r.seg_id: r.hints for r in queries.glossary_phrases(spark, sf).groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("hints")).collect()}
    for r in rows:
        want = sorted((a, b) for a, b, _ in plain_match(r.plain, r.plain, [t for t in held if (t[0] if t[4] or t[2] == "en" else t[1]).lower() in r.plain.lower()], "en", "de"))
        assert [tuple(h) for h in found.get(r.seg_id, [])] == want

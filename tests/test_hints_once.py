"""Glossaries: each text is matched once, and a matcher's quick choice is that of the plain one."""

import random

from lexmill import queries
from lexmill.operators import glossary


def test_texts_are_matched_once(spark):
    for f in (queries.glossary_phrases, queries.glossary_parts, queries.glossary_match):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("ArrowEvalPython") == 1, f.__name__


def test_quick_choice(spark):
    r = random.Random(5)
    words = ["water", "feed", "BMS", "es", "s", "x1", "ſafe", "K", "İ", "東京", "é", "Pump", "pumps", "a"]
    finds = [" ".join(r.choices(words, k=r.randint(1, 3))) for _ in range(60)]
    terms = [{"find": f, "instead": r.choice("xy"), "keep": r.random() < 0.2, "keywords": r.choice([[], [], ["bms"], ["ahu", "zz"]]), "priority": r.randrange(3), "term_seq": r.randrange(3)} for f in finds + finds[:20]]
    m = glossary.Matcher(terms)
    for _ in range(800):
        text = "".join(r.choice(words + [w.upper() for w in words]) + r.choice([" ", " ", "s ", "es ", "", "-", "ses "]) for _ in range(r.randint(0, 9)))
        around = r.choice(["", "the bms", "ahu"])
        assert [m.hints[i].as_py() for i in m.chosen(text, around)] == glossary.chosen(m.candidates(text), len(text), around) if text else m.chosen(text, around) == []
        for find, spans in m.spans(text).items():
            wanted = [x.span() for x in glossary.term_pattern(find).finditer(text)]
            assert spans == wanted, (find, text)

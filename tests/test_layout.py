"""Lines and scales against a plain reading, with widths that are exact in binary."""

import random
import re

from pyspark.sql import functions as F

from lexmill import queries
from lexmill.operators import layout

WIDTHS = {"latin": {c: (ord(c) % 5 + 2) / 8 for c in "abcdefgh .,-1"}, "native": {c: 1.125 for c in "東京都é"}}
ROWS = [(f, c, w) for f, cs in WIDTHS.items() for c, w in cs.items()]
SCRIPTS = {"ja": re.compile("[\u3040-\u30ff\u4e00-\u9fff]"), "de": re.compile("[A-Za-zÄÖÜäöüß]"), "my": re.compile("[က-႟]"), "en": None}


def piece_width(t, lang, table=WIDTHS):
    script = SCRIPTS[lang]
    own = script and script.search(t) and not t.isascii()
    return sum(table["native" if own else "latin"].get(c, 1.0 if lang == "ja" else 0.5) for c in t)


def pieces_of(line, lang):
    """A word with its blanks, a run of blanks, or one other character."""
    out, i, word = [], 0, re.compile(r"[A-Za-z0-9\u00C0-\u024F\-./:@_%°±+#()]" if lang != "my" else r"\S")
    while i < len(line):
        j = i
        while j < len(line) and word.match(line[j]):
            j += 1
        if j > i or line[i].isspace():
            while j < len(line) and line[j].isspace():
                j += 1
        else:
            j = i + 1
        out.append(line[i:j])
        i = j
    return out


def plain_lines(text, size, width, lang, wrap, table=WIDTHS):
    lines = []
    for hard in text.split("\n"):
        lines.append(0.0)
        for t in pieces_of(hard, lang):
            w = piece_width(t, lang, table) * size
            if wrap and lines[-1] and lines[-1] + w > width:
                lines.append(0.0)
                w = piece_width(t.lstrip(), lang, table) * size
            lines[-1] += w
            if wrap and lines[-1] > width > 0:  # full lines of a broken word, whose widths don't count
                full, rest = divmod(lines.pop(), width)
                lines += [None] * int(full) + [rest]
    return len(lines), max((x for x in lines if x is not None), default=0.0)


def test_lines_equal_a_plain_reading():
    r = random.Random(1)
    for lang in SCRIPTS:
        m = layout.Measure(ROWS, lang, "latin", "native")
        for _ in range(400):
            text = "".join(r.choices([*"abcdefgh", "  ", " ", ",", "東", "京", "é", "\n", "-", "abcdefghabcdefgh"], k=r.randint(0, 40)))
            size, width, wrap = r.choice([8.0, 12.0]), r.choice([24.0, 60.0, 200.0]), r.random() < 0.9
            assert layout.filled(text, size, width, m, wrap) == plain_lines(text, size, width, lang, wrap), (lang, text, size, width)


def plain_fit(b, lang, least, table):
    def height(sizes):
        total = 0.0
        for i, (p, size) in enumerate(zip(b["paragraphs"], sizes)):
            n, widest = plain_lines(p["text"], size, max(b["width"] - p["margin"], 0.3 * b["width"]), lang, b["wrap"], table)
            space = lambda s, line: s["value"] * (line if s["lines"] else 1)
            total += n * space(p["line"], 1.2 * size)
            total += space(p["before"], 1.2 * size) if i > 0 else 0
            total += space(p["after"], 1.2 * size) if i + 1 < len(sizes) else 0
            if not b["wrap"] and widest > b["width"]:
                total = max(total, b["height"] * widest / b["width"])
        return total

    sizes = [p["size"] for p in b["paragraphs"]]
    needed, limit = height(sizes), max(b["height"], b["allowed"] or 0) + 2
    if b["grows"] or needed <= limit:
        return needed, 1.0, False, bool(b["grows"]) and needed > b["height"] + 2, not b["grows"] and needed > b["height"] + 2
    steps = [round(1 - 0.05 * k, 2) for k in range(1, 20) if round(1 - 0.05 * k, 2) >= least - 1e-9]
    scale = next((s for s in steps if height([x * s for x in sizes]) <= limit), steps[-1] if steps else 1.0)
    after = height([round(x * scale * 100) / 100 for x in sizes])
    return needed, scale, after > limit, False, b["height"] + 2 < after <= limit


def test_fit_equals_a_plain_search(spark):
    sf = "/root/testdata/sf0.001"
    boxes = queries.text_boxes(spark, sf)
    widths = queries.character_widths(spark, sf)
    table = {"latin": {}, "native": {}}
    for f, c, w in widths.collect():
        table[f][c] = w
    want = {(b.doc_id, b.container): plain_fit(b.asDict(True), "de", 0.8, table) for b in boxes.collect()}
    found = {(r.doc_id, r.container): (r.needed, r.scale, r.overflow, r.grows, r.inherited) for r in queries.text_fit(spark, sf).collect()}
    assert found.keys() == want.keys() and len(found) > 100
    for k, (needed, *rest) in want.items():
        assert abs(found[k][0] - needed) < 1e-5 and list(found[k][1:]) == rest, k
    assert len({v[1] for v in found.values()}) > 3 and {v[2] for v in found.values()} == {True, False}


def test_odd_boxes(spark):
    schema = f"paragraphs {layout.PARAGRAPHS}, width double, height double, wrap boolean, grows boolean, allowed double"
    none, line = {"lines": False, "value": 0.0}, {"lines": True, "value": 1.0}
    para = {"text": None, "size": 10.0, "margin": 0.0, "before": none, "after": none, "line": line}
    boxes = spark.createDataFrame([([], 100.0, 50.0, True, False, None), ([para], 100.0, 50.0, True, False, None), ([{**para, "text": "a" * 99}], 0.0, 5.0, True, False, None)], schema)
    widths = spark.createDataFrame(ROWS, "font string, character string, width double")
    found = layout.fitted(boxes, widths, "en").select("fit.*").collect()
    assert [(r.needed, r.scale, r.overflow) for r in found] == [(0.0, 1.0, False), (12.0, 1.0, False), (12.0, 0.8, True)]
    assert layout.fitted(boxes.limit(0), widths.limit(0), "ja").count() == 0
    long = spark.createDataFrame([("ab " * 100_000,)], "t string").select(layout.line_count(F.col("t"), F.lit(8), F.lit(100), widths, "en").alias("x")).first().x
    assert long.lines == plain_lines("ab " * 100_000, 8.0, 100.0, "en", True)[0]

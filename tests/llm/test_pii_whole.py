"""The sanitisation, and the query made of it, against plain sets."""

import hashlib
import math
import re
from collections import Counter

from test_pii import PATTERNS, SCHEMA, brute, rows

from lexmill.llm import pii, queries


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def terms_of(text):
    spans = brute(text)
    for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", text or ""):
        if len(m[0].encode()) >= pii.LEAST_TERM and not any(m.start() < y and x < m.end() for _, x, y in spans):
            yield low(m[0]), m.start(), m.end()


def entity(kind, value):
    """A value however it is written: letters in any case, digits with any marks between."""
    digits = re.findall("[0-9]+", value)
    return kind, low(value) if kind == "email" else tuple(digits) if kind == "ip" else "".join(digits)


def said(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def brute_whole(texts):
    n, n_of, both = len(texts), Counter(), Counter()
    has = Counter(w for t in texts for w in {low(x) for x in re.findall(r"[A-Za-z\x80-\U0010ffff]+", t or "")})
    for t in texts:
        own = {entity(k, t[a:b]) for k, a, b in brute(t)}
        n_of.update(own)
        both.update({(e, w) for e in own for w, *_ in terms_of(t)})
    kinds = {}
    for (e, w), k in both.items():
        odds = k / has[w] if k >= pii.TOGETHER else (k + n_of[e] / n) / (has[w] + 1)
        share = math.log2(odds * n / n_of[e]) / math.log2(n / n_of[e]) if n_of[e] < n else 0
        if share >= pii.GENERALISE:
            kinds[w] = min(kinds.get(w, "term"), "drop" if share >= pii.REMOVE else "term")
    order = [*PATTERNS, "term", "drop"]
    found = [brute(t) + [(kinds[w], a, b) for w, a, b in terms_of(t) if w in kinds] for t in texts]
    return [said(sorted(s, key=lambda s: (s[1], order.index(s[0])))) for s in found]


def data():
    filler = " ".join(["alpha bravo charlie delta"] * 40)
    out = rows() + [(k, f"{filler} foxtrot golf", "x", 0) for k in range(400, 900)]
    out += [(1000, f"Wolpertinger {filler} rare@one.example {filler} été Basilisk", "x", 0)]  # one document, far apart
    out += [(1001, "a wolpertinger without the address, Été", "x", 0)]
    return out + [(1002 + i, f"pair@two.example {filler} Manticore", "x", 0) for i in range(2)]


def test_whole_form_matches_plain_sets(spark, tmp_path):
    table = data()
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    want = sorted(zip((str(d) for d, *_ in table), brute_whole([t for _, t, *_ in table])))
    assert sorted((str(r.doc_id), r.spans) for r in pii.find(df).collect()) == want
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((str(r.doc_id), r.spans) for r in queries.op9_pii(spark, str(tmp_path)).collect()) == want
    digest = {str((r.doc_id, r.spans)): (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(df).collect()}
    for (d, t, *_), (_, spans) in zip(table, zip(table, brute_whole([t for _, t, *_ in table]))):
        base = brute(t)
        counts = Counter(k for k, *_ in base)
        assert digest[str((d, spans))] == (*(counts[k] for k in PATTERNS), hashlib.sha256(said(base).encode()).hexdigest())
    clean = {r.doc_id: r.text for r in pii.sanitise(df).where("doc_id >= 1000").collect()}
    assert not re.search("wolpertinger|basilisk|manticore|@", " ".join(clean.values()).lower())
    assert "alpha bravo" in clean[1000]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pii.find(df).count() == 0 and pii.sanitise(df).count() == 0

"""Personal data: patterns, and information-theoretic sanitisation of what gives the found entities away.

Base spans are e-mail, IP, card and phone patterns. Each distinct value found is a protected entity, and every term (a
run of letters, lower-cased, of LEAST_TERM bytes or more) of a document is a candidate for all entities of that document.
Counts over the whole corpus say in how many documents a term, an entity and both stand, each anywhere in its text. The
pointwise mutual information of the two, over the information of the entity itself, is the share of it that the term
discloses; pairs of fewer than TOGETHER documents get a smoothed share (one document more with the term, which has the
entity as often as any). Terms that disclose GENERALISE or more of an entity become spans wherever they stand, also in
documents without one: of kind term, to be replaced by a general word; from REMOVE on of kind drop, to be removed.

Terms are counted by 64-bit hash. Defined results: null text is empty; null doc_ids and repeated rows are documents of
their own; an empty table gives an empty result; extra columns, whatever their names, are kept by sanitise() and ignored
by find().
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom, in_bloom, join_groups, materialize, numbered, quoted, unboxed
from .kernels import Words, steps

KINDS = ["email", "ip", "card", "phone"]
TOGETHER, GENERALISE, REMOVE = 3, 0.8, 0.97
LEAST_TERM = 4  # bytes of a term

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[@0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
_NO_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def _emails(text: str):
    """Matches of the local part, @ and domain, found from each @ so that long words cost their length once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    if not _ANY.search(text):
        return []
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _DIGITS.sub("", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def said(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else _DIGITS.sub('.' if kind == 'ip' else '', value)}"


HELD = 1 << 20  # hashes that a task counts before it passes them on


def _summed(held: list) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*held))
    terms, at = np.unique(h, return_inverse=True)
    return terms, np.bincount(at, n, len(terms)).astype(np.int64)


def _document_counts(batches):
    """Per task, in how many of its documents each term's hash stands."""
    held, size = [], 0
    for b in batches:
        for texts in steps(b.column(0).to_pylist()):
            words = Words([t.lower() for t in texts], _NO_LETTER)
            h = words.hashes()
            if not len(h):
                continue
            order = np.lexsort((words.doc, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])])
            held.append(np.unique(h[order][new], return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0][0])
            if size > HELD // 2 and len(held) == 1:
                yield pa.RecordBatch.from_pydict({"h": held[0][0].view(np.int64), "n": held[0][1]})
                held, size = [], 0
    if held:
        terms, n = _summed(held)
        yield pa.RecordBatch.from_pydict({"h": terms.view(np.int64), "n": n})


def counted_terms(docs: DataFrame) -> DataFrame:
    """(h, n_term): in how many documents of the column text each term stands."""
    return docs.select("text").mapInArrow(_document_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n_term"))


def _terms(batches, *columns: int):
    """Some MB of texts (the last column) at a time: values of the columns, words, code-point starts and ends of the words
    in their text, base spans per text, and which words are terms outside of these."""
    for batch in batches:
        done = 0
        for texts in steps(batch.column(batch.num_columns - 1).to_pylist()):
            words = Words([t.lower() for t in texts], _NO_LETTER)
            at = np.concatenate([[0], np.cumsum((words.buf & 0xC0) != 0x80)])
            first = at[words.edges[words.doc]]
            a, b = at[words.start] - first, at[words.end] - first
            free = words.end - words.start >= LEAST_TERM
            edges = np.concatenate([[0], np.cumsum(words.n)])
            said_by = [t.decode("utf-8", "surrogatepass") for t in texts]
            spans = [base_spans(t) for t in said_by]
            for i, found in enumerate(spans):
                own = slice(edges[i], edges[i + 1])
                for _, x, y in found:
                    free[own][np.searchsorted(b[own], x, "right") : np.searchsorted(a[own], y, "left")] = False
            yield [batch.column(c)[done : done + len(texts)] for c in columns], words, a, b, said_by, spans, free, edges
            done += len(texts)


def _entity_terms(batches):
    """Of each document with entities, the hashes of these and of its terms."""
    for _, words, _, _, texts, spans, free, edges in _terms(batches):
        hashes, es, hs = words.hashes().view(np.int64), [], []
        for i, found in enumerate(spans):
            if found:
                own = slice(edges[i], edges[i + 1])
                values = {entity(k, texts[i][x:y]).encode("utf-8", "surrogatepass") for k, x, y in found}
                es.append(np.array([xxhash.xxh64_intdigest(v) for v in values], np.uint64).view(np.int64))
                hs.append(np.unique(hashes[own][free[own]]))
        if es:
            yield pa.RecordBatch.from_arrays([pa.array(es, pa.list_(pa.int64())), pa.array(hs, pa.list_(pa.int64()))], ["e", "h"])


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(h, n_term, kind): the terms of the column text that disclose an entity of any document they share with it."""
    texts = docs.select("text")
    both = materialize(texts.mapInArrow(_entity_terms, "e array<long>, h array<long>"), "pii-entities")
    pairs = both.select(F.explode("e").alias("e"), "h").select("e", F.explode("h").alias("h")).groupBy("e", "h").agg(F.count(F.lit(1)).alias("n_both"))
    entities = both.select(F.explode("e").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_entity"))
    n = max(docs.count(), 1)
    most = entities.agg(F.max("n_entity")).first()[0] or 0
    terms = counted_terms(docs)
    # A share of GENERALISE needs n_both / n_term >= (n_entity / n) ** (1 - GENERALISE), and n_both <= n_entity.
    terms = terms.where(F.col("n_term") <= 1 + most**GENERALISE * n ** (1 - GENERALISE))
    pairs = materialize(pairs, "pii-pairs")
    sizes = materialize(pairs.groupBy("h").agg(F.count(F.lit(1)).alias("size")).join(terms, "h"), "pii-terms")
    met = join_groups(pairs, sizes, "h", "size", "inner").drop("size")
    owners = materialize(entities.join(pairs.groupBy("e").agg(F.count(F.lit(1)).alias("size")), "e"), "pii-owners")
    met = join_groups(met, owners, "e", "size", "inner")
    prior = F.col("n_entity") / float(n)
    odds = F.when(F.col("n_both") >= TOGETHER, F.col("n_both") / F.col("n_term")).otherwise((F.col("n_both") + prior) / (F.col("n_term") + 1))
    met = met.withColumn("share", F.log2(odds / prior) / F.nullif(-F.log2(prior), F.lit(0.0))).where(F.col("share") >= GENERALISE)
    told = met.groupBy("h").agg(F.first("n_term").alias("n_term"), F.max("share").alias("share"))
    return materialize(told.select("h", "n_term", F.when(F.col("share") >= REMOVE, "drop").otherwise("term").alias("kind")), "pii-disclosing")


FOUND = {"doc_id": "long", **{f"n_{k}": "long" for k in KINDS}, "base_sha256": "string", "base": "string", **{c: "array<long>" for c in "hab"}}
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _scan(bits):
    """Base spans of each document, and hash, start and end of the terms that the Bloom filter has."""

    def scan(batches):
        for (rows, ids), words, a, b, _, spans, free, edges in _terms(batches, 0, 1):
            hashes = words.hashes()
            hit = np.flatnonzero(free & in_bloom(hashes, bits.value))
            offsets = pa.array(np.searchsorted(hit, edges), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[hit].astype(np.int64))) for x in (hashes.view(np.int64), a, b)]
            counts = [[sum(s[0] == k for s in found) for found in spans] for k in KINDS]
            lines = [said(found) for found in spans]
            base = [ids.to_pylist(), *counts, [hashlib.sha256(x.encode()).hexdigest() for x in lines], lines]
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(c, _ARROW[t]) for c, t in zip(base, FOUND.values())), *lists], ["row", *FOUND])

    return scan


def find(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", row: Column | None = None) -> DataFrame:
    """One row per document: row, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(row.alias("row"), quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    told = disclosing_terms(rows)
    bits = rows.sparkSession.sparkContext.broadcast(bloom(told, told.count()))
    ddl = ", ".join([f"row {rows.schema['row'].dataType.simpleString()}", *(f"{k} {v}" for k, v in FOUND.items())])
    base = materialize(rows.mapInArrow(_scan(bits), ddl), "pii-base")
    hits = base.where(F.size("h") > 0).select("row", F.explode(F.arrays_zip("h", "a", "b")).alias("x")).select("row", "x.h", "x.a", "x.b")
    return _with_spans(base.drop("h", "a", "b"), join_groups(hits, told, "h", "n_term", "inner").select("row", "a", "b", "kind"))


def _with_spans(base: DataFrame, hits: DataFrame) -> DataFrame:
    """Base rows with the spans of hits (row, a, b, kind) among their own."""
    added = hits.groupBy("row", "a", "b").agg(F.min("kind").alias("kind")).groupBy("row").agg(F.collect_list(F.struct("a", "b", "kind")).alias("added"))
    parts = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("a"), F.split(s, ":")[2].cast("long").alias("b"), F.split(s, ":")[0].alias("kind")))
    order = lambda s: F.struct(s["a"].alias("a"), F.array_position(F.array(*[F.lit(k) for k in [*KINDS, "term", "drop"]]), s["kind"]).alias("o"), s["b"].alias("b"), s["kind"].alias("kind"))
    spans = F.array_sort(F.transform(F.concat(parts, "added"), order))
    line = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")
    out = base.join(added, "row", "left").withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(line))
    return out.select("row", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")


def _replaced(text: str, spans: str, words: dict[str, str]) -> str:
    out, done = [], 0
    for kind, a, b in (s.split(":") for s in spans.split(",")):
        a, b = int(a), int(b)
        if a >= done:
            out += [text[done:a], words[kind]]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", general: str = "[term]", stored: bool = False) -> DataFrame:
    """docs with the found spans of text replaced by their kind, disclosing terms generalised or removed. stored: see
    common.numbered()."""
    rows = numbered(docs, stored)
    asked = rows.select("row", F.col("doc")[doc_id].alias("doc_id"), F.col("doc")[text].alias("text"))
    found = find(asked, row=F.col("row")).where("spans <> ''").select("row", "spans")
    words = {k: f"[{k}]" for k in KINDS} | {"term": general, "drop": ""}

    @F.pandas_udf("string")
    def replaced(texts, spans):
        import pandas as pd

        return pd.Series([_replaced(t, s, words) for t, s in zip(texts, spans)], dtype="object")

    joined = rows.join(found, "row", "left")
    cut = joined.where("spans is not null").withColumn("text", replaced(F.col("doc")[text].cast("string"), F.col("spans")))
    clean = cut.select(*[(F.col("text").cast(docs.schema[c].dataType) if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
    return unboxed(joined.where("spans is null"), docs).unionByName(clean)

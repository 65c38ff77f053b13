"""Glossaries: matching terms in text, checks of use, and the stored table's statements."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from itertools import accumulate
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.languages import SCRIPT
from ..functions.text import uses
from ..sources.scratch import materialize
from .ranks import numbered

#: origin: glossary, or of a document's own terms document (not asked for in checks), enforced or consensus.
HINT = "array<struct<source:string,target:string,keep:boolean,origin:string>>"
PRIORITY = {"high": 0, "normal": 1, "low": 2}
KEY = ["glossary_id", "source_term", "source_lang", "target_lang", "context"]
KEYWORDS = 64  # that are looked for in Spark; of more, the texts around go to the tasks' Python
FEW = 64  # terms that are looked for in Spark first, so that only texts with one go to the tasks' Python
SHARD_BYTES = 4 << 20  # of terms in one automaton at most; it takes some 50 bytes for each
#: One letter for each, as in patterns that ignore case: A to Z, and the four others that stand for an ASCII letter there.
FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def folded(text: str) -> str:
    """text with one letter for each of these; bytes have the case of ASCII letters only."""
    if text.isascii():
        return text.lower()
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for c, letter in FOLDED.items():
        text = text.replace(c, letter)
    return text


def named(term: str) -> bool:
    """Whether an ASCII term looks like a name, which is matched in its own case only."""
    return term.isupper() or any(c.isdigit() for c in term)


@lru_cache(10_000)
def term_pattern(term: str) -> re.Pattern:
    """ASCII terms stand between non-alphanumerics, in the plural too, and in any case unless they look like a name."""
    if not term.isascii():
        return re.compile(re.escape(term))
    return re.compile(rf"(?<![A-Za-z0-9]){re.escape(term)}(?:s|es)?(?![A-Za-z0-9])", 0 if named(term) else re.I)


def directed(terms: DataFrame, src: str, tgt: str) -> DataFrame:
    """The terms that hold for a language pair, in matching order: find, source, target, keep, keywords, rank."""
    forward = (F.col("source_lang") == src) & (F.col("target_lang") == tgt)
    backward = (F.col("source_lang") == tgt) & (F.col("target_lang") == src)
    keep = F.col("do_not_translate")
    find = F.when(keep | forward, F.col("source_term")).when(backward, F.col("target_term"))
    instead = F.when(keep, F.col("source_term")).when(forward, F.col("target_term")).otherwise(F.col("source_term"))
    words = F.filter(F.transform(F.split("context", ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    held = terms.where(keep | forward | backward).select(find.alias("find"), instead.alias("instead"), keep.alias("keep"), words.alias("keywords"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("priority")), F.lit(1)).alias("priority"), (F.col("term_seq") if "term_seq" in terms.columns else F.lit(0)).cast("long").alias("term_seq"))
    return held.where("find <> ''")


def _order(t: dict) -> tuple:
    return -len(t["find"]), len(t["keywords"]) == 0, t["priority"], t["term_seq"], t["find"], t["instead"]


#: What words are made of: no term that is bounded stands beside one of them.
IN_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _end(seen: str, end: int) -> int:
    """Where a bounded term whose letters end there ends, in the plural too; -1 if a word goes on."""
    if end == len(seen) or seen[end] not in IN_WORD:
        return end
    to = end + 1 if seen[end] == "s" else end + 2 if seen.startswith("es", end) else 0
    return to if to and (to == len(seen) or seen[to] not in IN_WORD) else -1


class Matcher:
    """The terms of a glossary in one Aho-Corasick automaton, which finds all of them in one pass over a text.

    It reads texts in any case of ASCII letters; what a term's pattern says besides (its exact case, the characters
    around it, its plural) is asked at the places found.
    """

    def __init__(self, terms: list[dict]):
        self.terms: dict[str, list[dict]] = {}
        for t in terms:
            self.terms.setdefault(t["find"], []).append(t)
        alike: dict[str, list[tuple[str, bool, bool]]] = {}
        for find in self.terms:
            alike.setdefault(folded(find), []).append((find, find.isascii(), not find.isascii() or named(find)))
        self.automaton = ahocorasick.Automaton()
        for letters, finds in alike.items():
            bounded = finds[0][0] if len(finds) == 1 and finds[0][1:] == (True, False) else None
            self.automaton.add_word(letters, (len(letters), bounded, finds))
        if alike:
            self.automaton.make_automaton()
        #: The terms in matching order, the places of a term's entries there, and for each what it is told as.
        self.ordered = sorted(terms, key=_order)
        self.ranks: dict[str, list[int]] = {}
        for rank, t in enumerate(self.ordered):
            self.ranks.setdefault(t["find"], []).append(rank)
        each: dict[tuple, int] = {}
        self.told = [each.setdefault((t["find"], t["instead"], t["keep"]), len(each)) for t in self.ordered]
        columns = [pa.array([k[i] for k in each], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
        self.hints = pa.StructArray.from_arrays([*columns, pa.array(["glossary"] * len(each), pa.string())], ["source", "target", "keep", "origin"])

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Where each term stands, from left to right and without overlaps of its own."""
        found: dict[str, list[tuple[int, int]]] = {}
        lower, n, get = folded(text), len(text), found.get

        def add(find: str, start: int, to: int) -> None:
            # Hits of a term come in the order of their ends, which is that of their starts.
            before = get(find)
            if before is None:
                found[find] = [(start, to)]
            elif start >= before[-1][1]:
                before.append((start, to))

        for last, (size, usual, finds) in self.automaton.iter(lower) if self.terms else ():
            start, end = last + 1 - size, last + 1
            if usual is not None:  # one term, bounded and in any case
                if start and lower[start - 1] in IN_WORD:
                    continue
                if end < n and lower[end] in IN_WORD and (end := _end(lower, end)) < 0:
                    continue
                add(usual, start, end)
                continue
            for find, bounded, exact in finds:
                to = end
                if exact and text[start:end] != find:
                    continue
                if bounded:
                    seen = text if exact else lower
                    if start and seen[start - 1] in IN_WORD or (to := _end(seen, end)) < 0:
                        continue
                add(find, start, to)
        return found

    def chosen(self, text: str, around: str | list[str]) -> list[int]:
        """As chosen() on candidates(), by places in hints."""
        found = self.spans(text)
        taken, out = bytearray(len(text)), {}
        for rank in sorted([r for find in found for r in self.ranks[find]]):
            t = self.ordered[rank]
            if t["keywords"] and not any(k in around for k in t["keywords"]):
                continue
            for a, b in found[t["find"]]:
                if taken.find(1, a, b) < 0:
                    taken[a:b] = b"\x01" * (b - a)
                    out[self.told[rank]] = None
        return list(out)

    def candidates(self, text: str) -> list[dict]:
        return [{**t, "spans": [{"a": a, "b": b} for a, b in at]} for find, at in self.spans(text).items() for t in self.terms[find]]


def chosen(candidates: list[dict], size: int, around: str | list[str]) -> list[dict]:
    """Of the terms found in a text of so many characters, longest first, those that overlap none before; terms with
    keywords need one of them around: in that text, or among these keywords."""
    taken, hints = bytearray(size), {}
    for t in sorted(candidates, key=_order):
        if len(t["keywords"]) and not any(k in around for k in t["keywords"]):
            continue
        for span in t["spans"]:
            a, b = span["a"], span["b"]
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\x01" * (b - a)
                hints[t["find"], t["instead"], t["keep"]] = None
    return [{"source": a, "target": b, "keep": c, "origin": "glossary"} for a, b, c in hints]


_built: dict[str, Matcher] = {}


def _matcher(name: str, sent: Broadcast) -> Matcher:
    """The automaton of a broadcast glossary, built once in each Python worker, which holds one at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(sent.value)
    return _built[name]


def _literal(find: str) -> str:
    return re.sub(r"([^A-Za-z0-9\x80-\U0010ffff])", r"\\\1", find)


def _may_have(text: str, around: Column | None, held: DataFrame) -> Column:
    """Whether a text may have a term that can be chosen: one of few terms, in any case, and of those with keywords only
    where around, the array of keywords there, has one."""
    found = [(_literal(t.find), t.keywords) for t in held.select("find", "keywords").distinct().limit(FEW + 1).collect()]
    if len(found) > FEW:
        return F.lit(True)
    has = lambda finds: F.col(text).rlike("(?iu)" + "|".join(finds)) if finds else F.lit(False)
    if around is None:
        return has([f for f, _ in found])
    out = has([f for f, words in found if not words])
    for f, words in found:
        if words:
            out = out | (F.arrays_overlap(around, F.array(*map(F.lit, words))) & has([f]))
    return out


def with_hints(rows: DataFrame, terms: DataFrame, src: str, tgt: str, text: str = "plain", around: str | None = None, shard_bytes: int = SHARD_BYTES, page: list[str] | None = None) -> DataFrame:
    """rows with hints, the terms of their text. Keywords may stand in the column around or, where page is given, in any
    text of the rows that share these columns.

    Glossaries of up to shard_bytes go to all tasks as one automaton. Larger ones are dealt by hash into shards of that
    size: each shard's automaton passes over the texts once and leaves the places of its terms, and a row's places of all
    shards are put together by row, so no task ever holds more than one shard.
    """
    held = directed(terms, src, tgt)
    words = sorted(r.k for r in held.select(F.explode("keywords").alias("k")).distinct().limit(KEYWORDS + 1).collect())
    few, drop = len(words) <= KEYWORDS, []
    if page and few and not any("\n" in k for k in words):  # no keyword goes over two texts
        seen = {f"__seen{i}": F.max(F.lower(text).contains(k)).over(W.partitionBy(*page)) for i, k in enumerate(words)}
        rows, drop = rows.withColumns(seen) if seen else rows, [*seen]
        told = [F.col(c) for c in seen]
    else:
        if page:
            texts = rows.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text))), lambda s: s[text]), "\n").alias("__around"))
            rows, around, drop = rows.join(texts, page), "__around", ["__around"]
        both = F.lower(F.concat_ws("\n", text, *([around] if around else [])))
        told = [both.contains(k) for k in words]
    if few:  # most texts around have none, and they are far longer than the texts
        both = F.array_compact(F.array(*(F.when(has, k) for has, k in zip(told, words))).cast("array<string>"))
    shards = -(-(held.agg(F.sum(F.octet_length("find"))).first()[0] or 1) // shard_bytes)
    send = lambda df: (uuid4().hex, rows.sparkSession.sparkContext.broadcast([r.asDict() for r in df.collect()]))
    hint = pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("keep", pa.bool_()), ("origin", pa.string())]))
    if shards == 1:
        name, sent = send(held)

        @F.arrow_udf(HINT)
        def match(texts: pa.Array, arounds: pa.Array) -> pa.Array:
            m = _matcher(name, sent)
            each = [m.chosen(t, a or "") if t else [] for t, a in zip(texts.to_pylist(), arounds.to_pylist())]
            ends = pa.array([*accumulate(map(len, each), initial=0)], pa.int32())
            return pa.ListArray.from_arrays(ends, m.hints.take(pa.array([i for found in each for i in found], pa.int32())))

        return rows.withColumn("hints", match(F.when(_may_have(text, both if few else None, held), F.col(text)), both)).drop(*drop)

    keyed = materialize(rows.withColumns({"__row": F.monotonically_increasing_id(), "__both": both}).drop(*drop), "hints-rows")
    held = materialize(held.withColumn("__shard", F.pmod(F.xxhash64("find"), F.lit(shards))), "hints-terms")
    found = [_found(keyed.select("__row", F.col(text).alias("t")), *send(held.where(F.col("__shard") == i).drop("__shard"))) for i in range(shards)]
    # A text has a place for each of its characters and term lengths at most, however many shards there are.
    each = materialize(reduce(DataFrame.unionByName, found), "hints-found").groupBy("__row").agg(F.flatten(F.collect_list("found")).alias("__found"))

    @F.arrow_udf(HINT)
    def choose(texts: pa.Array, arounds: pa.Array, candidates: pa.Array) -> pa.Array:
        each = zip(texts.to_pylist(), arounds.to_pylist(), candidates.to_pylist())
        return pa.array([chosen(c, len(t), a or "") if c else [] for t, a, c in each], hint)

    return keyed.join(each, "__row", "left").withColumn("hints", choose(F.col(text), F.col("__both"), F.col("__found"))).drop("__row", "__both", "__found")


def _found(texts: DataFrame, name: str, sent: Broadcast) -> DataFrame:
    """(__row, found): the places of one shard's terms."""
    kind = pa.list_(pa.struct([("find", pa.string()), ("instead", pa.string()), ("keep", pa.bool_()), ("keywords", pa.list_(pa.string())), ("priority", pa.int32()), ("term_seq", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))

    def run(batches):
        m = _matcher(name, sent)
        for b in batches:
            held = [(row, c) for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (c := m.candidates(t or ""))]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in held], pa.int64()), pa.array([c for _, c in held], kind)], ["__row", "found"])

    return texts.mapInArrow(run, "__row long, found array<struct<find:string,instead:string,keep:boolean,keywords:array<string>,priority:int,term_seq:long,spans:array<struct<a:int,b:int>>>>")


def hint_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """A row (columns, h) for each hint of with_hints(). Empty hints go after they are made rows: before, as explode()
    has it, all texts would be matched twice, for that condition and for the rows."""
    return rows.select(*columns, F.explode_outer("hints").alias("h")).where("h is not null")


def kept_terms(hints: str = "hints") -> Column:
    return F.transform(F.filter(hints, lambda h: h["keep"]), lambda h: h["source"])


def required(hints: str = "hints") -> Column:
    """The hints that a translation is held to."""
    return F.filter(hints, lambda h: ~h["keep"] & (h["origin"] != "document"))


def injected(text: str = "plain", hints: str = "hints") -> Column:
    """text with its terms replaced by their approved translations, longest first."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, hs in zip(texts.to_pylist(), found.to_pylist()):
            for h in sorted((h for h in hs or () if not h["keep"]), key=lambda h: -len(h["source"])):
                t = t and term_pattern(h["source"]).sub(lambda _, to=h["target"]: to, t)
            out.append(t)
        return pa.array(out, pa.string())

    return replaced(F.col(text), F.col(hints))


def cut_out(text: Column, sources: Column, bar: str = " | ") -> Column:
    """text with bar for every place of these terms, one term after the other."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for t, finds in zip(texts.to_pylist(), terms.to_pylist()):
            for find in finds or ():
                t = t and term_pattern(find).sub(bar, t)
            out.append(t)
        return pa.array(out, pa.string())

    return cut(text, sources)


def adherence(pairs: DataFrame, tgt: str) -> DataFrame:
    """Per term: how many pairs use its approved translation, how many don't, where."""
    each = pairs.where("target is not null").withColumn("hint", F.explode("hints")).where("not hint.keep")
    each = each.withColumn("used", uses(F.col("target"), F.col("hint.target"), tgt))
    missed = lambda c: F.when(~F.col("used"), F.col(c))
    return each.groupBy("doc_id", F.lower("hint.source").alias("term"), F.col("hint.target").alias("approved")).agg(
        F.count_if("used").alias("n_used"), F.count_if(~F.col("used")).alias("n_missing"), F.array_sort(F.collect_set(missed("seg_id"))).alias("segments"), F.array_sort(F.collect_set(missed("container"))).alias("pages")
    )


def inconsistent(found: DataFrame) -> DataFrame:
    """Terms of adherence() that are used in some places and not in others."""
    return found.groupBy("term").agg(F.sum("n_used").alias("n_used"), F.sum("n_missing").alias("n_missing")).where("n_used > 0 and n_missing > 0")


def covers(phrase: Column, term: Column) -> Column:
    """Whether a term is just the phrase, in the plural too; for ASCII terms."""
    named = term.rlike("[0-9]") | (F.upper(term) == term)
    same = lambda a, b: (a == b) | (a == F.concat(b, F.lit("s"))) | (a == F.concat(b, F.lit("es")))
    return F.when(named, same(phrase, term)).otherwise(same(F.lower(phrase), F.lower(term)))


def invalid(terms: DataFrame) -> DataFrame:
    """term_seq and error of the rows that an import must refuse."""
    known = list(SCRIPT)
    row = F.concat(F.lit("Row "), (F.col("term_seq") + 2).cast("string"), F.lit(": "))
    error = (
        F.when(~F.col("source_lang").isin(known), F.concat(row, F.lit("unsupported language "), "source_lang"))
        .when(~F.col("target_lang").isin(known), F.concat(row, F.lit("unsupported language "), "target_lang"))
        .when(~F.col("do_not_translate") & (F.col("target_term") == ""), F.concat(row, F.lit("target_term is empty (or mark the row do_not_translate)")))
        .when(~F.col("priority").isin("low", "normal", "high"), F.concat(row, F.lit("priority must be low, normal or high")))
    )
    return terms.select("term_seq", error.alias("error")).where("error is not null")


def upserted(stored: DataFrame, new: DataFrame, key: list[str] = KEY, order: str = "seq") -> DataFrame:
    """stored with the rows of new put in by key: ids stay, the last new row of a key wins, unknown ones get the next ids.

    stored has id; new has the other columns and order, which says which of its rows is later.
    """
    values = [c for c in stored.columns if c not in ("id", *key)]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("v"), F.min(order).alias("__first"))
    joined = stored.select(*key, "id", F.struct(*values).alias("old")).join(last, key, "full")
    kept = joined.where("id is not null").select("id", *key, F.coalesce("v", "old").alias("v"))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(joined.where("id is null").select(*key, "v", "__first"), ["__first"], "id", top + 1)
    fresh = fresh.select(F.col("id").cast(stored.schema["id"].dataType).alias("id"), *key, "v")
    return kept.unionByName(fresh).select("id", *key, "v.*").select(*stored.columns)


def searched(stored: DataFrame, text: str) -> DataFrame:
    """Terms with the text in source, target or category, any case of ASCII letters; in listing order."""
    has = lambda c: F.lower(c).contains(text.lower())
    found = stored.where(has("source_term") | has("target_term") | has("category")) if text else stored
    return found.orderBy("source_lang", F.lower("source_term"), "context", "id")


def updated(stored: DataFrame, term_id: int, **changes) -> DataFrame:
    """stored with some columns of one row changed."""
    if bad := sorted(set(changes) - (set(stored.columns) - {"id", "glossary_id"})):
        raise ValueError(f"Unknown field(s): {', '.join(bad)}")
    return stored.withColumns({c: F.when(F.col("id") == term_id, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def deleted(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids, "id", "left_anti")


def without_glossary(glossaries: DataFrame, terms: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a glossary and its terms."""
    gone = glossaries.where(F.col("name") == name).select(F.col("id").alias("glossary_id"))
    return glossaries.where(F.col("name") != name), terms.join(F.broadcast(gone), "glossary_id", "left_anti")

"""Recurring terms of a document: mining, maximal phrases, candidates, majority vote, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..functions.text import clean_candidate, term_key, uses
from ..functions.tokens import escaped, protected_tokens
from ..sources.scratch import materialize
from .glossary import cut_out

# Fixed values.
STOP = """a an the and or of to in on for with by from at as is are be was were this that these those it its
into over under via per than then also not no all any each every more most less such can may will must should
our your their his her we you they i up out about between during after before when where which who what how""".split()
CUTS = r"[,.;:!?()\[\]{}\"“”'’/|•→–—]|(?U:\s)-(?U:\s)|\n"
WORD = r"^[A-Za-z][A-Za-z\-]*$"
RUN = r"[ァ-ヴーｦ-ﾟ一-龯々]+"
PIECE = r"[ァ-ヴーｦ-ﾟ]+|[一-龯々]+"
KATAKANA = r"^[ァ-ヴーｦ-ﾟ]+$"
MOST = 40
OTHER = "(other wording)"


def mined_english(segments: DataFrame, text: str = "source") -> DataFrame:
    """occurrences() of the phrases of two to five words, lower-cased, none across punctuation, that start and end with
    a word that isn't a stop word and have one of four letters.

    All neighbouring words of such a phrase recur in its document too. Where they do is told in the document's row, so
    only phrases of these words are made rows, and what a task holds is a document at a time.
    """
    segments = segments.select("doc_id", "seg_id", F.col(text).alias("text")).where("text is not null")
    docs = segments.repartition("doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("seg_id", "text")).alias("segs"))
    words = F.transform("segs", lambda s: F.struct(s["seg_id"].alias("seg_id"), _words(s["text"]).alias("ws")))
    rows = docs.select("doc_id", F.inline(let(words, _recurring_starts)))
    stop = lambda c: F.col(c).isin(STOP)
    rows = rows.where(~stop("w"))
    whole, long_, phrase, found = F.lit(True), F.length("w") >= 4, F.col("w"), []
    for k in range(1, 5):
        c = f"w{k}"
        whole, long_, phrase = whole & F.col(c).isNotNull(), long_ | (F.length(c) >= 4), F.concat(phrase, F.lit(" "), F.col(c))
        found.append(F.when(whole & ~stop(c) & long_, phrase))
    each = rows.select("doc_id", "seg_id", F.explode(F.array_compact(F.array(*found))).alias("phrase")).distinct()
    return _recurring(each)


def _words(text: Column) -> Column:
    """The words of a text, lower-cased, and null for all else between them and at the end."""
    raw = F.filter(F.split(F.regexp_replace(text, CUTS, " | "), r"(?U)\s+"), lambda w: w != "")
    return F.concat(F.transform(raw, lambda w: F.when(w.rlike(WORD), F.lower(w))), F.array(F.lit(None).cast("string")))


def _recurring_starts(segs: Column) -> Column:
    """Of segments (seg_id, ws) the words that with the next one stand in two places at least: array of seg_id, w and
    w1 to w4, those after it as far as that holds for all of them."""
    segment = F.flatten(F.transform(segs, lambda s, i: F.array_repeat(i, F.size(s["ws"]))))

    def starts(ws, segment, at):
        after = lambda k: F.slice(at, k + 1, F.size(at))
        runs = F.arrays_zip(at.alias("p"), after(1).alias("p1"), after(2).alias("p2"), after(3).alias("p3"))

        def start(r):
            p, further, out = r["p"], F.lit(True), [F.get(ws, r["p"]).alias("w"), F.get(ws, r["p"] + 1).alias("w1")]
            for k in (1, 2, 3):
                further = further & F.coalesce(r[f"p{k}"] == p + k, F.lit(False))
                out.append(F.when(further, F.get(ws, p + k + 1)).alias(f"w{k + 1}"))
            return F.struct(F.get(segs, F.get(segment, p))["seg_id"].alias("seg_id"), *out)

        return F.transform(runs, start)

    return let(F.flatten(F.transform(segs, lambda s: s["ws"])), lambda ws: let(segment, lambda g: let(_recurring_pairs(ws), lambda at: starts(ws, g, at))))


def _recurring_pairs(ws: Column) -> Column:
    """The places, from 0 and ascending, where a word and the next have a hash that two places at least have.

    Hash and place share a number, whose lower bits are the place, so sorting numbers brings equal hashes together. Of
    no pair it is -1: its place would be past the last.
    """
    step = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(ws) + 1))).cast("long")

    def numbers(step):
        two = F.arrays_zip(ws.alias("a"), F.slice(ws, 2, F.size(ws)).alias("b"))
        pair = lambda t, i: F.xxhash64(t["a"], t["b"]).bitwiseAND(-step) + i
        return F.sort_array(F.transform(two, lambda t, i: F.when(t["a"].isNotNull() & t["b"].isNotNull(), pair(t, i)).otherwise(F.lit(-1).cast("long"))))

    def places(found, step):
        same = lambda x, y: (x != -1) & (x.bitwiseAND(-step) == y.bitwiseAND(-step))
        place = lambda x: x.bitwiseAND(step - 1).cast("int")
        both = F.zip_with(found, F.slice(found, 2, F.size(found)), lambda x, y: F.when(same(x, y), F.array(place(x), place(y))).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(both)))

    return let(step, lambda step: let(numbers(step), lambda found: places(found, step)))


def japanese_phrases(text: Column) -> Column:
    """Distinct phrases of one to four pieces of katakana or kanji runs."""

    def of_pieces(ps):
        some = lambda n: F.when(F.size(ps) >= n, F.transform(F.sequence(F.lit(1), F.size(ps) - (n - 1)), lambda i: F.array_join(F.slice(ps, i, n), ""))).otherwise(F.array().cast("array<string>"))
        return F.concat(*[some(n) for n in range(1, 5)])

    def of_run(run):
        return let(F.regexp_extract_all(run, F.lit(PIECE), F.lit(0)), of_pieces)

    every = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), of_run))
    return F.array_distinct(F.filter(every, lambda p: F.length(p).between(3, 15) & ~(p.rlike(KATAKANA) & (F.length(p) < 5))))


def masked(text: Column, hints: Column | None = None) -> Column:
    """Known terms (hints of the text, as of glossary.with_hints) and identifiers cut out, so that they aren't mined again."""
    bar = F.lit(" | ")
    out = text if hints is None else cut_out(text, F.transform(hints, lambda h: h["source"]))
    return let(out, lambda t: F.aggregate(protected_tokens(t), t, lambda at, token: F.replace(at, token, bar)))


def mined(segments: DataFrame, src: str, text: str = "plain") -> DataFrame:
    """occurrences() in segments (doc_id, seg_id, hints, text): recurring phrases that no glossary has."""
    rows = segments.select("doc_id", "seg_id", masked(F.col(text), F.col("hints")).alias("masked"))
    return occurrences(rows, japanese_phrases(F.col("masked"))) if src in ("ja", "zh") else mined_english(rows, "masked")


def occurrences(segments: DataFrame, phrases: Column) -> DataFrame:
    """(doc_id, phrase, seg_id): which segments have which phrases, for phrases in two segments of a document or more.

    These are few beside all phrases and are written, so that what is made of them doesn't mine again.
    """
    return _recurring(segments.select("doc_id", "seg_id", F.explode(phrases).alias("phrase")))


def _recurring(rows: DataFrame) -> DataFrame:
    """Of distinct rows those of phrases in two segments of a document, with n, how many."""
    n = F.count(F.lit(1)).over(W.partitionBy("doc_id", "phrase"))
    return materialize(rows.withColumn("n", n).where("n >= 2"), "phrases")


def _seams(phrase: Column) -> Column:
    """Three characters around each blank; all threes of a phrase without blanks. A longer phrase has those of a shorter."""
    threes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(phrase) - 2, F.lit(1))), lambda i: F.substr(phrase, i, F.lit(3)))
    return F.array_distinct(F.when(phrase.contains(" "), F.regexp_extract_all(phrase, F.lit("(?=(. .))"), F.lit(1))).otherwise(threes))


def maximal(found: DataFrame) -> DataFrame:
    """Phrases of occurrences() without those that stand only where a longer one that has them does.

    A phrase is held against the longer phrases of its own segments: as many of those hold it as it has segments, or
    it stays. So no two phrases meet that share no segment, nor two that don't share the shorter one's first seam.
    """
    a = found.select("doc_id", "seg_id", F.col("phrase").alias("short"), F.col("n"), F.get(_seams(F.col("phrase")), F.lit(0)).alias("seam"))
    b = found.select("doc_id", "seg_id", F.col("phrase").alias("long"), F.explode(_seams(F.col("phrase"))).alias("seam"))
    inside = a.join(b, ["doc_id", "seg_id", "seam"]).where((F.length("long") > F.length("short")) & F.contains("long", "short"))
    lost = inside.groupBy("doc_id", "short", "long", "n").agg(F.count(F.lit(1)).alias("m")).where("m = n")
    lost = lost.select("doc_id", F.col("short").alias("phrase")).distinct()
    return found.join(lost, ["doc_id", "phrase"], "left_anti")


def top_terms(found: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, phrase, occurrences, place: the most frequent of each document, longer ones first."""
    counted = found.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("occurrences"))
    order = W.partitionBy("doc_id").orderBy(F.desc("occurrences"), F.desc(F.length("phrase")), "phrase")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def examples(found: DataFrame, segments: DataFrame, text: str = "source", n: int = 3) -> DataFrame:
    """The longest distinct texts of each phrase."""
    rows = found.join(segments.select("seg_id", F.col(text).alias("t")), "seg_id").select("doc_id", "phrase", "t").distinct()
    order = W.partitionBy("doc_id", "phrase").orderBy(F.desc(F.length("t")), "t")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def voted(candidates: DataFrame, translations: DataFrame, tgt: str) -> DataFrame:
    """(doc_id, phrase, winner, support, n): the candidate that most translations of a term's segments use, if two or
    more and over half do; else winner is null. candidates: doc_id, phrase, candidate, perhaps seq (of equals the first
    wins); translations: doc_id, phrase, seg_id, target."""
    held = candidates if "seq" in candidates.columns else candidates.withColumn("seq", F.lit(0))
    n = translations.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"))
    met = held.join(translations, ["doc_id", "phrase"]).where(uses(F.col("target"), F.col("candidate"), tgt))
    support = met.groupBy("doc_id", "phrase", "candidate").agg(F.count(F.lit(1)).alias("support"), F.min("seq").alias("seq"))
    best = support.groupBy("doc_id", "phrase").agg(F.max_by(F.struct("candidate", "support"), F.struct("support", F.length("candidate"), -F.col("seq"), "candidate")).alias("b"))
    told = n.join(best, ["doc_id", "phrase"], "left").withColumn("support", F.coalesce("b.support", F.lit(0)))
    clear = (F.col("n") >= 2) & (F.col("support") >= 2) & (2 * F.col("support") > F.col("n"))
    return told.select("doc_id", "phrase", F.when(clear, F.col("b.candidate")).alias("winner"), "support", "n")


def wordings(candidates: DataFrame, translations: DataFrame, majority: DataFrame, tgt: str) -> DataFrame:
    """(doc_id, phrase, seg_id, wording), and container where translations have it: the majority where a translation uses it,
    else its longest candidate."""
    rows = translations.join(majority.select("doc_id", "phrase", "winner"), ["doc_id", "phrase"], "left")
    met = rows.join(candidates, ["doc_id", "phrase"]).where(uses(F.col("target"), F.col("candidate"), tgt))
    longest = met.groupBy("doc_id", "phrase", "seg_id").agg(F.max_by("candidate", F.struct(F.length("candidate"), "candidate")).alias("longest"))
    used = F.col("winner").isNotNull() & uses(F.col("target"), F.col("winner"), tgt)
    told = rows.join(longest, ["doc_id", "phrase", "seg_id"], "left")
    return told.select("doc_id", "phrase", "seg_id", *(c for c in ("container",) if c in translations.columns), "winner", F.when(used, F.col("winner")).otherwise(F.coalesce("longest", F.lit(OTHER))).alias("wording"))


def distinct_candidates(rows: DataFrame, tgt: str) -> DataFrame:
    """The first of the candidates (doc_id, phrase, seq, candidate) that read alike."""
    keyed = rows.where("candidate <> ''").withColumn("key", term_key(F.col("candidate"), tgt))
    first = keyed.groupBy("doc_id", "phrase", "key").agg(F.min_by("candidate", "seq").alias("candidate"), F.min("seq").alias("seq"))
    return first.drop("key")


def review_rows(terms: DataFrame) -> DataFrame:
    """Terms (doc_id, phrase, target, candidates, occurrences) as glossary rows: unresolved ones with their first candidate
    and advice; those without candidates are left out."""
    n = F.col("occurrences").cast("string")
    settled = F.concat(n, F.lit(" paragraphs; review before importing"))
    open_ = F.concat(F.lit("UNRESOLVED ("), n, F.lit(" paragraphs, translated inconsistently); candidates: "), F.array_join("candidates", " / "), F.lit(" — correct the target before importing"))
    has = F.coalesce(F.col("target"), F.lit("")) != ""
    rows = terms.where(has | (F.size("candidates") > 0))
    return rows.select("doc_id", F.col("phrase").alias("source_term"), F.when(has, F.col("target")).otherwise(F.get("candidates", F.lit(0))).alias("target_term"), F.lit("document").alias("category"), F.when(has, settled).otherwise(open_).alias("notes"))


def sheet(found: DataFrame, segments: DataFrame, engine, tgt: str, contexts: int = 1, most: int = MOST) -> DataFrame:
    """A document's terms with candidate translations: doc_id, phrase, occurrences, place, candidates, target (the first).

    found is of occurrences(). engine is a function from a DataFrame (seg_id, text, context) to (seg_id, output); each
    term goes to it once in each of up to contexts of its texts.
    """
    held = materialize(top_terms(maximal(found), most), "terms-held")
    shown = examples(found.join(held.select("doc_id", "phrase"), ["doc_id", "phrase"], "left_semi"), segments, n=contexts)
    asked = materialize(shown.select("doc_id", "phrase", F.col("place").alias("seq"), F.col("t").alias("context"), F.concat_ws("\x1f", F.col("doc_id").cast("string"), "phrase", F.col("place").cast("string")).alias("seg_id")), "terms-asked")
    told = asked.join(engine(asked.select("seg_id", F.col("phrase").alias("text"), "context")), "seg_id")
    each = distinct_candidates(told.select("doc_id", "phrase", "seq", clean_candidate(F.col("output"), F.col("phrase"), tgt).alias("candidate")), tgt)
    listed = each.groupBy("doc_id", "phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "candidate"))), lambda c: c["candidate"]).alias("candidates"))
    out = held.join(listed, ["doc_id", "phrase"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return out.withColumn("target", F.coalesce(F.get("candidates", F.lit(0)), F.lit("")))


def resolved(sheet: DataFrame) -> DataFrame:
    """The terms that have a translation."""
    return sheet.where("target <> ''")


def spelled(term: Column) -> Column:
    """The pattern a term is found by: ASCII ones between non-alphanumerics, in the plural too, in any case unless they
    look like a name."""
    exact = ((F.upper(term) == term) & term.rlike("[A-Z]")) | term.rlike("[0-9]")
    bounded = F.concat(F.when(exact, "").otherwise("(?i)"), F.lit("(?<![A-Za-z0-9])"), escaped(term), F.lit("(?:s|es)?(?![A-Za-z0-9])"))
    return F.when(term.rlike(r"[^\x00-\x7f]"), escaped(term)).otherwise(bounded)


def with_document_hints(rows: DataFrame, sheet: DataFrame, text: str = "plain", origin: str = "document") -> DataFrame:
    """rows (doc_id, seg_id, hints, …) with the document's own terms added to hints: those of the text that no hint
    covers and that stand in no longer one. origin: see glossary.HINT."""
    known = resolved(sheet).select("doc_id", "phrase", F.col("target").alias("to"))
    covered = F.lower(F.array_join(F.transform("hints", lambda h: h["source"]), " "))
    met = rows.select("doc_id", "seg_id", F.col(text).alias("t"), covered.alias("covered")).join(known, "doc_id")
    met = met.where(~F.contains("covered", F.lower("phrase")) & F.regexp_like("t", spelled(F.col("phrase"))))
    own = met.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("phrase")).alias("n"), "phrase", "to"))).alias("own"))
    maximal_ = F.filter("own", lambda a: ~F.exists("own", lambda b: (b["n"] < a["n"]) & F.contains(F.lower(b["phrase"]), F.lower(a["phrase"]))))
    added = F.transform(maximal_, lambda a: F.struct(a["phrase"].alias("source"), a["to"].alias("target"), F.lit(False).alias("keep"), F.lit(origin).alias("origin")))
    out = rows.join(own, "seg_id", "left")
    return out.withColumn("hints", F.when(F.col("own").isNull(), F.col("hints")).otherwise(F.concat("hints", added))).select(*rows.columns)

"""Quality checks over pairs of a source and its translation; each returns findings.

Pairs have doc_id, pos, seg_id, container, kind, source (tagged), plain, target (null: not translated), protected
(identifiers), hints (glossary terms) and kept (nothing to translate); see plans.qc.pairs_of.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import latin, tags, text, tokens
from ..functions.languages import LATIN, SCRIPT
from ..functions.similarity import ratio
from .findings import finding, union
from .glossary import adherence
from .terms import OTHER, wordings
from .validate import foreign_scripts
from ..sources.scratch import materialize

# Fixed values; so are codes, severities and messages of the findings below.
ENGLISH_ONLY = "the and with is are this that for from which will be by to these those into their its our your should can of".split()
NOTATION = "lux ppm rpm sec min max bar psi mph kpa mpa khz mhz ghz kbps mbps gbps dpi ips fps www http https html json xml csv pdf pptx xlsx docx exe dll ini cfg log png jpg jpeg svg".split()
LOWER_WORD = r"(?<![A-Za-z0-9_\-./@])[a-z]{3,}(?:-[a-z]+)*(?![A-Za-z0-9_\-@])"
SOURCE_END = r"[.!?。！？]$"
TARGET_END = {"my": r"[။.!?]", "ja": r"[。！？.!?]", "zh": r"[。！？.!?]", "ko": r"[.!?。]"}
DANGLING = {
    "en": r"\b(and|or|of|the|with|for|to|a|an|in|on|by|from|via|as)$",
    "de": r"\b(und|oder|der|die|das|des|mit|für|zu|von|im|in|auf)$",
    "fr": r"\b(et|ou|de|des|du|la|le|les|avec|pour|à|en|sur|par)$",
    "es": r"\b(y|o|de|del|la|el|los|las|con|para|a|en|por)$",
    "ja": r"([、，,：:（(]|および|及び|ならびに)$",
    "zh": r"([、，,：:（(]|和|及|以及|与)$",
}
DANGLING_WORDS = {k: tuple(re.fullmatch(r"\\b\((.*)\)\$", v)[1].split("|")) for k, v in DANGLING.items() if k in LATIN}
CLOSING = ")）」』\"' \t\n\x0b\f\r"  # what may follow the end of a sentence
APART = 1 << 30  # partitions, of which there are never so many: Spark leaves a Python function of another's result out otherwise
MEASURED, RATED, LONG = 15, 20, 40  # letters of a source for the usual ratio, for a rating, for the strict limit
STRICT, LOOSE, FEWER = 0.58, 0.33, 0.8  # shares of the usual ratio
LIKE = 70  # similarity of a changed identifier
TAIL, WORD_TAIL = 64, 16  # characters


def where_label() -> Column:
    return F.concat(F.lit("slide "), F.col("container").cast("string"))


def residue() -> Column:
    """The translation without identifiers and terms that stay as they are."""
    same = F.transform(F.filter("hints", lambda h: h["keep"] | (h["target"] == h["source"])), lambda h: h["target"])
    gone = lambda at, t: F.regexp_replace(at, F.concat(F.lit("(?iu)"), tokens.escaped(t)), F.lit(" "))
    return F.aggregate(same, tokens.without(F.col("target"), F.col("protected")), gone)


def not_translated(src: str, tgt: str, rest: Column | None = None) -> Column:
    rest = residue() if rest is None else rest
    out = ~text.has_text(F.col("target")) | (text.casefold(text.norm(F.col("target"))) == text.casefold(text.norm(F.col("plain"))))
    if tgt not in LATIN:
        return out | ~rest.rlike(SCRIPT[tgt])
    if src not in LATIN:
        letters = F.length(F.regexp_replace(rest, r"(?U)[\s\d]", ""))
        return out | (F.regexp_count(rest, F.lit(SCRIPT[src])) > 0.5 * letters)
    return out


def _by_first(words: list[str]) -> str:
    """A pattern of words that reads the others of a first letter only where it stands."""
    firsts = sorted({w[0] for w in words})
    return f"(?=[{''.join(firsts)}])(?:" + "|".join(f"{a}(?:{'|'.join(w[1:] for w in words if w[0] == a)})" for a in firsts) + ")"


def leftovers(src: str, tgt: str, rest: Column | None = None) -> Column:
    """Words or characters of the source language left in the translation; distinct, in order."""
    rest = residue() if rest is None else rest
    if tgt not in LATIN:
        known = F.transform(F.regexp_extract_all("plain", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
        target = F.col("target")
        in_name = lambda w: F.regexp_like(target, F.concat(F.lit(r"(?U)[A-Z][\w/]*\s+"), w, F.lit(r"\s+[A-Z]")))
        words = F.regexp_extract_all(rest, F.lit(LOWER_WORD), F.lit(0))
        left = F.filter(words, lambda w: F.array_contains(known, w) & ~w.isin(NOTATION) & (F.length(F.replace(w, F.lit("-"), F.lit(""))) >= 4) & ~in_name(w))
        return F.array_distinct(left)
    if src not in LATIN:
        return F.array_distinct(F.regexp_extract_all(rest, F.lit(f"(?:{SCRIPT[src]})+"), F.lit(0)))
    if src == "en" and tgt != "en":
        words = F.regexp_extract_all(F.lower(rest), F.lit(f"(?<![a-z])(?:{_by_first(ENGLISH_ONLY)})(?![a-z])"), F.lit(0))
        return F.when(F.size(words) >= 2, F.array_distinct(words)).otherwise(F.array().cast("array<string>"))
    return F.array().cast("array<string>")


def tail(c: Column) -> Column:
    """The last characters of a text, more than any pattern of what ends it needs."""
    return F.right(F.when(F.right(c, F.lit(1)).rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)\s+$", "")).otherwise(c), F.lit(TAIL))


def cut_off(tgt: str) -> Column:
    source, target = tail(F.col("plain")), tail(F.col("target"))
    out = F.lit(False)
    if tgt in DANGLING:
        dangles = lambda c: F.right(c, F.lit(WORD_TAIL)).rlike("(?iuU)" + DANGLING[tgt])
        out = dangles(target) & ~dangles(source)
    if tgt == "th":
        return out
    closing = "[)）」』\"'\\s]*$"
    ending = TARGET_END.get(tgt, "[.!?]") + closing
    ends = target.rlike(ending) | (target.rlike("^" + closing) & F.col("target").rlike(ending[:-1] + r"(?U:\s)*$"))
    return out | (source.rlike(SOURCE_END) & ~ends)


def with_ratios(pairs: DataFrame) -> DataFrame:
    """size, ratio and the document's usual ratio, null under five measured pairs."""
    size = tokens.content_length(F.col("plain"), F.col("protected"))
    rows = pairs.withColumn("size", size).withColumn("ratio", tokens.content_length(F.col("target"), F.col("protected")) / F.nullif(F.col("size"), F.lit(0)))
    counts = ~F.col("kept") & F.col("target").isNotNull() & (F.col("size") >= MEASURED) & text.has_text(F.col("target"))
    usual = rows.where(counts).groupBy("doc_id").agg(F.when(F.count(F.lit(1)) >= 5, F.median("ratio")).alias("usual"))
    return rows.join(usual, "doc_id", "left")


def completeness(pairs: DataFrame, src: str, tgt: str) -> DataFrame:
    """not_translated ends the checks of a pair; so does a translation that stops mid-sentence.

    All that needs the texts is found in one pass over them and written without them; the documents' usual ratios meet
    these narrow rows.
    """
    tagged = F.col("target_tagged") if "target_tagged" in pairs.columns else F.col("target")
    plain, target = F.col("plain"), F.col("target")
    length = lambda c: tokens.content_length(c, F.col("protected"))
    more_lines = F.when(tagged.contains("\n"), F.regexp_count(tagged, F.lit("\n")) > F.regexp_count("source", F.lit("\n"))).otherwise(F.lit(False))
    # The patterns, for texts that aren't Latin.
    general = {
        "size": length(plain), "target_size": length(target), "bare": F.coalesce(not_translated(src, tgt), F.lit(True)), "cut": cut_off(tgt),
        "counts": target.isNotNull() & text.has_text(target), "stray": F.size(foreign_scripts(plain, target, tgt)) > 0,
    }
    none = F.array().cast("array<string>")
    rows = pairs.where("not kept")
    if src in LATIN and tgt in LATIN:
        stay = F.exists("hints", lambda h: h["keep"] | (h["target"] == h["source"]))
        rest = F.when(stay, residue()) if src == "en" and tgt != "en" else F.lit(None).cast("string")
        measured = latin.measures(DANGLING_WORDS.get(tgt, ()), CLOSING, frozenset(ENGLISH_ONLY if src == "en" and tgt != "en" else ()), RATED)
        rows = rows.withColumn("rest", rest).coalesce(APART).withColumn("latin", measured(plain, target, F.col("protected"), F.col("rest")))
        known = F.col("latin").isNotNull()
        told = lambda k, slow: F.when(known, F.col(f"latin.{k}")).otherwise(slow)
        general = {k: told(k, v) if k != "stray" else F.when(known, False).otherwise(v) for k, v in general.items()}
    else:
        told = lambda k, slow: slow
    rows = rows.withColumns({**general, "more_lines": more_lines})
    fewer = F.when(~F.col("bare") & ~F.col("cut") & (F.col("size") >= RATED), told("fewer", (text.sentences(plain) >= 2) & (text.sentences(target) < text.sentences(plain))))
    left = F.when(F.col("bare"), none).otherwise(told("left", leftovers(src, tgt)))
    ratio_ = F.col("target_size") / F.nullif(F.col("size"), F.lit(0))
    rows = materialize(rows.select("doc_id", "seg_id", "container", "size", ratio_.alias("ratio"), "bare", "cut", "counts", "stray", "more_lines", fewer.alias("fewer"), left.alias("left")), "qc-completeness")
    usual = rows.where(F.col("counts") & (F.col("size") >= MEASURED)).groupBy("doc_id").agg(F.when(F.count(F.lit(1)) >= 5, F.median("ratio")).alias("usual"))
    rows = rows.join(usual, "doc_id", "left")
    limit = F.when(F.col("size") >= LONG, STRICT).otherwise(LOOSE) * F.col("usual")
    short = (F.col("usual") > 0) & (F.col("size") >= RATED) & ((F.col("ratio") < limit) | (F.col("fewer") & (F.col("ratio") < FEWER * F.col("usual"))))
    say = lambda what: F.concat(where_label(), F.lit(": " + what))
    one = lambda cond, code, severity, said, detail=None: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), said.alias("said"), (F.lit(None).cast("string") if detail is None else F.to_json(detail)).alias("detail")))
    told = F.when(F.col("bare"), F.array(one(F.lit(True), "not_translated", "error", say("paragraph not translated")))).otherwise(F.array(
        one(F.size("left") > 0, "partly_translated", "warning", F.concat(where_label(), F.lit(": "), F.size("left").cast("string"), F.lit(" word(s) left in the original language")), F.struct("left")),
        one(F.col("stray"), "foreign_script", "warning", say("characters from another language")),
        one(F.col("more_lines"), "added_text", "warning", say("translation has extra lines (text may have been added)")),
        one(F.col("cut"), "possible_omission", "warning", say("translation ends mid-sentence (part may be missing)"), F.struct(F.lit(True).alias("cut_off"))),
        one(~F.col("cut") & short, "possible_omission", "warning", say("translation shorter than expected (part may be missing)"), F.struct(F.round(F.col("ratio") / F.col("usual"), 2).alias("ratio"))),
    ))
    each = rows.select("doc_id", "seg_id", "container", F.explode(F.array_compact(told)).alias("t"))
    return each.select(*finding("completeness", F.col("t.code"), F.col("t.severity"), F.col("t.said"))[:-1], F.col("t.detail").alias("detail"))


def glossary_terms(pairs: DataFrame, tgt: str) -> DataFrame:
    found = adherence(pairs.where("not kept"), tgt).where("n_missing > 0")
    said = F.concat(F.lit("approved glossary term not used in "), F.col("n_missing").cast("string"), F.lit(" of "), (F.col("n_missing") + F.col("n_used")).cast("string"), F.lit(" paragraph(s)"))
    return found.select(*finding("terminology", "glossary_term", "warning", said, F.struct("term", "approved"), F.col("segments"), F.col("pages")))


def with_repeat_hash(pairs: DataFrame) -> DataFrame:
    """pairs (plain, target) with repeat_hash, which is the same for sources that read alike; null without texts."""
    counts = text.has_text(F.col("target")) & F.col("plain").rlike(r"(?U)[^\W\d_]")
    return pairs.withColumn("repeat_hash", latin.repeat_hash(F.when(counts, F.col("plain"))))


def same_source_differs(pairs: DataFrame, tgt: str) -> DataFrame:
    """Texts that stand in a document once only, which most do, are left out by hashes of their keys first: the hashes that
    a document has twice are few, and no text is sorted or dealt out for them."""
    rows = pairs if "repeat_hash" in pairs.columns else with_repeat_hash(pairs)
    counted = rows.where("repeat_hash is not null").groupBy("doc_id", "repeat_hash").agg(F.count(F.lit(1)).alias("n"))
    twice = materialize(counted.where("n >= 2").select("doc_id", "repeat_hash"), "repeated", pack=True)
    rows = rows.where("not kept").join(twice, ["doc_id", "repeat_hash"], "left_semi")
    rows = rows.select("doc_id", "pos", "seg_id", "container", "plain", "target")
    rows = rows.withColumns({"key": text.repeat_key(F.col("plain"), True), "variant": text.repeat_key(F.col("target"), tgt in LATIN)})
    each = rows.groupBy("doc_id", "key", "variant").agg(F.min("pos").alias("pos"), F.min_by(F.struct("plain", "target"), "pos").alias("first"), F.collect_list("seg_id").alias("ids"), F.collect_set("container").alias("pages"))
    groups = each.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("segments"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.min_by("first.plain", "pos").alias("source"), F.array_sort(F.collect_list(F.struct("pos", "first", "ids"))).alias("each"))
    shown = F.map_from_entries(F.transform("each", lambda v: F.struct(v["first"]["target"], F.array_sort(v["ids"]))))
    said = F.concat(F.lit("the same text is translated "), F.col("n").cast("string"), F.lit(" different ways"))
    return groups.where("n >= 2").select(*finding("terminology", "same_source_differs", "warning", said, F.struct("source", shown.alias("variants")), F.col("segments"), F.col("pages")))


def term_variants(pairs: DataFrame, candidates: DataFrame, used_in: DataFrame, majority: DataFrame, tgt: str) -> DataFrame:
    """Recurring terms worded differently. candidates: doc_id, phrase, candidate; used_in: doc_id, phrase, seg_id, perhaps
    target, the segment's translation, so that those of all segments needn't meet it."""
    own = [c for c in ("target",) if c in used_in.columns]
    texts = pairs.where(~F.col("kept") & text.has_text(F.col("target"))).select("seg_id", "container", *(c for c in ("target",) if c not in own))
    met = used_in.select("doc_id", "phrase", "seg_id", *(tags.strip_tags(F.col(c)).alias(c) for c in own)).join(texts, "seg_id")
    told = wordings(candidates, met, majority, tgt)
    off = ~F.col("wording").eqNullSafe(F.col("winner"))
    variants = told.groupBy("doc_id", "phrase", "wording").agg(F.array_sort(F.collect_list("seg_id")).alias("ids"))
    variants = variants.groupBy("doc_id", "phrase").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("wording", "ids")))).alias("variants"))
    groups = told.groupBy("doc_id", "phrase").agg(
        F.max("winner").alias("winner"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(off).alias("n_off"),
        F.count_if(off & (F.col("wording") != OTHER)).alias("n_known_off"),
        F.count_distinct(F.when(F.col("wording") != OTHER, F.col("wording"))).alias("n_known"),
        F.count_distinct("wording").alias("n_wordings"),
        F.array_sort(F.collect_list(F.when(off, F.col("seg_id")))).alias("segments"),
        F.array_sort(F.collect_set(F.when(off, F.col("container")))).alias("pages"),
    )
    settled = F.col("winner").isNotNull()
    shown = groups.join(variants, ["doc_id", "phrase"]).where((F.col("n") >= 2) & ((settled & (F.col("n_off") > 0)) | (~settled & (F.col("n_known") >= 2))))
    with_majority = F.concat(F.lit("recurring term worded differently in "), F.col("n_off").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" paragraphs"))
    without = F.concat(F.lit("recurring term translated "), F.col("n_wordings").cast("string"), F.lit(" different ways"))
    severity = F.when(settled & (F.col("n_known_off") == 0), "info").otherwise("warning")
    detail = F.struct(F.col("phrase").alias("term"), F.coalesce("winner", F.lit("")).alias("majority"), "variants")
    return shown.select(*finding("terminology", "term_variants", severity, F.when(settled, with_majority).otherwise(without), detail, F.col("segments"), F.col("pages")))


def missing_tokens(pairs: DataFrame) -> DataFrame:
    """Per identifier that a translation lacks, the likest new one of its kind there: seg_id, token, near, score."""
    gone = F.filter("protected", lambda t: ~F.contains("target", t))
    active = pairs.where(~F.col("kept") & text.has_text(F.col("target"))).withColumn("gone", gone).where("size(gone) > 0")
    lost = active.withColumn("out", tokens.protected_tokens(F.col("target"))).select("doc_id", "seg_id", "container", "protected", "out", F.explode("gone").alias("token"))
    lost = lost.withColumn("opaque", tokens.is_opaque(F.col("token")))
    near = lost.select("*", F.explode_outer(F.array_except("out", "protected")).alias("other"))
    near = near.withColumn("score", F.when(F.col("other").isNotNull() & (tokens.is_opaque(F.col("other")) == F.col("opaque")), ratio("token", "other")).otherwise(0.0))
    return near.groupBy("doc_id", "seg_id", "container", "token", "opaque").agg(F.max(F.struct("score", "other")).alias("best")).select("doc_id", "seg_id", "container", "token", "opaque", F.col("best.score").alias("score"), F.col("best.other").alias("near"))


def identifiers(pairs: DataFrame) -> DataFrame:
    say = lambda what: F.concat(where_label(), F.lit(": " + what))
    lost = missing_tokens(pairs)
    changed = F.col("score") >= LIKE
    active = pairs.where(~F.col("kept") & text.has_text(F.col("target")))
    related = lambda o: F.exists("protected", lambda t: F.contains(t, o) | F.contains(o, t))
    source = F.col("plain")
    added = F.array_distinct(F.filter(tokens.opaque_tokens(F.col("target")), lambda o: ~source.contains(o) & ~related(o) & tokens.is_opaque(o)))
    rest = lambda c: tokens.without(F.col(c), F.col("protected"))
    # Where the source has no digit, no number or unit can be missing.
    numbers = active.where(source.rlike(r"(?U)\d")).withColumns({"a": rest("plain"), "b": rest("target")})
    numbers = numbers.withColumns({"na": tokens.significant_numbers(F.col("a")), "nb": tokens.significant_numbers(F.col("b"))})
    missing = F.concat(F.array_sort(F.array_except("na", "nb")), tokens.lost_units(F.col("a"), F.col("b")))
    either = lambda a, b: F.when(changed, a).otherwise(b)
    detail = either(F.to_json(F.struct(F.col("token").alias("from"), F.col("near").alias("to"))), F.to_json(F.struct(F.col("token").alias("missing"))))
    severity = F.when(changed | F.col("opaque"), "error").otherwise("warning")
    return union(
        lost.select(*finding("identifiers", either(F.lit("token_changed"), F.lit("token_missing")), severity, either(say("identifier changed"), say("identifier missing")))[:-1], detail.alias("detail")),
        active.withColumn("added", added).where("size(added) > 0").select(*finding("identifiers", "token_added", "warning", say("identifier not in the original"), F.struct("added"))),
        numbers.withColumn("missing", missing).where("size(missing) > 0").select(*finding("identifiers", "number_changed", "warning", say("number or unit missing or changed"), F.struct("missing", F.array_sort(F.array_except("nb", "na")).alias("new")))),
    )


def notes(rows: DataFrame) -> DataFrame:
    """Notes of a reader (doc_id, note) on what it couldn't take as text: findings of no segment."""
    picture = F.contains("note", F.lit("picture"))
    page = F.regexp_extract("note", r"^(?:slide|page) (\d+)", 1)
    code, severity = F.when(picture, "picture_text").otherwise("not_translatable"), F.when(picture, "warning").otherwise("info")
    none = F.array().cast("array<string>")
    return rows.select(*finding("completeness", code, severity, F.col("note"), segments=none, pages=F.when(page != "", F.array(page.cast("int"))).otherwise(F.array().cast("array<int>"))))


#: Severities of rendering issues, whatever the renderer says.
LAYOUT = {"overflow": "warning", "font_reduced": "info", "extra_lines": "info", "box_grows": "info", "overflow_inherited": "info"}


def layout(issues: DataFrame, segments: DataFrame) -> DataFrame:
    """Issues of rendering (doc_id, code, severity, ref, message) on segments, by id or else by shape; and, for each
    document, the translated segments whose formatting was simplified."""
    by_id = segments.select(F.col("seg_id").alias("ref"), F.col("seg_id").alias("by_id"))
    by_shape = segments.groupBy(F.col("shape_key").alias("ref")).agg(F.array_sort(F.collect_list("seg_id")).alias("by_shape"))
    met = issues.join(by_id, "ref", "left").join(by_shape, "ref", "left")
    found = F.coalesce(F.when(F.col("by_id").isNotNull(), F.array("by_id")), F.col("by_shape"), F.array().cast("array<string>"))
    page = F.regexp_extract("message", r"(?:slide|page) (\d+)", 1)
    pages = F.when(page == "", F.array().cast("array<int>")).otherwise(F.array(page.cast("int")))
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LAYOUT.items() for x in kv]), F.col("code")), F.col("severity"))
    shown = met.select(*finding("layout", F.col("code"), severity, F.col("message"), segments=found, pages=pages))
    simple = segments.where("formatting_simplified and target is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("seg_id")).alias("segments"), F.array_sort(F.collect_set(F.col("container").cast("int"))).alias("pages"))
    said = F.concat(F.col("n").cast("string"), F.lit(" paragraph(s) use one style instead of mixed formatting"))
    return shown.unionByName(simple.select(*finding("layout", "formatting_simplified", "info", said, segments=F.col("segments"), pages=F.col("pages"))))


def compared(expected: DataFrame, reread: DataFrame, threshold: float = 92.0) -> DataFrame:
    """Segments with written, whether the written file as read again (seg_id, text) has their translation, by
    compatibility form; long ones may differ a little."""
    want = expected.select("doc_id", "seg_id", "container", text.squash(F.col("target")).alias("want"))
    got = reread.select("seg_id", text.squash(F.col("text")).alias("got"))
    met = want.join(got, "seg_id", "left")
    alike = (F.length("want") >= 8) & (ratio("want", "got") >= threshold)
    return met.withColumn("written", F.col("got").isNotNull() & ((F.col("want") == F.col("got")) | alike))


def unwritten(expected: DataFrame, reread: DataFrame, threshold: float = 92.0) -> DataFrame:
    """Segments whose written text isn't the expected one."""
    met = compared(expected, reread, threshold).where("not written")
    return met.select(*finding("completeness", "not_written", "error", F.concat(where_label(), F.lit(": translation missing from the written file"))))


def tag_problems(pairs: DataFrame) -> DataFrame:
    """Pairs whose translation doesn't open the tags of its source."""
    bad = ~tags.is_well_formed(F.col("target")) | (tags.openings(F.col("target")) != tags.openings(F.col("source")))
    return pairs.where((F.size(tags.tag_ids(F.col("source"))) > 0) & bad)

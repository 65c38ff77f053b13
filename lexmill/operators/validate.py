"""Problems of a single translation, their score, and the choice among attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.expressions import let
from ..functions.languages import LATIN, SCRIPT
from ..functions.similarity import has_wide
from ..functions.text import has_text
from ..functions.tokens import parenthesised, significant_numbers

# Fixed values.
RETRYABLE = ["empty", "tags", "placeholders", "token_missing", "term_missing", "untranslated", "foreign_script", "number_mismatch", "added_text"]
FOREIGN = {
    "Korean": r"[가-힯ᄀ-ᇿ]",
    "Japanese kana": r"[぀-ヿ]",
    "Chinese/Japanese kanji": r"[⺀-⿟㐀-䶿一-鿿豈-﫿]",
    "Thai": r"[฀-๿]",
    "Burmese": r"[က-႟]",
    "Cyrillic": r"[Ѐ-ӿ]",
    "Arabic": r"[؀-ۿ]",
}
ALLOWED = {"ja": ("Japanese kana", "Chinese/Japanese kanji"), "zh": ("Chinese/Japanese kanji",), "ko": ("Korean", "Chinese/Japanese kanji"), "th": ("Thai",), "my": ("Burmese",)}
RATIO = {("en", "ja"): (0.2, 1.4), ("ja", "en"): (0.7, 5.0)}
OTHER_RATIO = (0.25, 4.0)
LONG = 40


def foreign_scripts(source: Column, output: Column, target: str) -> Column:
    """Names of scripts in output that are neither the target's nor in source."""
    foreign = {n: p for n, p in FOREIGN.items() if n not in ALLOWED.get(target, ())}
    named = F.filter(F.array(*[F.when(output.rlike(p) & ~source.rlike(p), n) for n, p in foreign.items()]), lambda n: n.isNotNull())
    # All of them lie past U+0400; texts without such a character are told fast.
    return F.when(output.rlike("[\u0400-\U0010ffff]"), named).otherwise(F.array().cast("array<string>"))


def problems(source: Column, output: Column, tokens: Column, src: str, tgt: str, required: Column | None = None, placeholders: Column | None = None) -> Column:
    """Array of (code, count). required: array of (source, target) terms that the output must use."""
    wide = has_wide(tags.strip_tags(output)) if tgt in LATIN and src not in LATIN else F.lit(False)
    held = F.struct(source.alias("source"), output.alias("output"), tags.strip_tags(source).alias("plain_source"), tags.strip_tags(output).alias("plain"), tokens.alias("tokens"), wide.alias("wide"))
    return let(held, lambda h: _problems(h, src, tgt, required, placeholders))


def _problems(h: Column, src: str, tgt: str, required: Column | None, placeholders: Column | None) -> Column:
    source, output, plain_source, plain, tokens = (h[k] for k in ("source", "output", "plain_source", "plain", "tokens"))
    lines = lambda t: F.regexp_count(t, F.lit("\n"))
    bare = lambda inside: F.filter(parenthesised(plain_source, tokens), lambda t: plain.contains(t) & ~F.array_contains(inside, t))
    missing = F.filter(tokens, lambda t: ~plain.contains(t))
    lost = F.array_except(significant_numbers(plain_source), significant_numbers(plain))
    rest = F.aggregate(F.filter(tokens, lambda t: t != ""), plain, lambda at, t: F.replace(at, t, F.lit("")))
    if tgt not in LATIN:
        untranslated = ~rest.rlike(SCRIPT[tgt])
    elif src not in LATIN:
        untranslated = rest.rlike(SCRIPT[src]) | h["wide"]
    else:
        untranslated = F.trim(plain) == F.trim(plain_source)
    low, high = RATIO.get((src, tgt), OTHER_RATIO)
    share = F.length(plain) / F.greatest(F.length(plain_source), F.lit(1))
    one = lambda cond, code: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(1).alias("count")))
    many = lambda found, code: let(F.size(found), lambda n: F.when(n > 0, F.struct(F.lit(code).alias("code"), n.alias("count"))))
    found = [
        one((F.size(tags.tag_ids(source)) > 0) & (~tags.is_well_formed(output) | (tags.openings(output) != tags.openings(source))), "tags"),
        one(lines(output) > lines(source), "added_text"),
        many(missing, "token_missing"),
        many(let(parenthesised(plain, tokens), bare), "parentheses_lost"),
        many(foreign_scripts(plain_source, plain, tgt), "foreign_script"),
        one(untranslated, "untranslated"),
        many(lost, "number_mismatch"),
        one((F.length(plain_source) >= LONG) & ~share.between(low, high), "length_suspicious"),
    ]
    if placeholders is not None:
        once = F.filter(placeholders, lambda p: F.size(F.split(output, F.concat(F.lit(r"\Q"), p, F.lit(r"\E")), -1)) != 2)
        found.insert(1, many(once, "placeholders"))
    if required is not None:
        unused = F.filter(required, lambda t: ~F.lower(plain).contains(F.lower(t["target"])))
        found.append(many(unused, "term_missing"))
    every = F.filter(F.array(*found), lambda p: p.isNotNull())
    empty = F.array(F.struct(F.lit("empty").alias("code"), F.lit(1).alias("count")))
    return F.when(~has_text(output), empty).otherwise(every)


def score(found: Column) -> Column:
    """Ten for each problem worth a retry, one for each other."""
    return F.aggregate(found, F.lit(0), lambda n, p: n + F.when(p["code"].isin(RETRYABLE), 10).otherwise(1))


FATAL, SIMPLER = 100, 5  # fixed values: what a useless or a simplified translation scores besides


def fatal(found: Column) -> Column:
    return F.exists(found, lambda p: p["code"].isin("empty", "untranslated"))


def outcome_score(found: Column, simplified: Column) -> Column:
    """The score of an accepted translation."""
    return score(found) + F.when(fatal(found), FATAL).otherwise(0) + F.when(simplified, SIMPLER).otherwise(0)


def retryable(found: Column) -> Column:
    return F.exists(found, lambda p: p["code"].isin(RETRYABLE))


def best_attempts(attempts: DataFrame, key: str = "seg_id") -> DataFrame:
    """Of the attempts (key, attempt, score, …) on each segment that of the least score, the earliest of equals."""
    rest = [c for c in attempts.columns if c != key]
    return attempts.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("score", "attempt")).alias("best")).select(key, "best.*")

"""License scan: whole phrases, and short notices with a bounded number of edits.

A text's normal form is its words, A-Z lower-cased, joined by single blanks. Base phrases are looked up in it as they are.
A notice of L characters may have k = L // 10 edits. It is cut into k + 1 pieces: an occurrence within k edits holds
at least one piece unchanged (pigeonhole), so an Aho-Corasick automaton over all pieces finds every place where one may
be. Around each lies a window that holds any occurrence using that piece. It must have a notice's telling words, those of
five letters or more within a third of their letters, shorter ones as they are, so that neither version 1 passes for
version 2 nor one name for another; and all but 2 k of the notice's pairs of neighbours, as an edit takes two at most.
What is left goes to the regex library's bounded-error search, which verifies it and reports its edits and span; that
span must have the telling words too. Of overlapping spans of one label that of the fewest edits, then the first, stays.

Everything happens in one pass over each text, without a shuffle. Defined results: null counts as the empty text, which
has no words, no labels and score 0; ties in score are one number; repeated rows come out alike, one for each; an empty
table gives an empty result; extra columns are the caller's, as scan() is a column of the text. Texts are looked at whole:
a text of n bytes takes some 4 n bytes more while it is, and each place of a piece one window of the notice's length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    telling: tuple[str, ...] = ()

    @property
    def edits(self) -> int:
        return len(self.words) // 10

    def pieces(self) -> list[tuple[int, str]]:
        """(place, piece): the notice in edits + 1 pieces of like length."""
        n, parts = len(self.words), self.edits + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:])]


NOTICES = (
    Notice("mit", "released under the mit license", ("mit",)),
    Notice("mit", "licensed under the mit license", ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("apache-2", "licensed under the apache license version 2 0", ("apache", "2")),
    Notice("gpl-2", "licensed under the gnu general public license version 2", ("gnu", "2")),
    Notice("gpl-3", "licensed under the gnu general public license version 3", ("gnu", "3")),
    Notice("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu", "affero", "3")),
    Notice("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu", "lesser", "3")),
    Notice("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla", "2")),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("cc-by", "licensed under cc by 4 0", ("cc", "by")),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc", "by", "sa")),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc")),
    Notice("cc-by", "creative commons attribution 4 0 international license", ("creative", "commons", "attribution")),
    Notice("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("commons", "noncommercial")),
    Notice("cc0", "creative commons zero v1 0 universal", ("commons", "zero")),
)

_SPLITS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FORM = bytes.maketrans(_SPLITS, b" " * len(_SPLITS))
_FORM = bytes(b + 32 if 0x41 <= b <= 0x5A else _FORM[b] for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_STEP = 1 << 21


def normal(text: bytes) -> str:
    """The words joined by single blanks; split some MB at a time."""
    marked, parts, at = text.translate(_FORM), [], 0
    while at < len(marked):
        end = marked.find(b" ", at + _STEP)
        end = len(marked) if end < 0 else end
        if part := b" ".join(marked[at:end].split()):
            parts.append(part)
        at = end
    return b" ".join(parts).decode("utf-8", "replace")


@dataclass(frozen=True)
class Match:
    label: str
    start: int
    end: int
    edits: int
    score: float


class Scanner:
    """Finds phrases and notices in normal forms."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] | None = None):
        self.notices, self.phrases = notices, PHRASES if phrases is None else phrases
        found: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for at, piece in notice.pieces():
                found.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in found.items():
            self.seeds.add_word(piece, (len(piece), places))
        if found:
            self.seeds.make_automaton()
        self.fuzzy = [regex.compile(f"(?:{regex.escape(n.words)}){{e<={n.edits}}}", regex.BESTMATCH) for n in notices]
        self.pairs = [Counter(zip(n.words, n.words[1:])) for n in notices]
        self.telling = [[regex.compile(rf"(?<!\S)(?:{w}){{e<={len(w) // 3 if len(w) >= 5 else 0}}}(?!\S)") for w in n.telling] for n in notices]

    def places(self, form: str) -> list[tuple[int, int]]:
        """(word, label) of each base phrase; in order of phrases."""
        padded, out = f" {form} ", []
        for phrase, label in self.phrases.items():
            at, word, seen = padded.find(f" {phrase} "), 0, 0
            while at >= 0:
                word, seen = word + padded.count(" ", seen, at), at
                out.append((word, label))
                at = padded.find(f" {phrase} ", at + 1)
        return out

    def windows(self, form: str) -> list[tuple[int, int, int]]:
        """(notice, start, end) of the places to verify."""
        out = set()
        for last, (size, places) in self.seeds.iter(form) if len(self.seeds) else ():
            for i, at in places:
                notice, start = self.notices[i], last + 1 - size - at
                out.add((i, max(start - notice.edits, 0), min(start + len(notice.words) + notice.edits, len(form))))
        return sorted(out)

    def tells(self, i: int, form: str, start: int, end: int) -> bool:
        """Whether a notice's telling words stand among the words of a part; it may begin or end inside one."""
        whole = form[form.rfind(" ", 0, start + 1) + 1 : e if (e := form.find(" ", end)) >= 0 else len(form)]
        return all(t.search(whole) for t in self.telling[i])

    def may_hold(self, i: int, window: str) -> bool:
        """Whether a window has enough of a notice's neighbouring characters: an edit takes two pairs at most."""
        shared = sum((self.pairs[i] & Counter(zip(window, window[1:]))).values())
        return shared >= len(self.notices[i].words) - 1 - 2 * self.notices[i].edits

    def matches(self, form: str, told: bool = True) -> list[Match]:
        """The notices in a normal form; told: only where their telling words stand."""
        out: list[Match] = []
        best: dict[str, list[Match]] = {}
        for i, start, end in self.windows(form):
            if told and not self.tells(i, form, start, end) or not self.may_hold(i, form[start:end]):
                continue
            notice, hit = self.notices[i], self.fuzzy[i].search(form, start, end)
            if not hit or told and not self.tells(i, form, *hit.span()):
                continue
            a, b = hit.span()
            span = form[a:b]
            a, b = a + len(span) - len(span.lstrip()), b - len(span) + len(span.rstrip())
            edits = sum(hit.fuzzy_counts)
            best.setdefault(notice.label, []).append(Match(notice.label, a, b, edits, 1 - edits / len(notice.words)))
        for hits in best.values():
            taken: list[Match] = []
            for m in sorted(set(hits), key=lambda m: (m.edits, m.start, -m.end)):
                if all(m.end <= t.start or t.end <= m.start for t in taken):
                    taken.append(m)
            out += taken
        return sorted(set(out), key=lambda m: (m.start, m.end, m.label, m.edits))


def _spans(text: bytes, form: str, matches: list[Match]) -> list[str]:
    """label:start:end:edits, in code points of the text as it was."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))).decode("utf-8", "replace"))]
    out = []
    for m in matches:
        first, last = form.count(" ", 0, m.start), form.count(" ", 0, m.end)
        start = words[first][0] + m.start - (form.rfind(" ", 0, m.start) + 1)
        end = words[last][0] + m.end - (form.rfind(" ", 0, m.end) + 1)
        out.append(f"{m.label}:{start}:{end}:{m.edits}")
    return out


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def found(text: bytes, scanner: Scanner) -> tuple:
    form = normal(text)
    base, matches = scanner.places(form), scanner.matches(form)
    labels = {label for _, label in base}
    words = [w for w, _ in base]
    score = 1.0 if base else max((m.score for m in matches), default=0.0)
    spans = ",".join(_spans(text, form, matches)) if matches else ""
    return (form.count(" ") + 1 if form else 0, len(base), min(words, default=None), max(words, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {m.label for m in matches})), score, spans)


@cache
def _scanner(notices: tuple[Notice, ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(notices, dict(phrases))


def scan(text: Column, notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] | None = None) -> Column:
    """Struct of FIELDS: n_words, n_base places of base phrases, first_word and last_word of these (their least and
    greatest first word), base_labels and labels (with the notices'), score, and spans of notices."""
    pairs = tuple((PHRASES if phrases is None else phrases).items())
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(texts: pa.Array) -> pa.Array:
        scanner = _scanner(notices, pairs)
        rows = [found(t.as_py() or b"", scanner) for t in texts.cast(pa.binary())]
        cols = zip(*rows) if rows else [()] * len(types)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return F.arrow_udf(run, FIELDS)(text.cast("string"))

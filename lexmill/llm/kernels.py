"""Vectorised looks at whole texts inside tasks: words, their hashes, repeated windows. No Spark here.

Texts are looked at some MB at a time, one text at least, so memory doesn't depend on how many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BLANKS = " \t\n\x0b\x0c\r"
STEP_BYTES = 1 << 21
LONG_WORD = 256  # bytes; longer words are hashed one by one
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * B
    h = (h ^ (h >> np.uint64(32))) * B
    return h ^ (h >> np.uint64(32))


def steps(texts: Iterable[str | None], most: int = STEP_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 texts (null: empty) in lists of about so many bytes."""
    held, size = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > most:
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held


class Words:
    """The words of some texts: start, end (byte places in buf), doc (which text), and per text n. blank: what parts
    words, by byte; the line end between texts must."""

    def __init__(self, texts: list[bytes], blank: np.ndarray = BLANK):
        self.raw = b"\n".join(texts) + b"\n" + bytes(8)
        self.buf = np.frombuffer(self.raw, np.uint8)[: len(self.raw) - 8]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.blank = blank[self.buf]
        turn = np.flatnonzero(self.blank[1:] != self.blank[:-1]) + 1
        if len(self.buf) and not self.blank[0]:
            turn = np.concatenate([[0], turn])
        self.start, self.end = turn[0::2], turn[1::2]
        self.doc = np.searchsorted(self.edges, self.start, "right") - 1
        self.n = np.bincount(self.doc, minlength=len(texts))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes flagged lie in each text."""
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[self.edges[1:]] - sums[self.edges[:-1]]

    def chars(self) -> np.ndarray:
        """Code points in words."""
        return self.per_text(~self.blank & ((self.buf & 0xC0) != 0x80))

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        eight = np.ndarray((len(self.buf),), "<u8", self.raw, strides=(1,))
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * A)
        at, left, who = self.start, size, slice(None)
        while len(at):
            chunk = eight[at]
            short = left < 8
            chunk[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            h[who] = mix(h[who] * A ^ chunk)
            go = np.flatnonzero((left > 8) & (size[who] <= LONG_WORD))
            who = go if isinstance(who, slice) else who[go]
            at, left = at[go] + 8, left[go] - 8
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.raw[self.start[i] : self.end[i]])
        return h


def pairs(h: np.ndarray, apart: int = 1) -> np.ndarray:
    """Hashes of what h says here and so many places on; shorter by apart."""
    return mix(h[:-apart] * A ^ h[apart:]) if len(h) > apart else h[:0]


def repeated_words(words: Words, h: np.ndarray, width: int = 8) -> np.ndarray:
    """Per text, the words in windows of width (a power of two) that occur twice or more in it."""
    w, apart = h, 1
    while apart < width:
        w, apart = pairs(w, apart), apart * 2
    out = np.zeros(len(words.n), np.int64)
    if not len(w):
        return out
    inside = np.flatnonzero(words.doc[: len(w)] == words.doc[width - 1 :])
    key = mix(w[inside] + words.doc[inside].astype(np.uint64) * A)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = inside[twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=len(out))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS.encode())]
    return len(lines) - len(set(lines))

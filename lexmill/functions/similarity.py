"""Similarity and Unicode helpers that Spark has no built-in for: small Arrow functions over strings."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of b at a time (Hyyrö's bit vectors)."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    left = full
    for c in a:
        hit = left & places.get(c, 0)
        left = ((left + hit) | (left - hit)) & full
    return len(b) - left.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 times the common length over both lengths; 100 for two empty strings."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


OFTEN = 0.55  # share of the characters that the most frequent letters make up
PAIRS = 1 << 11  # cells that pairs of neighbouring characters are counted in


def _pair_cells(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left.astype(np.uint64) * np.uint64(0x9E3779B1) + right) * np.uint64(0x85EBCA77) >> np.uint64(13)).astype(np.int64) % PAIRS


class Block:
    """Texts side by side, a column of characters after the other, for comparing another text with all of them at once."""

    def __init__(self, texts: list[str]):
        self._rare = None
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        most = int(self.sizes.max(initial=1)) or 1
        characters = np.frombuffer("".join(t.ljust(most, "\U0010ffff") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(0x110000, bool)
        seen[characters] = True
        self.alphabet = np.flatnonzero(seen).astype(np.uint32)
        place = np.zeros(0x110000, np.intp)
        place[self.alphabet] = np.arange(len(self.alphabet))
        codes = place[characters].reshape(len(texts), most)
        self.columns = np.ascontiguousarray(codes.T)
        inside = np.arange(most) < self.sizes[:, None]
        owner = np.broadcast_to(np.arange(len(texts))[:, None], inside.shape)
        self.letters = self._counted(codes[inside], owner[inside], len(self.alphabet))
        characters, both = characters.reshape(len(texts), most), inside[:, 1:]
        self.pairs = self._counted(_pair_cells(characters[:, :-1][both], characters[:, 1:][both]), owner[:, 1:][both], PAIRS)

    def _counted(self, cells: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """How often each text has each cell, a row a cell."""
        out = np.bincount(cells * len(self.sizes) + owner, minlength=n * len(self.sizes)).reshape(n, -1)
        return out.astype(np.uint16 if self.columns.shape[0] < 1 << 16 else np.uint32)

    def _places(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some characters the texts have, and their codes."""
        place = np.minimum(np.searchsorted(self.alphabet, own), len(self.alphabet) - 1)
        known = np.flatnonzero((self.alphabet[place] == own) & (own != 0x10FFFF))
        return known, place[known]

    def possible(self, a: str, least: np.ndarray) -> np.ndarray:
        """The texts whose common length with a may be least or more.

        A common subsequence has no more of any letter than either text. And of the neighbours in one text those that
        stay neighbours in it, and are so in the other, are all but two for each character of its own that is left out
        and one for each of the other's (what comes in between). Pairs are counted in cells, which only makes more
        of them equal.
        """
        own = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        cells, n = np.unique(self._places(own)[1], return_counts=True)
        near = np.flatnonzero(np.minimum(self.letters[cells], n[:, None].astype(np.uint32)).sum(0, dtype=np.int64) >= least)
        if not len(near) or len(own) < 2:
            return near
        cells, n = np.unique(_pair_cells(own[:-1], own[1:]), return_counts=True)
        shared = np.minimum(self.pairs[cells][:, near], n[:, None].astype(np.uint32)).sum(0, dtype=np.int64)
        out_a, out_b = len(own) - least[near], self.sizes[near] - least[near]
        return near[shared >= np.maximum(len(own) - 1 - 2 * out_a - out_b, self.sizes[near] - 1 - 2 * out_b - out_a)]

    def rare(self) -> tuple[Block, dict[int, None], np.ndarray]:
        """The texts without the letters that most of their characters are, these as str.translate() has them, and their codes."""
        if self._rare is None:
            codes = np.argsort(-self.letters.sum(1, dtype=np.int64), kind="stable")
            share = np.cumsum(self.letters[codes].sum(1, dtype=np.int64))
            often = codes[: int(np.searchsorted(share, OFTEN * share[-1])) + 1]
            gone = {int(c): None for c in self.alphabet[often]}
            keep = ~np.isin(np.arange(len(self.alphabet)), often)[self.columns] & (np.arange(self.columns.shape[0])[:, None] < self.sizes)
            block = object.__new__(Block)
            block.alphabet, block.sizes = self.alphabet, keep.sum(0)
            # What is left of a text closes up; a letter that is gone from all fills the rest.
            block.columns = np.full((max(1, int(block.sizes.max(initial=0))), len(self.sizes)), often[0])
            place, text = np.nonzero(keep)
            block.columns[(np.cumsum(keep, 0) - 1)[place, text], text] = self.columns[place, text]
            self._rare = block, gone, often
        return self._rare

    def reachable(self, a: str, some: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Those of some whose common length with a may be least or more by that of what is left of both without the most
        frequent letters, which takes a fraction of the work: of these letters no more are common than either has."""
        block, gone, often = self.rare()
        own = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = (own[:, None] == self.alphabet[often]).sum(0)
        most = np.minimum(self.letters[often][:, some], counts[:, None].astype(np.uint32)).sum(0, dtype=np.int64)
        return some[block.common_lengths(a.translate(gone), some) + most >= least]

    def common_lengths(self, a: str, some: np.ndarray | None = None) -> np.ndarray:
        """common_length() of a and each text (of some): the same bit vectors, 64 bits of a at a time, for all together."""
        sizes = self.sizes if some is None else self.sizes[some]
        columns = self.columns if some is None else self.columns[: int(sizes.max(initial=0)), some]
        own = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        words = max(1, -(-len(own) // 64))
        table = np.zeros((words, len(self.alphabet)), np.uint64)
        known, place = self._places(own)
        np.bitwise_or.at(table, (known // 64, place), np.uint64(1) << (known % 64).astype(np.uint64))
        left = np.full((words, len(sizes)), np.uint64(2**64 - 1))
        hit, total = np.empty(len(sizes), np.uint64), np.empty(len(sizes), np.uint64)
        for column in columns:
            carry = None
            for w in range(words):
                row = left[w]
                np.take(table[w], column, out=hit, mode="clip")
                hit &= row
                np.add(row, hit, out=total)
                if w + 1 < words:  # what the last word carries is of no use
                    over = total < row
                if carry is not None:
                    total += carry
                    if w + 1 < words:
                        over |= total < carry
                row ^= hit
                row |= total
                carry = over.view(np.uint8) if w + 1 < words else None
        full = np.full(words, np.uint64(2**64 - 1))
        full[-1] = np.uint64((1 << (len(own) - 64 * (words - 1))) - 1)
        return np.bitwise_count(~left & full[:, None]).sum(axis=0, dtype=np.int64)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter with a window of its length in the longer, cut at the ends too."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
    return max(indel_ratio(short, w) for w in windows)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_part(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(BooleanType())
def has_wide(text: pd.Series) -> pd.Series:
    """Any East Asian wide or full-width character."""
    return text.map(lambda t: None if t is None else any(unicodedata.east_asian_width(c) in "WF" for c in t))


def in_cp932(c: str) -> bool:
    try:
        return bool(c.encode("cp932")) or True
    except UnicodeEncodeError:
        return False


@F.pandas_udf(IntegerType())
def not_japanese(text: pd.Series) -> pd.Series:
    """How many characters past U+2E80 Japanese encoding doesn't have."""
    return text.map(lambda t: None if t is None else sum(ord(c) > 0x2E80 and not in_cp932(c) for c in t))

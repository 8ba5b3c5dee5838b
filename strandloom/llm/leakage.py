"""Problem 9: evaluation texts that leak into training text.

Method: pigeonhole edit matching. A passage of ``PASSAGE`` words may have ``BUDGET``
words changed, lost or added, so of the budget plus one pieces it is cut into, one
is untouched. As a passage may begin anywhere in an item, the pieces of all its
starts are looked up: every run of PASSAGE / (BUDGET + 1) words. An exact hit fixes
item, document and offset. There, words are aligned within the shift that the
budget allows, which rules out most hits, and what remains is verified with Myers'
bit-parallel edit distance over words.

Longer passages may have one edit in eight words. Cut into stretches of PASSAGE words and a
rest, one of three stretches or more is itself a passage, and words past a multiple
of eight add nothing to the budget: so of all longer passages only those of ``LENGTHS`` words
need a check of their own. The work is in proportion to the words of the item, however long.

Documents stream through once, whole; nothing of them is shuffled or collected. The
test items go to the workers in blocks of at most ``BLOCK_WORDS`` words, one pass
over the documents for each block.

Defined cases: null and blank texts hold and leak nothing; items shorter than a
passage cannot leak; repeated rows give one row per pair; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .texts import words

PASSAGE = 24
ONE_IN = 8
BUDGET = PASSAGE // ONE_IN
PIECE = PASSAGE // (BUDGET + 1)
#: Lengths of passages; each passage of another length holds one of these.
LENGTHS = (PASSAGE, PASSAGE + ONE_IN, PASSAGE + 2 * ONE_IN, 2 * PASSAGE + 2 * ONE_IN)
#: Words by which a passage can shift against one of its pieces.
SHIFT = LENGTHS[-1] // ONE_IN
#: Least words in runs among some PASSAGE words of a passage of any length.
IN_RUNS = PASSAGE - 10
BLOCK_WORDS = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def least_distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least number of changed, lost or added words between ``pattern`` and any
    run of words of ``text``, and where that run ends (Myers 1999, search variant)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | (1 << i)
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score = full, 0, len(pattern)
    best, end = score, 0
    for j, w in enumerate(text):
        equal = masks.get(w, 0)
        xv = equal | minus
        xh = ((((equal & plus) + plus) & full) ^ plus) | equal
        up, down = minus | (full & ~(xh | plus)), plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(xv | up)), up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@lru_cache(256)
def _shifted(length: int) -> np.ndarray:
    """Places of ``length`` words at every shift."""
    return np.arange(2 * SHIFT + 1, dtype=np.int32)[:, None] + np.arange(length, dtype=np.int32)[None, :]


class Items:
    """The pieces of the test items, ready for look-up."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        codes, owners, places = [], [], []
        for item, text in items:
            own = words(text or "")
            if len(own) < PASSAGE:
                continue
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], dtype=np.int64)
            codes.append(self.codes(numbers))
            owners.append(np.full(len(codes[-1]), len(self.ids)))
            places.append(np.arange(len(codes[-1])))
            self.ids.append(item)
            self.words.append(numbers)
        empty = np.zeros(0, np.int64)
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.owner = (np.concatenate(owners) if owners else empty)[order]
        self.place = (np.concatenate(places) if places else empty)[order]

    @staticmethod
    def codes(numbers: np.ndarray) -> np.ndarray:
        """A code for every run of PIECE words."""
        if len(numbers) < PIECE:
            return np.zeros(0, np.uint64)
        n = numbers.astype(np.uint64)
        out = np.zeros(len(n) - PIECE + 1, np.uint64)
        for k in range(PIECE):
            out = out * _MULTIPLIER + n[k : k + len(out)]
        return out ^ (out >> np.uint64(29))

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, first word of the passage in the item, its length, edits) of each item that leaked."""
        own = words(text)
        if len(own) < PASSAGE - BUDGET or not len(self.code):
            return []
        known = self.vocabulary
        numbers = np.fromiter((known.get(w, 0) for w in own), np.int64, len(own))
        codes = self.codes(numbers)
        first, last = np.searchsorted(self.code, codes), np.searchsorted(self.code, codes, "right")
        offsets: dict[int, set[int]] = {}
        for at in np.flatnonzero(last > first):
            for hit in range(first[at], last[at]):
                offsets.setdefault(int(self.owner[hit]), set()).add(int(at - self.place[hit]))
        found = []
        for item, shifts in offsets.items():
            for shift in sorted(shifts):
                if passage := self._passage(self.words[item], numbers, shift):
                    found.append((self.ids[item], *passage))
                    break
        return found

    @staticmethod
    def _passage(item: np.ndarray, document: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        length = len(item)
        low = shift - SHIFT
        padded = np.zeros(length + 2 * SHIFT, np.int64)
        a, b = max(0, low), min(len(document), low + len(padded))
        padded[a - low : b - low] = document[a:b]
        hits = padded[_shifted(length)] == item
        same = hits.any(axis=0)
        if same.sum() < PASSAGE - BUDGET:
            return None
        # A passage is at most one run more than it has edits, so few of its words match
        # without a neighbour: some PASSAGE words of it hold IN_RUNS that do.
        pair = hits[:, 1:] & hits[:, :-1]
        run = np.zeros(length, bool)
        run[1:] |= pair.any(axis=0)
        run[:-1] |= pair.any(axis=0)
        held = np.concatenate([[0], np.cumsum(run)])
        if (held[PASSAGE:] - held[:-PASSAGE]).max() < IN_RUNS:
            return None
        upto = np.concatenate([[0], np.cumsum(~same)])
        for size in LENGTHS:
            allowed = size // ONE_IN
            missing = upto[size:] - upto[:-size]
            for s in np.argsort(missing, kind="stable")[: np.count_nonzero(missing <= allowed)].tolist():
                region = padded[max(0, s + SHIFT - allowed) : s + size + SHIFT + allowed]
                edits, _ = least_distance(item[s : s + size].tolist(), region.tolist())
                if edits <= allowed:
                    return s, size, edits
        return None


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1].split())
        if size > BLOCK_WORDS:
            yield block
            block, size = [], 0
    yield block


def leaked(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``item_key``, ``key``, ``first_word``, ``n_words`` and ``edits`` of one leaked passage per pair."""
    pairs = None
    schema = f"{item_key} bigint, {key} bigint, first_word int, n_words int, edits int"
    rows = spread(documents.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()))
    for block in _blocks(items, item_key, item_text):
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def search(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Items(sent.value)
            for part in parts:
                out = [(i, d, *rest) for d, t in zip(part[key], part[text]) for i, *rest in index.leaks(t)]
                yield pd.DataFrame(out, columns=[item_key, key, "first_word", "n_words", "edits"])

        # What a block finds is written at once, so the workers and the driver hold one block at a time.
        found = cut_lineage(rows.mapInPandas(search, schema))
        sent.destroy()
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.dropDuplicates([item_key, key])

"""Evaluation texts leaking into training text (problem 6).

Method: a broadcast hash index of the words of all normalised test items. A window of a document proposes an item if the two
share enough words, and keeps it if the longest common subsequence has enough; both are upper bounds of what an alignment can match,
so that neither loses a case. A local alignment of the item's words with the window's decides: at least ``LEAST_SHARE`` of the item's
words in their order within one passage. If the best passage has less, what lies before and behind it is aligned as well. The
passage's place is reported, so that spans or whole documents can be taken out.

The index is broadcast in blocks of ``MOST_ITEMS`` items and ``MOST_CHARACTERS`` of their text, whatever the size of the set: a larger
set takes one pass over the documents for each block.

Defined results: null and empty texts leak nothing; of repeated items each
leaks; equal documents under other ids each give their rows; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table

#: Share of an item's words that the alignment must match.
LEAST_SHARE = 0.5
#: Items, and characters of their texts, in one broadcast index.
MOST_ITEMS, MOST_CHARACTERS = 20_000, 20_000_000
MATCH, MISMATCH, GAP = 10, -7, -5
#: Words of a passage for each word of the item at most: with more, gaps cost more than all matches give.
STRETCH = 1 + MATCH // -GAP
#: Items whose longest common subsequences are found together.
BLOCK = 32

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,60}>|\[\d+\]|​|­|⁠|﻿")
_BROKEN = re.compile(r"(?<=[^\W\d_])-\s*\n[>\s]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_ACCENT = re.compile("[\u0300-\u036f]")
_LOOKS = re.compile("[\u0370-\u04ff]")
# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһԛԝοανρτυ", "aeopcyxijsdhqwoavptu")


def words(text: str) -> list[str]:
    """Normalised words: without tags, citations, accents, line-end hyphens, and with look-alike letters in Latin words undone."""
    if "&" in text or "<" in text or "[" in text or "\n" in text:
        text = _BROKEN.sub("", _TAG.sub(" ", html.unescape(text)))
    if text.isascii():
        return _WORD.findall(text.lower())
    found = _WORD.findall(_ACCENT.sub("", unicodedata.normalize("NFKD", text.lower())))
    if _LOOKS.search(text):
        found = [w.translate(_LOOKALIKE) if any("a" <= c <= "z" for c in w) else w for w in found]
    return found


class ItemIndex:
    """Normalised items, where each word stands in them, and how often; bounded by the number of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words(t)) for i, t in items if t]
        self.items = [(i, w) for i, w in self.items if w]
        ids: dict[str, int] = {}
        self.ids = ids
        self.codes = [np.array([ids.setdefault(x, len(ids)) for x in w], np.int64) for _, w in self.items]
        self.lengths = np.array([len(w) for _, w in self.items], np.int64)
        self.step = STRETCH * int(self.lengths.max(initial=1))
        # of each item, a bit set of the places of each word
        self.bits: list[dict[int, int]] = []
        # of each word, in which items it stands and how often: a slice of two flat arrays
        holders: list[list[tuple[int, int]]] = [[] for _ in ids]
        for k, c in enumerate(self.codes):
            bits: dict[int, int] = {}
            for j, x in enumerate(c.tolist()):
                bits[x] = bits.get(x, 0) | 1 << j
            self.bits.append(bits)
            for x, b in bits.items():
                holders[x].append((k, b.bit_count()))
        self.sizes = np.array([len(v) for v in holders], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        flat = [x for v in holders for x in v]
        self.item_of = np.array([k for k, _ in flat], np.int64)
        self.times = np.array([n for _, n in flat], np.int64)
        # items with the same commonest word side by side, so that those of a language share blocks
        common = [int(c[np.argmax(self.sizes[c])]) for c in self.codes]
        order = sorted(range(len(common)), key=lambda k: (common[k], k))
        self.blocks = [self._joined(order[i : i + BLOCK]) for i in range(0, len(order), BLOCK)]

    def _joined(self, members: list[int]) -> tuple[dict[int, int], dict[int, int], int]:
        """(first bit of each item, bit set of each word, all places) of a block of items, a free bit behind each."""
        firsts, bits, full, at = {}, {}, 0, 0
        for k in members:
            firsts[k] = at
            full |= (1 << len(self.codes[k])) - 1 << at
            for x, b in self.bits[k].items():
                bits[x] = bits.get(x, 0) | b << at
            at += len(self.codes[k]) + 1
        return firsts, bits, full

    def leaks(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, share of its words found, first word, last word) of each item in ``text``; its fullest passage."""
        w = words(text)
        codes = np.fromiter((self.ids.get(x, -1) for x in w), np.int64, len(w))
        best: dict[int, tuple[int, int, int]] = {}
        # a passage is at most ``step`` words long, so that each lies within one of the windows
        for start in range(0, max(1, len(codes) - self.step), self.step):
            window = codes[start : start + 2 * self.step]
            for k in self._proposed(window):
                for matched, a, z in self._passages(k, window, start):
                    if k not in best or matched > best[k][0]:
                        best[k] = matched, a, z
        return [(self.items[k][0], round(m / len(self.codes[k]), 4), a, z) for k, (m, a, z) in sorted(best.items())]

    def _proposed(self, window: np.ndarray) -> list[int]:
        """Items of which the window has enough words, each counted as often as both have it, and enough of them in order."""
        known, often = np.unique(window[window >= 0], return_counts=True)
        sizes = self.sizes[known]
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(self.firsts[known], sizes) + inside
        shared = np.bincount(self.item_of[at], np.minimum(self.times[at], np.repeat(often, sizes)), len(self.items))
        enough = set(np.flatnonzero(shared >= LEAST_SHARE * self.lengths).tolist())
        out, text = [], window.tolist() if enough else []
        for firsts, bits, full in self.blocks if enough else ():
            if here := enough & firsts.keys():
                left = unmatched(bits, full, text)
                for k in here:
                    length = len(self.codes[k])
                    if length - (left >> firsts[k] & (1 << length) - 1).bit_count() >= LEAST_SHARE * length:
                        out.append(k)
        return out

    def _passages(self, k: int, part: np.ndarray, start: int) -> list[tuple[int, int, int]]:
        """(matched, first word, last word) of the passages of ``part`` that hold item ``k``; what a short one leaves is searched too."""
        out, parts, item = [], [(start, part)], self.codes[k]
        while parts:
            at, rest = parts.pop()
            if not self._dense(k, rest):
                continue
            matched, a, z = align(item, rest)
            if matched >= LEAST_SHARE * len(item):
                out.append((matched, at + a, at + z))
            elif matched:
                parts += [(at, rest[:a]), (at + z + 1, rest[z + 1 :])]
        return out

    def _dense(self, k: int, part: np.ndarray) -> bool:
        """Whether enough words stand in order so near that the alignment's first ``LEAST_SHARE`` may be there: no start of a best one scores less than 0."""
        length = len(self.codes[k])
        need, hop, text = LEAST_SHARE * length, max(1, length // 4), part.tolist()
        full, span = (1 << length) - 1, STRETCH * -int(-need // 1)
        return any(length - unmatched(self.bits[k], full, text[i : i + span + hop]).bit_count() >= need for i in range(0, max(1, len(text) - span), hop))


def unmatched(bits: dict[int, int], full: int, text: list[int]) -> int:
    """The places of an item, or of a block of items, that its longest common subsequence with ``text`` leaves; one addition a word."""
    left = full
    for b in map(bits.get, text):
        if b:
            hit = left & b
            left = (left + hit | left - hit) & full
    return left


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: matched words, and the first and last word of ``text`` in it.

    The score, the number of matches and the start are packed into one integer, so that a row is a few array operations.
    """
    m = len(text)
    if not m or not len(item):
        return 0, 0, 0
    # matches and starts share 34 bits; integers of any size where a text is too long for that
    wide = max(m, len(item)).bit_length()
    kind = np.int64 if wide <= 17 else object
    unit, start_bits = (1 << 34, 1 << 17) if wide <= 17 else (1 << 2 * wide, 1 << wide)
    starts = np.arange(m).astype(kind)
    steps = np.arange(m + 1).astype(kind) * (-GAP * unit)
    row = np.zeros(m + 1, kind)
    top, end = 0, 0
    for x in item:
        hit = text == x
        fresh = row[:-1] < unit
        base = np.where(fresh, starts, row[:-1])
        new = np.empty(m + 1, kind)
        new[0] = 0
        new[1:] = np.where(hit, base + MATCH * unit + start_bits, row[:-1] + MISMATCH * unit)
        np.maximum(new[1:], row[1:] + GAP * unit, out=new[1:])
        new = np.maximum.accumulate(new + steps) - steps
        new[new < unit] = 0
        row = new
        j = int(row.argmax())
        if row[j] // unit > top // unit:
            top, end = int(row[j]), j - 1
    return (top % unit) // start_bits, top % start_bits, end


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> (doc_id, item_id, share, first_word, last_word); one Arrow pass over the documents for each block of items."""
    known = items.where("text is not null").select("item_id", "text").dropDuplicates()
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0]
    blocks = max(1, -(-2 * n // MOST_ITEMS), -(-2 * size // MOST_CHARACTERS)) if n > MOST_ITEMS or size > MOST_CHARACTERS else 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = [_searched(documents, [(r["item_id"], r["text"]) for r in known.where(of == b).collect()]) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _searched(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """The leaks of one block of items."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(ItemIndex(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(shared.value)
        for batch in batches:
            out = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for x in index.leaks(t)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "item_id", "share", "first_word", "last_word"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, share double, first_word int, last_word int")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item fully or by half, with the item."""
    found = leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "test_items"))
    return found.select("doc_id", "item_id").dropDuplicates()


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the documents that hold a test item: (doc_id, text) of every other document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.join(leaks(spread(documents), table(spark, sf_dir, "test_items")).select("doc_id").distinct(), "doc_id", "left_anti")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, into how many documents, and how fully at most."""
    items = table(spark, sf_dir, "test_items")
    found = leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), items)
    per_item = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("share").alias("largest_share"))
    return items.select("item_id", "lang").join(per_item, "item_id", "left").select("item_id", "lang", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("largest_share", F.lit(0.0)).alias("largest_share"))

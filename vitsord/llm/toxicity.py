"""Abusive, hateful or sexual content (problem 8).

Method: compression-distance classification. Separate zstandard dictionaries are trained on ordinary text and on the text of each
category; a window (a sentence) that compresses better with a category's dictionary than with the ordinary one, relative to its
ordinary length, has that gain as its score, and a document has the score of its highest window. Thresholds are calibrated on
labelled documents that the dictionaries have not seen.

Labels are of whole documents, so the windows that train a category are found first: windows of its documents that the ordinary
dictionary does not cover and whose word pairs stand far more often in documents of the category than in ordinary ones.

Fit: on at most ``FIT_DOCS`` labelled documents, chosen by hash. Every document is scored whole, once per distinct window.

Defined results: null and empty texts score 0 in every category; labels that are null or of unknown documents are ignored; equal
texts under other ids score alike; without labelled documents every score is 0; empty tables give empty results; further columns are
ignored. Spaced, starred, doubled and mixed-case spellings are undone before compression as far as the letters are there.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from .mixing import clean_source

CATEGORIES = ("abusive", "hateful", "sexual")
#: Most labelled documents the dictionaries are trained on.
FIT_DOCS = 12_000
#: Share of its length above which a window is not covered by the ordinary dictionary, and lifts of ordinary and of toxic windows.
UNCOVERED, ORDINARY_LIFT, TOXIC_LIFT = 0.3, 0.92, 0.92
#: Characters below which a sentence is read together with the next one.
SHORTEST = 16
#: Characters above which it is read in overlapping runs of words.
LONGEST = 170
LEVEL = 12
ORDINARY_BYTES, REST_BYTES, CATEGORY_BYTES = 220_000, 300_000, 80_000

_SENTENCE = re.compile(r"(?<=[^\W\d_]{2}[.!?…])[\"”»’)\]]*\s+|(?<=[。！？؟।!?])[\"”»’)\]]*\s+|\n+|(?<=[a-zåäö][.!?])(?=[A-ZÅÄÖ])|(?<=[。！？।])")
_HIDDEN = re.compile("[​‌‍­⁠﻿]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_NUMBER = re.compile(r"\d+(?:[.,\s]\d+)*")
_LEET = re.compile(r"(?<=[a-zåäö])[@01345$](?!\d)(?=[a-zåäö@$\s.,]|$)|(?<![\w$@])[@$0345](?=[a-zåäö]{3})|(?<=[a-zåäö])!(?=[a-zåäö])")
_LEET_LETTERS = {"@": "a", "0": "o", "1": "i", "3": "e", "4": "a", "$": "s", "!": "i", "5": "s"}


def windows(text: str | None) -> list[str]:
    """The sentences of a text, normalised, in reading order."""
    if not text:
        return []
    out, short = [], ""
    for s in _SENTENCE.split(_HIDDEN.sub("", unicodedata.normalize("NFKC", text))):
        if s and not s.isspace():
            s = short + s
            if len(s) < SHORTEST:  # too little to compress: read together with what follows
                short = s + " "
            else:
                out += _parts(normalised(s))
                short = ""
    if short:
        out.append(normalised(short))
    return out


def _parts(window: str) -> list[str]:
    """A long stretch without sentence marks as overlapping runs of words, so that a short insult in it is not outweighed."""
    if len(window) <= LONGEST:
        return [window]
    words = window.split()
    if len(words) < 18:
        return [window]
    return [" ".join(words[i : i + 14]) for i in range(0, len(words) - 7, 7)]


def normalised(sentence: str) -> str:
    s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), sentence).lower()
    s = _LEET.sub(lambda m: _LEET_LETTERS[m.group()], s)
    s = _NUMBER.sub("0", _REPEATED.sub(r"\1", s))
    return " ".join(s.split())


def _dictionary(samples: list[str], size: int) -> bytes:
    """A trained dictionary; of too little text for training, the text itself."""
    data = [x.encode() for x in samples]
    if sum(map(len, data)) > 2 * size and len(data) > 50:
        try:
            return zstandard.train_dictionary(size, data, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(data)[-size:]


class Compressors:
    """One compressor for each dictionary; lengths of windows with it."""

    def __init__(self, dictionaries: list[bytes]):
        self.dictionaries = dictionaries
        self._ready: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> list[bytes]:
        return self.dictionaries

    def __setstate__(self, state: list[bytes]) -> None:
        self.__init__(state)

    def lengths(self, window: str) -> list[int]:
        if self._ready is None:
            self._ready = []
            for d in self.dictionaries:
                kind = zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                data = zstandard.ZstdCompressionDict(d or b"        ", dict_type=kind)
                data.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        raw = window.encode()
        return [len(c.compress(raw)) for c in self._ready]


class ToxicModel:
    """Dictionaries of ordinary text and of the categories, and a threshold for each category."""

    def __init__(self, compressors: Compressors | None, thresholds: list[float]):
        self.compressors, self.thresholds = compressors, thresholds
        self.cache: dict[str, tuple[float, ...]] = {}

    def gains(self, window: str) -> tuple[float, ...]:
        """Of each category, how much shorter its dictionary makes the window; only the best category gains."""
        found = self.cache.get(window)
        if found is None:
            ordinary, *others = self.compressors.lengths(window)
            best = min(others)
            found = tuple(max(0.0, (ordinary - x) / (ordinary + 10.0)) if x == best else 0.0 for x in others)
            if len(self.cache) < 100_000:
                self.cache[window] = found
        return found

    def scores(self, text: str | None) -> list[float]:
        """The document's score in each category."""
        best = [0.0] * len(CATEGORIES)
        if self.compressors is None:
            return best
        for w in windows(text):
            for k, g in enumerate(self.gains(w)):
                if g > best[k]:
                    best[k] = g
        return [round(x, 4) for x in best]


def _grams(window: str) -> set[str]:
    """Word pairs, or letters by threes where there are few spaces."""
    words = window.split()
    if len(words) < 3:
        return {window[i : i + 3] for i in range(max(1, len(window) - 2))}
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


class Lift:
    """How much more often a window's grams stand in documents of a category than in ordinary ones."""

    def __init__(self, documents: list[tuple[list[str], frozenset[str]]]):
        self.counts: dict[str, Counter] = {c: Counter() for c in ("none", "any", *CATEGORIES)}
        self.sizes: Counter = Counter()
        for found, labels in documents:
            grams = {g for w in found for g in _grams(w)}
            kinds = ["none"] if labels <= {"none"} else ["any", *(c for c in CATEGORIES if c in labels)]
            for k in kinds:
                self.sizes[k] += 1
                self.counts[k].update(grams)

    def toxic(self, window: str, own: int = 0) -> float:
        """Near 1 for what stands in toxic documents only, 0.5 for what stands anywhere; ``own`` toxic documents are left out."""
        r = self.sizes["any"] / max(1, self.sizes["none"])
        t, o = self.counts["any"], self.counts["none"]
        parts = sorted((max(0, t[g] - own) + r / 2) / (max(0, t[g] - own) + r / 2 + (o[g] + 0.5) * r) for g in _grams(window))
        parts = parts[len(parts) // 2 :]  # the more telling half: a toxic sentence also has common words
        return sum(parts) / len(parts)

    def category(self, window: str) -> int:
        """The category in whose documents the window's grams are most frequent."""
        grams = _grams(window)
        return int(np.argmax([sum(self.counts[c][g] for g in grams) / max(1, self.sizes[c]) for c in CATEGORIES]))


def _novelty(base: Compressors) -> Callable[[str], float]:
    empty = base.lengths("")[0]
    return lambda w: (base.lengths(w)[0] - empty) / (len(w.encode()) + 1)


def _ordinary(known: list[str], rng: np.random.Generator) -> bytes:
    """The ordinary dictionary: what training picks, and of what that does not cover, as of rare languages, samples until little is left."""
    content = _dictionary(known, ORDINARY_BYTES)
    for _ in range(6):
        novelty = _novelty(Compressors([content]))
        rest = [w for w in known if novelty(w) > UNCOVERED]
        if len(content) > ORDINARY_BYTES + REST_BYTES or len(rest) < 5:
            break
        some = rng.choice(len(rest), min(len(rest), 400), replace=False)
        content = "\n".join(rest[i] for i in sorted(some)).encode() + b"\n" + content
    return content


def fit_model(labelled: list[tuple[str, frozenset[str]]]) -> ToxicModel:
    """From (text, labels) of documents; labels may be wrong and leave categories out."""
    train = [(windows(t), labels) for i, (t, labels) in enumerate(labelled) if i % 4]
    held = [(t, labels) for i, (t, labels) in enumerate(labelled) if i % 4 == 0]
    if not any(labels <= {"none"} for _, labels in train) or not any(labels & set(CATEGORIES) for _, labels in train):
        return ToxicModel(None, [2.0] * len(CATEGORIES))
    lift = Lift(train)
    # a document rated as ordinary by mistake must not bring its windows into the ordinary dictionary
    known = sorted({w for found, labels in train if labels <= {"none"} for w in found if lift.toxic(w) < ORDINARY_LIFT})
    base = _ordinary(known, np.random.default_rng(5))
    novelty = _novelty(Compressors([base]))
    sides: list[set[str]] = [set() for _ in CATEGORIES]
    for found, labels in train:
        if not labels <= {"none"}:
            for w in found:
                if lift.toxic(w, own=1) > TOXIC_LIFT and novelty(w) > UNCOVERED:
                    sides[lift.category(w)].add(w)
    model = ToxicModel(Compressors([base, *(_dictionary(sorted(s), CATEGORY_BYTES) for s in sides)]), [0.2] * len(CATEGORIES))
    for k, c in enumerate(CATEGORIES):
        # a document with another category's label may have this one too, unlabelled: it is no counterexample
        cases = [(model.scores(t)[k], c in labels) for t, labels in held if c in labels or labels <= {"none"}]
        model.thresholds[k] = _calibrated(cases)
    model.cache.clear()
    return model


def _calibrated(cases: list[tuple[float, bool]]) -> float:
    """The threshold of the best F1; the middle of equally good ones."""
    best, at = -1.0, [0.2]
    for t in np.arange(0.08, 0.6, 0.01):
        tp = sum(y for s, y in cases if s >= t)
        f1 = 2 * tp / max(1, sum(s >= t for s, _ in cases) + sum(y for _, y in cases))
        if f1 > best + 1e-9:
            best, at = f1, [t]
        elif abs(f1 - best) <= 1e-9:
            at.append(t)
    return float(np.median(at))


def fit(spark: SparkSession, sf_dir: str) -> ToxicModel:
    labels = table(spark, sf_dir, "content_labels").where("label is not null").groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    n = labels.count()
    if n > FIT_DOCS:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * FIT_DOCS / n))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    rows = documents.join(labels, "doc_id").select("doc_id", "text", "labels").collect()
    return fit_model([(r["text"], frozenset(r["labels"])) for r in sorted(rows, key=lambda r: r["doc_id"])])


def scored(documents: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, text) -> (doc_id, scores), in the order of ``CATEGORIES``; one Arrow pass."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            found = [m.scores(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "scores"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, scores array<double>")


def _flags(model: ToxicModel) -> list:
    return [(F.get("scores", F.lit(k)) >= F.lit(t)).alias(c) for k, (c, t) in enumerate(zip(CATEGORIES, model.thresholds))]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and category whose content it utters."""
    model = fit(spark, sf_dir)
    found = scored(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), model)
    hits = F.array_compact(F.array(*(F.when(f, F.lit(c)) for f, c in zip(_flags(model), CATEGORIES))))
    return found.select("doc_id", F.explode(hits).alias("category"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score in each category."""
    found = scored(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), fit(spark, sf_dir))
    return found.select("doc_id", *(F.get("scores", F.lit(k)).alias(c) for k, c in enumerate(CATEGORIES)))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source (one spelling; unknown ones together), documents and the share of each category."""
    model = fit(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(clean_source("source"), F.lit("unknown")).alias("source"), "text")
    flags = scored(spread(documents), model).select("doc_id", *_flags(model))
    both = documents.select("doc_id", "source").join(flags, "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("documents"), *(F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate") for c in CATEGORIES))

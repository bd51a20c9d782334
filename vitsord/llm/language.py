"""Missing or wrong language labels, for whole questions and for the segments of mixed ones (problem 2).

Method: nearest-centroid classification. A piece of text is a normalised TF-IDF vector of hashed letter n-grams and words; each
language has several centroids (spherical k-means over cleaned labelled pieces); the cosine to the nearest one decides, and a piece
that lies farther from every centroid than the language's own pieces do is rejected: it makes no segment, and a question of
rejected pieces alone is ``und``. The pieces of a question are joined to segments by dynamic programming with a cost for each
change of language, so that names, numbers and single borrowed words make none.

Fit: on at most ``FIT_DOCUMENTS`` and ``FIT_QUESTIONS`` labelled texts, chosen by hash; nothing else is bounded. Labels may be
wrong: a piece has the label of most of its occurrences, stays only if most nearly equal pieces have it too, and, where these are
few, only while that label's mean, without the piece itself, is about the nearest. All labels weigh the same in means and
document frequencies, however many rows they have, so neither a large neighbour nor stray foreign rows can take over a small one.

Defined results: a null, empty or wordless question is one segment ``und`` with confidence 0; equal rows count once; empty
tables give empty results; further columns are ignored. Ties between languages go to the first in ``LANGUAGES``.
"""

from __future__ import annotations

import math
import pickle
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table

#: Most labelled documents and evaluation questions that the centroids are fitted on.
FIT_DOCUMENTS, FIT_QUESTIONS = 4000, 6000
#: Pieces for one centroid, and most centroids of a language beside its mean.
PER_CENTROID, CENTROIDS = 40, 16
#: A labelled piece stays while its own label's mean is at least so near, against the nearest other one.
NEAR = 0.7
#: How many times a word counts beside its n-grams.
WORD = 3
#: Hash buckets of the features.
BUCKETS = 1 << 16
#: Cosine from which labelled pieces are nearly equal, and their votes from which a label is taken as known.
ALIKE, VOTES = 0.75, 4
#: Share of the usual cosine of a language's own pieces below which a piece is rejected.
REJECT = 0.05
#: Cost of a change of language in cosine times letters, by the break before the piece.
COST = {"inside": 6.0, "end": 3.5, "script": 2.5, "mark": 2.5, "quote": 0.2}
#: Weight of a feature that no two labelled pieces have, against the median of the others.
UNKNOWN = 0.3
#: Letters of a piece that count.
FULL = 80
#: Rows of features that are multiplied at once.
CHUNK = 60_000

LANGUAGES = "en sv nb da fi de es pl so ar fa uk zh ja th hi".split()

# Names and codes of the languages (ISO 639-1, 639-2, 639-3, English and own names).
NOTATIONS = {
    "en": "en eng english engelska engelsk englisch inglés",
    "sv": "sv swe swedish svenska svensk schwedisch sueco",
    "nb": "nb no nob nor nn nno norwegian norska norsk bokmål bokmal norwegisch",
    "da": "da dan danish danska dansk dänisch",
    "fi": "fi fin finnish finska suomi finnisch",
    "de": "de deu ger german tyska tysk deutsch",
    "es": "es spa spanish spanska spansk español espanol castellano",
    "pl": "pl pol polish polska polski",
    "so": "so som somali somaliska soomaali af-soomaali",
    "ar": "ar ara arb arabic arabiska العربية عربي",
    "fa": "fa fas per pes prs persian farsi dari persiska فارسی",
    "uk": "uk ukr ukrainian ukrainska українська",
    "zh": "zh zho chi cmn chinese kinesiska mandarin 中文 汉语 漢語",
    "ja": "ja jpn japanese japanska 日本語",
    "th": "th tha thai thailändska ไทย ภาษาไทย",
    "hi": "hi hin hindi हिन्दी हिंदी",
}

_CONTACT = regex.compile(
    r"<?[\w.+-]+\s*(?:@|[\[(]\s*at\s*[\])]| at )\s*[\w-]+(?:\s*(?:\.(?=\w)|[\[(]\s*dot\s*[\])]| dot )\s*[\w-]+)+>?|(?:https?://|www\.)[!-~]+|\[\p{Lu}+\]"
)
_SCRIPTS = ("Latin", "Arabic", "Cyrillic", "Han}\\p{Hiragana}\\p{Katakana", "Thai", "Devanagari}\\p{Mn}\\p{Mc")
_BREAKS = r"(?P<end>[.!?؟…][\"'”»“)\]]?\s+|[。！？।])|(?P<mark>\n+|\s[-–—/|]\s|[()（）])"
_SPLIT = regex.compile(_BREAKS)
_SPLIT_SCRIPTS = regex.compile(
    _BREAKS
    + "|(?P<script>"
    + "|".join(f"(?<=[\\p{{{a}}}])[\\s,]+(?=[\\p{{{b}}}])" for a in _SCRIPTS for b in _SCRIPTS if a != b).replace("\\\\p", "\\p")
    + ")"
)
_LATIN = regex.compile(r"\p{Latin}")
_INITIAL = regex.compile(r"\b\p{Lu}$")
_OTHER_SCRIPT = regex.compile(r"[\p{L}--\p{Latin}]", regex.V1)
_QUOTED = regex.compile(r"\"([^\"\n]+)\"|[“”]([^“”\n]+)[“”]|„([^„“”\n]+)[“”]|«([^«»\n]+)»|»([^«»\n]+)«|「([^「」\n]+)」")
_WORD = regex.compile(r"[\p{L}\p{M}'’‌]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_MARKS = regex.compile(r"\p{Mn}+")
_CLOSED = regex.compile(r"[.!?؟…。！？।]\s*$")

#: (words of a clause, the break before it, the clause whose sentence goes on in it or -1)
Piece = tuple[list[str], str, int]


def _inside(words: list[str], kind: str) -> Iterator[tuple[list[str], str]]:
    """A clause cut once more where a capital may open a sentence after one without a mark: between small words, three before, four from it on."""
    at = 0
    for i in range(3, len(words) - 3):
        if i - at >= 3 and words[i][0].isupper() and words[i - 1].islower() and words[i + 1].islower():
            yield words[at:i], kind
            at, kind = i, "inside"
    yield words[at:], kind


def _clauses(text: str, kind: str) -> list[tuple[list[str], str]]:
    """Clauses with words of a stretch without quotations; ``kind`` is the break before the first."""
    out, at, pending = [], 0, kind
    order = ("script", "end", "mark", "quote")
    for m in (_SPLIT_SCRIPTS if _OTHER_SCRIPT.search(text) and _LATIN.search(text) else _SPLIT).finditer(text):
        if text[m.start()] == "." and _INITIAL.search(text, max(at, m.start() - 2), m.start()):
            continue  # a name's first letter
        words = _WORD.findall(text[at : m.start()])
        if words:
            out += _inside(words, pending)
            pending = m.lastgroup
        else:
            pending = max(pending, m.lastgroup, key=order.index)
        at = m.end()
    words = _WORD.findall(text[at:])
    if words:
        out += _inside(words, pending)
    return out


def pieces(text: str | None) -> list[Piece]:
    """The clauses of a question in reading order, without contact details; both sides of a quotation inside a sentence are tied."""
    if not text:
        return []
    text = unicodedata.normalize("NFC", text)
    if any(x in text for x in ("@", "[", "(", "www.", "://", " at ")):
        text = _CONTACT.sub(" ", text)
    out: list[Piece] = []
    at, kind, open_ = 0, "end", -1  # open_: the clause before a quotation, where its sentence is not closed there

    def add(stretch: str, kind: str, open_: int) -> None:
        for j, (words, k) in enumerate(_clauses(stretch, kind)):
            out.append((words, k, open_ if j == 0 else -1))

    for m in _QUOTED.finditer(text):
        inside = m.group()[1:-1]
        words = _WORD.findall(inside)
        if len(words) < 2 and not (words and _CJK.search(words[0]) and len(words[0]) > 3):
            continue  # a quoted single word belongs to its sentence
        before = text[at : m.start()]
        add(before, kind, open_)
        open_ = len(out) - 1 if _WORD.search(before) and not _CLOSED.search(before) else -1
        add(inside, "quote", -1)
        at, kind = m.end(), "quote"
    add(text[at:], kind, open_)
    return out


def _no_names(words: list[str]) -> list[str]:
    """Words without the capitalised ones inside the clause, where most are small."""
    small = [w for i, w in enumerate(words) if i == 0 or len(w) == 1 or not w[0].isupper()]
    return small if len(small) >= 3 and 2 * len(small) >= len(words) else words


def whole(parts: list[Piece]) -> list[list[str]]:
    """The words each clause is judged by: without names, and both sides of a quotation as one."""
    joined = {i: parts[i][0] + words for words, _, i in parts if i >= 0}
    return [_no_names(joined[tied] if tied >= 0 else joined.get(j, words)) for j, (words, _, tied) in enumerate(parts)]


def plain(text: str) -> str:
    """``text`` as typed on a keyboard without its accents."""
    return _MARKS.sub("", unicodedata.normalize("NFD", text)).replace("ø", "o").replace("æ", "ae").replace("ł", "l").replace("ß", "ss")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rows:
    """Sparse rows: ``bucket`` and ``count`` of each feature, ``start`` of each row; built for many texts at once."""

    def __init__(self, bucket: np.ndarray, count: np.ndarray, start: np.ndarray):
        self.bucket, self.count, self.start = bucket, count, start
        self.n = len(start) - 1
        self.row = np.repeat(np.arange(self.n), np.diff(start))

    def some(self, which: np.ndarray) -> Rows:
        length = np.diff(self.start)[which]
        start = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.start[which] - start[:-1], length) + np.arange(start[-1])
        return Rows(self.bucket[at], self.count[at], start)


def features(texts: list[str]) -> Rows:
    """Letter n-grams within words (of two and three letters, of one outside Latin) and whole words, hashed into ``BUCKETS``.

    Each text is words with one space between; a space also stands for the end of a word in its n-grams.
    """
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    a = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    letter = a != 32
    keys, rows = [], []

    def take(mask: np.ndarray, hashed: np.ndarray) -> None:
        rows.append(row[: len(mask)][mask])
        keys.append(_mixed(hashed) >> np.uint64(64 - BUCKETS.bit_length() + 1))

    if len(a) >= 3:
        m = (letter[:-1] | letter[1:]) & (row[:-1] == row[1:])
        take(m, (a[:-1][m] << np.uint64(21)) | a[1:][m] | np.uint64(1 << 62))
        m = letter[1:-1]
        take(m, (a[:-2][m] << np.uint64(42)) ^ (a[1:-1][m] << np.uint64(21)) ^ a[2:][m] ^ np.uint64(1 << 63))
        m = a >= 0x250
        take(m, a[m])
        first = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        if len(first):
            at = np.arange(len(a), dtype=np.int64)
            begin = np.zeros(len(a), np.int64)
            begin[first] = first
            place = (at - np.maximum.accumulate(begin)).astype(np.uint64)
            word = np.add.reduceat(np.where(letter, _mixed(a | (place << np.uint64(24))), np.uint64(0)), first)
            spaced = ~(((a[first] >= 0x0E00) & (a[first] < 0x0E80)) | (a[first] >= 0x3040))
            bucket = _mixed(word[spaced]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
            for _ in range(WORD):
                keys.append(bucket)
                rows.append(row[first][spaced])
    key = np.concatenate(rows) * np.uint64(BUCKETS) + np.concatenate(keys) if keys else np.empty(0, np.uint64)
    key, count = np.unique(key, return_counts=True)
    return Rows((key % np.uint64(BUCKETS)).astype(np.int64), count, np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) * np.uint64(BUCKETS)))


def weighted(rows: Rows, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of all features, each row of length 1."""
    w = ((1 + np.log(rows.count)) * idf[rows.bucket]).astype(np.float32)
    norm = np.sqrt(np.bincount(rows.row, w * w, rows.n))
    return w / np.maximum(1e-9, norm)[rows.row].astype(np.float32)


def cosines(rows: Rows, w: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosine of each row to each column of ``centroids`` (buckets by centroids)."""
    out = np.zeros((rows.n, centroids.shape[1]), np.float32)
    length = np.diff(rows.start)
    order = np.argsort(length, kind="stable")
    at = int(np.searchsorted(length[order], 1))
    while at < rows.n:
        upto = at + 1
        while upto < rows.n and (upto + 1 - at) * length[order[upto]] <= CHUNK:
            upto = min(rows.n, max(upto + 1, at + CHUNK // int(length[order[upto]]) // 2))
        some = order[at:upto]
        wide = np.arange(length[some[-1]])
        there = wide < length[some][:, None]
        feature = np.where(there, rows.start[some][:, None] + wide, 0)
        out[some] = np.matmul(np.where(there, w[feature], 0)[:, None, :], centroids[rows.bucket[feature]])[:, 0]
        at = upto
    return out


class LanguageModel:
    def __init__(self, idf: np.ndarray, centroids: np.ndarray, owners: np.ndarray, usual: np.ndarray):
        self.idf, self.centroids, self.owners = idf, centroids, owners
        #: Usual cosine of each language's own pieces to their nearest centroid.
        self.usual = usual
        #: Where the centroids of each language begin; they lie together.
        self.starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))

    def similarities(self, texts: list[str]) -> np.ndarray:
        """Cosine to the nearest centroid of each language; zeros for a text that is rejected."""
        rows = features(texts)
        found = cosines(rows, weighted(rows, self.idf), self.centroids)
        out = np.zeros((len(texts), len(LANGUAGES)))
        out[:, self.owners[self.starts]] = np.maximum.reduceat(found, self.starts, axis=1)
        top = out.argmax(axis=1)
        out[out[np.arange(len(texts)), top] < REJECT * self.usual[top]] = 0
        return out

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """(language, confidence) of each segment in reading order, for every text."""
        parts = [pieces(t) for t in texts]
        judged, places = {}, []
        for p in parts:
            places.append([(judged.setdefault(" ".join(words).lower(), len(judged)), words) for words in whole(p)])
        cosine = self.similarities(list(judged)) if judged else np.zeros((0, len(LANGUAGES)))
        top = cosine.argmax(axis=1).tolist()
        best, second = np.sort(cosine, axis=1)[:, :-3:-1].T if judged else (np.zeros(0), np.zeros(0))
        sure = np.round(np.minimum(1, (best - second) / np.maximum(1e-9, best) * 2), 4).tolist()
        one = [[(LANGUAGES[k], c) if b else ("und", 0.0)] for k, c, b in zip(top, sure, best)]
        return [self._joined(p, here, cosine) if len(p) > 1 else list(one[here[0][0]]) if p else [("und", 0.0)] for p, here in zip(parts, places)]

    def _joined(self, parts: list[Piece], places: list[tuple[int, list[str]]], cosine: np.ndarray) -> list[tuple[str, float]]:
        weight = np.empty(len(parts))
        for i, (_, words) in enumerate(places):
            letters = sum(map(len, words)) * (3 if _CJK.search(words[0]) else 1)
            # a name or borrowed word is too little for a segment of its own
            weight[i] = 0.05 if len(words) < 2 and letters < 16 else min(letters, FULL)
        at = [i for i, _ in places]
        score = weight[:, None] * cosine[at]
        tops = score.argmax(axis=1).tolist()
        seen = {k for k, (i, _) in zip(tops, places) if cosine[i, k] > 0}
        if not seen:
            return [("und", 0.0)]
        if len(seen) == 1:
            path = list(seen) * len(parts)
        else:
            best, back = score[0].copy(), np.zeros(score.shape, np.int64)
            for i in range(1, len(parts)):
                jump, cost = int(best.argmax()), COST[parts[i][1]]
                stay = best >= best[jump] - cost
                back[i] = np.where(stay, np.arange(len(best)), jump)
                best = np.where(stay, best, best[jump] - cost) + score[i]
            path = [int(best.argmax())]
            for i in range(len(parts) - 1, 0, -1):
                path.append(int(back[i][path[-1]]))
            path.reverse()
        out, start = [], 0
        for i in range(1, len(parts) + 1):
            if i == len(parts) or path[i] != path[start]:
                total = score[start:i].sum(axis=0).tolist()
                top = total.pop(path[start])
                out.append((LANGUAGES[path[start]], round(max(0.0, min(1.0, (top - max(total)) / top * 2)), 4) if top > 0 else 0.0))
                start = i
        return out


def _means(rows: Rows, w: np.ndarray, owners: np.ndarray, keep: np.ndarray, k: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised mean vector of each owner's kept rows, as columns, and the lengths of the sums."""
    of = owners[rows.row]
    on = keep[rows.row]
    if times is not None:
        w = w * times[rows.row]
    sums = np.bincount(rows.bucket[on] * k + of[on], w[on], BUCKETS * k).reshape(BUCKETS, k)
    size = np.maximum(1e-9, np.sqrt((sums * sums).sum(axis=0)))
    return (sums / size).astype(np.float32), size


def fit_model(labelled: list[tuple[str, str]]) -> LanguageModel:
    """Centroids from (language, text) pairs, some of them wrongly labelled."""
    votes: dict[str, Counter] = {}
    for lang, text in labelled:
        for words in whole(pieces(text)):
            if len(words) >= 3 or _CJK.search("".join(words)):
                votes.setdefault(" ".join(words).lower(), Counter())[LANGUAGES.index(lang)] += 1
    # the same piece under several labels has the label of most of its occurrences
    owned = sorted((k, piece, n) for piece, v in votes.items() for k, n in v.items() if n == max(v.values()))
    owners, times = np.array([k for k, _, _ in owned], np.int64), np.array([n for _, _, n in owned], np.float32)
    k = len(LANGUAGES)
    if not owned:  # no labelled piece: nothing is near
        return LanguageModel(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.int64), np.ones(k))
    rows = features([plain(t) if i % 4 == 3 else t for i, (_, t, _) in enumerate(owned)])
    rng = np.random.default_rng(7)
    agree, known = _alike(rows, owners, times, rng)
    keep, few = agree, np.bincount(owners[agree], minlength=k)[owners] < 4  # too few pieces to be held against each other
    for turn in range(6):
        idf = _class_weights(rows, owners, keep, turn > 1)
        w = weighted(rows, idf)
        means, size = _means(rows, w, owners, keep, k)
        found = cosines(rows, w, means)
        own = found[np.arange(rows.n), owners] - np.where(keep, 1 / size[owners], 0)  # a piece is no evidence for its own label
        found[np.arange(rows.n), owners] = 0
        agreeing = agree & (known | few | (own > found.max(axis=1) * (NEAR if turn > 2 else 1)))
        if turn > 3 and (agreeing == keep).all():
            break
        keep = agreeing
    centroids, languages, usual = [], [], np.ones(k)
    for lang in range(k):
        which = np.flatnonzero(keep & (owners == lang))
        if not len(which):
            continue
        own = rows.some(which)
        v = weighted(own, idf)
        every, often = np.ones(own.n, bool), np.sqrt(times[which])
        c = mean = _means(own, v, np.zeros(own.n, np.int64), every, 1, often)[0]
        n = min(CENTROIDS, max(own.n // PER_CENTROID, own.n // 4 if own.n < 16 else 4))
        if n > 1:
            at = rng.permutation(own.n) % n
            for _ in range(8):
                c = _means(own, v, at, every, n, often)[0]
                at = cosines(own, v, c).argmax(axis=1)
            # the mean of all pieces stands beside the clusters, for pieces that lie between them
            c = np.concatenate([c[:, np.bincount(at, minlength=n) > 2], mean], axis=1)
        usual[lang] = float(np.median(cosines(own, v, c).max(axis=1)))
        centroids.append(c)
        languages += [lang] * c.shape[1]
    if not centroids:
        return fit_model([])
    return LanguageModel(idf.astype(np.float32), np.ascontiguousarray(np.concatenate(centroids, axis=1)), np.array(languages), usual)


def _alike(rows: Rows, owners: np.ndarray, times: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Votes of nearly equal pieces: where a piece's label has most of them, and where it has many.

    Nearly equal pieces are one sentence with other words in some places, so a language of few rows keeps the majority of its own.
    """
    w = weighted(rows, _class_weights(rows, owners, np.ones(rows.n, bool), False))
    low = cosines(rows, w, rng.standard_normal((BUCKETS, 128), np.float32))
    low /= np.maximum(1e-9, np.linalg.norm(low, axis=1, keepdims=True))
    ballot = np.zeros((rows.n, len(LANGUAGES)), np.float32)
    ballot[np.arange(rows.n), owners] = times
    votes = np.concatenate([(low[at : at + 1000] @ low.T > ALIKE).astype(np.float32) @ ballot for at in range(0, rows.n, 1000)])
    own = votes[np.arange(rows.n), owners]
    return own >= votes.max(axis=1), (own >= VOTES) & (own >= 0.6 * votes.sum(axis=1))


def _class_weights(rows: Rows, owners: np.ndarray, keep: np.ndarray, clean: bool) -> np.ndarray:
    """Inverse document frequency over the languages' shares; once labels are ``clean``, times how few languages a feature belongs to."""
    k = len(LANGUAGES)
    on = keep[rows.row]
    sizes = np.maximum(1, np.bincount(owners[keep], minlength=k))
    counts = np.bincount(rows.bucket[on] * k + owners[rows.row[on]], minlength=BUCKETS * k).reshape(BUCKETS, k)
    share = counts / sizes
    known = counts.sum(axis=1) > 1
    idf = np.log(1 + 1 / np.maximum(share.mean(axis=1), 1e-3))
    if not clean:
        return idf
    share[share < 0.05 * share.max(axis=1, keepdims=True)] = 0  # stray pieces of another language
    p = share / (share + 0.002)  # present or not, whatever the variety of a language's pieces
    p /= np.maximum(1e-12, p.sum(axis=1, keepdims=True))
    mixed = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1) / math.log(k)
    out = idf * (1.02 - np.minimum(1.0, mixed * 1.5))
    # a feature that no labelled piece has, as in a name, makes a piece less like any language
    out[~known] = UNKNOWN * float(np.median(out[known])) if known.any() else 1.0
    return out


def language_code(column: str) -> Column:
    """The language that a label names, in whatever notation; null where it names none of ``LANGUAGES``."""
    names = F.create_map(*[F.lit(x) for code, all_ in NOTATIONS.items() for name in all_.split() for x in (name, code)])
    label = F.lower(F.trim(F.col(column)))
    return F.coalesce(F.try_element_at(names, label), F.try_element_at(names, F.regexp_extract(label, r"^(\p{L}+)[-_]", 1)))


def labelled_sample(df: DataFrame, text: str, most: int) -> DataFrame:
    """About ``most`` rows (lang, text) at most, chosen by hash alike for all labels: so right labels outnumber wrong ones as in the table."""
    named = df.select(language_code("lang").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null and text <> ''")
    n = named.count()
    return named if n <= most else named.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * most / n))


def fit(spark: SparkSession, sf_dir: str) -> LanguageModel:
    sample = labelled_sample(table(spark, sf_dir, "documents"), "text", FIT_DOCUMENTS).unionByName(labelled_sample(table(spark, sf_dir, "eval_dataset"), "question", FIT_QUESTIONS))
    return fit_model(sorted((r["lang"], r["text"]) for r in sample.collect()))


_SCHEMA = "record_table string, record_id string, label string, langs array<string>, confidences array<double>"


def classified(df: DataFrame, model: LanguageModel) -> DataFrame:
    """(record_table, record_id, label, text) -> the segments' languages and confidences, in reading order; one Arrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            texts, at = np.unique(np.array(batch.column(3).fill_null("").to_pylist(), object), return_inverse=True)
            each = m.segments(list(texts))
            found = [each[i] for i in at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([[a for a, _ in f] for f in found], pa.list_(pa.string())), pa.array([[b for _, b in f] for f in found], pa.list_(pa.float64()))],
                names=["record_table", "record_id", "label", "langs", "confidences"],
            )

    return df.select("record_table", "record_id", "label", "text").mapInArrow(run, _SCHEMA)


def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both inputs of problem 2 as (record_table, record_id, label, text)."""
    requests = table(spark, sf_dir, "ask_requests").select(F.lit("ask_requests").alias("record_table"), F.col("request_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("label"), F.col("question").alias("text"))
    items = table(spark, sf_dir, "eval_dataset").select(F.lit("eval_dataset").alias("record_table"), F.col("id").alias("record_id"), language_code("lang").alias("label"), F.col("question").alias("text"))
    return requests.unionByName(items)


def untrusted(df: DataFrame) -> DataFrame:
    """Of classified rows, all requests, and the items whose label is missing or wrong or whose question is mixed or wordless."""
    first = F.get("langs", F.lit(0))
    return df.where((F.col("record_table") == "ask_requests") | F.col("label").isNull() | (F.size("langs") > 1) | (first == "und") | (F.col("label") != first))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language segments of every request and of every evaluation question whose label can't be trusted."""
    found = untrusted(classified(spread(question_records(spark, sf_dir)), fit(spark, sf_dir)))
    rows = found.select("record_table", "record_id", "langs").dropDuplicates()
    return rows.select("record_table", "record_id", F.posexplode("langs").alias("seg_no", "lang"))


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of ``p2_found`` with the language of the whole (its longest run of one language), its confidence, and its segments."""
    found = untrusted(classified(spread(question_records(spark, sf_dir)), fit(spark, sf_dir)))
    segments = F.arrays_zip(F.col("langs").alias("lang"), F.col("confidences").alias("confidence"))
    sure = F.array_max(F.transform(segments, lambda s: F.struct(s["confidence"].alias("confidence"), s["lang"].alias("lang"))))
    return found.dropDuplicates(["record_table", "record_id", "langs"]).select("record_table", "record_id", sure["lang"].alias("lang"), sure["confidence"].alias("confidence"), segments.alias("segments"))

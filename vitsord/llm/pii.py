"""Personal information inside free text (problem 4).

Method: generators with high recall propose overlapping candidate spans (addresses of several kinds, runs of digits, names beside
a cue or with a word known from such places); gradient-boosted trees score each candidate from its format and its context;
a threshold for each type, calibrated on held-out candidates, selects what is redacted. Of overlapping spans the surer one stays.

How often a word stands where names do is counted over all questions. The trees are a Spark ML ``GBTClassifier``, fitted on the candidates of at most ``FIT_ROWS`` questions. Labels come from checks that
define a type (check digits, dates, dialling prefixes, street words, cues of names); in at most ``PLACED_ROWS`` questions of which the
service has redacted something, its placeholders are the labels: what stands at one is of its type, whatever the rules say, and what it
passed over is unknown. Thresholds are calibrated on a quarter of both. The fitted trees are read back as arrays, so that scoring happens in the
pass that proposes the candidates, without a shuffle.

Defined results: null and empty texts have no item; placeholders such as ``[EMAIL]`` are none; equal rows give each item once; empty
tables give empty results; further columns are ignored. Texts are processed whole.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from .sentences import bounded_sample

#: Most questions whose candidates the trees are fitted on.
FIT_ROWS = 9000
#: Most redacted questions that are aligned with their originals for labels.
PLACED_ROWS = 9000
TREES, DEPTH = 24, 5
#: Least share of a word's places that are name places, for the word to be known as a name.
LEAST_SHARE = 0.2

TYPES = ("email", "phone", "identity_number", "address", "name", "iban", "card")
CHECKED = ("identity_number", "iban", "card")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[IDENTITY_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]", "iban": "[IBAN]", "card": "[CARD]"}

_UP = "A-ZÅÄÖÆØÜÉ"
_EMAIL = re.compile(r"[\w.+-]+(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\s(?:at|snabel-a)\s)[\w-]+(?:(?:\.(?=\w)|\s?[\[(]\s?dot\s?[\])]\s?|\s(?:dot|punkt)\s)[\w-]+)+", re.I)
_MAYBE_EMAIL = re.compile(r"@|[\[(]\s?at\s?[\])]| at .* dot | snabel-a ", re.I)
_MAYBE_RUN = re.compile(r"\d(?:[\s\-–./()]?\d){6}|\d\(\d")
_DIGITS = re.compile(r"(?:(?<![\w/])(?:\+|00)\s?|(?<![\w/.,])\(?)\d(?:[\d\-–]|[\s./()](?=[\d(])){6,26}(?<=\d)(?![\w/])")
_IDENTITY = re.compile(r"(?<!\d)(?:\d{8}|\d{6})[-–+ ]?\d{4}(?!\d)")
_IBAN = re.compile(r"(?<!\w)[A-Za-z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?!\w)")
_TOWN = rf"(?:,\s*|\s+)(?:(?:SE-)?\d{{3}}\s?\d{{2}}\s+[{_UP}][\w-]+|(?<=,\s)[{_UP}][\w-]+|(?<=,)[{_UP}][\w-]+)"
_HOUSE = r"\d{1,3}(?:\s?[A-Za-z](?![\w'’]))?(?:,?\s(?:lgh|apt\.?|vån)\s?\d{1,4})?"
_ADDRESS = re.compile(
    rf"(?<![\w@.])(?:[{_UP}][\w.:-]*\s+(?:[Aa]v |och )?){{0,2}}[{_UP}][\w-]{{3,}}\s+{_HOUSE}(?![\w.:%/-]|,\d)(?:{_TOWN})?"
    rf"|(?<![\w@.,-])\d{{1,4}}[A-Za-z]?\s+(?:[{_UP}][\w'’-]+\s?){{1,4}}(?:{_TOWN})?"
)
_MAYBE_ADDRESS = re.compile(rf"[^\W\d_]{{4}}\s+\d{{1,3}}(?!\d)|\d[A-Za-z]?\s+[{_UP}][\w'’-]+\s[{_UP}]")
# Words and endings of street names.
STREET_ENDS = ("gatan", "vägen", "stigen", "gränd", "gränden", "backen", "allén", "allen", "promenaden", "torget", "platsen", "leden", "kajen", "stranden", "plan", "esplanaden", "gata", "väg", "straße", "strasse", "weg", "katu", "tie", "gade", "vej", "veien")
STREET_WORDS = {"street", "road", "lane", "hill", "terrace", "avenue", "drive", "close", "square", "court", "way", "place", "crescent", "gardens", "row", "walk"}
# Words before or behind a person's name in the languages of the service.
NAME_CUES = set("heter heiter hedder heiße heisse llamo nimeni nazywam się mvh hälsningar hälsar regards sincerely mamma pappa mother father son dotter granne neighbour neighbor med with står is nå reach gäller concerns name namn am jag hr herr fru fröken mr mrs ms dr dr. hr. mr. doc. doktor".split())
STRONG_CUES = set("heter heiße heisse llamo nazywam się mvh regards mamma mother granne neighbour pratade spoke nå reach nimeni".split())
SHORTENED = {"dr", "hr", "mr", "mrs", "ms", "doc"}
_TOKEN = re.compile(rf"(?<![\w@.+-])(?:[{_UP}]\.(?=\s?[{_UP}])|[^\W\d_]+(?:[-'’][^\W\d_]+)*)")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def identity_date(digits: str) -> bool:
    """Whether ten or twelve digits begin with a date; coordination numbers have 60 added to the day."""
    if len(digits) == 12:
        year, rest = int(digits[:4]), digits[4:]
        if not 1850 <= year <= 2100:
            return False
    elif len(digits) == 10:
        year, rest = 2000, digits[2:]  # a leap year, so that 29 February is valid without a century
    else:
        return False
    day = int(rest[2:4])
    try:
        date(year, int(rest[:2]), day - 60 if day > 60 else day)
    except ValueError:
        return False
    return True


def iban_ok(text: str) -> bool:
    s = re.sub(r"\s", "", text).upper()
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_FEATURES = 26
Candidate = tuple[int, int, str, list[float], int]


def _street(words: list[str]) -> bool:
    return any(w.lower().endswith(STREET_ENDS) for w in words) or any(w.lower() in STREET_WORDS for w in words)


def _base(text: str, a: int, b: int, kind: str) -> list[float]:
    body = text[a:b]
    n = sum(c.isdigit() for c in body)
    before = text[max(0, a - 24) : a]
    word = before.split()[-1].lower().strip(",:(<\"") if before.split() else ""
    out = [0.0] * _FEATURES
    out[TYPES.index(kind)] = 1.0
    out[7], out[8] = float(b - a), float(n)
    out[9] = float(body.startswith(("+", "00")))
    out[10] = float(body[:1] == "0" or body[:2] == "(0")
    out[11] = float(sum(c in " -–./()" for c in body))
    out[12] = float(word in ("ocr", "organisationsnummer", "fakturan", "dnr", "sk", "flight", "tåg", "train", "case", "ärende", "invoice", "faktura", "ref", "nr"))
    out[13] = float(word in ("pnr", "personnummer", "id", "number", "número", "numer", "tunnukseni"))
    out[14] = float(word in ("på", "eller", "or", "tel", "tfn", "unter", "numeroon", "on", "phone", "telefon", "ring"))
    out[15] = float(not before.strip())
    return out


def candidates(text: str, names: dict[str, float]) -> list[Candidate]:
    """(start, end, type, features, weak label: 1, 0 or -1 for none) of all proposals; ``names`` has how often a word stands where names do."""
    out: list[Candidate] = []
    low = text.lower()
    if _MAYBE_EMAIL.search(text):
        for m in _EMAIL.finditer(text):
            f = _base(text, m.start(), m.end(), "email")
            body = m.group()
            f[16], f[17] = float("@" in body or bool(re.search(r"[\[(]\s?at", body, re.I))), float(" " in body)
            out.append((m.start(), m.end(), "email", f, int(f[16])))
    if _MAYBE_RUN.search(text):
        for m in _IBAN.finditer(text):
            end = m.end()
            while end - m.start() > 14:  # a word behind the number may look like its last group
                f = _base(text, m.start(), end, "iban")
                f[18] = float(iban_ok(text[m.start() : end]))
                out.append((m.start(), end, "iban", f, int(f[18])))
                end = text.rfind(" ", m.start(), end)
        runs = [(m.start() + (m.group()[0] == "(" and ")" not in m.group()), m.end()) for m in _DIGITS.finditer(text)]
        spans = {(a, b, k) for a, b in runs for k in ("phone", "card")}
        for m in _IDENTITY.finditer(text):
            spans.add((m.start(), m.end(), "identity_number"))
            for a, b in runs:  # a run may hold an identity number and a phone number beside each other
                if a == m.start() and b > m.end() or b == m.end() and a < m.start():
                    rest = (m.end(), b) if a == m.start() else (a, m.start())
                    x = text[rest[0] : rest[1]]
                    spans.add((rest[0] + len(x) - len(x.lstrip(" -–./")), rest[0] + len(x.rstrip(" -–./")), "phone"))
        for a, b, kind in sorted(spans):
            digits = "".join(c for c in text[a:b] if c.isdigit())
            if not digits:
                continue
            f = _base(text, a, b, kind)
            f[19], f[20] = float(luhn(digits[-10:])), float(identity_date(digits))
            f[21] = float(13 <= len(digits) <= 19 and luhn(digits))
            glued = a > 0 and text[a - 1] in "-–./" or b < len(text) and text[b : b + 1] in ("-", "–")
            f[22] = float(glued)
            if kind == "identity_number":
                label = -1 if f[10] and f[14] and not f[13] and b - a == 10 else int(f[19] and f[20] and not glued)  # a phone number may pass the checks
            elif kind == "card":
                label = int(f[21] and digits[0] != "0" and not f[12])
            else:
                label = int(7 <= len(digits) <= 14 and (f[9] or f[10] and digits[:2] != "00") and not f[12] and not (f[20] and _IDENTITY.fullmatch(text[a:b])))
                f[23] = float(_IDENTITY.fullmatch(text[a:b]) is not None)
            out.append((a, b, kind, f, label))
    if _MAYBE_ADDRESS.search(text):
        for m in _ADDRESS.finditer(text):
            body = m.group().rstrip()
            start = m.start()
            words = re.findall(r"[^\W\d_][\w'’-]*", body.split(",")[0])
            if body[0].isalpha() and len(words) > 1:  # of several capital words only the street itself
                for i, w in enumerate(words[:-1]):
                    if not _street(words[: i + 1]) and _street(words[i + 1 :]) and w.lower() in names | _OPENERS:
                        start = m.start() + m.group().index(words[i + 1], m.group().index(w) + len(w))
            f = _base(text, start, m.start() + len(body), "address")
            street = _street(words)
            f[23] = float(street)
            f[24] = float(bool(re.search(r"\d{3}\s?\d{2}", body)))
            f[25] = float("," in body)
            out.append((start, m.start() + len(body), "address", f, int(street)))
    out += _names(text, low, names)
    return out


_OPENERS = dict.fromkeys("på at in till to i von bei skicka send min".split(), 0.0)


def _names(text: str, low: str, names: dict[str, float]) -> list[Candidate]:
    """Runs of one to four words of which one is known as a name or stands behind a cue."""
    out: list[Candidate] = []
    words = set(_WORD.findall(low))
    if words.isdisjoint(names) and words.isdisjoint(NAME_CUES):
        return out
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    i = 0
    while i < len(tokens):
        a, b = tokens[i]
        word = text[a:b]
        known = max((names.get(x, 0.0) for x in low[a:b].replace("’", "-").split("-")), default=0.0)
        initial = len(word) == 2 and word[1] == "."
        before = low[tokens[i - 1][0] : tokens[i - 1][1]] if i else ""
        if i and (gap := text[tokens[i - 1][1] : a].strip()) not in ("", ",", ":") and not (gap == "." and before in SHORTENED):
            before = ""
        if known < 0.05 and not (before in NAME_CUES and word[0].isupper()) and not initial:
            i += 1
            continue
        j, best = i, known
        capital = word[0].isupper()
        while j + 1 < len(tokens):
            c, d = tokens[j + 1]
            gap = text[tokens[j][1] : c]
            nxt = text[c:d]
            k = max((names.get(x, 0.0) for x in low[c:d].split("-")), default=0.0)
            if gap == " " and (k >= 0.05 or nxt[0].isupper() and j + 1 - i < 3 and capital and k > 0 or initial and j == i) or gap == ", " and k >= 0.3 and best >= 0.3 and j == i and not initial:
                best = max(best, k)
                j += 1
            else:
                break
        if initial and j == i:
            i += 1
            continue
        end = tokens[j][1]
        after = low[end : end + 14]
        digits_behind = bool(re.match(r"\s+\d{1,3}\b", text[end:]))
        f = _base(text, a, end, "name")
        f[16] = best
        f[17] = known
        f[18] = float(before in NAME_CUES or before.rstrip(".") in NAME_CUES)
        f[19] = float(before in STRONG_CUES)
        f[20] = float(j - i + 1)
        f[21] = float(text[a].isupper())
        f[22] = float(digits_behind)
        f[23] = float(low[a:end].endswith(("verket", "kassan", "nämnden", "myndigheten", "kommun")) or _street([text[tokens[j][0] : end]]))
        f[24] = float(before in ("i", "in", "en", "w", "på", "at", "von", "magaalada"))
        f[25] = float(bool(re.match(r"\s*(?:,|och|and|und|on|på|i |at|y |mój|ja )", after)))
        if f[23] or f[22] and best < 0.5:
            label = 0
        elif best >= 0.3 and not f[24]:
            label = 1
        elif f[24] and best < 0.5:
            label = 0
        elif f[19] and f[21]:
            label = 1
        else:
            label = 0 if best < 0.15 else -1
        out.append((a, end, "name", f, label))
        i = j + 1
    return out


class Trees:
    """Boosted regression trees as nested tuples (feature, threshold, left, right) with leaves; evaluated on whole arrays."""

    def __init__(self, debug: str):
        self.trees: list[tuple[float, object]] = []
        lines = [x.strip() for x in debug.splitlines() if x.strip()]
        weights = [float(m.group(1)) for x in lines if (m := re.match(r"Tree \d+ \(weight ([^)]+)\)", x))]
        body = [x for x in lines if x.startswith(("If", "Else", "Predict", "Tree"))]
        at = 0

        def node() -> object:
            nonlocal at
            line = body[at]
            at += 1
            if line.startswith("Predict"):
                return float(line.split(":")[1])
            m = re.search(r"feature (\d+) <= ([^)]+)\)", line)
            left = node()
            at += 1  # the Else line
            return int(m.group(1)), float(m.group(2)), left, node()

        for w in weights:
            at += 1  # the Tree line
            self.trees.append((w, node()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row."""
        margin = np.zeros(len(x))
        for w, tree in self.trees:
            stack = [(tree, np.arange(len(x)))]
            while stack:
                n, rows = stack.pop()
                if not len(rows):
                    continue
                if isinstance(n, float):
                    margin[rows] += w * n
                else:
                    left = x[rows, n[0]] <= n[1]
                    stack += [(n[2], rows[left]), (n[3], rows[~left])]
        return 1 / (1 + np.exp(-2 * margin))


class Finder:
    """What a task needs to find items: name statistics, trees and thresholds."""

    def __init__(self, names: dict[str, float], trees: Trees, thresholds: dict[str, float]):
        self.names, self.trees, self.thresholds = names, trees, thresholds

    def items(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, type) of the items of each text, in reading order."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        same: dict[str, int] = {}
        found, rows = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            first = same.setdefault(text, i)
            if first != i:
                continue
            for c in candidates(text, self.names):
                found.append((i, c))
                rows.append(c[3])
        if rows:
            p = self.trees.score(np.array(rows))
            sure: dict[int, list] = {}
            for (i, c), score in zip(found, p):
                # of the types that a check digit defines, an exact check follows
                if score >= self.thresholds[c[2]] and (c[4] == 1 or c[2] not in CHECKED):
                    sure.setdefault(i, []).append((-round(float(score), 2), -(c[1] - c[0]), c[0], c[1], c[2]))
            for i, options in sure.items():
                taken: list[tuple[int, int, str]] = []
                for _, _, a, b, kind in sorted(options):
                    if all(b <= s or a >= e for s, e, _ in taken):
                        taken.append((a, b, kind))
                out[i] = sorted(taken)
        for i, text in enumerate(texts):
            if text and same[text] != i:
                out[i] = out[same[text]]
        return out


def name_places(texts: list[str]) -> tuple[Counter, Counter]:
    """For each word, its places in a sentence that stand behind a strong cue of a name, or behind such a word, and all of them."""
    behind: Counter = Counter()
    total: Counter = Counter()
    for text in texts:
        tokens = list(_TOKEN.finditer(text))
        low = text.lower()
        run = False
        for t, m in enumerate(tokens):
            word = m.group()
            before = low[tokens[t - 1].start() : tokens[t - 1].end()] if t else ""
            gap = text[tokens[t - 1].end() : m.start()] if t else ""
            cue = before in STRONG_CUES and gap.strip() in ("", ",")
            if before == "med" and t > 1:
                cue = low[tokens[t - 2].start() : tokens[t - 2].end()] == "pratade"
            elif before == "with" and t > 1:
                cue = low[tokens[t - 2].start() : tokens[t - 2].end()] == "spoke"
            elif before == "min" or before == "my":
                cue = False
            capital = word[0].isupper() and not (len(word) > 1 and word.isupper() and text.isupper())
            street = _street([word]) or text[m.end() : m.end() + 2].strip().isdigit()
            run = bool(word[0].isupper() and not street and (cue or run and gap in (" ", ", ")))
            for part in low[m.start() : m.end()].split("-"):
                total[part] += 1
                behind[part] += run and capital
    return behind, total


def name_words(questions: DataFrame) -> dict[str, float]:
    """The share of name places of each word that stands in one at least twice, counted over all questions; those of ``LEAST_SHARE`` and more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            behind, total = name_places([t for t in batch.column(0).to_pylist() if t])
            words = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([behind[w] for w in words], pa.int64()), pa.array([total[w] for w in words], pa.int64())], names=["word", "behind", "total"])

    counts = questions.mapInArrow(count, "word string, behind long, total long").groupBy("word").agg(F.sum("behind").alias("behind"), F.sum("total").alias("total"))
    share = F.col("behind") / (F.col("total") + 1)
    kept = counts.where((F.col("behind") >= 2) & (F.length("word") > 2) & (share >= LEAST_SHARE)).select("word", F.round(share, 3).alias("share"))
    return {r["word"]: r["share"] for r in kept.collect()}  # a vocabulary of personal names


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both inputs of problem 4 as (record_table, record_id, text)."""
    requests = table(spark, sf_dir, "ask_requests").select(F.lit("ask_requests").alias("record_table"), F.col("request_id").cast("string").alias("record_id"), F.col("question").alias("text"))
    results = table(spark, sf_dir, "ask_results").select(F.lit("ask_results").alias("record_table"), F.col("trace_id").alias("record_id"), F.col("question").alias("text"))
    return requests.unionByName(results)


# The service's placeholders and their types.
_PLACED = {"[EMAIL]": "email", "[PHONE]": "phone", "[PERSONNUMMER]": "identity_number", "[SAMORDNINGSNUMMER]": "identity_number", "[IDENTITY_NUMBER]": "identity_number", "[ADDRESS]": "address", "[NAME]": "name", "[IBAN]": "iban", "[CARD]": "card"}
_HOLDER = re.compile(r"(\[[A-ZÅÄÖ_]{2,}\])")


def placed(text: str, redacted: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of what the service replaced in ``text`` to get ``redacted``; none where the two cannot be aligned surely."""
    parts = _HOLDER.split(redacted)
    if not text.startswith(parts[0]):
        return []
    out, at = [], len(parts[0])
    for i in range(1, len(parts), 2):
        behind, last = parts[i + 1], i + 2 == len(parts)
        end = len(text) - len(behind) if last and text.endswith(behind) else text.find(behind, at + 1) if behind and not last else -1
        if end <= at:
            return []
        if parts[i] in _PLACED:
            out.append((at, end, _PLACED[parts[i]]))
        at = end + len(behind)
    return out


def placed_label(candidate: Candidate, spans: list[tuple[int, int, str]]) -> int:
    """1 for a span that the service replaced as that type, 0 for another type at its place, else -1 for unknown."""
    a, b, kind = candidate[:3]
    if (a, b, kind) in spans:
        return 1
    return 0 if any(a < e and b > s and kind != k for s, e, k in spans) else -1


def placed_rows(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """(question, redacted question) of a bounded sample of the results in which the service replaced something."""
    results = table(spark, sf_dir, "ask_results").where(F.col("question").rlike(_HOLDER.pattern)).select("request_id", F.col("question").alias("redacted"))
    asked = table(spark, sf_dir, "ask_requests").where("question is not null").select("request_id", "question")
    pairs = bounded_sample(results, "redacted", PLACED_ROWS).dropDuplicates().join(asked, "request_id").select("question", "redacted").dropDuplicates()
    return sorted((r["question"], r["redacted"]) for r in pairs.collect())


def fit(spark: SparkSession, sf_dir: str) -> Finder:
    questions = table(spark, sf_dir, "ask_requests").where("question is not null").select("question")
    texts = sorted(r["question"] for r in bounded_sample(questions, "question", FIT_ROWS).dropDuplicates().collect())
    names = name_words(spread(questions))
    rows = [(TYPES.index(c[2]), c[3], c[4], i % 4 == 0) for i, t in enumerate(texts) for c in candidates(t, names) if c[4] >= 0]
    for i, (text, redacted) in enumerate(placed_rows(spark, sf_dir)):
        if spans := placed(text, redacted):
            rows += [(TYPES.index(c[2]), c[3], y, i % 4 == 0) for c in candidates(text, names) if (y := placed_label(c, spans)) >= 0]
    # few candidates of a type, or of a written form of addresses, are not drowned by the many of others
    group = lambda t, f, label: (t, label, f[16:18] if TYPES[t] == "email" else None)
    sizes = Counter(str(group(t, f, label)) for t, f, label, held in rows if not held)
    train = [(float(label), f, sizes[str(group(t, f, label))] ** -0.5) for t, f, label, held in rows if not held]
    if len({label for label, _, _ in train}) < 2:
        return Finder(names, Trees(""), dict.fromkeys(TYPES, 2.0))
    frame = spark.createDataFrame(train, "label double, f array<double>, weight double").select("label", "weight", array_to_vector("f").alias("features")).coalesce(2)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=3, maxBins=32, weightCol="weight").fit(frame)
    trees = Trees(model.toDebugString)
    thresholds = {}
    for k, kind in enumerate(TYPES):
        held = [(f, label) for t, f, label, h in rows if h and t == k]
        thresholds[kind] = _threshold(trees.score(np.array([f for f, _ in held])), np.array([y for _, y in held])) if held else 0.5
    return Finder(names, trees, thresholds)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """A low one of the thresholds whose F1 on held-out candidates is within 0.002 of the best: a missed item costs more than a blank."""
    f1 = []
    for t in np.arange(0.1, 0.91, 0.05):
        hit = p >= t
        f1.append((2 * float((hit & (y == 1)).sum()) / max(1.0, float(hit.sum() + (y == 1).sum())), t))
    best = max(f1)[0]
    return float(np.percentile([t for f, t in f1 if f >= best - 0.002], 25))


def with_items(df: DataFrame, finder: Finder) -> DataFrame:
    """(record_table, record_id, text) -> the items' starts, ends and types and the redacted text, one Arrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(finder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pickle.loads(shared.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = f.items(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([redact(t, x) for t, x in zip(texts, found)], pa.string()), pa.array([[a for a, _, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[k for _, _, k in x] for x in found], pa.list_(pa.string()))],
                names=["record_table", "record_id", "redacted", "starts", "kinds"],
            )

    return df.select("record_table", "record_id", "text").mapInArrow(run, "record_table string, record_id string, redacted string, starts array<int>, kinds array<string>")


def redact(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    """``text`` with a typed placeholder for each item."""
    if not text or not items:
        return text
    out, at = [], 0
    for a, b, kind in items:
        out += (text[at:a], PLACEHOLDER[kind])
        at = b
    return "".join(out) + text[at:]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of personal information in the questions of requests and results."""
    found = with_items(spread(records(spark, sf_dir)), fit(spark, sf_dir)).where(F.size("starts") > 0)
    rows = found.select("record_table", "record_id", F.explode(F.arrays_zip("starts", "kinds")).alias("x"))
    return rows.select("record_table", "record_id", F.col("x.starts").alias("start_pos"), F.col("x.kinds").alias("pii_type")).dropDuplicates()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its redacted question and a ``pii_redacted`` that agrees with what was replaced."""
    found = with_items(spread(records(spark, sf_dir)), fit(spark, sf_dir)).dropDuplicates(["record_table", "record_id", "redacted"])
    counts = F.map_from_entries(F.transform(F.array_distinct("kinds"), lambda k: F.struct(k, F.size(F.filter("kinds", lambda x: x == k)))))
    return found.select("record_table", "record_id", F.col("redacted").alias("question"), counts.alias("pii_redacted"))

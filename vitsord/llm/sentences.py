"""Sentence boundaries across languages and scripts (problem 1).

Method: a hidden-event n-gram language model. Between words there may stand an unseen boundary token; forward-backward
posteriors over the gaps of a line decide where it stands. The model is estimated from the corpus itself: line ends are
certain boundaries, gaps behind a word without a closing mark certain non-boundaries, and all other gaps are filled in by
expectation maximisation. Thai, which has no closing marks, has a gap at every space.

Fit: on every distinct text of each input, in one pass that counts certain events and the runs of gaps. A run holds gaps with no
word between them; runs do not depend on each other, so equal ones are one row with its number, whatever lines they stand in, and the
rounds of estimation read those rows. The broadcast model has the words beside gaps and in lines.
Decoding: every row, one Arrow pass, no shuffle of texts; equal runs are decided once a task.

Defined results: null, empty or blank text gives no unit; equal rows give each unit once; empty tables give empty results;
further columns of the input are ignored, whatever their names. The length of a text is not limited.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, spread, table

#: Keys that a task counts before it hands them on.
HELD = 200_000
#: Rounds of expectation maximisation after the first guess.
ROUNDS = 2
#: Words beside gaps and runs of gaps that a task keeps worked out.
KEPT = 400_000

_CLOSE = r"[\"'”“’»«›」』）\)\]】》〉]"
_CITE = r"(?:\[(?:\d+(?:\s*[,;]\s*\d+)*|\p{Ll}{1,12})\]|\p{So}️?)"
_WIDE = r"。！？｡"
_MARK = r"[.!?…؟۔।॥።။។]"
#: Group 1: the closing marks, 2: closers, citations and symbols behind them, 3: the gap.
_GAP = regex.compile(
    rf"({_MARK}++|[{_WIDE}]++)((?:{_CLOSE}|\s*{_CITE}{_MARK}*+)*+)(?:(\s++)(?=\S)|(?<=[{_WIDE}]{_CLOSE}?{_CLOSE}?)(?=\S)|(?=[\p{{Lu}}\p{{Lo}}\"“«„(¿¡]))"
)
_CITED = regex.compile(rf"((?:\s*{_CITE})++{_MARK}*+)({_CLOSE}*+)(\s++)(?=\S)")
_SPACELESS = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_BLANK = regex.compile(r"\s++(?=\S)")
_ITEM = regex.compile(r"\s*(?:[-*•–‣▪◦]|\(?\p{Nd}{1,3}[.)]|\p{L}\))\s+(?=\S)")
_NUMBER = regex.compile(r"\p{Nd}+")
_WIDE_LETTER = regex.compile(r"[\u3040-\u30ff\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]")
_GLUED = regex.compile(rf"(?<=\p{{L}}{_MARK})(?=[\p{{Lu}}\p{{Lo}}])")
_CITES = regex.compile(rf"\s*{_CITE}")
_QUOTES = {"“": "”", "«": "»", "„": "“”", "»": "«", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "”": "”", '"': '"', "《": "》"}
_ANYQUOTE = re.compile(r"[\"“”„«»「『」』(（）)《》]")
_OPEN_WORD = regex.compile(r"^[\"'“”„«»「『(（¿¡\[]+")
# Patterns of ``re``, which reads a line several times as fast: where they find nothing, those above cannot either.
_MARKS = re.compile(f"[{_MARK[1:-1]}{_WIDE}]+")
_RUN = re.compile(rf"{_MARK}+|[{_WIDE}]+")
_LAST_RUN = re.compile(rf"(?:{_MARK}+|[{_WIDE}]+)\Z")
_MAY_CITE = re.compile("[\\[" + "".join(regex.findall(r"\p{So}", "".join(map(chr, range(0x10000))))) + "\U00010000-\U0010ffff]")
_MAY_BE_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u19e0-\u19ff\ua9e0-\ua9ff\uaa60-\uaa7f\U00010000-\U0010ffff]")
#: The word behind one that ends neither in a letter, a digit or an underscore nor in a mark that closes nothing.
_BEHIND_MARK = re.compile(r"[^\w,;:\s]\s+(?=(\S+))")


@functools.lru_cache(200_000)
def _left_class(word: str) -> str:
    body = word.rstrip("\"'”“’»«›」』）)]】》〉")
    mark = body.lstrip()[-1:] if body else ""
    core = body.rstrip(".!?…؟۔।॥。！？")
    core = _OPEN_WORD.sub("", core)
    dots = len(body) - len(core)
    tail = "q" if len(body) < len(word) else ""
    if not core:
        shape = "none"
    elif core[-1].isdigit():
        shape = "num"
    elif len(core) == 1:
        shape = "one"
    elif "." in core:
        shape = "abb"
    elif not core[-1].isalpha():
        shape = "sym"
    elif core[0].isupper():
        shape = "cap" if len(core) > 3 else "capshort"
    elif core[0].islower():
        shape = "low" if len(core) > 6 else "lowshort"
    else:
        shape = "other" if len(core) > 2 else "othershort"
    return f"{mark if mark in '.!?…؟۔।॥。！？' else '-'}{'+' if dots > 1 else ''}{tail}{shape}"


@functools.lru_cache(200_000)
def _right_class(word: str) -> str:
    core = _OPEN_WORD.sub("", word)
    head = "q" if len(core) < len(word) else ""
    if not core:
        return head + "none"
    c = core[0]
    return head + ("num" if c.isdigit() else "up" if c.isupper() else "low" if c.islower() else "other" if c.isalpha() else "sym")


@functools.lru_cache(200_000)
def _norm_left(word: str) -> str:
    return _NUMBER.sub("0", _CITES.sub("", word).replace("\xa0", " "))[-16:]


@functools.lru_cache(200_000)
def _norm_right(word: str) -> str:
    word = _NUMBER.sub("0", word)
    m = _WIDE_LETTER.search(word, 0, 6)
    return word[: max(3, m.end() + 1)] if m else _GLUED.split(word, 1)[0][:14]


def _inside_quotes(line: str) -> list[tuple[int, int]]:
    """Outermost quoted or bracketed stretches of a line that are closed in the same line."""
    spans, stack = [], []
    for m in _ANYQUOTE.finditer(line):
        c, at = m.group(), m.start()
        if stack and c in stack[-1][0]:
            start = stack.pop()[1]
            if not stack:
                spans.append((start, at))
        elif c in _QUOTES and (c not in "»”" or at + 1 < len(line) and not line[at + 1].isspace()) and len(stack) < 8:
            stack.append((_QUOTES[c], at))
    return spans


def _word_before(line: str, at: int, first: int) -> str:
    """What of the word that ends at ``at`` decides: its last letters, or three of a script written without spaces."""
    head = line[max(first, at - 24) : at]
    if head[-1:] == "]":  # a citation before the closing mark belongs to neither word
        head = _CITES.sub("", line[max(first, at - 60) : at]).rstrip()
    word = head.rsplit(None, 1)[-1] if head and not head.isspace() else ""
    return word[-3:] if word and "\u3000" <= word[-1] <= "\uffef" else word


def _item(line: str) -> regex.Match | None:
    """The mark of a list item that ``line`` begins with; a letter begins none unless a bracket follows."""
    return None if line[:1].isalpha() and line[1:2] != ")" else _ITEM.match(line)


def _spaceless(line: str) -> bool:
    return not line.isascii() and _MAY_BE_SPACELESS.search(line) is not None and _SPACELESS.search(line) is not None


def _mark_runs(line: str, first: int) -> Iterator[re.Match]:
    """Runs of closing marks from ``first`` on, those of wide ones apart."""
    for m in _MARKS.finditer(line, first):
        if m.end() - m.start() == 1:
            yield m
        else:
            yield from _RUN.finditer(line, m.start(), m.end())


def _candidates(line: str) -> list[tuple[int, int, str, str, int]]:
    """Gaps of one line that may hold a boundary: (end of the left unit, start of the right one, left word, right word, words between)."""
    item = _item(line)
    first = at = item.end() if item else 0
    found: dict[int, tuple[int, int, str]] = {}
    for run in _mark_runs(line, first):  # what _GAP.finditer finds
        begin, end = run.span()
        if begin < at or end == len(line):
            continue
        after = line[end]
        if after == " " and line[end + 1 : end + 2].isalpha():
            at = end + 1
            found[at] = (end, at, _word_before(line, begin, first) + run.group())
        elif ("a" <= after <= "z" or "0" <= after <= "9") and line[begin] not in _WIDE:
            continue
        elif m := _GAP.match(line, begin):
            at = m.end()
            found[at] = (m.end(2), at, _word_before(line, begin, first) + m.group(1) + m.group(2))
    if "[" in line:
        at = first
        for cite in _MAY_CITE.finditer(line, first):  # what _CITED.finditer finds
            begin = cite.start()
            while begin > at and line[begin - 1].isspace() and not "\x1c" <= line[begin - 1] <= "\x1f":
                begin -= 1
            if begin >= at and (m := _CITED.match(line, begin)):
                at = m.end()
                if at not in found:
                    found[at] = (m.end(2), at, _word_before(line, begin, first) + m.group(1))
    if _spaceless(line):
        for m in _BLANK.finditer(line, first):
            left = line.rfind(" ", 0, m.start()) + 1
            if m.end() not in found and (_SPACELESS.search(line, m.start() - 1, m.start()) or line[m.start() - 1] in "0123456789]") and not _CITES.match(line, m.end()):
                word = line[left : m.start()]
                if word[-1:] == "]":  # a citation behind the clause
                    word = _CITES.sub("", line[max(0, left - 40) : m.start()]).split(" ")[-1]
                found[m.end()] = (m.start(), m.end(), word)
    if not found:
        return []
    quoted = _inside_quotes(line) if _ANYQUOTE.search(line) else []
    out, before = [], first
    for at in sorted(found):
        end, start, left = found[at]
        if quoted and any(a < end <= b for a, b in quoted) or line[start] == "[" and _CITES.match(line, start):
            continue
        right = line[start : start + 20].split(None, 1)
        out.append((end, start, _norm_left(left), _norm_right(right[0]), int(end - len(left) > before)))
        before = start
    return out


class BoundaryModel:
    """Hidden-event n-gram tables.

    Keys of ``counts``: LB and LN (left word, context) boundary and no boundary behind a word; BR and NR (right word) the word
    behind a boundary and inside a sentence; ENDS, OPENS certain line ends and starts; CL, CR words beside an open gap; INSIDE words behind one without a closing mark.
    """

    def __init__(self, counts: dict[tuple[str, ...], float]):
        self.n = Counter(counts)
        self.left_class = {kind: Counter() for kind in ("LB", "LN", "ENDS", "CL")}
        self.right_class = {kind: Counter() for kind in ("BR", "NR", "OPENS", "CR", "INSIDE")}
        total = Counter()
        for (kind, word, *_), v in counts.items():
            total[kind] += v
            if kind in self.left_class:
                self.left_class[kind][_left_class(word)] += v
            else:
                self.right_class[kind][_right_class(word)] += v
        self.total = total
        self.vocabulary = max(1, len({k[1] for k in counts if k[0] in ("BR", "NR", "OPENS", "CR")}))
        #: How often a boundary is a line break.
        self.rate = 0.25 * total["ENDS"] / max(1.0, total["ENDS"] + total["CL"])
        self.cache: dict[tuple[str, str], np.ndarray] = {}
        self.decided: dict[tuple[str, ...], list[bool]] = {}

    def first_guess(self, left: str, right: str) -> float:
        """Before any expected count: words that end a line as often as boundaries do, and words that open one, make a boundary."""
        n, rate = self.n, self.rate
        lc, rc = _left_class(left), _right_class(right)
        of, og = self.left_class, self.right_class
        f = min(1.0, of["ENDS"][lc] / max(1e-9, rate * (of["ENDS"][lc] + of["CL"][lc])))
        f = min(1.0, (n["ENDS", left] + 2 * rate * f) / (rate * (n["ENDS", left] + n["CL", left] + 2)))
        g = min(1.0, og["OPENS"][rc] / max(1e-9, rate * (og["OPENS"][rc] + og["CR"][rc] + og["INSIDE"][rc])))
        g = min(1.0, (n["OPENS", right] + 2 * rate * g) / (rate * (n["OPENS", right] + n["CR", right] + n["INSIDE", right] + 2)))
        if lc[0] in "!?؟।॥。！？":  # no abbreviation ends in these marks
            g = g**0.25
        return min(0.99, max(0.01, f * g))

    def factors(self, left: str, right: str) -> np.ndarray:
        """Log factors [context, event]: contexts are a far, a boundary and a non-boundary gap one word before; events no boundary, boundary."""
        hit = self.cache.get((left, right))
        if hit is None:
            n, lc, rc = self.n, _left_class(left), _right_class(right)
            base = (self.left_class["LB"][lc] + 0.5) / (self.left_class["LB"][lc] + self.left_class["LN"][lc] + 1.0)
            b = sum(n["LB", left, c] for c in "-BN")
            base = (b + 2 * base) / (b + sum(n["LN", left, c] for c in "-BN") + 2)
            spread_out = 8.0 / self.vocabulary
            rb = (self.right_class["BR"][rc] + 0.1) / (self.total["BR"] + 1) * spread_out
            rn = (self.right_class["NR"][rc] + 0.1) / (self.total["NR"] + 1) * spread_out
            rb = (n["BR", right] + rb) / (self.total["BR"] + 1)
            inside = 2 * (n["INSIDE", right] + rn) / (self.total["INSIDE"] + 1)
            rn = (n["NR", right] + rn + inside) / (self.total["NR"] + 3)
            hit = np.empty((3, 2))
            for i, context in enumerate("-BN"):
                p = (n["LB", left, context] + 4 * base) / (n["LB", left, context] + n["LN", left, context] + 4)
                p = min(1 - 1e-4, max(1e-4, p))
                hit[i] = (1 - p) * rn, p * rb
            hit = np.log(hit)
            if len(self.cache) > KEPT:
                self.cache.clear()
            self.cache[left, right] = hit
        return hit


def posteriors(model: BoundaryModel, lines: list[list[tuple[int, int, str, str, int]]]) -> list[np.ndarray]:
    """Forward-backward over the gaps of each line: the posterior of a boundary at each."""
    sizes = [len(x) for x in lines]
    total = sum(sizes)
    if not total:
        return [np.empty(0) for _ in lines]
    score = np.empty((total, 3, 2))
    adjacent = np.zeros(total, bool)
    k = 0
    for gaps in lines:
        for i, g in enumerate(gaps):
            score[k] = model.factors(g[2], g[3])
            adjacent[k] = i > 0 and g[4] == 0
            k += 1
    depth = np.zeros(total, np.int64)
    idx = np.flatnonzero(adjacent)
    for i in idx:
        depth[i] = depth[i - 1] + 1
    alpha = score[:, 0, :].copy()
    beta = np.zeros((total, 2))
    deepest = int(depth.max())
    for d in range(1, deepest + 1):
        i = np.flatnonzero(depth == d)
        prev = alpha[i - 1]
        # the state no boundary (0) is context N (2), the state boundary (1) context B (1)
        alpha[i] = np.logaddexp(prev[:, :1] + score[i, 2, :], prev[:, 1:] + score[i, 1, :])
    for d in range(deepest, 0, -1):
        i = np.flatnonzero(depth == d)
        after = beta[i]
        beta[i - 1, 0] = np.logaddexp(score[i, 2, 0] + after[:, 0], score[i, 2, 1] + after[:, 1])
        beta[i - 1, 1] = np.logaddexp(score[i, 1, 0] + after[:, 0], score[i, 1, 1] + after[:, 1])
    both = alpha + beta
    post = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
    return np.split(post, np.cumsum(sizes)[:-1])


def _runs(found: list[tuple[int, int, str, str, int]]) -> list[tuple[str, ...]]:
    """The gaps of a line in runs without words between: (left word, right word, left word, right word, ...) each."""
    out: list[tuple[str, ...]] = []
    for _, _, left, right, between in found:
        if out and not between:
            out[-1] += (left, right)
        else:
            out.append((left, right))
    return out


def _gaps(run: tuple[str, ...] | list[str]) -> list[tuple[int, int, str, str, int]]:
    """A run as a line that has no other gaps."""
    return [(0, 0, run[i], run[i + 1], 0) for i in range(0, len(run), 2)]


def _decide(model: BoundaryModel, runs: set[tuple[str, ...]]) -> dict[tuple[str, ...], list[bool]]:
    """For each run, among others, which of its gaps are boundaries."""
    if len(model.decided) > KEPT:
        model.decided.clear()
    new = [x for x in runs if x not in model.decided] if model.decided else list(runs)
    for run, post in zip(new, posteriors(model, [_gaps(x) for x in new])):
        model.decided[run] = (post > 0.5).tolist()
    return model.decided


def _lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        if line and not line.isspace():
            yield at, line
        at += len(line) + 1


def units(model: BoundaryModel, texts: list[str | None]) -> list[list[int]]:
    """For each text the flat list [start, end, start, end, ...] of its units."""
    places, plain = [], {}
    for i, text in enumerate(texts):
        for at, line in _lines(text.replace("\r", "\n") if text and "\r" in text else text or ""):
            places.append((i, at, line))
            if line not in plain:
                found = _candidates(line)
                plain[line] = found, _runs(found)
    decided = _decide(model, {x for _, runs in plain.values() for x in runs})
    out: list[list[int]] = [[] for _ in texts]
    for i, at, line in places:
        start = len(line) - len(line.lstrip())
        end = len(line.rstrip())
        found, runs = plain[line]
        for gap, boundary in zip(found, (b for x in runs for b in decided[x])):
            if boundary and gap[0] > start:
                out[i] += (at + start, at + gap[0])
                start = gap[1]
        out[i] += (at + start, at + end)
    return out


def _last_word(line: str) -> str:
    """The word that ends a line, with its closing marks and without citations."""
    tail = line[-80:].rstrip()
    if _MAY_CITE.search(tail):
        tail = _CITES.sub("", tail)
    if tail and not _MAY_CITE.search(tail):
        if tail[-1].isalnum():
            return tail[-30:].split()[-1]
        if last := _LAST_RUN.search(tail, max(0, len(tail) - 12)):
            return _word_before(tail, last.start(), 0) + last.group()
    last = None
    for last in _GAP.finditer(tail + " X", max(0, len(tail) - 12)):
        pass
    return _word_before(tail, last.start(), 0) + last.group(1) + last.group(2) if last and last.end(2) >= len(tail) else (tail[-30:].split() or [""])[-1]


class _Seen:
    """Certain events and open gaps of lines; words are counted as they stand and brought to their form once each."""

    def __init__(self) -> None:
        self.words = {"OPENS": Counter(), "INSIDE": Counter(), "ENDS": Counter()}
        self.runs: Counter = Counter()
        self.behind: list[str] = []
        self.behind_marks: list[str] = []

    def add(self, line: str) -> None:
        """Certain events of a line: its start, its end, the words inside that follow no closing mark; and its open gaps."""
        item = _item(line)
        first = item.end() if item else 0
        words = line[first:].split()
        if not words:
            return
        if not item:
            self.words["OPENS"][words[0]] += 1
        if "_" in line or _spaceless(line):
            self.behind += [b for a, b in pairwise(words) if (a[-1].isalnum() or a[-1] in ",;:") and not _SPACELESS.search(a[-1] + b[0])]
        else:  # all words but the first, less those behind other marks
            self.behind += words[1:]
            self.behind_marks += _BEHIND_MARK.findall(line, first)
        if len(self.behind) > HELD:
            self.count_behind()
        self.words["ENDS"][_last_word(line)] += 1
        for run in _runs(_candidates(line)):
            self.runs[run] += 1

    def count_behind(self) -> None:
        self.words["INSIDE"].update(self.behind)
        self.words["INSIDE"].subtract(self.behind_marks)
        self.behind.clear()
        self.behind_marks.clear()

    def size(self) -> int:
        return len(self.runs) + sum(map(len, self.words.values()))

    def known(self) -> Counter:
        self.count_behind()
        counts: Counter = Counter()
        for kind, found in self.words.items():
            form = _norm_left if kind == "ENDS" else _norm_right
            for word, n in found.items():
                if n:
                    counts[kind, form(word)] += n
        for run, n in self.runs.items():
            for left, right in zip(run[::2], run[1::2]):
                counts["CL", left] += n
                counts["CR", right] += n
        return counts


Keys = dict[tuple[str, ...], float]


def _batch(known: bool, counts: Keys) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([known] * len(keys), pa.bool_()), pa.array([list(k) for k in keys], pa.list_(pa.string())), pa.array([float(counts[k]) for k in keys], pa.float64())], names=["known", "key", "n"])


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Certain events of the lines, and the runs of gaps of each line, with their numbers."""
    seen = _Seen()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for _, line in _lines(text or ""):
                seen.add(line)
        if seen.size() > HELD:
            yield _batch(True, seen.known())
            yield _batch(False, seen.runs)
            seen = _Seen()
    yield _batch(True, seen.known())
    yield _batch(False, seen.runs)


def _expected(rows: list[tuple[list[str], float]], model: BoundaryModel, guess: bool) -> Counter:
    """Expected counts of the gaps of runs, from the first guess or from the posteriors."""
    counts: Counter = Counter()
    gaps = [_gaps(key) for key, _ in rows]
    posts = [[model.first_guess(g[2], g[3]) for g in found] for found in gaps] if guess else posteriors(model, gaps)
    for (_, n), found, post in zip(rows, gaps, posts):
        for i, ((_, _, left, right, _), p) in enumerate(zip(found, post)):
            context = "-" if i == 0 else "B" if post[i - 1] > 0.5 else "N"
            counts["LB", left, context] += n * p
            counts["LN", left, context] += n * (1 - p)
            counts["BR", right] += n * p
            counts["NR", right] += n * (1 - p)
    return counts


def _collected(counted: DataFrame) -> Keys:
    return {tuple(r["key"]): r["n"] for r in counted.select("key", "n").collect()}


def _soft_counts(runs: DataFrame, model: BoundaryModel, guess: bool = False) -> Keys:
    """Expected counts over all rows (key, n) of ``runs``."""
    shared = runs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = pickle.loads(shared.value), Counter()
        for batch in batches:
            counts.update(_expected(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), m, guess))
            if len(counts) > HELD:
                yield _batch(False, counts)
                counts = Counter()
        yield _batch(False, counts)

    return _collected(runs.select("key", "n").mapInArrow(count, "known boolean, key array<string>, n double").groupBy("key").agg(F.sum("n").alias("n")))


def _with_certain(known: dict, soft: dict) -> dict:
    """Certain and expected counts together."""
    out = Counter(known)
    out.update(soft)
    for (kind, word, *_), v in known.items():
        if kind == "ENDS":
            out["LB", word, "-"] += v
        elif kind == "OPENS":
            out["BR", word] += v
    return out


def bounded_sample(df: DataFrame, column: str, rows: int) -> DataFrame:
    """About ``rows`` of the distinct-by-hash texts of ``df``, the same ones on every run; all of them where there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(column), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def fit(texts: list[DataFrame]) -> BoundaryModel:
    """Estimate the model from every distinct text of one-column frames named ``text``."""
    every = None
    for df in texts:
        parts = max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
        part = df.where("text is not null").repartition(parts, "text").dropDuplicates(["text"]).mapInArrow(_events, "known boolean, key array<string>, n double")
        every = part if every is None else every.unionByName(part)
    counted = cut(every.groupBy("known", "key").agg(F.sum("n").alias("n")))
    known = _collected(counted.where("known"))
    runs = spread(counted.where("not known"))
    soft = _soft_counts(runs, BoundaryModel(known), guess=True)
    for _ in range(ROUNDS):
        soft = _soft_counts(runs, BoundaryModel(_with_certain(known, soft)))
    kept = {k: v for k, v in _with_certain(known, soft).items() if k[0] in ("LB", "LN", "BR", "NR", "INSIDE")}
    return BoundaryModel(kept)


def with_cuts(df: DataFrame, model: BoundaryModel) -> DataFrame:
    """Columns unit_table, record_id, text -> unit_table, record_id, cuts ARRAY<INT>."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            cuts = units(m, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.list_(pa.int32()))], names=["unit_table", "record_id", "cuts"])

    return df.select("unit_table", "record_id", "text").mapInArrow(run, "unit_table string, record_id string, cuts array<int>")


def sentence_units(df: DataFrame, model: BoundaryModel) -> DataFrame:
    """One row (unit_table, record_id, start_pos, end_pos) per sentence unit of the rows of ``df`` (unit_table, record_id, text)."""
    cuts = with_cuts(df, model).dropDuplicates(["unit_table", "record_id", "cuts"])
    pairs = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2, F.lit(2)), lambda i: F.struct(F.get("cuts", i).alias("s"), F.get("cuts", i + 1).alias("e")))
    return cuts.where(F.size("cuts") > 0).select("unit_table", "record_id", F.explode(pairs).alias("p")).select("unit_table", "record_id", F.col("p.s").alias("start_pos"), F.col("p.e").alias("end_pos"))


def corpus_texts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The two inputs of problem 1 as (unit_table, record_id, text)."""
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("unit_table"), F.col("chunk_id").alias("record_id"), "text")
    answers = table(spark, sf_dir, "ask_results").select(F.lit("ask_results").alias("unit_table"), F.col("trace_id").alias("record_id"), F.col("answer").alias("text"))
    return [chunks, answers]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunks.text and ask_results.answer as its ordered sentence units."""
    inputs = corpus_texts(spark, sf_dir)
    model = fit([x.select("text") for x in inputs])
    both = inputs[0].unionByName(inputs[1])
    return sentence_units(spread(both), model)

"""Page boilerplate mixed with main content (problem 5).

Method: tag-path ratios. The pages are text whose tags are gone, so the tree is read from the layout: a page has the zones before and
after its first heading, a zone has blocks between blank lines and headings, a block has lines. The path from the root to a line is
the zone, the shape of its block (the kinds of its lines in order), its place in the block, its own kind and its size class. No text
of a line is part of its path. Over the whole corpus each path gets its text length and its closing punctuation against the corpus
mean, and how often it occurs in the documents that have no site around them. The ratios are smoothed with those of the parent path
and with the neighbouring lines, fused as a geometric mean, and a threshold on the fused value selects the content.

Two passes: paths are counted by Spark with partial aggregation over all documents; there are at most ``RUNS`` runs in a shape, so the
table of paths that the second pass needs does not grow with the corpus. Every path is kept, however rare.

Defined results: pages without url have no site and give no row; null and empty texts give none; a page fetched again counts once
in the result; a corpus without plain documents is judged by length and punctuation alone; empty tables give empty results; further
columns are ignored. Texts are processed whole.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table

#: Runs of equal kinds that are told apart in the shape of a block.
RUNS = 4
#: Lines' worth of belief in the parent path.
PRIOR = 5.0
#: Part of the neighbouring lines in the value of a line whose path is unknown.
NEAR = 0.3
#: Weight of length, of punctuation and of the occurrence in plain documents.
WEIGHTS = (0.2, 0.2, 0.6)
THRESHOLD = 0.3

_ITEM = re.compile(r"\s*([-*•‣]|\d{1,3}[.)])\s+")
_JOINED = re.compile(r"\S(?:\s+[|/·•›>»–-]\s+|\s{2,})\S")
_END = re.compile(r"[.!?。！？؟।…](?:[\"'”“’»«」』）)\]]|\s|\[\d+\]|\W)*$")
#: Scripts whose sentences bear no closing marks: Thai, Lao, Burmese, Khmer.
_UNMARKED = re.compile(r"[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff]")


def _kind(line: str) -> str:
    """h heading, n numbered item, i item, r row of links, t text with and u text without a closing mark, x text of a script without such marks."""
    bare = line.strip()
    if bare[0] == "#" and bare.lstrip("#")[:1].isspace():
        return "h"
    if m := _ITEM.match(line):
        return "n" if m.group(1)[0].isdigit() else "i"
    if _END.search(bare):
        return "t"
    if _JOINED.search(bare):
        return "r"
    return "x" if len(_UNMARKED.findall(bare)) * 2 > len(bare) else "u"


#: (line number, path, length, closing mark, block)
Line = tuple[int, tuple[str, ...], int, int, int]


def line_paths(text: str) -> list[Line]:
    """The path of each non-blank line, from the root to the leaf; a heading is a block of its own."""
    blocks: list[list[tuple[int, str, str]]] = []
    apart = True
    for no, line in enumerate(text.split("\n")):
        if not line.strip():
            apart = True
            continue
        kind = _kind(line)
        if apart or kind == "h":
            blocks.append([])
        blocks[-1].append((no, kind, line.strip()))
        apart = kind == "h"
    out: list[Line] = []
    zone = "head"
    for b, block in enumerate(blocks):
        if block[0][1] == "h":
            zone = "body"
        runs = [(k, len(list(g))) for k, g in itertools.groupby(kind for _, kind, _ in block)]
        shape = "".join(k + "+" * (n > 1) for k, n in runs[:RUNS]) + "*" * (len(runs) > RUNS)
        for i, (no, kind, line) in enumerate(block):
            path = (zone, shape, "rest" if i else "first", kind, str(min(8, len(line) // 25)))
            out.append((no, path, len(line), int(bool(_END.search(line))), b))
    return out


def path_counts(documents: DataFrame) -> DataFrame:
    """(path, lines of pages, lines of plain documents, text length, closing marks) of every path, summed over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, ...], list[float]] = {}
        for batch in batches:
            for url, text in zip(*(c.to_pylist() for c in batch.columns)):
                for _, path, length, ends, _ in line_paths(text or ""):
                    s = sums.setdefault(path, [0.0, 0.0, 0.0, 0.0])
                    s[0 if url else 1] += 1
                    s[2] += length
                    s[3] += ends
        yield pa.RecordBatch.from_arrays([pa.array(["/".join(k) for k in sums], pa.string()), *(pa.array([v[i] for v in sums.values()], pa.float64()) for i in range(4))], names=["path", "web", "plain", "length", "ends"])

    sums = documents.select("url", "text").mapInArrow(count, "path string, web double, plain double, length double, ends double")
    return sums.groupBy("path").agg(*(F.sum(c).alias(c) for c in ("web", "plain", "length", "ends")))


class PathRatios:
    """The smoothed and fused ratios of every path."""

    def __init__(self, rows: list[tuple[str, float, float, float, float]], weights: tuple[float, float, float] = WEIGHTS):
        nodes: dict[tuple[str, ...], list[float]] = {}
        for path, *sums in rows:
            parts = tuple(path.split("/"))
            for i in range(len(parts) + 1):
                s = nodes.setdefault(self._node(parts, i), [0.0, 0.0, 0.0, 0.0])
                for j, x in enumerate(sums):
                    s[j] += x
        self.nodes = nodes
        web, plain, length, ends = nodes.get((), (0.0, 0.0, 0.0, 0.0))
        self.share = plain / (web + plain) if web + plain else 0.0
        # without plain documents length and punctuation decide alone
        a, b, c = weights
        self.weights = weights if self.share else (a / (a + b), b / (a + b), 0.0)
        self.length, self.ends = (x / (web + plain) if web + plain else 1.0 for x in (length, ends))
        self.known: dict[tuple[str, ...], tuple[float, float]] = {}

    @staticmethod
    def _node(parts: tuple[str, ...], depth: int) -> tuple[str, ...]:
        """The first ``depth`` steps of a path; the leaf's kind and size come before the shape of the block, which is the finest step."""
        zone, shape, place, kind, size = parts
        return (zone, kind, size, place, shape)[:depth]

    def ratios(self, path: tuple[str, ...]) -> tuple[float, float, float]:
        """(length, closing marks, share of plain documents) of a path's lines, each step smoothed with the one above."""
        mean = [self.length, self.ends, self.share]
        for depth in range(1, 6):
            s = self.nodes.get(self._node(path, depth))
            if s is None:
                break
            n = s[0] + s[1]
            mean = [(x + PRIOR * m) / (n + PRIOR) for x, m in zip((s[2], s[3], s[1]), mean)]
        return mean[0], mean[1], mean[2]

    def value(self, path: tuple[str, ...]) -> tuple[float, float]:
        """Fused ratio of a line's path, and how much its neighbours count: the less, the better the path is known."""
        if path not in self.known:
            length, ends, plain = self.ratios(path)
            text = min(1.0, length / max(1e-9, self.length))
            marks = text if path[3] == "x" else min(1.0, ends / max(1e-9, self.ends))
            own = min(1.0, plain / self.share) if self.share else 1.0
            a, b, c = self.weights
            n = sum(self.nodes.get(self._node(path, 5), (0.0, 0.0))[:2])
            # the product of the ratios to their weights: none makes up for another that is near 0
            self.known[path] = max(0.02, text) ** a * max(0.02, marks) ** b * own**c, NEAR * PRIOR / (PRIOR + n)
        return self.known[path]

    def furniture(self, text: str) -> list[int]:
        """Numbers of the lines that are not main content."""
        lines = line_paths(text)
        own = [self.value(path) for _, path, *_ in lines]
        out = []
        for i, (no, path, _, _, block) in enumerate(lines):
            if path[3] == "h":
                continue
            near = [own[j][0] for j in (i - 1, i + 1) if 0 <= j < len(lines) and lines[j][4] == block]
            value, share = own[i]
            if (1 - share) * value + share * (sum(near) / len(near) if near else value) < THRESHOLD:
                out.append(no)
        return out


def fit(documents: DataFrame) -> PathRatios:
    """The ratios of all paths; their number is bounded by the shapes, not by the corpus."""
    return PathRatios([tuple(r) for r in path_counts(spread(documents)).collect()])


def with_furniture(documents: DataFrame, ratios: PathRatios) -> DataFrame:
    """(doc_id, url, text) -> (doc_id, text, lines) with the numbers of the lines that are not main content."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(ratios))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = pickle.loads(shared.value)
        for batch in batches:
            lines = [r.furniture(t) if t and u else [] for u, t in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lines, pa.list_(pa.int32()))], names=["doc_id", "text", "lines"])

    return documents.select("doc_id", "url", "text").mapInArrow(run, "doc_id string, text string, lines array<int>")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a fetched page that is not main content."""
    documents = table(spark, sf_dir, "source_documents")
    pages = documents.where("url is not null and url <> ''")
    found = with_furniture(spread(pages), fit(documents)).select("doc_id", "lines").dropDuplicates()
    return found.select("doc_id", F.explode("lines").alias("line_no")).dropDuplicates()


def p5_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fetched page's own heading and body, with the number of lines taken out."""
    documents = table(spark, sf_dir, "source_documents")
    pages = documents.where("url is not null and url <> ''")
    found = with_furniture(spread(pages), fit(documents)).dropDuplicates(["doc_id", "lines"])
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("lines", i), x)), lambda x: x.isNotNull())
    return found.select("doc_id", F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n(?:[ \t]*\n){2,}", "\n\n")).alias("text"), F.size("lines").alias("lines_removed"))

"""Splitting oversized items at natural boundaries (problem 3).

Method: a recursive hierarchy of separators. An item is cut into sections, those that are too long into paragraphs, then
sentences (the units of problem 1), words and, at last, characters; the resulting atoms are packed greedily, so that each piece
stays within the limit and begins with the last ``overlap_chars`` of its predecessor.

A piece's new text is at most ``max_chars - overlap_chars`` long, so that every piece fits with its overlap. Pieces are spans
(start_pos, end_pos) of the item in code points; the first starts at 0, the last ends at the item's length, and each later one
starts exactly ``overlap_chars`` before the end of its predecessor.

Defined results: null texts and items within the limit give no piece; a limit not above its overlap is an error; equal rows count
once; empty tables give empty results; further columns are ignored. The length of an item is not limited.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from . import sentences

LEVELS = ("section", "paragraph", "sentence", "word", "character")
_HEADING = regex.compile(r"(?m)^(?=#{1,6}\s)")
_BLANK_LINES = regex.compile(r"\n[^\S\n]*\n\s*")
_LINES = regex.compile(r"\n+")
_SPACES = regex.compile(r"\s+")


def _cut(text: str, start: int, end: int, separator: regex.Pattern, empty: bool = False) -> list[tuple[int, int]]:
    """Atoms of [start, end) that each end behind a separator (before it, where the separator is empty)."""
    out, at = [], start
    for m in separator.finditer(text, start, end):
        stop = m.start() if empty else m.end()
        if stop > at:
            out.append((at, stop))
            at = stop
    if end > at:
        out.append((at, end))
    return out


def _sentence_atoms(text: str, start: int, end: int, model: sentences.BoundaryModel) -> list[tuple[int, int]]:
    ends = sentences.units(model, [text[start:end]])[0][2::2]
    marks = [start, *(start + e for e in ends), end]
    return [(a, b) for a, b in zip(marks, marks[1:]) if b > a]


def atoms(text: str, start: int, end: int, most: int, level: int, lines_are_paragraphs: bool, model: sentences.BoundaryModel) -> list[tuple[int, int]]:
    """[start, end) in parts of at most ``most`` characters, of the highest level that allows it."""
    if end - start <= most:
        return [(start, end)]
    if level == 4:
        return [(a, min(end, a + most)) for a in range(start, end, most)]
    if level == 0:
        parts = _cut(text, start, end, _HEADING, empty=True)
    elif level == 1:
        parts = _cut(text, start, end, _LINES if lines_are_paragraphs else _BLANK_LINES)
    elif level == 2:
        parts = _sentence_atoms(text, start, end, model)
    else:
        parts = _cut(text, start, end, _SPACES)
    return [x for a, b in parts for x in atoms(text, a, b, most, level + 1, lines_are_paragraphs, model)]


def pack(parts: list[tuple[int, int]], max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Greedily joined atoms; from the second piece on with the overlap before them."""
    out: list[tuple[int, int]] = []
    start = at = 0
    for a, b in parts:
        room = max_chars if not out else max_chars - overlap
        if b - start > room and at > start:
            out.append((start if not out else start - overlap, at))
            start = a
        at = b
    out.append((start if not out else start - overlap, at))
    return out


def longest_run(text: str, separator: regex.Pattern) -> int:
    return max((len(x.strip()) for x in separator.split(text)), default=0)


def cut_level(text: str, most: int, lines_are_paragraphs: bool, model: sentences.BoundaryModel) -> str:
    """The highest level at which no part is longer than ``most``."""
    if longest_run(text, _LINES if lines_are_paragraphs else _BLANK_LINES) <= most:
        return "paragraph"
    cuts = sentences.units(model, [text])[0]
    if max((b - a for a, b in zip(cuts[::2], cuts[1::2])), default=0) <= most:
        return "sentence"
    return "word" if longest_run(text, _SPACES) <= most else "character"


def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items above their limit, once each: (item_table, item_id, item_field, max_chars, overlap_chars, text)."""
    limits = table(spark, sf_dir, "split_limits")
    documents, chunks = table(spark, sf_dir, "source_documents"), table(spark, sf_dir, "chunks")
    items = [
        documents.select(F.lit("source_documents").alias("item_table"), F.lit("text").alias("item_field"), F.col("doc_id").alias("item_id"), "text"),
        chunks.select(F.lit("chunks").alias("item_table"), F.lit("text").alias("item_field"), F.col("chunk_id").alias("item_id"), "text"),
        chunks.select(F.lit("chunks").alias("item_table"), F.lit("section").alias("item_field"), F.col("chunk_id").alias("item_id"), F.col("section").alias("text")),
    ]
    fields = ("item_table", "item_field")
    # one row per field of the schema, whatever the size of the data: small by construction
    limit = limits.groupBy(*fields).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("limit")).select(*fields, "limit.max_chars", "limit.overlap_chars")
    every = items[0].unionByName(items[1]).unionByName(items[2])
    above = every.join(F.broadcast(limit), list(fields)).where(F.char_length("text") > F.col("max_chars"))
    return above.select("item_table", "item_id", "item_field", "max_chars", "overlap_chars", "text").dropDuplicates(["item_table", "item_id", "item_field", "text"])


_COLUMNS = ("item_table", "item_id", "item_field", "max_chars", "overlap_chars")


def split_items(df: DataFrame, model: sentences.BoundaryModel) -> DataFrame:
    """Each item of ``oversized`` with its cut level and the spans of its pieces, one Arrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            levels, pieces = [], []
            for name, _, _, most, overlap, text in zip(*(c.to_pylist() for c in batch.columns)):
                if most <= overlap or overlap < 0:
                    raise ValueError(f"max_chars {most} must be above overlap_chars {overlap}, and that not below 0")
                lines = name == "chunks"
                levels.append(cut_level(text, most - overlap, lines, m))
                spans = pack(atoms(text, 0, len(text), most - overlap, 0, lines, m), most, overlap)
                pieces.append([{"start_pos": a, "end_pos": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(levels, pa.string()), pa.array(pieces, kind)], names=["item_table", "item_id", "item_field", "cut_level", "pieces"])

    schema = "item_table string, item_id string, item_field string, cut_level string, pieces array<struct<start_pos: int, end_pos: int>>"
    return df.select(*_COLUMNS, "text").mapInArrow(run, schema)


def _model(spark: SparkSession, sf_dir: str) -> sentences.BoundaryModel:
    return sentences.fit([x.select("text") for x in sentences.corpus_texts(spark, sf_dir)])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized item with the level at which it can be cut."""
    return split_items(spread(oversized(spark, sf_dir)), _model(spark, sf_dir)).select("item_table", "item_id", "item_field", "cut_level")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized item as its pieces, numbered from 0."""
    items = oversized(spark, sf_dir)
    found = split_items(spread(items), _model(spark, sf_dir)).withColumnRenamed("item_table", "t")
    found = found.select(F.col("t").alias("item_table"), "item_id", "item_field", F.posexplode("pieces").alias("piece_no", "p"))
    return found.select("item_table", "item_id", "item_field", "piece_no", F.col("p.start_pos").alias("start_pos"), F.col("p.end_pos").alias("end_pos"))

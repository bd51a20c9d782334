"""BM25 over an inverted index, coverage and confidence, rank fusion and dense search, for whole batches of questions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import text as tx
from ..runtime import cut

K1, B = 1.4, 0.75
RRF_K = 60
#: Most query vectors held by every task of a dense search; more are searched in several passes.
QUERY_BLOCK = 4096
#: Rows scored at once against a block of query vectors.
ROWS = 1000
#: Sets of words held by every task of a search, in ``QUERY_BLOCK``s.
SETS = 16
#: Chunks that a task of a search has at most on average; rows of its first block and of the further ones, which are indexed at once.
TASK_ROWS, FIRST_ROWS, BLOCK_ROWS = 500_000, 4096, 65_536
#: More than sums of the same gains in another order, or rounding to nine digits, may differ by.
SLACK = 1e-8
#: Buckets of hashed term vectors.
DIMENSIONS = 256


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, title, section, text) -> (chunk_id, terms, dl), one row per chunk; header and text are indexed together."""
    title, section = F.coalesce("title", F.lit("")), F.coalesce("section", F.lit(""))
    header = F.when((section != "") & (section != title), F.concat_ws(" > ", title, section)).otherwise(title)
    once = chunks.dropDuplicates(["chunk_id"])
    terms = once.select("chunk_id", tx.content_terms(F.concat(header, F.lit("\n"), F.coalesce("text", F.lit("")))).alias("terms"))
    return terms.select("chunk_id", "terms", F.size("terms").alias("dl"))


def postings(terms: DataFrame) -> DataFrame:
    """(chunk_id, terms, dl) -> (term, chunk_id, tf, dl), counted by Spark."""
    return terms.select("chunk_id", "dl", F.explode("terms").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def terms_once(terms: DataFrame) -> DataFrame:
    """(chunk_id, terms) -> (term, chunk_id) with each term of a chunk once, without a shuffle."""
    return terms.select(F.explode(F.array_distinct("terms")).alias("term"), "chunk_id")


def corpus_size(terms: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    return terms.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(found: DataFrame, size: DataFrame) -> DataFrame:
    """(term, chunk_id) -> (term, df, idf); ``size`` is one row."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(size)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(questions: DataFrame) -> DataFrame:
    """(qid, question) -> (qid, term, alt): each content term of a question with itself and its glossary terms."""
    gloss = tx.glossary(questions.sparkSession)
    kept = F.filter(tx.tokens(F.col("question")), tx.is_content)
    words = questions.select("qid", F.explode(F.array_distinct(kept)).alias("token")).withColumn("term", tx.stem(F.col("token")))
    own = words.select("qid", "term", F.col("term").alias("alt"))
    more = words.join(F.broadcast(gloss), "token").select("qid", "term", F.col("gloss").alias("alt"))
    return own.unionByName(more).dropDuplicates()


def indexed(chunks: DataFrame) -> DataFrame:
    """``chunk_terms`` written once, for the several stages that read it."""
    return cut(chunk_terms(chunks))


def search(questions: DataFrame, terms: DataFrame, k: int = 5) -> DataFrame:
    """(qid, question) x ``indexed`` chunks -> (qid, rank, chunk_id, score): the k best chunks of every question by BM25.

    Questions of the same words are one set of words and searched once; of chunks with the same terms only the k lowest ids can be
    among the best. Sets are taken in blocks of ``SETS`` times ``QUERY_BLOCK``. A pass over the chunks scores them against the sets of
    a block and keeps the k best of each set per task, so that what is shuffled is k rows per set and task, never a row per
    question and chunk; the result is exact. Ties of the score go to the lower chunk_id. Contributions are added in the order of
    the terms, so that equal sets of terms give equal scores.
    """
    spark = questions.sparkSession
    asked = query_terms(questions).groupBy("qid").agg(F.array_sort(F.collect_set("alt")).alias("words"))
    asked = cut(asked.select("qid", "words", F.concat_ws(" ", "words").alias("said")))
    sets = cut(asked.select("said", "words").dropDuplicates(["said"]).select(F.monotonically_increasing_id().alias("set_no"), "said", "words"))
    blocks = max(1, math.ceil(sets.count() / (SETS * QUERY_BLOCK)))
    of = F.pmod(F.xxhash64("set_no"), F.lit(blocks))
    size = corpus_size(terms)
    of_all = size.collect()[0]
    slots = max(spark.sparkContext.defaultParallelism, math.ceil(of_all["n"] / TASK_ROWS))
    alike = terms.select("chunk_id", F.sort_array("terms").alias("terms"), "dl").withColumn("h", F.xxhash64("terms")).repartition(slots, "h")
    alike = alike.withColumn("copy", F.row_number().over(Window.partitionBy("h", "terms").orderBy("chunk_id"))).where(F.col("copy") <= k).select("chunk_id", "terms", "dl")
    alike = cut(alike) if blocks > 1 else alike
    found = []
    for block in range(blocks):
        # at most SETS * QUERY_BLOCK sets and their words
        some = sets.where(of == block).select("set_no", "words").toArrow()
        used = spark.createDataFrame([(t,) for t in sorted(set(pc.unique(some.column(1).combine_chunks().flatten()).to_pylist()))], "term string")
        weights = {r["term"]: r["idf"] for r in idf(terms_once(terms).join(F.broadcast(used), "term", "left_semi"), size).collect()}
        found.append(_best_chunks(alike, some, weights, float(of_all["avgdl"]), k))
    rank = F.row_number().over(Window.partitionBy("set_no").orderBy(F.round("score", 9).desc(), "chunk_id"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(sets.select("set_no", "said"), "set_no").join(asked.select("qid", "said"), "said").select("qid", "rank", "chunk_id", "score")


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in blocks: a small one, from which the least scores are known, then blocks of about ``BLOCK_ROWS``."""
    held, n, most = [], 0, FIRST_ROWS
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            part = whole.slice(at, most - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, most = [], 0, BLOCK_ROWS
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _best_chunks(terms: DataFrame, sets: pa.Table, weights: dict[str, float], avgdl: float, k: int) -> DataFrame:
    """The k best chunks (set_no, chunk_id, score) of each set of words (set_no, words) in each task."""
    vocabulary = sorted(weights)
    words = sets.column(1).combine_chunks()
    code = pc.index_in(words.flatten(), value_set=pa.array(vocabulary, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    starts = np.searchsorted(owner[code >= 0], np.arange(len(words) + 1))  # words are in the order of the terms
    shared = terms.sparkSession.sparkContext.broadcast((sets.column(0).to_numpy(), starts, code[code >= 0], vocabulary, np.array([weights[t] for t in vocabulary])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, starts, codes, vocabulary, idfs = shared.value
        known = pa.array(vocabulary, pa.string())
        best_score = np.full((len(numbers), k), -np.inf)
        best_chunk = np.full((len(numbers), k), "", object)
        asking = np.flatnonzero(np.diff(starts))
        for part in _row_blocks(batches) if len(asking) else ():
            n = part.num_rows
            lists = part.column(1)
            code = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            chunk = np.repeat(np.arange(n), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            there = code >= 0
            key, tf = np.unique(code[there].astype(np.int64) * n + chunk[there], return_counts=True)
            term, row = np.divmod(key, n)
            dl = part.column(2).to_numpy(zero_copy_only=False)[row]
            gain = idfs[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)))
            of_term = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            some = np.diff(of_term) > 0
            most = np.zeros(len(vocabulary))
            if len(term):
                most[some] = np.maximum.reduceat(gain, of_term[:-1][some])
            postings = [(row[a:z], gain[a:z]) for a, z in zip(of_term[:-1].tolist(), of_term[1:].tolist())]
            ids = part.column(0).to_numpy(zero_copy_only=False)
            by_id = np.empty(n, np.int64)
            by_id[np.argsort(ids)] = np.arange(n)
            # a set whose words' greatest gains together stay below its k-th score has no better chunk here
            reach = np.add.reduceat(most[codes], starts[asking])
            for q in asking[(reach > 0) & (reach >= best_score[asking, -1] - SLACK)].tolist():
                own = codes[starts[q] : starts[q + 1]].tolist()
                hit, s = _scored(postings, most, key, gain, own, n, best_score[q, -1] - SLACK)
                if not len(hit):
                    continue
                r = np.round(s, 9)
                if len(hit) > k:
                    least = r >= np.partition(r, len(r) - k)[len(r) - k]  # with all ties of the last place
                    hit, s, r = hit[least], s[least], r[least]
                first = np.lexsort((by_id[hit], -r))[:k]
                every = [(-a, c, b) for a, c, b in zip(r[first].tolist(), ids[hit[first]], s[first].tolist())]
                every += [(-round(b, 9), c, b) for b, c in zip(best_score[q].tolist(), best_chunk[q]) if b > -np.inf]
                for i, (_, c, b) in enumerate(sorted(every)[:k]):
                    best_score[q, i], best_chunk[q, i] = b, c
        at, place = np.nonzero(best_score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[at], pa.int64()), pa.array(best_chunk[at, place], pa.string()), pa.array(best_score[at, place], pa.float64())], names=["set_no", "chunk_id", "score"])

    return terms.select("chunk_id", "terms", "dl").mapInArrow(run, "set_no bigint, chunk_id string, score double")


def _scored(postings: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray, key: np.ndarray, gain: np.ndarray, own: list[int], n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that score at least ``least``, if not more, for the terms ``own``, and their scores.

    ``postings`` has the rows and gains of each term, ``most`` its greatest gain, ``key`` and ``gain`` all postings by term * n + row.
    Rows that have only terms whose greatest gains together stay below ``least`` are not looked at.
    """
    needed, left = own, 0.0
    if least > 0:
        needed = []
        for t in sorted(own, key=most.__getitem__):
            if needed or left + most[t] >= least:
                needed.append(t)
            else:
                left += most[t]
        needed.sort()
    if not needed:
        return np.empty(0, np.int64), np.empty(0)
    lists = [postings[t] for t in needed]
    s = np.bincount(np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists]), n)
    hit = np.flatnonzero(s > max(0.0, least - left - SLACK))
    if len(needed) == len(own) or not len(hit):
        return hit, s[hit]
    lists = [postings[t] for t in own]
    if 40 * len(hit) * len(own) > sum(len(x[0]) for x in lists):  # looking up so many is slower than adding all
        s = np.bincount(np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists]), n)
        hit = np.flatnonzero(s > max(0.0, least - SLACK))
        return hit, s[hit]
    # the remaining rows in full, added in the order of the terms
    total = np.zeros(len(hit))
    wanted = np.array(own, np.int64)[:, None] * n + hit
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    for part in np.where(key[at] == wanted, gain[at], 0.0):
        total += part
    return hit, total


def coverage(questions: DataFrame, hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Each hit of ``search`` with the weighted share of the question's terms that its chunk has.

    A term weighs the least idf of its known alternatives, or the greatest possible one if none is known.
    """
    wanted = query_terms(questions)
    found = terms_once(terms).join(wanted.select(F.col("alt").alias("term")).dropDuplicates(), "term", "left_semi")
    size = corpus_size(terms)
    known = idf(found, size)
    top = size.select(F.log(1 + (F.greatest("n", F.lit(1)) + 0.5) / 0.5).alias("top"))
    weights = wanted.join(known, wanted["alt"] == known["term"], "left").groupBy("qid", wanted["term"]).agg(F.min("idf").alias("w"), F.collect_set("alt").alias("alts"))
    weights = weights.join(F.broadcast(top)).select("qid", F.struct(F.coalesce("w", "top").alias("w"), "alts").alias("t"))
    per_question = weights.groupBy("qid").agg(F.collect_list("t").alias("qterms"))
    own = hits.join(terms.select("chunk_id", "terms"), "chunk_id").join(per_question, "qid", "left")
    total = F.aggregate("qterms", F.lit(0.0), lambda a, t: a + t["w"])
    hit = F.aggregate(F.filter("qterms", lambda t: F.arrays_overlap(t["alts"], F.col("terms"))), F.lit(0.0), lambda a, t: a + t["w"])
    return own.select("qid", "rank", "chunk_id", "score", F.when(total > 0, hit / total).otherwise(0.0).alias("coverage"))


def confidence(covered: DataFrame) -> DataFrame:
    """(qid, rank, coverage) -> (qid, confidence): the best coverage of the three first hits."""
    return covered.where("rank <= 3").groupBy("qid").agg(F.max("coverage").alias("confidence"))


def fuse(rankings: list[DataFrame], k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of rankings (qid, rank, chunk_id): sums of 1 / (60 + rank); ties go to the lower chunk_id."""
    every = rankings[0].select("qid", "rank", "chunk_id")
    for r in rankings[1:]:
        every = every.unionByName(r.select("qid", "rank", "chunk_id"))
    fused = every.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "chunk_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(qid, embedding) x (vec_id, embedding) -> (qid, rank, vec_id, score): the k nearest by inner product.

    Queries are taken in blocks of ``QUERY_BLOCK``; a pass multiplies each block of rows with a block of queries and keeps the k
    best of each query per batch of rows, so that what is shuffled is k rows per query and batch. Null vectors match nothing.
    """
    spark = queries.sparkSession
    count = queries.where("embedding is not null").count()
    ids = queries.where("embedding is not null").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, math.ceil(count / QUERY_BLOCK)))))
    kinds = (queries.schema["qid"].dataType, vectors.schema["vec_id"].dataType)
    found = None
    for block in range(max(1, math.ceil(count / QUERY_BLOCK))):
        rows = ids.where(F.col("block") == block).select("qid", "embedding").collect()
        shared = spark.sparkContext.broadcast(([r["qid"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            for batch in batches:
                if not batch.num_rows or not len(qids):
                    continue
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    v = np.array(part.column(1).to_pylist(), np.float64)
                    scores = q @ v.T
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    order = np.lexsort((np.broadcast_to(keys, scores.shape), -np.round(scores, 9)))[:, :k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(qids, order.shape[1]), to_arrow_type(kinds[0])), pa.array(keys[order].ravel(), to_arrow_type(kinds[1])), pa.array(np.take_along_axis(scores, order, 1).ravel(), pa.float64())],
                        names=["qid", "vec_id", "score"],
                    )

        part = vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(best, f"qid {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")


def hashed_vectors(terms: DataFrame) -> DataFrame:
    """(chunk_id, terms) -> (chunk_id, embedding): hashed term counts of length 1, for where no encoder is at hand.

    Bucket of a term: the first two hexadecimal digits of its MD5. A chunk without terms has a vector of zeros.
    """
    buckets = F.transform("terms", lambda t: F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int"))
    zeros = F.array_repeat(F.lit(0.0), DIMENSIONS)
    counts = terms.select("chunk_id", F.explode_outer(buckets).alias("b")).groupBy("chunk_id", "b").agg(F.count("b").cast("double").alias("c"))
    each = counts.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "c")))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return each.select("chunk_id", F.transform(zeros, lambda z, i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), z) / F.col("norm")).otherwise(z)).alias("embedding"))


def question_vectors(questions: DataFrame) -> DataFrame:
    """(qid, question) -> (qid, embedding): the same vectors of the questions' words and glossary terms."""
    words = query_terms(questions).groupBy("qid").agg(F.collect_set("alt").alias("terms"))
    return hashed_vectors(words.withColumnRenamed("qid", "chunk_id")).withColumnRenamed("chunk_id", "qid")


def hybrid(questions: DataFrame, terms: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 5, depth: int = 20) -> DataFrame:
    """Reciprocal rank fusion of the ``depth`` best chunks by BM25 and by inner product of (chunk_id, embedding) with (qid, embedding).

    (qid, rank, chunk_id, score, dense): ``dense`` is the inner product where the chunk is among the nearest.
    """
    lexical = search(questions, terms, depth)
    dense = dense_search(query_vectors, vectors.withColumnRenamed("chunk_id", "vec_id"), depth).where("score > 0").withColumnRenamed("vec_id", "chunk_id")
    near = cut(dense)
    fused = fuse([lexical, near], k)
    return fused.join(near.select("qid", "chunk_id", F.col("score").alias("dense")), ["qid", "chunk_id"], "left").select("qid", "rank", "chunk_id", "score", "dense")


def dense_confidence(covered: DataFrame, low: float = 0.78, high: float = 0.90) -> DataFrame:
    """(qid, rank, coverage, dense) -> (qid, confidence): coverage of the three first hits, or their similarity between ``low`` and ``high`` if higher."""
    near = F.when(F.col("dense").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("dense") - low) / (high - low))))
    return covered.where("rank <= 3").groupBy("qid").agg(F.greatest(F.max("coverage"), F.coalesce(F.max(near), F.lit(0.0))).alias("confidence"))


def write_index(chunks: DataFrame, path: str) -> None:
    """The index as Parquet: the chunks' terms, which every search reads."""
    chunk_terms(chunks).write.mode("overwrite").parquet(f"{path}/terms")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index written by ``write_index``, as ``search`` and ``coverage`` take it."""
    return spark.read.parquet(f"{path}/terms")


def load_or_build(chunks: DataFrame, path: str) -> DataFrame:
    """The stored index, built first where there is none."""
    spark = chunks.sparkSession
    try:
        return read_index(spark, path)
    except AnalysisException:  # no such path
        write_index(chunks, path)
        return read_index(spark, path)

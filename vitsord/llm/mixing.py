"""Mixing sources to target weights (problem 7).

Method: Pareto order sampling. Sizes are tokens of a public tokenizer. From the tokens of each source, its target share and the most
copies of a record follow the whole copies that every record gets for certain and the rest, for which records are ranked by their
random odds divided by their inclusion odds, u/(1-u) over p/(1-p); the lowest ranks fill the rest of the source's tokens.

Inclusion probabilities grow with the root of a record's size, p = min(1, c * sqrt(size)); c is solved for each source from a
histogram of its sizes, so that the expected tokens are what is to be filled and the certain records (p = 1) never exceed it.

The total defaults to the largest at which every source with records meets its target share with at most ``max_repeats`` copies; a
larger ``total_tokens`` may be asked for, and then capped sources fall short. Targets of sources without records are shared by the
others in proportion, and reported with a reached share of 0.

The cut of the ranking is found without sorting a source in one task: ranks are counted in buckets of their logarithm, ``STEPS`` to a
factor of e (an aggregation of bounded size), and only the bucket in which the tokens run out is ordered by a window.

Defined results: spellings of a source (case, outer spaces, - for _) are one source; records without source, of a source without
target, or without any token are not drawn; equal texts under other ids are other records; ties of the ranking fall to the lower
doc_id; empty tables give empty results; further columns are ignored. The draw is the same for the same ``seed``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, spread, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public vocabulary splits a text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rank buckets to a factor of e, and the largest logarithm kept apart.
STEPS, FAR = 1024, 40
#: Size classes to a factor of two, for the scale of the inclusion probabilities.
CLASSES = 16


def clean_source(column: str) -> Column:
    """One spelling of a source; null where it is blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s-]+", "_"), F.lit(""))


def with_tokens(df: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, source, tokens); every text is tokenized whole. The vocabulary file goes to the executors."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])

    return df.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, tokens long")


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, float]:
    """Tokens to take of each source that has records and a target."""
    shares = {s: share for s, (share, _) in targets.items() if sizes.get(s, 0) > 0 and share > 0}
    whole = sum(shares.values())
    if not whole:
        return {}
    most = {s: sizes[s] * max(0, targets[s][1]) for s in shares}
    total = total_tokens if total_tokens is not None else min(most[s] / (shares[s] / whole) for s in shares)
    return {s: min(float(most[s]), total * shares[s] / whole) for s in shares}


def scale(classes: list[tuple[float, float, float]], rest: float) -> float:
    """c of p = min(1, c * sqrt(size)) for which the expected tokens are ``rest``.

    ``classes`` are (largest size, tokens, sum of size * sqrt(size)) of each size class. Classes are taken as certain from the largest
    sizes on, while their largest record would have p of 1 or more and all of them fit into ``rest``.
    """
    certain, others = 0.0, sum(root for _, _, root in classes)
    for largest, tokens, root in sorted(classes, reverse=True):
        c = (rest - certain) / others
        if c * largest**0.5 < 1:
            return c
        if certain + tokens > rest:
            return (1 - 1e-9) / largest**0.5
        certain, others = certain + tokens, others - root
    return 1.0


def filled(ranked: DataFrame, nearest: bool) -> DataFrame:
    """Ranked records with ``extra`` = 1 for the lowest ranks of each source, up to ``rest`` tokens.

    The record at which the tokens run out is left out, or taken if that comes ``nearest``.
    """
    buckets = ranked.groupBy("source", "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("tokens")
    edge = buckets.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest"))).select("source", F.col("bucket").alias("edge"), F.col("before").alias("taken"))
    # at most one row per source
    marked = ranked.join(F.broadcast(edge), "source", "left")
    inside = marked.where(F.col("bucket") == F.col("edge")).withColumn("sum", F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id")) + F.col("taken"))
    last = F.col("sum") - F.col("tokens") / 2 if nearest else F.col("sum")
    inside = inside.withColumn("extra", (last <= F.col("rest")).cast("int")).drop("sum")
    others = marked.where(~F.equal_null("bucket", "edge")).withColumn("extra", F.when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), (F.col("rest") > 0).cast("int")).otherwise(0))
    return others.unionByName(inside).drop("edge", "taken")


def draw(records: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens) and (source, target_share, max_repeats) -> the mix (doc_id, source, tokens, copies) and its shares."""
    # one row per source of the targets table, a fixed and small list
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source is not null and target_share is not null").select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).collect()}
    known = records.where(F.col("source").isin(*wanted) & (F.col("tokens") > 0)) if wanted else records.where(F.lit(False))
    sized = known.groupBy("source", F.floor(F.log2("tokens") * CLASSES).alias("class")).agg(
        F.max("tokens").alias("largest"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.sqrt("tokens")).alias("root")
    )
    classes: dict[str, list[tuple[float, float, float]]] = {}
    for r in sized.collect():  # some hundred size classes of each source
        classes.setdefault(r["source"], []).append((float(r["largest"]), float(r["tokens"]), float(r["root"])))
    sizes = {s: int(sum(t for _, t, _ in c)) for s, c in classes.items()}
    take = plan(sizes, wanted, total_tokens)
    spark = records.sparkSession
    rows = []
    for s, tokens in sorted(take.items()):
        copies = min(int(tokens // sizes[s]), wanted[s][1])
        rest = max(0.0, float(tokens - copies * sizes[s]))
        rows.append((s, copies, rest, scale(classes[s], rest)))
    quota = spark.createDataFrame(rows, "source string, whole_copies int, rest double, scale double")
    p = F.col("scale") * F.sqrt("tokens")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    odds = F.log(u / (1 - u)) - F.log(p / (1 - p))
    rank = F.when(p >= 1, F.lit(float("-inf"))).when(p <= 0, F.lit(float("inf"))).otherwise(odds)
    ranked = known.join(F.broadcast(quota), "source").withColumn("rank", rank)
    # certain records have a bucket of their own before all others
    ranked = ranked.withColumn("bucket", F.when(p >= 1, -FAR * STEPS - 1).otherwise(F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("rank"))) * STEPS)).cast("int"))
    first = filled(ranked, nearest=False)
    # what the record that did not fit leaves open is filled by the next ones that are small enough
    sums = {r["source"]: r["taken"] for r in first.where("extra > 0").groupBy("source").agg(F.sum("tokens").alias("taken")).collect()}
    gaps = spark.createDataFrame([(s, rest - float(sums.get(s, 0))) for s, _, rest, _ in rows], "source string, gap double")
    rest_of = first.join(F.broadcast(gaps), "source").withColumn("open", (F.col("extra") == 0) & (F.col("tokens") <= F.col("gap")))
    second = filled(rest_of.where("open").drop("extra", "open", "rest").withColumnRenamed("gap", "rest"), nearest=True)
    columns = ["doc_id", "source", "tokens", "whole_copies", "extra"]
    both = rest_of.where("not open").select(columns).unionByName(second.select(columns))
    mix = both.select("doc_id", "source", "tokens", (F.col("whole_copies") + F.col("extra")).alias("copies")).where("copies > 0")
    reached = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("records"), F.max("copies").alias("most_copies"))
    whole = reached.agg(F.sum("tokens").alias("all_tokens"))
    shares = targets.select("source", "target_share", "max_repeats").join(reached, "source", "left").join(F.broadcast(whole))
    shares = shares.select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "records", "most_copies")), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"))
    return mix, shares


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with one spelling of their source and their size in tokens; cut, for sizes are needed several times."""
    documents = table(spark, sf_dir, "documents").select("doc_id", clean_source("source").alias("source"), "text")
    return cut(with_tokens(spread(documents)))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn document with its copies."""
    return draw(records_of(spark, sf_dir), table(spark, sf_dir, "source_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens that each target source reached."""
    return draw(records_of(spark, sf_dir), table(spark, sf_dir, "source_targets"))[1]

"""Extractive answers: the best sentences of the best chunks, each with the number of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import guard
from ..functions import text as tx
from ..runtime import cut, spread
from . import plan, retrieve, verify

ABSTAIN_BELOW = 0.34
HITS, SENTENCES, RELATIVE = 4, 3, 0.6
# What is said where the sources do not answer, and the words that make a question Swedish or English.
ABSTAIN_EN = "I could not find this in the documents I have. Please contact the relevant agency directly."
ABSTAIN_SV = "Jag kunde inte hitta detta i de dokument jag har. Please contact the relevant agency directly."
SWEDISH = r"(?iuU)\b(hur|vad|när|vilken|vilka|måste|jag|kan|får|ska|min|mitt|mina)\b"
ENGLISH = r"(?iuU)\b(the|what|how|when)\b"


def question_terms(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, question), (term, idf) -> (qid, qterms): each term with its place in the question, its alternatives and their idf."""
    kept = F.filter(tx.tokens(F.col("question")), tx.is_content)
    words = questions.select("qid", F.posexplode(kept).alias("pos", "token")).withColumn("term", tx.stem(F.col("token")))
    gloss = tx.glossary(questions.sparkSession).withColumnRenamed("gloss", "alt")
    own = words.select("qid", "pos", "term", F.col("term").alias("alt"))
    every = own.unionByName(words.join(F.broadcast(gloss), "token").select("qid", "pos", "term", "alt"))
    every = every.groupBy("qid", "term", "alt").agg(F.min("pos").alias("pos"))
    weighed = every.join(known.select(F.col("term").alias("alt"), "idf"), "alt", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    per_term = weighed.groupBy("qid", "term").agg(F.min("pos").alias("pos"), F.collect_list(F.struct("alt", "idf")).alias("alts"))
    return per_term.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "alts"))).alias("qterms"))


def _has(t: Column, terms: Column) -> Column:
    return F.exists(t["alts"], lambda a: F.array_contains(terms, a["alt"]))


def _best(alts: Column) -> Column:
    return F.array_max(F.transform(alts, lambda a: a["idf"]))


def cited(sentence: Column, n: Column) -> Column:
    """The sentence with its source number before its closing mark."""
    mark = F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))
    return F.when(sentence.rlike(r"[.!?]$"), F.concat(F.substring(sentence, F.lit(1), F.char_length(sentence) - 1), mark, F.substring(sentence, -1, 1))).otherwise(F.concat(sentence, mark, F.lit(".")))


def scored_sentences(questions: DataFrame, hits: DataFrame, chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, rank, pos, chunk_id, sentence, score) of every sentence of the first hits that shares a word with its question.

    A term counts half if the title has it. The sum of the greatest idf of each term's hit alternatives, plus 0.6 of those in the
    section but not the title, is multiplied by the weight of the last term, in the question's order, that the sentence has.
    """
    alts = retrieve.query_terms(questions).select(F.col("alt").alias("term")).dropDuplicates()
    known = retrieve.idf(retrieve.terms_once(terms).join(alts, "term", "left_semi"), retrieve.corpus_size(terms))
    first = hits.where(F.col("rank") <= HITS).select("qid", "rank", "chunk_id")
    # each chunk that is among the hits of any question is taken apart once
    own = chunks.join(first.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]).select("chunk_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "section", "text")))
    parts = F.transform(tx.sentences(F.col("text")), lambda x: F.named_struct(F.lit("sentence"), x, F.lit("s_terms"), tx.content_terms(x)))
    apart = cut(spread(own).select("chunk_id", tx.content_terms(F.col("title")).alias("title_terms"), tx.content_terms(F.col("section")).alias("section_terms"), parts.alias("parts")))
    rows = first.join(apart, "chunk_id").join(question_terms(questions, known), "qid")
    in_section = F.filter("qterms", lambda t: _has(t, F.col("section_terms")) & ~_has(t, F.col("title_terms")))
    rows = rows.withColumn("bonus", F.aggregate(in_section, F.lit(0.0), lambda a, t: a + _best(t["alts"])))
    # each term with its weight for this chunk
    weighed = F.transform("qterms", lambda t: F.named_struct(F.lit("alts"), t["alts"], F.lit("w"), F.when(_has(t, F.col("title_terms")), 0.5).otherwise(1.0)))
    rows = rows.select("qid", "rank", "chunk_id", "bonus", weighed.alias("qterms"), F.posexplode("parts").alias("pos", "p")).select("qid", "rank", "chunk_id", "bonus", "qterms", "pos", "p.sentence", "p.s_terms")
    rows = rows.withColumn("hit", F.filter("qterms", lambda t: _has(t, F.col("s_terms"))))
    overlap = F.aggregate("hit", F.lit(0.0), lambda a, t: a + t["w"] * _best(F.filter(t["alts"], lambda x: F.array_contains("s_terms", x["alt"]))))
    rows = rows.where(F.size("hit") > 0).withColumn("overlap", overlap).where("overlap > 0")
    return rows.select("qid", "rank", "pos", "chunk_id", "sentence", ((F.col("overlap") + 0.6 * F.col("bonus")) * F.element_at("hit", -1)["w"]).alias("score"))


def extract(questions: DataFrame, chunks: DataFrame, k: int = 5, abstain_below: float = ABSTAIN_BELOW, terms: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(qid, question) -> (qid, answer, abstained, confidence, sources): one row per question, whatever was found.

    Up to three sentences within 0.6 of the best, in the order of their chunks; a question below the confidence is not answered.
    ``terms`` is the index and ``hits`` are the ranked chunks, where these are at hand.
    """
    terms = retrieve.indexed(chunks) if terms is None else terms
    hits = cut(retrieve.search(questions, terms, k)) if hits is None else hits
    sure = retrieve.confidence(retrieve.coverage(questions, hits, terms))
    found = scored_sentences(questions, hits, chunks, terms)
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "rank", "pos")
    best = found.withColumn("place", F.row_number().over(order)).withColumn("best", F.max("score").over(Window.partitionBy("qid")))
    chosen = best.where((F.col("place") <= SENTENCES) & (F.col("score") >= RELATIVE * F.col("best")))
    numbered = chosen.withColumn("n", F.dense_rank().over(Window.partitionBy("qid").orderBy("rank")))
    parts = F.array_sort(F.collect_list(F.struct("rank", "pos", cited(F.col("sentence"), F.col("n")).alias("text"), "n", "chunk_id")))
    answers = numbered.groupBy("qid").agg(parts.alias("parts"))
    every = questions.select("qid", "question").join(sure, "qid", "left").join(answers, "qid", "left")
    gate = F.coalesce(F.col("confidence"), F.lit(0.0)) < abstain_below
    silent = gate | F.col("parts").isNull()
    refusal = F.when(F.col("question").rlike(SWEDISH) & ~F.col("question").rlike(ENGLISH), ABSTAIN_SV).otherwise(ABSTAIN_EN)
    text = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    sources = F.array_distinct(F.transform("parts", lambda p: F.struct(p["n"].alias("n"), p["chunk_id"].alias("chunk_id"))))
    return every.select("qid", F.when(silent, refusal).otherwise(text).alias("answer"), silent.alias("abstained"), F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"), F.when(~silent, sources).alias("sources"))


def ask(questions: DataFrame, chunks: DataFrame, calendar: DataFrame, k: int = 5, abstain_below: float = ABSTAIN_BELOW, strict: bool = True, min_faithfulness: float = 0.5) -> DataFrame:
    """(qid, question) -> one trace per question, as the service gives it without a language model.

    Personal data are redacted; of k + 3 hits those with injected instructions are blocked; a deadline is planned, else sentences are
    extracted; the answer is verified against its sources; in strict mode an answer below ``min_faithfulness`` is withdrawn.
    Columns: qid, question, answer, abstained, confidence, sources, label, faithfulness, deadline, pii_redacted, blocked_chunks.
    """
    safe = cut(questions.select("qid", guard.redact(F.col("question")).alias("r")).select("qid", F.col("r.text").alias("question"), F.col("r.found").alias("pii_redacted")))
    terms = retrieve.indexed(chunks)
    wide = cut(retrieve.search(safe.select("qid", "question"), terms, k + 3))
    seen = chunks.join(wide.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    marked = cut(wide.join(seen.select("chunk_id", (verify.injection_findings(F.coalesce("text", F.lit(""))) > 0).alias("bad")), "chunk_id"))
    blocked = marked.where("bad").groupBy("qid").agg(F.array_sort(F.collect_list("chunk_id")).alias("blocked_chunks"))
    clean = marked.where("not bad").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")
    clean = cut(clean)
    drafts = extract(safe.select("qid", "question"), chunks, k, abstain_below, terms, clean)
    plans = plan.said(plan.planned(safe, clean, chunks), calendar, cited(F.col("sentence"), F.lit(1)))
    both = drafts.join(plans.withColumnRenamed("text", "plan"), "qid", "left")
    sure = F.col("plan").isNotNull() & (F.col("confidence") >= abstain_below)
    one = F.array(F.struct(F.lit(1).alias("n"), F.col("chunk_id")))
    both = cut(both.select("qid", F.when(sure, F.col("plan")).otherwise(F.col("answer")).alias("answer"), (F.col("abstained") & ~sure).alias("abstained"), "confidence", F.when(sure, one).otherwise(F.col("sources")).alias("sources"), F.when(sure, F.col("tool_calls")).alias("tool_calls"), F.when(sure, F.col("deadline")).alias("deadline")))
    used = both.select("qid", F.explode("sources").alias("s")).select("qid", F.col("s.n").alias("n"), F.col("s.chunk_id").alias("chunk_id"))
    texts = used.join(seen.select("chunk_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "section", "text"))), "chunk_id")
    per = texts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "title", "section", "text"))).alias("evidence"))
    stated = both.join(per, "qid", "left").select(F.col("qid").alias("trace_id"), "answer", F.col("evidence").alias("sources"), "tool_calls")
    checked = verify.verification(verify.claims(stated)).withColumnRenamed("trace_id", "qid").select("qid", "label", "faithfulness")
    every = safe.join(both, "qid").join(checked, "qid", "left").join(blocked, "qid", "left")
    fails = ~F.col("abstained") & F.lit(strict) & ~F.col("label").isin("verified", "no-claims") & (F.col("faithfulness") < min_faithfulness)
    refusal = F.when(F.col("question").rlike(SWEDISH) & ~F.col("question").rlike(ENGLISH), ABSTAIN_SV).otherwise(ABSTAIN_EN)
    text = F.when(fails, F.concat(refusal, F.lit(" (The draft answer could not be verified against the sources.)"))).otherwise(F.col("answer"))
    silent = F.col("abstained") | fails
    return every.select("qid", "question", text.alias("answer"), silent.alias("abstained"), "confidence", F.when(~silent, F.col("sources")).alias("sources"), "label", "faithfulness", F.when(~silent, F.col("deadline")).alias("deadline"), "pii_redacted", F.coalesce("blocked_chunks", F.array().cast("array<string>")).alias("blocked_chunks"))

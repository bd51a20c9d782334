"""Queries over the reference's operators, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as dt
from ..functions import guard
from ..functions import text as tx
from ..operators import answer, plan, retrieve, verify
from ..runtime import cut, spread, table
from ..sources import documents as src
from ..streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
THRESHOLDS = (0.1, 0.2, 0.25, 0.3, 0.34, 0.4, 0.5, 0.6)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: the question of every request whose id is divisible by 100."""
    asked = table(spark, sf_dir, "ask_requests").where((F.col("request_id") % 100 == 0) & F.col("question").isNotNull())
    return asked.groupBy(F.col("request_id").alias("qid")).agg(F.min("question").alias("question"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation question with the documents it expects."""
    return table(spark, sf_dir, "eval_dataset").groupBy(F.col("id").alias("qid")).agg(F.min("question").alias("question"), F.min("expected_docs").alias("expected_docs"), F.max("answerable").alias("answerable"))


_CHUNKS_SQL = "(SELECT chunk_id, any_value(doc_id) AS doc_id, any_value(title) AS title, any_value(section) AS section, any_value(text) AS text FROM chunks GROUP BY chunk_id)"
_HEADER_SQL = "CASE WHEN coalesce(section, '') <> '' AND coalesce(section, '') <> coalesce(title, '') THEN coalesce(title, '') || ' > ' || section ELSE coalesce(title, '') END"
_GLOSS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in tx.glossary_words())
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.STOP) + "]"
_ASKED_SQL = "SELECT request_id AS qid, min(question) AS question FROM ask_requests WHERE request_id % 100 = 0 AND question IS NOT NULL GROUP BY request_id"
_BM25_SQL = f"""
WITH q AS ({_ASKED_SQL}),
tok AS (SELECT DISTINCT qid, unnest({tx.sql_tokens('question')}) AS token FROM q),
kept AS (SELECT qid, token, {tx.sql_stem('token')} AS term FROM tok WHERE NOT list_contains({_STOP_SQL}, token) AND (length(token) > 1 OR regexp_full_match(token, '\\p{{Nd}}+'))),
gloss AS (SELECT token, {tx.sql_stem('word')} AS gloss FROM (VALUES {_GLOSS_SQL}) v(token, word)),
qt AS (SELECT DISTINCT qid, term, term AS alt FROM kept UNION SELECT qid, term, gloss FROM kept JOIN gloss USING (token)),
t AS (SELECT chunk_id, {tx.sql_content_terms(f"({_HEADER_SQL}) || chr(10) || coalesce(text, '')")} AS terms FROM {_CHUNKS_SQL}),
size AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM t),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, size GROUP BY term),
hits AS (SELECT qid, chunk_id, sum(idf * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT DISTINCT qid, alt AS term FROM qt) JOIN p USING (term) JOIN idf USING (term), size GROUP BY qid, chunk_id),
ranked AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits)
"""


@query(f"SELECT doc_id, len({tx.sql_tokens('text')}) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(tx.tokens(F.col("text")))).cast("long").alias("n_tokens"))


@query(f"""WITH t AS (SELECT chunk_id, {tx.sql_content_terms(f"({_HEADER_SQL}) || chr(10) || coalesce(text, '')")} AS terms FROM {_CHUNKS_SQL}), size AS (SELECT count(*) AS n FROM t),
d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(terms) AS term FROM t) GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, size""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of every content term of the chunks."""
    terms = retrieve.indexed(spread(table(spark, sf_dir, "chunks")))
    return retrieve.idf(retrieve.terms_once(terms), retrieve.corpus_size(terms)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(_BM25_SQL + "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of every question of the query set."""
    hits = retrieve.search(_questions(spark, sf_dir), retrieve.indexed(spread(table(spark, sf_dir, "chunks"))), 5)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query(_BM25_SQL + """, w AS (SELECT qid, term, coalesce(min(idf), any_value(ln(1 + (n + 0.5) / 0.5))) AS w, list(alt) AS alts FROM size, qt LEFT JOIN idf ON qt.alt = idf.term GROUP BY qid, qt.term),
cov AS (SELECT r.qid, r.rank, sum(CASE WHEN list_has_any(alts, t.terms) THEN w ELSE 0 END) / sum(w) AS coverage FROM ranked r JOIN t USING (chunk_id) JOIN w USING (qid) WHERE r.rank <= 5 GROUP BY r.qid, r.rank)
SELECT qid, round(max(coverage), 6) AS confidence FROM cov WHERE rank <= 3 GROUP BY qid""".replace("qt.term GROUP", "term GROUP").replace("SELECT qid, term, coalesce", "SELECT qid, qt.term AS term, coalesce"))
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a question's weighted terms that the best of its three first hits has."""
    questions, terms = _questions(spark, sf_dir), retrieve.indexed(spread(table(spark, sf_dir, "chunks")))
    covered = retrieve.coverage(questions, retrieve.search(questions, terms, 5), terms)
    return retrieve.confidence(covered).select("qid", F.round("confidence", 6).alias("confidence"))


@query(_BM25_SQL.replace(_ASKED_SQL, "SELECT id AS qid, min(question) AS question FROM eval_dataset GROUP BY id") + """, e AS (SELECT id AS qid, min(expected_docs) AS expected_docs, max(answerable) AS answerable FROM eval_dataset GROUP BY id),
f AS (SELECT e.qid, min(CASE WHEN list_contains(e.expected_docs, c.doc_id) THEN r.rank END) AS r FROM e LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r USING (qid) LEFT JOIN (SELECT DISTINCT chunk_id, doc_id FROM chunks) c USING (chunk_id) WHERE e.answerable GROUP BY e.qid)
SELECT count(*) AS answerable, round(count(r) / greatest(1, count(*)), 6) AS recall_at_5, round(coalesce(sum(1.0 / r), 0) / greatest(1, count(*)), 6) AS mrr FROM f""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 5 and mean reciprocal rank of the expected documents over all answerable evaluation questions."""
    chunks, items = spread(table(spark, sf_dir, "chunks")), _items(spark, sf_dir)
    hits = retrieve.search(items.select("qid", "question"), retrieve.indexed(chunks), 5).join(chunks.select("chunk_id", "doc_id").dropDuplicates(), "chunk_id")
    first = items.where("answerable").join(hits.select("qid", "rank", "doc_id"), "qid", "left").groupBy("qid").agg(F.min(F.when(F.array_contains("expected_docs", F.col("doc_id")), F.col("rank"))).alias("r"))
    n = F.greatest(F.count("*"), F.lit(1))
    return first.agg(F.count("*").alias("answerable"), F.round(F.count("r") / n, 6).alias("recall_at_5"), F.round(F.coalesce(F.sum(1.0 / F.col("r")), F.lit(0.0)) / n, 6).alias("mrr"))


_HASHED_SQL = "list_transform({}, lambda t: CAST('0x' || left(md5(t), 2) AS INT))"


@query(_BM25_SQL + f""", cb AS (SELECT chunk_id, unnest({_HASHED_SQL.format('terms')}) AS b FROM t), cc AS (SELECT chunk_id, b, count(*)::DOUBLE AS c FROM cb GROUP BY ALL),
cv AS (SELECT chunk_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)) AS w FROM cc),
qb AS (SELECT qid, unnest({_HASHED_SQL.format('list(DISTINCT alt)')}) AS b FROM qt GROUP BY qid), qc AS (SELECT qid, b, count(*)::DOUBLE AS c FROM qb GROUP BY ALL),
qv AS (SELECT qid, b, c / sqrt(sum(c * c) OVER (PARTITION BY qid)) AS w FROM qc),
ds AS (SELECT qid, chunk_id, sum(qv.w * cv.w) AS score FROM qv JOIN cv USING (b) GROUP BY ALL),
dr AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ds),
f AS (SELECT qid, chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT qid, chunk_id, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT qid, chunk_id, rank FROM dr WHERE rank <= 20) GROUP BY qid, chunk_id)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS rank, chunk_id, round(score, 9) AS score FROM f) WHERE rank <= 10""")
def rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the twenty best chunks of each question by BM25 with the twenty nearest by hashed term vectors."""
    questions, terms = _questions(spark, sf_dir), retrieve.indexed(spread(table(spark, sf_dir, "chunks")))
    found = retrieve.hybrid(questions, terms, retrieve.hashed_vectors(terms), retrieve.question_vectors(questions), 10)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 9).alias("score"))


@query("""SELECT * FROM (SELECT q.vec_id AS qid, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS rank, v.vec_id,
round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def dense_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    queries_ = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return retrieve.dense_search(queries_, vectors, 10).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[\\s\\x0b\\p{Z}\\x{85}\\x1c-\\x1f]+([A-ZÅÄÖ0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '|\\n{2,}'),
lambda x: trim(regexp_replace(x, '[\\s\\x0b\\p{Z}\\x{85}\\x1c-\\x1f]+', ' ', 'g'))), lambda x: x <> '')) AS n_sentences FROM documents WHERE text IS NOT NULL""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document by the reference's simple rule."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(f"""SELECT trace_id, unnest(list_distinct(list_transform(list_transform(regexp_extract_all(answer, '{tx.NUMBER}'), lambda n: replace(n, ',', '.')),
lambda n: CASE WHEN contains(n, '.') THEN regexp_replace(regexp_replace(regexp_replace(n, '^0+([0-9])', '\\1'), '0+$', ''), '\\.$', '.0') ELSE regexp_replace(n, '^0+([0-9])', '\\1') END))) AS number FROM (SELECT DISTINCT trace_id, answer FROM ask_results)""")
def answer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number that an answer states, in one notation."""
    answers = table(spark, sf_dir, "ask_results").select("trace_id", "answer").dropDuplicates()
    return answers.select("trace_id", F.explode(tx.numbers(F.col("answer"))).alias("number"))


@query(r"""WITH c AS (SELECT DISTINCT trace_id, answer, list_transform(sources, lambda s: s.n) AS known FROM ask_results),
g AS (SELECT trace_id, known, unnest(regexp_extract_all(answer, '\[(\d+(?:\s*[,;]\s*\d+)*)\]', 1)) AS grp FROM c),
n AS (SELECT DISTINCT trace_id, known, CAST(unnest(regexp_split_to_array(grp, '\s*[,;]\s*')) AS INTEGER) AS n FROM g)
SELECT trace_id, n, coalesce(list_contains(known, n), false) AS is_valid FROM n""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source number that an answer cites, and whether the answer has such a source."""
    answers = table(spark, sf_dir, "ask_results").select("trace_id", "answer", F.transform("sources", lambda s: s["n"]).alias("known")).dropDuplicates()
    cited = answers.select("trace_id", "known", F.explode(F.array_distinct(tx.citations(F.col("answer")))).alias("n"))
    return cited.select("trace_id", "n", F.coalesce(F.array_contains("known", F.col("n")), F.lit(False)).alias("is_valid")).dropDuplicates()


@query()
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faithfulness, citation coverage and label of every answer, sentence by sentence against its own sources and tool results."""
    answers = spread(table(spark, sf_dir, "ask_results")).where("answer is not null").select("trace_id", "answer", "sources", "tool_calls").dropDuplicates(["trace_id"])
    return verify.verification(verify.claims(answers))


@query("SELECT chunk_id, " + " + ".join(f"CAST(regexp_matches(text, '(?im){p.replace(chr(39), chr(39) * 2)}') AS INT)" for p in verify.INJECTION) + " AS findings FROM (SELECT DISTINCT chunk_id, text FROM chunks)")
def injection_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many patterns of injected instructions each chunk matches."""
    return table(spark, sf_dir, "chunks").select("chunk_id", "text").dropDuplicates().select("chunk_id", verify.injection_findings(F.col("text")).alias("findings"))


@query("""SELECT content_hash, doc_id, copies FROM (SELECT left(sha256(text), 16) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM source_documents WHERE text IS NOT NULL GROUP BY ALL)""")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal content: the first of each hash, and how many there are."""
    hashed = table(spark, sf_dir, "source_documents").where("text is not null").select(tx.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT DISTINCT url, coalesce(nullif(left(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) || regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 120), ''), 'index') AS slug FROM source_documents WHERE url <> ''""")
def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file name of every fetched page."""
    return table(spark, sf_dir, "source_documents").where("url <> ''").select("url", tx.url_slug(F.col("url")).alias("slug")).dropDuplicates()


_MONTH_SQL = "MAP {" + ", ".join(f"'{m}': {n}" for m, n in dt.MONTHS.items()) + "}"
_DATES_SQL = f"""list_distinct_kept(list_filter(list_transform(regexp_extract_all({{0}}, '(?i){dt.DATE}'), lambda m: CASE WHEN regexp_matches(m, '^[0-9]{{{{4}}}}-')
THEN TRY_CAST(regexp_extract(m, '^([0-9]{{{{4}}}})-', 1) || '-' || lpad(regexp_extract(m, '-([0-9]{{{{1,2}}}})-', 1), 2, '0') || '-' || lpad(regexp_extract(m, '-([0-9]{{{{1,2}}}})$', 1), 2, '0') AS DATE)
ELSE TRY_CAST(regexp_extract(m, '([0-9]{{{{4}}}})$', 1) || '-' || lpad({_MONTH_SQL.replace('{', '{{').replace('}', '}}')}[regexp_extract(lower(m), '(?:^|[^a-z])({dt.MONTH})(?:[^a-z]|$)', 1)]::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(lower(m), '(?:^|[^0-9])([0-9]{{{{1,2}}}})(?:st|nd|rd|th|e|:e)?(?:[^0-9]|$)', 1), 2, '0') AS DATE) END), lambda d: d IS NOT NULL))"""


def _dates_sql(text: str) -> str:
    """The dates of a text as a DuckDB list, repeats included."""
    return _DATES_SQL.replace("list_distinct_kept(", "(").replace("{0}", text).replace(dt.DATE.replace("{", "{{").replace("}", "}}"), dt.DATE).replace("{{", "{").replace("}}", "}")


@query(f"""SELECT DISTINCT trace_id, day FROM (SELECT trace_id, unnest({_dates_sql('answer')}) AS day FROM ask_results)""")
def found_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date that an answer states, in whatever notation."""
    answers = table(spark, sf_dir, "ask_results").select("trace_id", "answer").dropDuplicates()
    return answers.select("trace_id", F.explode(dt.found_dates(F.col("answer"))).alias("day")).dropDuplicates()


_DATED_SQL = f"SELECT request_id AS qid, min(question) AS question FROM ask_requests WHERE regexp_matches(question, '(?i){plan.DEADLINE}') AND len({_dates_sql('question')}) > 0 GROUP BY request_id"
_UNIT_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**plan.UNITS, "days": "days", "weeks": "weeks", "months": "months"}.items()) + "}"
_WORD_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in plan.WORDS.items()) + "}"
_SENTENCES_SQL = """list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?])[\\s\\x0b\\p{{Z}}\\x{{85}}\\x1c-\\x1f]+([A-ZÅÄÖ0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '|\\n{{2,}}'),
lambda x: trim(regexp_replace(x, '[\\s\\x0b\\p{{Z}}\\x{{85}}\\x1c-\\x1f]+', ' ', 'g'))), lambda x: x <> '')"""


@query(_BM25_SQL.replace(_ASKED_SQL, _DATED_SQL) + f""", d AS (SELECT qid, ({_dates_sql('question')})[1] AS start_day FROM q),
s AS (SELECT r.qid, r.rank, r.chunk_id, d.start_day, unnest({_SENTENCES_SQL.format('c.text')}) AS sentence, generate_subscripts({_SENTENCES_SQL.format('c.text')}, 1) AS pos FROM ranked r JOIN d USING (qid) JOIN {_CHUNKS_SQL} c USING (chunk_id) WHERE r.rank <= 3),
m AS (SELECT *, lower(regexp_extract(sentence, '(?i){plan.DURATION}', 1)) AS n, lower(regexp_extract(sentence, '(?i){plan.DURATION}', 2)) AS u FROM s WHERE regexp_matches(sentence, '(?i){plan.DURATION}')),
p1 AS (SELECT *, coalesce(TRY_CAST(n AS INT), {_WORD_SQL}[n]) AS amount, {_UNIT_SQL}[u] AS unit, row_number() OVER (PARTITION BY qid ORDER BY rank, pos) AS place FROM m)
SELECT qid, chunk_id, start_day, amount, unit, CAST(CASE unit WHEN 'days' THEN start_day + amount WHEN 'weeks' THEN start_day + amount * 7 ELSE start_day + to_months(amount) END AS DATE) AS due FROM p1 WHERE place = 1""")
def planned_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every request that asks for a deadline and gives a date, the first rule of its three best chunks and the day it gives."""
    asked = table(spark, sf_dir, "ask_requests").where(plan.asks_deadline(F.col("question")) & (F.size(dt.found_dates(F.col("question"))) > 0))
    questions = cut(asked.groupBy(F.col("request_id").alias("qid")).agg(F.min("question").alias("question")))
    chunks = spread(table(spark, sf_dir, "chunks"))
    found = plan.planned(questions, retrieve.search(questions, retrieve.indexed(chunks), plan.HITS), chunks)
    return found.where("amount is not null").select("qid", "chunk_id", "start_day", "amount", "unit", "due")


def _service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, answerable, must_include, expected_date, trace_id, answer, abstained) of the service's answers to evaluation questions."""
    items = table(spark, sf_dir, "eval_dataset").groupBy("id").agg(F.min("question").alias("question"), F.max("answerable").alias("answerable"), F.min("must_include").alias("must_include"), F.min("expected_date").alias("expected_date"))
    asked = table(spark, sf_dir, "ask_requests").where("question is not null").select("request_id", "question").dropDuplicates()
    told = table(spark, sf_dir, "ask_results").where("abstained is not null").groupBy("trace_id").agg(F.min("request_id").alias("request_id"), F.min("answer").alias("answer"), F.max("abstained").alias("abstained"), F.min("verification.faithfulness").alias("faithfulness"))
    return asked.join(items.where("question is not null"), "question").join(told, "request_id").drop("question")


_SERVICE_SQL = """WITH i AS (SELECT id, min(question) AS question, max(answerable) AS answerable, min(must_include) AS must_include, min(expected_date) AS expected_date FROM eval_dataset GROUP BY id),
a AS (SELECT DISTINCT request_id, question FROM ask_requests WHERE question IS NOT NULL),
r AS (SELECT trace_id, min(request_id) AS request_id, min(answer) AS answer, max(abstained) AS abstained, min(verification.faithfulness) AS faithfulness FROM ask_results WHERE abstained IS NOT NULL GROUP BY trace_id),
x AS (SELECT * FROM a JOIN i USING (question) JOIN r USING (request_id)) """


@query(_SERVICE_SQL + """SELECT count(*) AS answers, round(coalesce(avg(CASE WHEN NOT abstained AND answer IS NOT NULL AND len(list_filter(must_include, lambda m: NOT contains(lower(answer), lower(m)))) = 0 THEN 1 ELSE 0 END), 0), 6) AS accuracy,
round(coalesce(avg(CASE WHEN NOT abstained THEN faithfulness END), 0), 6) AS faithfulness, count(expected_date) AS dated, round(coalesce(avg(CASE WHEN expected_date IS NOT NULL THEN CASE WHEN contains(answer, expected_date) THEN 1 ELSE 0 END END), 0), 6) AS date_accuracy FROM x WHERE answerable""")
def answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the service's answers to answerable evaluation questions: those with all required phrases, mean faithfulness, and those with the expected date."""
    rows = _service_answers(spark, sf_dir).where("answerable")
    has_all = F.coalesce(F.forall("must_include", lambda m: F.contains(F.lower("answer"), F.lower(m))), F.lit(False))
    right = (~F.col("abstained") & has_all).cast("int")
    dated = F.when(F.col("expected_date").isNotNull(), F.coalesce(F.contains("answer", F.col("expected_date")), F.lit(False)).cast("int"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.agg(F.count("*").alias("answers"), mean(right).alias("accuracy"), mean(F.when(~F.col("abstained"), F.col("faithfulness"))).alias("faithfulness"), F.count("expected_date").alias("dated"), mean(dated).alias("date_accuracy"))


@query(_SERVICE_SQL + """SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS r
FROM (SELECT count(*) FILTER (abstained AND NOT answerable) AS tp, count(*) FILTER (abstained AND answerable) AS fp, count(*) FILTER (NOT abstained AND NOT answerable) AS fn FROM x))""")
def abstention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the service's abstentions; the positive class are evaluation questions that cannot be answered."""
    pairs = _service_answers(spark, sf_dir).where("answerable is not null").select(F.col("abstained").alias("predicted"), (~F.col("answerable")).alias("actual"))
    found = verify.abstention(pairs, [])
    return found.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def _calendar(spark: SparkSession) -> DataFrame:
    """Working days of a century: some hundred rows a year."""
    return dt.calendar(spark, 2000, 2099)


@query()
def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of the questions of the query set: redacted, searched, injected chunks blocked, planned or extracted, verified."""
    found = answer.ask(_questions(spark, sf_dir), spread(table(spark, sf_dir, "chunks")), _calendar(spark))
    return found.withColumn("sources", F.to_json("sources")).withColumn("pii_redacted", F.to_json("pii_redacted")).withColumn("blocked_chunks", F.array_join("blocked_chunks", ","))


@query()
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on all evaluation questions as this library answers them: accuracy, abstention, faithfulness, citation precision, date accuracy, and the gates."""
    items = table(spark, sf_dir, "eval_dataset").groupBy(F.col("id").alias("qid")).agg(F.min("question").alias("question"), F.max("answerable").alias("answerable"), F.min("must_include").alias("must_include"), F.min("expected_docs").alias("expected_docs"), F.min("expected_date").alias("expected_date"))
    chunks = spread(table(spark, sf_dir, "chunks"))
    # questions of the same text have the same answer
    asked = cut(items.where("question is not null").groupBy("question").agg(F.min("qid").alias("asked_as")))
    told = answer.ask(asked.select(F.col("asked_as").alias("qid"), "question"), chunks, _calendar(spark)).select(F.col("qid").alias("asked_as"), "answer", "abstained", "sources", "faithfulness")
    rows = cut(items.join(asked.join(told, "asked_as").drop("asked_as"), "question").drop("question"))
    docs = chunks.select("chunk_id", "doc_id").dropDuplicates(["chunk_id"])
    cited = rows.where("answerable and not abstained").select("qid", "expected_docs", F.explode("sources").alias("s")).join(docs, F.col("s.chunk_id") == docs["chunk_id"])
    precision = cited.agg(F.coalesce(F.avg(F.array_contains("expected_docs", F.col("doc_id")).cast("int")), F.lit(0.0)).alias("citation_precision"))
    has_all = F.forall("must_include", lambda m: F.contains(F.lower("answer"), F.lower(m)))
    on = F.col("answerable") & ~F.col("abstained")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    main = rows.agg(
        F.count_if("answerable").alias("answerable"),
        mean(F.when(F.col("answerable"), F.coalesce(on & has_all, F.lit(False)).cast("int"))).alias("accuracy"),
        mean(F.when(on, F.col("faithfulness"))).alias("faithfulness"),
        mean(F.when(F.col("answerable") & F.col("expected_date").isNotNull(), F.contains("answer", F.col("expected_date")).cast("int"))).alias("date_accuracy"),
    )
    quality = verify.abstention(rows.where("answerable is not null").select(F.col("abstained").alias("predicted"), (~F.col("answerable")).alias("actual")), []).select(F.col("f1").alias("abstention_f1"))
    every = main.join(F.broadcast(precision)).join(F.broadcast(quality))  # three tables of one row
    gates = (F.col("accuracy") >= 0.8) & (F.col("abstention_f1") >= 0.8) & (F.col("faithfulness") >= 1.0) & (F.col("date_accuracy") >= 1.0)
    return every.select("answerable", *(F.round(c, 6).alias(c) for c in ("accuracy", "faithfulness", "date_accuracy", "citation_precision", "abstention_f1")), gates.alias("gates_passed"))


@query()
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of cited sentences to the questions of the query set, or an abstention."""
    found = answer.extract(_questions(spark, sf_dir), spread(table(spark, sf_dir, "chunks")))
    return found.select("qid", "answer", "abstained", "confidence", F.to_json("sources").alias("sources"))


@query()
def service_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's question as the reference's fixed rules redact it, with counts by kind."""
    asked = spread(table(spark, sf_dir, "ask_requests")).select("request_id", "question").dropDuplicates()
    redacted = asked.select("request_id", guard.redact(F.col("question")).alias("r"))
    return redacted.select("request_id", F.col("r.text").alias("question"), F.to_json("r.found").alias("found"))


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as chunks: sections by heading, paragraphs packed to 160 words."""
    once = spread(table(spark, sf_dir, "source_documents")).select("doc_id", "title", "agency", "url", "text").dropDuplicates(["doc_id"])
    return src.chunk_documents(once)


_HOLIDAY_SQL = """
WITH RECURSIVE years AS (SELECT unnest(range((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders) + 2)) AS y),
g AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM g),
l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h),
m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l),
easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS e FROM m),
mid AS (SELECT y, e, make_date(y, 6, 19) + CAST((5 - isodow(make_date(y, 6, 19)) + 7) % 7 AS INT) AS ms, make_date(y, 10, 31) + CAST((6 - isodow(make_date(y, 10, 31)) + 7) % 7 AS INT) AS al FROM easter),
hol AS (SELECT day, max_by(name, place) AS name FROM (SELECT unnest([{'place': 0, 'day': make_date(y, 1, 1), 'name': 'New Year''s Day'}, {'place': 1, 'day': make_date(y, 1, 6), 'name': 'Epiphany'}, {'place': 2, 'day': e - 2, 'name': 'Good Friday'}, {'place': 3, 'day': e, 'name': 'Easter Sunday'}, {'place': 4, 'day': e + 1, 'name': 'Easter Monday'}, {'place': 5, 'day': make_date(y, 5, 1), 'name': 'May Day'}, {'place': 6, 'day': e + 39, 'name': 'Ascension Day'}, {'place': 7, 'day': e + 49, 'name': 'Whit Sunday'}, {'place': 8, 'day': make_date(y, 6, 6), 'name': 'National Day'}, {'place': 9, 'day': ms, 'name': 'Midsummer Eve'}, {'place': 10, 'day': ms + 1, 'name': 'Midsummer Day'}, {'place': 11, 'day': al, 'name': 'All Saints'' Day'}, {'place': 12, 'day': make_date(y, 12, 24), 'name': 'Christmas Eve'}, {'place': 13, 'day': make_date(y, 12, 25), 'name': 'Christmas Day'}, {'place': 14, 'day': make_date(y, 12, 26), 'name': 'Boxing Day'}, {'place': 15, 'day': make_date(y, 12, 31), 'name': 'New Year''s Eve'}], recursive := true) FROM mid) GROUP BY day)
"""


def _order_years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).collect()[0]
    return (row["a"], row["b"]) if row["a"] is not None else (2000, 2000)


@query(_HOLIDAY_SQL + "SELECT name, count(*) AS orders FROM orders JOIN hol ON CAST(o_orderdate AS DATE) = day GROUP BY name")
def holiday_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on each Swedish holiday."""
    first, last = _order_years(spark, sf_dir)
    free = dt.holidays(spark.range(first, last + 2).select(F.col("id").alias("year")))
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.join(F.broadcast(free), "day").groupBy("name").agg(F.sum("n").alias("orders"))


@query(_HOLIDAY_SQL + """, days AS (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders) + INTERVAL 20 DAY, INTERVAL 1 DAY)) AS DATE) AS day),
w AS (SELECT day FROM days WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM hol)), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7 AS due FROM orders)
SELECT o_orderkey, due, w.day AS rolled FROM o ASOF JOIN w ON o.due <= w.day""")
def deadline_business_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One week after every order, rolled forward to a working day."""
    first, last = _order_years(spark, sf_dir)
    due = table(spark, sf_dir, "orders").select("o_orderkey", dt.deadline(F.to_date("o_orderdate"), F.lit(1), F.lit("week")).alias("due"))
    # some hundred rows for each year of the data
    days = dt.calendar(spark, first, last + 1).select(F.col("day").alias("due"), F.col("next_business_day").alias("rolled"))
    return due.join(F.broadcast(days), "due").select("o_orderkey", "due", "rolled")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS in_30_days, CAST(o_orderdate AS DATE) + 14 AS in_2_weeks, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS in_1_month, strftime(o_orderdate, '%A %-d %B %Y') AS said FROM orders""")
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of days, weeks and months after every order, and its date in words."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dt.deadline(day, F.lit(30), F.lit("days")).alias("in_30_days"), dt.deadline(day, F.lit(2), F.lit("veckor")).alias("in_2_weeks"), dt.deadline(day, F.lit(1), F.lit("month")).alias("in_1_month"), dt.long_date(day).alias("said"))


@query("""WITH r AS (SELECT lower(trim(mode)) AS mode, latency_ms, row_number() OVER (PARTITION BY lower(trim(mode)) ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY lower(trim(mode))) AS n FROM (SELECT DISTINCT trace_id, mode, latency_ms FROM ask_results WHERE latency_ms >= 0))
SELECT mode, any_value(n) AS n, max(CASE WHEN i = n // 2 THEN latency_ms END) AS p50, max(CASE WHEN i = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN latency_ms END) AS p95 FROM r GROUP BY mode""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies at the index n div 2 and 0.95 (n - 1) of each mode, read from counts of distinct values, not from a sort of all rows."""
    rows = table(spark, sf_dir, "ask_results").where("latency_ms >= 0").select("trace_id", F.lower(F.trim("mode")).alias("mode"), "latency_ms").dropDuplicates()
    values = rows.groupBy("mode", "latency_ms").agg(F.count("*").alias("c"))
    upto = values.withColumn("upto", F.sum("c").over(Window.partitionBy("mode").orderBy("latency_ms"))).withColumn("n", F.sum("c").over(Window.partitionBy("mode")))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("latency_ms")))
    return upto.groupBy("mode").agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(0.95 * (F.col("n") - 1))).alias("p95"))


_SWEEP_SQL = "SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS r FROM (SELECT threshold, count(*) FILTER (confidence < threshold AND abstained) AS tp, count(*) FILTER (confidence < threshold AND NOT abstained) AS fp, count(*) FILTER (confidence >= threshold AND abstained) AS fn FROM (SELECT DISTINCT trace_id, confidence, abstained FROM ask_results WHERE confidence IS NOT NULL AND abstained IS NOT NULL), (VALUES " + ", ".join(f"(CAST({t} AS DOUBLE))" for t in THRESHOLDS) + ") v(threshold) GROUP BY threshold))"


@query(_SWEEP_SQL)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of abstaining below each threshold against what the service did, in one pass over the results."""
    rows = table(spark, sf_dir, "ask_results").where("confidence is not null and abstained is not null").select("trace_id", "confidence", "abstained").dropDuplicates()
    every = rows.select("confidence", F.col("abstained").alias("actual"), F.explode(F.array(*(F.lit(t) for t in THRESHOLDS))).alias("threshold"))
    found = verify.abstention(every.withColumn("predicted", F.col("confidence") < F.col("threshold")), ["threshold"])
    return found.select("threshold", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH e AS (SELECT DISTINCT id, expected_docs, must_include FROM eval_dataset), d AS (SELECT id, must_include, unnest(expected_docs) AS doc_id FROM e),
c AS (SELECT doc_id, lower(string_agg(text, ' ')) AS body FROM (SELECT DISTINCT doc_id, text FROM source_documents WHERE text IS NOT NULL) GROUP BY doc_id)
SELECT id, max(CAST(len(list_filter(must_include, lambda m: NOT contains(body, lower(m)))) = 0 AS INT)) AS covered FROM d JOIN c USING (doc_id) GROUP BY id""")
def must_include_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an expected document of each evaluation question has all the phrases that the answer must include."""
    items = table(spark, sf_dir, "eval_dataset").select("id", "expected_docs", "must_include").dropDuplicates()
    wanted = items.select("id", "must_include", F.explode("expected_docs").alias("doc_id"))
    bodies = table(spark, sf_dir, "source_documents").where("text is not null").select("doc_id", F.lower("text").alias("body")).dropDuplicates()
    has_all = F.forall("must_include", lambda m: F.col("body").contains(F.lower(m)))
    return wanted.join(bodies, "doc_id").groupBy("id").agg(F.max(has_all.cast("int")).alias("covered"))


@query(r"""SELECT trace_id, CAST(coalesce(list_sum(list_transform(map_values(pii_redacted), lambda v: v)), 0) AS BIGINT) AS said, len(regexp_extract_all(question, '\[[A-ZÅÄÖ_]{2,}\]')) AS shown FROM (SELECT trace_id, any_value(pii_redacted) AS pii_redacted, any_value(question) AS question FROM ask_results GROUP BY trace_id) WHERE question IS NOT NULL""")
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placeholders that a redacted question says it has, and those that it shows."""
    rows = table(spark, sf_dir, "ask_results").where("question is not null").dropDuplicates(["trace_id"])
    said = F.coalesce(F.aggregate(F.map_values("pii_redacted"), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0)).cast("long")
    return rows.select("trace_id", said.alias("said"), F.size(F.regexp_extract_all("question", F.lit(r"\[[A-ZÅÄÖ_]{2,}\]"), F.lit(0))).cast("long").alias("shown"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in hours, the batch form of the streaming job."""
    found = stream.hourly(table(spark, sf_dir, "events"))
    return found.select("window_start", "event_type", "events", F.round("value", 4).alias("value"))

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vitsord.functions import text as tx
from vitsord.operators import retrieve, verify
from vitsord.runtime import table
from vitsord.sources import documents as src
from vitsord.streaming import events as stream

CHUNK = "chunk_id string, title string, section string, text string"


def test_search_equals_brute_force(spark, small):
    chunks = table(spark, small, "chunks")
    asked = spark.createDataFrame([(1, "How do I apply for the water fee?"), (2, "hur flytta"), (3, ""), (4, None)], "qid long, question string")
    got = {(r["qid"], r["rank"]): (r["chunk_id"], round(r["score"], 6)) for r in retrieve.search(asked, retrieve.indexed(chunks), 3).collect()}
    terms = {r["chunk_id"]: r["terms"] for r in retrieve.chunk_terms(chunks).collect()}
    n, avgdl = len(terms), sum(map(len, terms.values())) / len(terms)
    df = Counter(t for v in terms.values() for t in set(v))
    want = {}
    for q in (1, 2):
        words = {r["alt"] for r in retrieve.query_terms(asked.where(F.col("qid") == q)).collect()}
        scores = []
        for c, v in terms.items():
            tf, s = Counter(v), 0.0
            for t in sorted(words):
                if tf[t]:
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.4 / (tf[t] + 1.4 * (0.25 + 0.75 * len(v) / avgdl))
            if s:
                scores.append((-round(s, 9), c, s))
        for rank, (_, c, s) in enumerate(sorted(scores)[:3], 1):
            want[q, rank] = (c, round(s, 6))
    assert got == want


def test_search_of_nothing(spark):
    chunks = spark.createDataFrame([], CHUNK)
    asked = spark.createDataFrame([(1, "water fee")], "qid long, question string")
    assert retrieve.search(asked, retrieve.indexed(chunks)).count() == 0
    some = spark.createDataFrame([("a#0", None, None, None), ("a#0", None, None, None), ("b#0", "Water fee", "Water fee", "The water fee is due.")], CHUNK)
    assert [r["chunk_id"] for r in retrieve.search(asked, retrieve.indexed(some)).collect()] == ["b#0"]


def test_dense_search_equals_brute_force(spark, small):
    v = table(spark, small, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in retrieve.dense_search(q, v, 5).collect()}
    rows = v.collect()
    for x in q.collect():
        best = sorted(rows, key=lambda r: (-round(sum(a * b for a, b in zip(r["embedding"], x["embedding"])), 9), r["vec_id"]))[:5]
        assert [got[x["qid"], k] for k in range(1, 6)] == [r["vec_id"] for r in best]


def _answers(spark, rows):
    kind = "trace_id string, answer string, sources array<struct<n: int, title: string, section: string, text: string>>"
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize(
    ("answer", "label", "faithfulness"),
    [
        ("You must report the move within one week. [1]", "verified", 1.0),
        ("You must report the move within 9 weeks [1].", "unverified", 0.0),
        ("You must report the move within one week.", "unverified", 0.0),
        ("You must report the move within one week [7].", "unverified", 0.0),
        ("I could not find this in the documents I have.", "no-claims", 1.0),
        ("Cats and dogs are lovely animals [1].", "unverified", 0.0),
    ],
)
def test_verification(spark, answer, label, faithfulness):
    source = [(1, "Moving", "Report", "You must report a move to the agency within one week.")]
    row = verify.verification(verify.claims(_answers(spark, [("t", answer, source)]))).collect()[0]
    assert (row["label"], row["faithfulness"]) == (label, faithfulness)
    assert row["invalid_citations"] == ([7] if "[7]" in answer else [])


RESULT = '{"start": "2026-03-10", "rule": "1 week", "deadline": "2026-03-17", "moved_because": []}'


COMPUTED = [
    ("Counting from Tuesday 10 March 2026, the deadline is Tuesday 17 March 2026 [calc].", [("calculate_deadline", RESULT)], "verified"),
    ("Sista dagen är 2026-03-17 [calc].", [("search_documents", "[1]"), ("calculate_deadline", RESULT)], "verified"),
    ("Counting from Tuesday 10 March 2026, the deadline is Tuesday 18 March 2026 [calc].", [("calculate_deadline", RESULT)], "unverified"),
    ("Sista dagen är 2026-03-17 [calc].", [("search_documents", RESULT)], "unverified"),
    ("Sista dagen är 2026-03-17 [calc].", [("next_business_day", "no object"), ("next_business_day", None)], "unverified"),
    ("The latest possible day remains unknown here [calc].", None, "unverified"),
    ("Report the move by Tuesday 17 March 2026 at the counter downstairs [1] [calc].", [("calculate_deadline", RESULT)], "verified"),
    ("Report the move by Wednesday 18 March 2026 [1] [calc].", [("calculate_deadline", RESULT)], "unverified"),
    ("Cats and dogs love Tuesday 17 March 2026 [1] [calc].", [("calculate_deadline", RESULT)], "unverified"),
    ("Report the move by Tuesday 17 March 2026 [1].", [("calculate_deadline", RESULT)], "unverified"),
]


def test_verification_of_computed_claims(spark):
    source = [(1, "Moving", "Report", "You must report a move to the agency within one week.")]
    kind = "trace_id string, answer string, sources array<struct<n: int, title: string, section: string, text: string>>, tool_calls array<struct<tool: string, result: string>>"
    answers = spark.createDataFrame([(str(i), answer, source, calls) for i, (answer, calls, _) in enumerate(COMPUTED)], kind)
    got = {r["trace_id"]: r["label"] for r in verify.verification(verify.claims(answers)).collect()}
    assert [got[str(i)] for i in range(len(COMPUTED))] == [label for _, _, label in COMPUTED]


def test_verification_of_nulls(spark):
    rows = verify.verification(verify.claims(_answers(spark, [("a", None, None), ("b", "You must report the move within one week [1].", None)]))).collect()
    assert {r["trace_id"]: r["label"] for r in rows} == {"b": "unverified"}


def test_front_matter_html_and_files(spark, tmp_path):
    (tmp_path / "moving-home.md").write_text("---\nTitle: 'Move'\nagency: A\nagency: B\nnoise\n---\n# Heading\n\nText one.\n", encoding="utf-8")
    (tmp_path / "page.html").write_text("<html><title>Page &amp; co</title><nav>menu</nav><h1>Top</h1><p>Body   text</p><script>x</script><ul><li>one</li></ul><footer>f</footer></html>", encoding="utf-8")
    (tmp_path / "skip.bin").write_text("x", encoding="utf-8")
    rows = {r["doc_id"]: r for r in src.read_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"moving-home", "page"}
    assert (rows["moving-home"]["title"], rows["moving-home"]["agency"]) == ("Move", "B")
    assert rows["page"]["title"] == "Page & co"
    assert rows["page"]["text"] == "# Top\n\nBody text\n\n- one"


def test_chunks_pack_paragraphs(spark):
    long = " ".join(["word"] * 100)
    text = f"lead\n\n# A\n\n{long}\n\n{long}\n\nshort\n\n## Empty\n\n## B\nlast"
    doc = spark.createDataFrame([("d", "T", "x", "u", text), ("e", None, None, None, None)], "doc_id string, title string, agency string, url string, text string")
    got = [(r["chunk_id"], r["section"], len(r["text"].split())) for r in src.chunk_documents(doc).orderBy("chunk_id").collect()]
    assert got == [("d#0", "T", 1), ("d#1", "A", 100), ("d#2", "A", 101), ("d#3", "B", 1)]


def test_stream_of_questions(spark, tmp_path, small):
    asked = spark.createDataFrame([(1, "How do I apply for the water fee?")], "qid long, question string")
    asked.write.json(str(tmp_path / "in"))
    stream_in = spark.readStream.schema(asked.schema).json(str(tmp_path / "in"))
    stream.answer_stream(stream_in, retrieve.indexed(table(spark, small, "chunks")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert '"retrieved"' in spark.read.text(str(tmp_path / "out")).collect()[0]["value"]


def test_entry_and_registered_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_agree_with_their_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    import os

    from vitsord.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    sql, queries = catalog.oracle_sql(), catalog.queries()
    for name in ("token_counts", "term_statistics", "answer_citations", "threshold_sweep", "holiday_orders"):
        mine, theirs = queries[name](spark, small).toPandas(), con.sql(sql[name]).df()
        key = lambda frame: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) for row in frame[sorted(frame.columns)].values.tolist())
        assert key(mine) == key(theirs), name


def test_glossary_is_stemmed(spark):
    assert {("flytt", "move"), ("kostar", "cost"), ("sjukpenning", "benefit"), ("veckor", "week")} <= {tuple(r) for r in tx.glossary(spark).collect()}

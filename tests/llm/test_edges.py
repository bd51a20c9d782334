"""Every query over empty tables, and over nulls, blanks, repeats, very long texts and further columns of clashing names."""

import pytest

from vitsord.llm import registry

QUERIES = sorted(registry.queries())
LONG = "ord " * 30_000 + "slut. Nästa mening!" + "x" * 20_000


@pytest.fixture(scope="module")
def empty_dir(make_dir):
    return make_dir()


@pytest.fixture(scope="module")
def odd_dir(make_dir):
    texts = [None, "", "  \n ", "!!", LONG, "One rule. One rule.", "One rule. One rule."]
    documents = [{"doc_id": i, "text": t, "lang": None, "source": [None, " FAQ", "faq"][i % 3]} for i, t in enumerate(texts)]
    chunks = [{"chunk_id": f"d#{i}", "doc_id": "d", "text": t, "section": t} for i, t in enumerate(texts)] * 2
    pages = [{"doc_id": f"p{i}", "text": t, "url": ["", None, "https://a.example/x"][i % 3]} for i, t in enumerate(texts)] * 2
    requests = [{"request_id": i, "question": t} for i, t in enumerate(texts)] * 2
    results = [{"trace_id": f"t{i}", "request_id": i, "question": t, "answer": t} for i, t in enumerate(texts)] * 2
    items = [{"id": f"q{i}", "question": t, "lang": [None, "en", "zz"][i % 3]} for i, t in enumerate(texts)]
    return make_dir(
        extra_column="starts",
        documents=documents, chunks=chunks, source_documents=pages, ask_requests=requests, ask_results=results, eval_dataset=items,
        test_items=[{"item_id": 1, "text": None}, {"item_id": 2, "text": ""}, {"item_id": 3, "text": "One rule"}],
        content_labels=[{"doc_id": 5, "label": "none"}, {"doc_id": 6, "label": "abusive"}, {"doc_id": 99, "label": None}],
        source_targets=[{"source": "faq", "target_share": 0.9, "max_repeats": 2}, {"source": "radio", "target_share": 0.1, "max_repeats": 3}],
        split_limits=[{"item_table": "chunks", "item_field": "text", "max_chars": 100, "overlap_chars": 10}],
    )


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_empty_results(spark, empty_dir, name):
    assert registry.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows_do_not_fail(spark, odd_dir, name):
    rows = registry.queries()[name](spark, odd_dir).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_wordless_questions_are_und(spark, odd_dir):
    rows = {(r["record_table"], r["record_id"]): r["lang"] for r in registry.queries()["p2_found"](spark, odd_dir).collect()}
    assert all(rows["ask_requests", str(i)] == "und" for i in (0, 1, 2, 3))


def test_mix_counts_spellings_as_one_source(spark, odd_dir):
    rows = {r["source"]: r for r in registry.queries()["p7_shares"](spark, odd_dir).collect()}
    assert rows["radio"]["tokens"] == 0 and rows["faq"]["reached_share"] == 1.0

import numpy as np
import pyarrow as pa

from vitsord.operators import retrieve

CHUNK = "chunk_id string, title string, section string, text string"


def test_questions_of_equal_words_are_searched_once(spark, monkeypatch):
    rows = [(f"c#{i:02}", "Fees", None, "The water fee is due in May." if i % 2 else f"A permit for house {i}.") for i in range(12)]
    terms = retrieve.indexed(spark.createDataFrame(rows, CHUNK))
    asked = spark.createDataFrame([(i, "Water fee?" if i % 3 else "the fee of the WATER") for i in range(40)], "qid long, question string")
    passes, score = [], retrieve._best_chunks
    monkeypatch.setattr(retrieve, "_best_chunks", lambda *x: passes.append(1) or score(*x))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 1)
    found = retrieve.search(asked, terms, 3).collect()
    assert len(passes) == 1
    # six chunks tie for the first place: the lowest ids of equal chunks
    assert sorted((r["qid"], r["rank"], r["chunk_id"]) for r in found) == [(q, n, c) for q in range(40) for n, c in ((1, "c#01"), (2, "c#03"), (3, "c#05"))]


def test_rows_left_out_of_a_block_score_less():
    rng = np.random.default_rng(1)
    n, vocabulary = 4000, 30
    for share in (0.02, 0.3):
        dense = np.where(rng.random((vocabulary, n)) < share * np.linspace(0.05, 1, vocabulary)[:, None], rng.random((vocabulary, n)) * np.linspace(4, 1, vocabulary)[:, None], 0.0)
        term, row = np.nonzero(dense)
        postings = [(row[term == t], dense[t][dense[t] > 0]) for t in range(vocabulary)]
        for _ in range(40):
            own = sorted(rng.choice(vocabulary, rng.integers(1, 9), replace=False).tolist())
            full = np.zeros(n)
            for t in own:
                full += dense[t]
            for least in (-np.inf, 0.0, np.sort(full)[-5], np.sort(full)[-100], 99.0):
                hit, s = retrieve._scored(postings, dense.max(axis=1), term * n + row, dense[term, row], own, n, least)
                assert np.array_equal(s, full[hit])
                assert set(np.flatnonzero((full >= least) & (full > 0))) <= set(hit)


def test_blocks_hold_every_row_once():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, a + 9000))}) for a in range(0, 90000, 9000)]
    blocks = [b.column(0).to_pylist() for b in retrieve._row_blocks(iter(batches))]
    assert [x for b in blocks for x in b] == list(range(90000))
    assert [len(b) for b in blocks] == [retrieve.FIRST_ROWS, retrieve.BLOCK_ROWS, 90000 - retrieve.FIRST_ROWS - retrieve.BLOCK_ROWS]

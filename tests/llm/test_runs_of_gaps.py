from collections import Counter
from itertools import pairwise, permutations

import pyarrow as pa

from vitsord.llm import sentences

ODD = [
    "He said “Stop.” Then [1] he left! [2, 3]  Why?! No.", "合计。「对。」下一个。！好 A。b", "v2.1 of a_b is out.Next one... [x] [4]. End", "- Item one. 3 more? (Yes.) No",
    "เปิด 9.00 น. ทุกวัน ไม่มี [1] ปิด", "See ★. Then ©! And [12] a © Then", "a. B?[1]C [2] D. \"E\" f.", "!?.。.", "1. First. Second.Third", "क्या? हाँ। ठीक [3]। अब",
]


def _events(texts):
    known, runs = Counter(), Counter()
    for batch in sentences._events(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        for certain, key, n in zip(*(c.to_pylist() for c in batch.columns)):
            (known if certain else runs)[tuple(key)] += n
    return known, runs


def test_equal_runs_of_gaps_are_one_row_in_whatever_lines_they_stand():
    parts = ["The house is old.", "Who called me?", "Nobody was there!", "It rained all day…", "They left early."]
    lines = [" ".join(x) for x in permutations(parts)]
    known, runs = _events(lines)
    assert len(runs) == 20 and sum(runs.values()) == 4 * len(lines)
    assert known["CL", "old."] == 4 * len(lines) / 5 and known["ENDS", "old."] == len(lines) / 5
    soft = sentences._expected([(list(k), n) for k, n in runs.items()], sentences.BoundaryModel(known), guess=True)
    assert abs(soft["BR", "Who"] + soft["NR", "Who"] - known["CR", "Who"]) < 1e-6


def test_a_run_keeps_its_gaps_together():
    _, runs = _events(["See p. 3. 4. Then go on. Now"])
    assert [g[4] for g in sentences._candidates("See p. 3. 4. Then go on. Now")] == [1, 0, 0, 1]
    assert set(runs) == {("p.", "0.", "0.", "0.", "0.", "Then"), ("on.", "Now")}


def test_scan_finds_the_gaps_of_the_patterns():
    for line in ODD:
        item = sentences._ITEM.match(line)
        first = item.end() if item else 0
        wanted = {m.end() for m in sentences._GAP.finditer(line, first)}
        if "[" in line:
            wanted |= {m.end() for m in sentences._CITED.finditer(line, first)}
        quoted = sentences._inside_quotes(line)
        wanted = {at for at in wanted if not (line[at] == "[" and sentences._CITES.match(line, at))}
        found = {g[1]: g[0] for g in sentences._candidates(line)}
        assert all(at in found or any(a < at <= b + 2 for a, b in quoted) for at in wanted), line
        assert all(at in wanted or sentences._spaceless(line) for at in found), line


def test_words_inside_are_those_behind_a_letter_a_digit_or_a_comma():
    for line in [x for x in ODD if not sentences._spaceless(x)]:
        item = sentences._ITEM.match(line)
        words = line[item.end() if item else 0 :].split()
        wanted = Counter(sentences._norm_right(b) for a, b in pairwise(words) if a[-1].isalnum() or a[-1] in ",;:")
        known, _ = _events([line])
        assert Counter({k[1]: n for k, n in known.items() if k[0] == "INSIDE"}) == wanted, line


def test_prefilters_pass_whatever_the_patterns_match():
    import regex

    every = "".join(map(chr, range(0x110000)))
    assert all(sentences._MAY_CITE.match(c) for c in regex.findall(r"\p{So}", every))
    assert all(sentences._MAY_BE_SPACELESS.match(c) for c in sentences._SPACELESS.findall(every))

import random

import numpy as np
import pytest

from vitsord.llm import boilerplate, language, leakage, mixing, pii, sentences, splitting, toxicity


@pytest.fixture(scope="module")
def boundary_model(spark):
    sf_dir = "/root/testdata/sf0.01"
    return sentences.fit([x.select("text") for x in sentences.corpus_texts(spark, sf_dir)])


def cut(model, text):
    flat = sentences.units(model, [text])[0]
    return [text[a:b] for a, b in zip(flat[::2], flat[1::2])]


def test_units(boundary_model):
    m = boundary_model
    assert cut(m, "Dörren stängs kl. 17 e.m. Stödet lämnas i högst sex månader per ärende. [2]") == ["Dörren stängs kl. 17 e.m.", "Stödet lämnas i högst sex månader per ärende. [2]"]
    assert cut(m, "- Fill in part A.\n1. Map of the plot") == ["- Fill in part A.", "1. Map of the plot"]
    assert cut(m, "您忘记表格了吗？我们晚上不打电话！") == ["您忘记表格了吗？", "我们晚上不打电话！"]
    assert cut(m, " \n\t") == []


def test_units_cover_all_that_is_no_space(boundary_model, spark):
    texts = [r["text"] for df in sentences.corpus_texts(spark, "/root/testdata/sf0.001") for r in df.select("text").collect() if r["text"]]
    for text, flat in zip(texts, sentences.units(boundary_model, texts)):
        inside = set()
        for a, b in zip(flat[::2], flat[1::2]):
            assert a < b and not text[a].isspace() and not text[b - 1].isspace() and "\n" not in text[a:b]
            assert not inside & set(range(a, b))
            inside |= set(range(a, b))
        assert all(c.isspace() for i, c in enumerate(text) if i not in inside)


def test_forward_backward_equals_all_paths():
    model = sentences.BoundaryModel({("LB", "a.", "-"): 3.0, ("LN", "b.", "B"): 2.0, ("LB", "b.", "N"): 4.0, ("BR", "X"): 5.0, ("NR", "y"): 4.0})
    gaps = [(1, 2, "a.", "b.", 1), (3, 4, "b.", "X", 0), (5, 6, "a.", "y", 0)]
    got = sentences.posteriors(model, [gaps])[0]
    total, ones = 0.0, np.zeros(3)
    for path in range(8):
        bits, p = [(path >> i) & 1 for i in range(3)], 1.0
        for i, g in enumerate(gaps):
            context = 0 if i == 0 else (1 if bits[i - 1] else 2)
            p *= np.exp(model.factors(g[2], g[3])[context, bits[i]])
        total += p
        ones += p * np.array(bits)
    assert np.allclose(got, ones / total)


def test_languages():
    base = {
        "sv": ["Jag vill gärna veta hur jag ansöker om stöd.", "Du måste skicka blanketten till kontoret.", "När öppnar ni på måndag morgon?"],
        "en": ["I would like to know how to apply for support.", "You must send the form to the office.", "When do you open on Monday morning?"],
        "fi": ["Haluaisin tietää miten haen tukea.", "Sinun on lähetettävä lomake toimistoon.", "Milloin avaatte maanantaina aamulla?"],
    }
    model = language.fit_model([(k, t) for k, v in base.items() for t in v])
    langs = lambda t: [x for x, _ in model.segments([t])[0]]
    assert langs("How do I send the form to the office?") == ["en"]
    assert langs("Hur skickar jag blanketten till kontoret? You must send the form to the office.") == ["sv", "en"]
    assert langs('Hur skickar jag "Sinun on lähetettävä lomake toimistoon." till kontoret?') == ["sv", "fi", "sv"]
    assert langs('Hur skickar jag "lomake" till kontoret?') == ["sv"]
    assert langs("Hur skickar jag blanketten till Sirkka Kuusilehto på 070-174 06 05 eller a.b@c.test?") == ["sv"]
    assert langs("12:30 / 14:00") == ["und"] and langs(None) == ["und"]
    assert langs("Ω̱ξψ ζθφ") == ["und"]  # farther from every centroid than any language's own pieces


def test_languages_under_wrong_labels():
    """Two in five labels wrong, mostly those of the large language put on a small one: the small ones stay, the templates keep their language."""
    rng = random.Random(5)
    forms = {
        "sv": ["Hur ansöker jag om {}?", "Vem beslutar om {} i kommunen?", "Varför fick jag avslag på min ansökan om {}?"],
        "nb": ["Hvordan søker jeg om {}?", "Hvem bestemmer over {} i kommunen?", "Hvorfor fikk jeg avslag på søknaden min om {}?"],
        "ar": ["كيف أقدم طلب {}؟", "من الذي يقرر بشأن {} في المدينة؟", "لماذا رُفض طلبي بخصوص {}؟"],
    }
    things = {"sv": ["bygglov", "bostadsstöd", "flytt", "språkkurs"], "nb": ["byggetillatelse", "bostøtte", "flytting", "språkkurs"], "ar": ["دعم السكن", "دورة اللغة"]}
    ask = lambda k: rng.choice(forms[k]).format(rng.choice(things[k]))
    rows = [("sv", ask("sv")) for _ in range(600)]
    for small in ("nb", "ar"):
        rows += [(small, ask(small)) for _ in range(60)] + [(small, ask("sv")) for _ in range(40)]
        rows += [("sv", ask(small)) for _ in range(10)]
    model = language.fit_model(rows)
    for k in forms:
        for form in forms[k]:
            for thing in things[k]:
                assert model.segments([form.format(thing)])[0][0][0] == k


def test_language_codes(spark):
    df = spark.createDataFrame([("sv-SE",), (" EN",), ("suomi",), ("xx",), (None,), ("no",)], "lang string")
    assert [r[0] for r in df.select(language.language_code("lang")).collect()] == ["sv", "en", "fi", None, None, "nb"]


def test_pieces_round_trip(boundary_model):
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["ord ", "x" * rng.randint(1, 60), ". ", "\n\n", "\n", "## A\n", "å", " "]) for _ in range(rng.randint(1, 300)))
        most, overlap = rng.choice([(40, 5), (100, 20), (64, 0)])
        if len(text) <= most:
            continue
        spans = splitting.pack(splitting.atoms(text, 0, len(text), most - overlap, 0, False, boundary_model), most, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(0 < b - a <= most for a, b in spans)
        assert all(y[0] == x[1] - overlap for x, y in zip(spans, spans[1:]))
        assert text == text[: spans[0][1]] + "".join(text[x[1] : y[1]] for x, y in zip(spans, spans[1:]))


def test_cut_levels(boundary_model):
    level = lambda t: splitting.cut_level(t, 40, False, boundary_model)
    assert level("a b\n\n" * 30) == "paragraph"
    assert level("word " * 60) == "word"
    assert level("x" * 90) == "character"


def test_checks_of_personal_numbers():
    assert pii.luhn("8112189876") and not pii.luhn("8112189875")
    assert pii.identity_date("8112189876") and pii.identity_date("197010632391") and not pii.identity_date("8113189876")
    assert pii.iban_ok("SE45 5000 0000 0583 9825 7466") and not pii.iban_ok("SE46 5000 0000 0583 9825 7466")


@pytest.fixture(scope="module")
def finder(spark):
    return pii.fit(spark, "/root/testdata/sf0.01")


def test_personal_information(finder):
    text = "Skriv till anna.b (at) mail.test eller 070-174 06 05. Jag bor på Storgatan 5 B, 123 45 Mossvik. Mitt personnummer är 811218-9876. Björkvägen är avstängd. Tåg 1234-5678 var sent."
    found = finder.items([text])[0]
    assert [(text[a:b], k) for a, b, k in found] == [("anna.b (at) mail.test", "email"), ("070-174 06 05", "phone"), ("Storgatan 5 B, 123 45 Mossvik", "address"), ("811218-9876", "identity_number")]
    assert pii.redact(text, found).startswith("Skriv till [EMAIL] eller [PHONE]. Jag bor på [ADDRESS]. Mitt personnummer är [IDENTITY_NUMBER].")
    assert finder.items([None, "", "[EMAIL] [PHONE]"]) == [[], [], []]


def test_trees_decide_between_candidates(spark):
    """Without trees and thresholds (every candidate kept, the first of overlapping ones) the same generators redact what is none."""
    full = pii.fit(spark, "/root/testdata/sf0.01")
    bare = pii.Finder(full.names, pii.Trees(""), dict.fromkeys(pii.TYPES, 0.0))
    texts = ["Tåg 1234-5678 var sent.", "På fakturan står OCR 7002 1234 567897.", "Ring mig på 070-174 06 05."]
    assert [[k for _, _, k in x] for x in full.items(texts)] == [[], [], ["phone"]]
    assert all(bare.items(texts)[:2])


def test_labels_from_the_services_placeholders():
    text = "Hej, ring 555 01 06 eller a.b@c.test. Ring 555 01 07."
    spans = pii.placed(text, "Hej, ring [PHONE] eller [EMAIL]. Ring 555 01 07.")
    assert [(text[a:b], k) for a, b, k in spans] == [("555 01 06", "phone"), ("a.b@c.test", "email")]
    assert pii.placed(text, text) == [] and pii.placed(text, "Hej [PHONE] hopp") == [] and pii.placed("", "[NAME]") == []
    label = lambda a, b, k: pii.placed_label((a, b, k, [], 0), spans)
    assert (label(10, 19, "phone"), label(10, 19, "card"), label(10, 16, "phone"), label(43, 52, "phone")) == (1, 0, -1, -1)


def test_fit_takes_the_services_labels(spark, make_dir, monkeypatch):
    requests = [{"request_id": i, "question": f"Ring Ada eller {i} 555 {i:02d}"} for i in range(40)]
    results = [{"trace_id": str(i), "request_id": i, "question": "Ring [NAME] eller " + f"{i} 555 {i:02d}"} for i in range(40)]
    assert pii.placed_rows(spark, make_dir(ask_requests=requests, ask_results=results))[0][1].startswith("Ring [NAME]")
    seen = []
    monkeypatch.setattr(pii, "placed_label", lambda c, spans: seen.append(spans) or -1)
    pii.fit(spark, "/root/testdata/sf0.001")
    assert seen and all(seen)


def test_exported_trees_score_as_spark_does(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = random.Random(1)
    rows = [(float(x[0] + x[1] > 1), x) for x in ([rng.random(), rng.random(), rng.random()] for _ in range(300))]
    df = spark.createDataFrame(rows, "label double, f array<double>").select("label", "f", array_to_vector("f").alias("features"))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    theirs = [r["p"] for r in model.transform(df).select(vector_to_array("probability")[1].alias("p")).collect()]
    mine = pii.Trees(model.toDebugString).score(np.array([x for _, x in rows]))
    assert np.allclose(theirs, mine, atol=1e-6)


def test_page_content(spark):
    menu = "Start\nOm oss\nPress\n\n# T{0}\n\n{1} är sidans egen text. Den är lång nog och har punkter.\n\nSkriv ut sidan\n\n© 2024 Verket\nFölj oss"
    pages = [(f"p{i}", f"https://v{i % 3}.example/{i}", menu.format(i, "ab" * (i + 1)), None) for i in range(40)] + [(f"m{i}", "", "# M\n\n" + "cd" * (i + 1) + " är sidans egen text. Den är lång nog och har punkter.", None) for i in range(16)]
    df = spark.createDataFrame(pages, "doc_id string, url string, text string, agency string")
    ratios = boilerplate.fit(df)
    lines = ratios.furniture(menu.format(7, "ab" * 8))
    assert lines == [0, 1, 2, 8, 10, 11]


def test_length_and_punctuation_decide(spark):
    """Without plain documents the two ratios alone part menus from text, and with them they keep text of a path that plain documents lack."""
    page = "Start\nOm oss\nPress\n\n# T\n\n{} är sidans egen text. Den är lång nog och har punkter.\n\nSkriv ut sidan\n\nTill toppen\nFölj oss"
    pages = [(f"p{i}", "https://v.example/1", page.format("ab" * (i + 1))) for i in range(40)]
    alone = boilerplate.fit(spark.createDataFrame(pages, "doc_id string, url string, text string"))
    assert alone.furniture(page.format("abc")) == [0, 1, 2, 8, 10, 11]
    plain = [(f"m{i}", "", "# M\n\n- En kort rad\n\n- En rad till") for i in range(20)]
    counts = boilerplate.path_counts(spark.createDataFrame(pages + plain, "doc_id string, url string, text string")).collect()
    frequency = boilerplate.PathRatios([tuple(r) for r in counts], weights=(0.0, 0.0, 1.0))
    fused = boilerplate.PathRatios([tuple(r) for r in counts])
    assert 6 in frequency.furniture(page.format("ab" * 30)) and fused.value(boilerplate.line_paths(page.format("ab" * 30))[4][1]) > frequency.value(boilerplate.line_paths(page.format("ab" * 30))[4][1])


def test_alignment_equals_plain_smith_waterman():
    rng = random.Random(4)
    for _ in range(80):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        best = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (leakage.MATCH if a[i - 1] == b[j - 1] else leakage.MISMATCH), h[i - 1][j] + leakage.GAP, h[i][j - 1] + leakage.GAP)
                best = max(best, h[i][j])
        matched, start, end = leakage.align(np.array(a), np.array(b))
        assert (matched > 0) == (best > 0)
        if matched:
            assert b[start] in a and b[end] in a and matched * leakage.MATCH >= best


def test_leaks():
    item = " ".join(f"word{i} of{i} the{i}" for i in range(20))
    index = leakage.ItemIndex([(7, item), (8, "other words that never occur in the corpus at all here")])
    assert [x[:2] for x in index.leaks(f"Before. {item.upper()} After.")] == [(7, 1.0)]
    assert [x[0] for x in index.leaks("> " + " ".join(f"<b>{w}</b>" for w in item.split()[:40]))] == [7]
    assert index.leaks(" ".join(item.split()[:20])) == []


def test_leaks_of_half_an_item():
    item = [f"word{i}" for i in range(100)]
    index = leakage.ItemIndex([(7, " ".join(item))])
    assert [x[:2] for x in index.leaks(" ".join(["before"] * 9 + item[:50] + ["after"] * 9))] == [(7, 0.5)]
    assert [x[:2] for x in index.leaks(" ".join(["before"] * 9 + item[30:83] + ["after"] * 9))] == [(7, 0.53)]
    assert index.leaks(" ".join(["before"] * 9 + item[:49] + ["after"] * 9)) == []


@pytest.mark.parametrize("every", [2, 3, 5, 6])
def test_leaks_with_changed_words(every):
    item = [f"word{i}" for i in range(100)]
    index = leakage.ItemIndex([(7, " ".join(item)), (8, "other words that never occur")])
    changed = [f"x{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
    assert [x[0] for x in index.leaks(" ".join(["before"] * 40 + changed + ["after"] * 40))] == [7]


@pytest.mark.parametrize("between", [10, 400])
def test_leaks_behind_a_shorter_part_of_the_same_item(between):
    item = [f"word{i}" for i in range(90)]
    index = leakage.ItemIndex([(7, " ".join(item))])
    later = [f"x{i}" if i % 2 else w for i, w in enumerate(item)]
    assert [x[0] for x in index.leaks(" ".join(item[:35] + ["between"] * between + later + ["on"] * 3000))] == [7]
    assert index.leaks(" ".join(item[:35] + ["between"] * 400 + item[46:])) == []


def test_leaks_in_blocks_of_items_and_in_texts_past_the_packed_width(spark, monkeypatch):
    documents = spark.createDataFrame([(1, "x y z " + " ".join(f"w{i}" for i in range(30))), (2, "nothing here"), (3, " ".join(f"v{i}" for i in range(15)))], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"{c}{j}" for j in range(30))) for i, c in enumerate("wvutsr")], "item_id long, text string")
    whole = {tuple(r) for r in leakage.leaks(documents, items).collect()}
    monkeypatch.setattr(leakage, "MOST_ITEMS", 2)
    assert {tuple(r) for r in leakage.leaks(documents, items).collect()} == whole and {r[:2] for r in whole} == {(1, 0), (3, 1)}
    item, text = np.arange(40), np.concatenate([np.full(140_000, -1), np.arange(40)])
    assert leakage.align(item, text) == (40, 140_000, 140_039)


def test_subsequence_bound_is_exact():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 14))] for _ in range(2))
        most = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                most[i + 1][j + 1] = most[i][j] + 1 if x == y else max(most[i][j + 1], most[i + 1][j])
        index = leakage.ItemIndex([(1, "z z z"), (2, " ".join(map(str, a))), (3, "0 1 2 3 4 5 5")])
        text = [index.ids.get(str(y), -1) for y in b]
        firsts, bits, full = index.blocks[0]
        left = leakage.unmatched(bits, full, text)
        assert len(a) - (left >> firsts[1] & (1 << len(a)) - 1).bit_count() == most[-1][-1]
        assert len(a) - leakage.unmatched(index.bits[1], (1 << len(a)) - 1, text).bit_count() == most[-1][-1]


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, s, rng.randint(1, 50)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 500 + ["tiny"] * 40)]
    records = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.draw(records, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["big"]["reached_share"] - 0.5 / 0.9) < 0.01 and abs(got["mid"]["reached_share"] - 0.3 / 0.9) < 0.01
    assert got["tiny"]["most_copies"] <= 4 and got["none"]["tokens"] == 0
    assert mix.count() == mix.select("doc_id").distinct().count()
    capped = {r["source"]: r for r in mixing.draw(records, targets, total_tokens=10**7)[1].collect()}
    assert capped["big"]["most_copies"] == 1 and capped["tiny"]["most_copies"] == 4


def test_mix_of_heavy_tailed_sizes(spark):
    """Pareto(1.1) sizes: the largest records do not overrun a source's tokens."""
    rng = random.Random(8)
    sizes = [("heavy", int(10 * rng.paretovariate(1.1))) for _ in range(20_000)] + [("even", 10) for _ in range(20_000)]
    records = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("heavy", 0.5, 1), ("even", 0.5, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.draw(records, targets, total_tokens=300_000)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["heavy"]["reached_share"] - 0.5) < 0.01 and got["heavy"]["records"] > 500
    assert abs(got["heavy"]["tokens"] + got["even"]["tokens"] - 300_000) < 3000


def test_scale_fills_the_expected_tokens():
    rng = random.Random(9)
    sizes = [int(5 * rng.paretovariate(1.0)) + 1 for _ in range(5000)]
    classes = {}
    for n in sizes:
        c = classes.setdefault(int(np.floor(np.log2(n) * mixing.CLASSES)), [0, 0, 0.0])
        classes[int(np.floor(np.log2(n) * mixing.CLASSES))] = [max(c[0], n), c[1] + n, c[2] + n**1.5]
    for part in (0.05, 0.4, 0.9):
        rest = part * sum(sizes)
        c = mixing.scale([tuple(v) for v in classes.values()], rest)
        assert sum(n for n in sizes if c * n**0.5 >= 1) <= rest
        assert sum(min(1.0, c * n**0.5) * n for n in sizes) < 1.03 * rest


def test_compression_distance():
    plain = [f"Du måste skicka blankett {i} till kontoret före den {i}." for i in range(40)] + [f"Kontoret i Mossvik öppnar klockan {i} varje vardag." for i in range(40)]
    nasty = [f"Håll käften din äckliga {w}, ingen vill se dig här." for w in ("mes", "idiot", "fårskalle", "skurk", "typ", "drummel", "slyngel", "tok")] * 3
    rng = random.Random(5)
    labelled = [(" ".join(rng.sample(plain, 3)), frozenset({"none"})) for _ in range(80)] + [(f"{rng.choice(plain)} {x}", frozenset({"abusive"})) for x in nasty]
    rng.shuffle(labelled)
    model = toxicity.fit_model(labelled)
    assert model.scores("Håll käften din äckliga luns, ingen vill se dig här.")[0] >= model.thresholds[0]
    assert model.scores(plain[3])[0] < model.thresholds[0]
    assert model.scores(None) == [0.0, 0.0, 0.0]


def test_hidden_spellings_are_undone():
    assert toxicity.normalised("You H a l f w i t, you aSsHoLe, nuuuude st0p 12") == "you halfwit, you asshole, nude stop 0"

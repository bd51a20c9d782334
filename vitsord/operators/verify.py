"""Sentence-level verification of answers against their cited sources, and evaluation of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import text as tx

#: Share of a claim's terms that its sources must have; of a computed one, whose other words come from the tool.
SUPPORT, CALC_SUPPORT = 0.5, 0.3
#: Tools whose results bear a computed claim.
CALC_TOOLS = ("calculate_deadline", "next_business_day")
# Phrases of sentences that state nothing about the matter itself.
META = r"(?iu)(could not find|couldn't find|cannot find|can't find|not (?:mentioned|covered|stated) in|no information|please (?:verify|check|contact)|contact (?:the|your)|this is not (?:legal|official)|kunde inte hitta|hittar inte|kontakta|sources?:|källor?:)"
# Patterns of text that tries to give instructions.
INJECTION = [
    r"ignore\s+(all\s+|any\s+)?(the\s+)?(previous|prior|above|earlier)\s+(instructions|prompts?|rules)",
    r"disregard\s+(all\s+|the\s+)?(previous|prior|above|system)",
    r"\b(system|developer)\s+prompt\b",
    r"\byou\s+are\s+now\b",
    r"\bact\s+as\s+(an?\s+)?(unrestricted|jailbroken|dan)\b",
    r"\bdo\s+not\s+(tell|inform|mention\s+to)\s+the\s+user\b",
    r"\b(reveal|print|output)\s+(your|the)\s+(instructions|system prompt|api key)",
    r"<\|?(im_start|im_end|system|assistant)\|?>",
    r"^\s*(###\s*)?(system|assistant)\s*:",
    r"\bnew\s+instructions?\s*:",
    r"ignorera\s+(alla\s+)?(tidigare|föregående)\s+instruktioner",
    r"\bsend\s+(the\s+)?(user'?s?\s+)?(data|personnummer|password|credentials)\s+to\b",
]


def injection_findings(text: Column) -> Column:
    """How many of the patterns a text matches."""
    return sum((F.when(text.rlike(f"(?iumU){p}"), 1).otherwise(0) for p in INJECTION), F.lit(0))


def tool_texts(calls: Column) -> Column:
    """The values of each result of the calendar tools, its ISO dates also as in "Tuesday 17 March 2026"; what is no object is none."""

    def said(call: Column) -> Column:
        values = F.map_values(F.from_json(call["result"], "map<string,string>"))
        plain = F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit("None"))), " ")
        days = F.transform(F.regexp_extract_all(plain, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)), lambda d: dt.long_date(d.try_cast("date")))
        return F.concat_ws(" ", plain, days)

    found = F.transform(F.filter(calls, lambda c: c["tool"].isin(*CALC_TOOLS)), lambda c: F.when(F.from_json(c["result"], "map<string,string>").isNotNull(), said(c)))
    return F.coalesce(F.filter(found, lambda t: t.isNotNull()), F.array().cast("array<string>"))


def claims(answers: DataFrame) -> DataFrame:
    """(trace_id, answer, sources[, tool_calls]) -> one row per sentence with its citations, its support and whether the cited text bears it.

    A sentence of fewer than three content terms, or about the answer itself, is no claim. A claim is supported if it has a valid
    citation, at least half of its terms stand in the cited sources, and so do all its numbers. A claim marked [calc] may take its
    numbers from the calendar tools' results as well; with a citation, 0.3 of the terms that no result has must stand in the sources;
    without one, its numbers decide, if there is a result. ``sources`` is an array of structs with n, title, section and text,
    ``tool_calls`` one of tool and result. Null answers give no sentence; null sources and calls are none.
    """
    calls = tool_texts(F.col("tool_calls")) if "tool_calls" in answers.columns else F.array().cast("array<string>")
    told = answers.select("trace_id", "answer", F.coalesce("sources", F.array()).alias("sources"), calls.alias("told")).withColumn("tool_text", F.array_join("told", " "))
    told = told.select("trace_id", "answer", "sources", (F.size("told") > 0).alias("has_result"), tx.numbers(F.replace("tool_text", F.lit("-"), F.lit(" "))).alias("tool_numbers"), F.array_distinct(tx.content_terms(F.col("tool_text"))).alias("tool_terms"))
    found = told.select("trace_id", "sources", "has_result", "tool_numbers", "tool_terms", F.posexplode(tx.sentences(tx.citations_inside(F.col("answer")))).alias("sentence_no", "sentence"))
    cited = found.withColumn("cited", tx.citations(F.col("sentence"))).withColumn("has_calc", F.col("sentence").rlike(r"(?i)\[calc\]"))
    body = F.regexp_replace(F.regexp_replace("sentence", tx.CITATION, " "), r"(?i)\[calc\]", " ")
    cited = cited.withColumn("body", body).withColumn("terms", F.array_distinct(tx.content_terms(F.col("body"))))
    known = F.transform("sources", lambda s: s["n"])
    cited = cited.withColumn("is_claim", (F.size("terms") >= 3) & ~F.col("body").rlike(META)).withColumn("valid", F.array_intersect("cited", known))
    text_of = lambda s: F.concat_ws(". ", F.coalesce(s["title"], F.lit("")), F.coalesce(s["section"], F.lit("")), F.coalesce(s["text"], F.lit("")))
    evidence = F.array_join(F.transform(F.filter("sources", lambda s: F.array_contains("valid", s["n"])), text_of), " ")
    cited = cited.withColumn("evidence", evidence).drop("sources")
    # of a computed claim, the words that the tool gives need no source
    cited = cited.withColumn("rest", F.when(F.col("has_calc"), F.array_except("terms", "tool_terms")).otherwise(F.col("terms")))
    share = F.when(F.size("rest") == 0, 1.0).otherwise(F.size(F.array_intersect("rest", tx.content_terms(F.col("evidence")))) / F.size("rest"))
    unsaid = F.array_except(tx.numbers(F.col("body")), tx.numbers(F.col("evidence")))
    checked = cited.withColumn("missing", F.size(F.when(F.col("has_calc"), F.array_except(unsaid, F.col("tool_numbers"))).otherwise(unsaid)))
    matches = (F.col("missing") == 0) & F.col("has_result")
    alone = F.col("has_calc") & (F.size("valid") == 0)
    checked = checked.withColumn("support", F.when(~F.col("is_claim"), 1.0).when(alone, matches.cast("double")).when(F.size("valid") == 0, 0.0).otherwise(share))
    least = F.when(F.col("has_calc"), CALC_SUPPORT).otherwise(SUPPORT)
    ok = F.when(~F.col("is_claim"), True).when(alone, matches).when(F.size("valid") == 0, False).otherwise((F.col("support") >= least) & (F.col("missing") == 0))
    return checked.select("trace_id", "sentence_no", "sentence", "cited", "valid", "has_calc", "is_claim", "support", ok.alias("supported"))


def verification(checked: DataFrame) -> DataFrame:
    """Claims per answer -> (trace_id, claims, faithfulness, citation_coverage, invalid_citations, label)."""
    claim = F.col("is_claim")
    bad = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(claim, F.array_except("cited", "valid"))))))
    per = checked.groupBy("trace_id").agg(
        F.count_if(claim).alias("claims"),
        F.count_if(claim & F.col("supported")).alias("good"),
        F.count_if(claim & ((F.size("cited") > 0) | F.col("has_calc"))).alias("with_citation"),
        bad.alias("invalid_citations"),
    )
    share = lambda c: F.when(F.col("claims") > 0, F.bround(F.col(c) / F.col("claims"), 3)).otherwise(1.0)
    label = F.when(F.col("claims") == 0, "no-claims").when(F.col("faithfulness") >= 0.999, "verified").when(F.col("faithfulness") >= 0.5, "partially-verified").otherwise("unverified")
    return per.withColumn("faithfulness", share("good")).withColumn("citation_coverage", share("with_citation")).select("trace_id", "claims", "faithfulness", "citation_coverage", "invalid_citations", label.alias("label"))


def abstention(pairs: DataFrame, group: list[str]) -> DataFrame:
    """(predicted, actual) booleans -> counts, precision, recall and F1 of abstaining; empty denominators give 1, and F1 0 if both are 0."""
    per = pairs.groupBy(*group).agg(F.count_if(F.col("predicted") & F.col("actual")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("actual")).alias("fp"), F.count_if(~F.col("predicted") & F.col("actual")).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    per = per.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return per.withColumn("f1", f1)

"""Deadlines computed from a date in the question and a rule in the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as dt
from ..functions import text as tx

#: Hits that are searched for a rule.
HITS = 3
# What makes a question one about a deadline, numbers in words, and the forms of rules.
DEADLINE = r"\b(deadline|last day|latest|by when|when (?:do|must|should|is)|how long|senast|sista dag|när måste|när ska|frist)\b"
WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fourteen": 14, "thirty": 30, "ninety": 90,
    "en": 1, "ett": 1, "två": 2, "tre": 3, "fyra": 4, "fem": 5, "sex": 6, "sju": 7, "åtta": 8, "nio": 9, "tio": 10,
}
UNITS = {"day": "days", "dag": "days", "dagar": "days", "week": "weeks", "vecka": "weeks", "veckor": "weeks", "month": "months", "månad": "months", "månader": "months"}
DURATION = rf"\b(?:within|no later than|inom|senast)\s+(\d+|{'|'.join(WORDS)})\s+(days?|weeks?|months?|dagar|dag|veckor|vecka|månader|månad)\b"
FIXED = rf"\b(?:no later than|by|senast(?: den)?)\s+(\d{{1,2}})\s+({dt.MONTH})\b"
ROLL = r"next working day|nästa vardag|närmast följande vardag"
YEAR = r"\b(20\d{2})\b"


def _map(values: dict[str, object], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.lower(key))


def asks_deadline(question: Column) -> Column:
    """Whether a question is about a deadline."""
    return question.rlike(f"(?iuU){DEADLINE}")


def rules(sentence: Column) -> Column:
    """Struct (amount, unit, day, month) of the first duration and the first fixed date of a sentence; what is missing is null."""
    n, unit = (F.nullif(F.regexp_extract(sentence, f"(?iuU){DURATION}", i), F.lit("")) for i in (1, 2))
    day, month = (F.nullif(F.regexp_extract(sentence, f"(?iuU){FIXED}", i), F.lit("")) for i in (1, 2))
    return F.struct(
        F.coalesce(n.try_cast("int"), _map(WORDS, n)).alias("amount"),
        F.coalesce(_map(UNITS, unit), F.lower(unit)).alias("unit"),
        day.try_cast("int").alias("day"),
        dt.month_number(month).alias("month"),
    )


def planned(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, question), (qid, rank, chunk_id) -> (qid, chunk_id, sentence, start_day, amount, unit, due, rolls), one row per planned question.

    The first sentence of the first hits decides that has a duration, where the question has a date, or a fixed day, where it has a
    year and no date. ``due`` is the day the rule gives; ``rolls`` says whether the chunk moves it to the next working day.
    """
    asked = questions.where(asks_deadline(F.col("question"))).select("qid", F.get(dt.found_dates(F.col("question")), F.lit(0)).alias("start_day"), F.nullif(F.regexp_extract("question", YEAR, 1), F.lit("")).alias("year"))
    asked = asked.where("start_day is not null or year is not null")
    first = hits.where(F.col("rank") <= HITS).join(asked, "qid").select("qid", "rank", "chunk_id", "start_day", "year")
    # bodies move only to the hits of questions that have a date
    texts = chunks.join(F.broadcast(first.select("chunk_id").distinct()), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]).select("chunk_id", "text")
    said = first.join(texts, "chunk_id").select("*", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("r", rules(F.col("sentence")))
    lasting = F.col("start_day").isNotNull() & F.col("r.amount").isNotNull()
    fixed = dt.day_of(F.col("year"), F.col("r.month"), F.col("r.day"))
    due = F.when(lasting, dt.deadline(F.col("start_day"), F.col("r.amount"), F.col("r.unit"))).when(F.col("start_day").isNull(), fixed)
    found = said.withColumn("due", due).where("due is not null").withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "pos")))
    return found.where("place = 1").select(
        "qid", "rank", "chunk_id", "sentence", "start_day", F.when(lasting, F.col("r.amount")).alias("amount"), F.when(lasting, F.col("r.unit")).alias("unit"), "due", (~lasting & F.col("text").rlike(f"(?iuU){ROLL}")).alias("rolls")
    )


def said(plans: DataFrame, calendar: DataFrame, cited: Column) -> DataFrame:
    """``planned`` rows and ``dates.calendar`` -> (qid, text, tool_calls): the rule's sentence with its source, and the computed day.

    ``cited`` is the sentence with its citation.
    """
    days = calendar.select(F.col("day").alias("due"), "next_business_day")
    rolled = plans.join(F.broadcast(days), "due", "left")  # some hundred rows for each year
    moved = F.col("rolls") & (F.col("next_business_day") > F.col("due"))
    long, year = dt.long_date(F.col("due")), F.year("due").cast("string")
    tail = (
        F.when(F.col("amount").isNotNull(), F.concat(F.lit(" Counting from "), dt.long_date(F.col("start_day")), F.lit(", the deadline is "), long, F.lit(" [calc].")))
        .when(moved, F.concat(F.lit(" In "), year, F.lit(", "), long, F.lit(" is not a working day, so the deadline is "), dt.long_date(F.col("next_business_day")), F.lit(" [calc].")))
        .when(F.col("rolls"), F.concat(F.lit(" In "), year, F.lit(" that is "), long, F.lit(" [calc].")))
        .otherwise("")
    )
    final = F.coalesce(F.when(F.col("rolls"), F.col("next_business_day")), F.col("due"))
    tool = F.when(F.col("amount").isNotNull(), "calculate_deadline").when(F.col("rolls"), "next_business_day")
    result = F.to_json(F.struct(F.coalesce("start_day", "due").cast("string").alias("start"), F.concat_ws(" ", F.col("amount").cast("string"), "unit").alias("rule"), final.cast("string").alias("deadline")))
    calls = F.when(tool.isNotNull(), F.array(F.struct(tool.alias("tool"), result.alias("result"))))
    return rolled.select("qid", F.concat(cited, tail).alias("text"), calls.alias("tool_calls"), "chunk_id", final.alias("deadline"))

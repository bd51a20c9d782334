"""Calendar functions: Easter, Swedish holidays, working days and deadlines as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter of a year, by integer arithmetic (the anonymous computus)."""
    div = lambda a, b: F.floor(a / b)  # noqa: E731 - years are positive, so floor is integer division
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    weekday = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * weekday, 451)
    n = h + weekday - 7 * m + 114
    return F.make_date(year.cast("int"), div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def holidays(years: DataFrame) -> DataFrame:
    """(year) -> (day, name): one row per holiday; of two names for a day the later one in this order stays."""
    easter = easter_sunday(F.col("year"))
    day = lambda m, d: F.make_date("year", F.lit(m), F.lit(d))
    weekday_from = lambda start, wanted: F.date_add(start, (F.lit(wanted) - F.weekday(start) + 7) % 7)
    midsummer = weekday_from(day(6, 19), 4)
    # The holidays in the order in which a later name replaces an earlier one.
    named = [
        ("New Year's Day", day(1, 1)), ("Epiphany", day(1, 6)), ("Good Friday", F.date_sub(easter, 2)), ("Easter Sunday", easter),
        ("Easter Monday", F.date_add(easter, 1)), ("May Day", day(5, 1)), ("Ascension Day", F.date_add(easter, 39)),
        ("Whit Sunday", F.date_add(easter, 49)), ("National Day", day(6, 6)), ("Midsummer Eve", midsummer),
        ("Midsummer Day", F.date_add(midsummer, 1)), ("All Saints' Day", weekday_from(day(10, 31), 5)), ("Christmas Eve", day(12, 24)),
        ("Christmas Day", day(12, 25)), ("Boxing Day", day(12, 26)), ("New Year's Eve", day(12, 31)),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("place"), d.alias("day"), F.lit(n).alias("name")) for i, (n, d) in enumerate(named)))
    return years.select("year", F.inline(rows)).groupBy("day").agg(F.max_by("name", "place").alias("name"))


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(day, is_working_day, next_business_day) of the years given; a dimension of some hundred rows a year, whatever the data."""
    years = spark.range(first_year, last_year + 2).select(F.col("id").alias("year"))
    days = years.select(F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("day"))
    marked = days.join(F.broadcast(holidays(years)), "day", "left").select("day", ((F.weekday("day") < 5) & F.col("name").isNull()).alias("is_working_day"))
    # no run of free days is longer than the window, which is by month and the next, so that no task gets all days
    ahead = Window.partitionBy("part").orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    parts = marked.select("day", "is_working_day", F.explode(F.array(F.trunc("day", "month"), F.trunc(F.date_sub("day", 15), "month"))).alias("part")).dropDuplicates()
    found = parts.withColumn("next_business_day", F.min(F.when(F.col("is_working_day"), F.col("day"))).over(ahead))
    return found.where(F.col("part") == F.trunc("day", "month")).where(F.year("day") <= last_year).select("day", "is_working_day", "next_business_day")


def deadline(start: Column, amount: Column, unit: Column) -> Column:
    """``start`` plus ``amount`` days, weeks or months in English or Swedish; an unknown unit is an error."""
    u = F.regexp_replace(F.lower(F.trim(unit)), "s$", "")
    return (
        F.when(u.isin("day", "dag", "dagar"), F.date_add(start, amount.cast("int")))
        .when(u.isin("week", "vecka", "veckor"), F.date_add(start, (amount * 7).cast("int")))
        .when(u.isin("month", "månad", "månader", "manad"), F.add_months(start, amount.cast("int")))
        .when(unit.isNull(), F.lit(None).cast("date"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown unit: "), unit)).cast("date"))
    )


def long_date(day: Column) -> Column:
    """A date as in "Tuesday 17 March 2026"."""
    return F.date_format(day, "EEEE d MMMM yyyy")


# English months, their short forms, and Swedish months, by their number.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "januari": 1, "februari": 2, "mars": 3, "maj": 5, "juni": 6, "juli": 7, "augusti": 8, "oktober": 10,
}
#: Month names, the longer first, as a pattern.
MONTH = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
#: A date such as 2026-03-17, 17 March 2026, 17th of March, 2026 or March 17, 2026.
DATE = rf"\b\d{{4}}-\d{{1,2}}-\d{{1,2}}\b|\b\d{{1,2}}(?:st|nd|rd|th|e|:e)?\s+(?:of\s+)?(?:{MONTH})\.?,?\s+\d{{4}}\b|\b(?:{MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"


def month_number(name: Column) -> Column:
    """The number of a month's name; null for another word."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), F.lower(name))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("-", year.cast("string"), two(month), two(day)).try_cast("date")


def found_dates(text: Column) -> Column:
    """The distinct dates of a text in reading order; days that do not exist are none, null gives null."""

    def parsed(m: Column) -> Column:
        low = F.lower(m)
        iso = day_of(F.regexp_extract(low, r"^(\d{4})-", 1), F.regexp_extract(low, r"-(\d{1,2})-", 1), F.regexp_extract(low, r"-(\d{1,2})$", 1))
        said = day_of(F.regexp_extract(low, r"(\d{4})$", 1), month_number(F.regexp_extract(low, rf"(?:^|[^a-z])({MONTH})(?:[^a-z]|$)", 1)), F.regexp_extract(low, r"(?:^|\D)(\d{1,2})(?:st|nd|rd|th|e|:e)?(?:\D|$)", 1))
        return F.when(low.rlike(r"^\d{4}-"), iso).otherwise(said)

    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){DATE}"), F.lit(0)), parsed)
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))

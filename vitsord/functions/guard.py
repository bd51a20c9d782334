"""Redaction of Swedish personal data by the reference's fixed rules, as Column expressions.

The order is part of the result: identity numbers, IBAN, cards, e-mail addresses, phone numbers. Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of each kind.
IDENTITY = r"(?<![\d-])(?:(?:19|20)?\d{2})\d{2}\d{2}[-+]?\d{4}(?![\d-])"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
PHONE = r"(?<![\d+])(?:\+46|0046|0)[\s-]?7[02369](?:[\s-]?\d){7}(?!\d)|(?<![\d+])\+46(?:[\s-]?\d){7,10}(?!\d)"
IBAN = r"(?i)\bSE\d{2}(?:\s?\d{4}){5}\b"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def identity_kind(candidate: Column) -> Column:
    """``personnummer``, ``samordningsnummer`` or null: ten digits with a valid check digit and date, 60 added to the day of the latter."""
    digits = _digits(candidate)
    ten = F.substring(digits, -10, 10)
    year = F.when(F.char_length(digits) == 12, F.substring(digits, 1, 4)).otherwise("2000")
    day = F.substring(ten, 5, 2).cast("int")
    real = F.when(day > 60, day - 60).otherwise(day)
    valid = F.concat_ws("-", year, F.substring(ten, 3, 2), F.lpad(real.cast("string"), 2, "0")).try_cast("date").isNotNull()
    return F.when(_luhn(ten) & valid, F.when(day > 60, "samordningsnummer").otherwise("personnummer"))


def redact(text: Column) -> Column:
    """Struct (text, found): the redacted text, and how many of each kind were replaced."""

    def swap(value: Column, candidates: Column, token: Column) -> Column:
        return F.aggregate(candidates, value, lambda a, c: F.regexp_replace(a, F.concat(F.lit(r"(?<![\d-])\Q"), c, F.lit(r"\E(?![\d-])")), token))

    numbers = F.regexp_extract_all(text, F.lit(IDENTITY), F.lit(0))
    kinds = {
        "personnummer": F.filter(numbers, lambda c: identity_kind(c) == "personnummer"),
        "samordningsnummer": F.filter(numbers, lambda c: identity_kind(c) == "samordningsnummer"),
    }
    out = text
    for kind, found in kinds.items():
        out = swap(out, found, F.lit(f"[{kind.upper()}]"))
    counts = {kind: F.size(found) for kind, found in kinds.items()}
    ibans = F.regexp_count(out, F.lit(IBAN))
    out = F.regexp_replace(out, IBAN, "[IBAN]")
    length = lambda c: F.char_length(_digits(c))
    cards = F.filter(F.regexp_extract_all(out, F.lit(CARD), F.lit(0)), lambda c: (length(c) >= 13) & (length(c) <= 19) & _luhn(_digits(c)))
    after = F.aggregate(cards, out, lambda a, c: F.replace(a, c, F.lit("[CARD]")))
    emails = F.regexp_count(after, F.lit(EMAIL))
    masked = F.regexp_replace(after, EMAIL, "[EMAIL]")
    phones = F.regexp_count(masked, F.lit(PHONE))
    counts |= {"iban": ibans, "card": F.size(cards), "email": emails, "phone": phones}
    found = F.map_filter(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), n))), lambda k, n: n > 0)
    return F.when(text.isNotNull(), F.struct(F.regexp_replace(masked, PHONE, "[PHONE]").alias("text"), found.alias("found")))

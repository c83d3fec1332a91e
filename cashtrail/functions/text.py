"""Narration, identifier and number clean-up expressions for ledger rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword ladder for the payment rail; the first rail with a keyword present wins.
RAIL_KEYWORDS = [
    ("RTGS", ["RTGS"]),
    ("NEFT", ["NEFT"]),
    ("UPI", ["UPI"]),
    ("IMPS", ["IMPS"]),
    ("INDO_GIBL", ["INDO GIBL"]),
    ("INTERNAL_TRANSFER", ["FDRL", "INTERNAL"]),
    ("BOOK_TRANSFER", ["TRF", "TRANSFER"]),
    ("CHEQUE", ["CHQ", "CHEQUE", "CLEARING"]),
    ("CASH_ATM", ["CASH", "CDM", "ATM"]),
    ("CARD_POS", ["POS", "ECOM"]),
]
RAIL_NO_KEYWORD = "GENERAL_TRANSFER"
RAIL_NO_NARRATION = "OTHER"
# Fixed value: narration prefixes that are not part of the counterparty.
COUNTERPARTY_PREFIX = r"(?i)^(TRF (?:FROM|FRM|TO)|NEFT|RTGS|UPI/CR|UPI/DR|FDRL/)\s*"
WIDE_GAP = r"\s{2,}|[\t\n\x0B\f\r]"        # white space that is not one blank already
# Cheque numbers that mean "none".
NO_CHEQUE = ["", "nan", "None"]


# What ``\s`` matches, and the line ends beyond it, before which ``$`` matches too.
WHITE = " \t\n\x0b\f\r"
LINE_ENDS = ["\x85", "\u2028", "\u2029"]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often and in whichever branches it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks alone."""
    odd = lambda t: reduce(lambda a, b: a | b, [t.endswith(e) for e in LINE_ENDS])
    return once(c, lambda raw: once(F.trim(raw, F.lit(WHITE)), lambda t: F.when(odd(t), F.regexp_replace(raw, r"^\s+|\s+$", "")).otherwise(t)))


def payment_rail(narration: Column) -> Column:
    def rail(text: Column) -> Column:
        has = lambda words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        found = F.when(text.isNull(), RAIL_NO_NARRATION)
        for name, words in RAIL_KEYWORDS:
            found = found.when(has(words), name)
        return found.otherwise(RAIL_NO_KEYWORD)

    return once(F.upper(narration), rail)


def counterparty(narration: Column) -> Column:
    def party(text: Column) -> Column:
        rest = strip(F.regexp_replace(F.regexp_replace(text, COUNTERPARTY_PREFIX, ""), WIDE_GAP, " "))
        return F.when(text != "", once(rest, lambda r: F.when(r == "", text).otherwise(r)))

    return once(strip(narration), party)


def clean_account(account: Column) -> Column:
    return strip(F.replace(account.cast("string"), F.lit("'"), F.lit("")))


def number_or_zero(c: Column) -> Column:
    """Unreadable, absent and NaN numbers count as 0."""
    return F.nanvl(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def cheque_number(c: Column) -> Column:
    text = strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\.0$", ""))
    return once(text, lambda t: F.when(~t.isin(NO_CHEQUE), t))


def first_number(text: Column) -> Column:
    """The first run of digits, as a row index."""
    return F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).cast("long")

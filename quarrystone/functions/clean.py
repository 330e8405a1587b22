"""Normalising dirty text columns, as expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value", compared after trimming, case-sensitive.
SENTINELS = ["", "NULL", "null", "N/A", "n/a", "-", "unknown", "9999-12-31"]
#: Country names (lower case) and their codes.
COUNTRIES = {"india": "IN", "in": "IN", "bharat": "IN", "us": "US", "usa": "US"}
#: Timestamp patterns in order of trial.
ISO = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX"]
MIXED = [*ISO, "dd-MM-yyyy HH:mm", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss"]
DATES = ["yyyy-MM-dd", "dd/MM/yyyy"]


def without_sentinel(c: Column) -> Column:
    """Trimmed; null for null and sentinels."""
    t = F.trim(c)
    return F.when(~t.isin(SENTINELS), t)


def number_text(c: Column) -> Column:
    """Without thousands separators, currency signs and white space."""
    return F.regexp_replace(c, r"[,₹$\s]", "")


def first_timestamp(c: Column, patterns: list[str]) -> Column:
    """By the first pattern that fits, in the session's zone; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in patterns or MIXED))


def first_date(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)).cast("date") for p in DATES))


def email(c: Column) -> Column:
    """Lower case, trimmed, without one dot at the end; null if blank."""
    t = F.lower(F.trim(c))
    return F.when(t != "", F.regexp_replace(t, r"\.$", ""))


def requester_email(c: Column) -> Column:
    """As email(), but a blank stays blank."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")


def recipient_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def phone(c: Column) -> Column:
    """``+91`` and ten digits, with a trunk zero, 91 or 091 taken off; null for any other number of digits."""
    d = F.regexp_replace(c, r"\D", "")
    n = F.length(d)
    trunk = (n == 10) | ((n == 11) & d.startswith("0")) | ((n == 12) & d.startswith("91")) | ((n == 13) & d.startswith("091"))
    return F.when(trunk, F.concat(F.lit("+91"), F.right(d, F.lit(10))))


def country(c: Column) -> Column:
    key = F.lower(F.trim(c))
    known = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, key), F.upper(F.trim(c)))


def status(c: Column) -> Column:
    return F.lower(F.trim(c))


def name(c: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def first_token(c: Column) -> Column:
    return F.get(F.split(name(c), " "), F.lit(0))


def last_token(c: Column) -> Column:
    return F.element_at(F.split(name(c), " "), -1)


def authoritative_id(c: Column) -> Column:
    return F.upper(F.trim(c))


def full_name(first: Column, last: Column) -> Column:
    """Both null: the empty string."""
    return F.concat_ws(" ", first, last)


def display_name(first: Column, last: Column) -> Column:
    """Trimmed parts; null if nothing is left."""
    text = F.trim(F.concat_ws(" ", F.trim(first), F.trim(last)))
    return F.when(text != "", text)


def value_hash(namespace: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", namespace, value), 256)


def masked_value(value: Column) -> Column:
    """The first two characters and, of more than four, the last two."""
    tail = F.when(F.length(value) > 4, F.right(value, F.lit(2))).otherwise("")
    return F.concat(F.left(value, F.lit(2)), F.lit("***"), tail)


def masked_email(c: Column) -> Column:
    """Two characters and the domain after the first @; other texts unchanged."""
    at = F.instr(c, "@")
    return F.when(at > 0, F.concat(F.substring(F.substring_index(c, "@", 1), 1, 2), F.lit("***@"), F.substr(c, at + 1))).otherwise(c)


def masked_phone(c: Column) -> Column:
    """The prefix and the last two digits; texts under four characters unchanged."""
    return F.when(F.length(c) >= 4, F.concat(F.left(c, F.lit(3)), F.lit("***"), F.right(c, F.lit(2)))).otherwise(c)

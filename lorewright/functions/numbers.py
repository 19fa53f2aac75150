"""Arithmetic, array, JSON and time expressions (MTH-*, ARR-*, JSN-*, DAT-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
RRF_K, VECTOR_FLOOR, VECTOR_BAND = 60, 0.58, 0.86
RECENCY_DAYS, RECENCY_BONUS = 365, 0.15
RETENTION_DAYS, RETENTION_FLOOR = 90, 0.2
EXPIRED, SUPERSEDED, RERANK_BOOST = 0.5, 0.4, 0.25


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """MTH-01: 0 where the lengths differ or a vector is zero."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """MTH-03 over arrays of distinct values; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """MTH-03: share of the smaller set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def recency(updated_at: Column, now_ms: int) -> Column:
    """MTH-04."""
    age = F.greatest(F.lit(0), F.lit(now_ms) - updated_at)
    return F.greatest(F.lit(0.0), 1 - age / (RECENCY_DAYS * DAY_MS)) * RECENCY_BONUS


def retention(last_access_at: Column, access_count: Column, utility: Column, now_ms: int) -> Column:
    """MTH-05: forgetting lowers a note, never below a fifth."""
    days = F.coalesce((F.lit(now_ms) - last_access_at) / DAY_MS, F.lit(0.0))
    tau = (utility + F.least(access_count, F.lit(10)) + 0.1) * RETENTION_DAYS
    return RETENTION_FLOOR + (1 - RETENTION_FLOOR) * F.exp(-days / tau)


def signature_length(n: Column, threshold: float, most: int | None = 32) -> Column:
    """MTH-08: tokens of a prefix that a similar set must hit; with ``most`` no more than that, which can miss some."""
    whole = n - F.ceil(F.lit(threshold) * n) + 1
    return F.when(n <= 0, 0).otherwise(F.greatest(F.lit(1), whole if most is None else F.least(F.lit(most), whole))).cast("int")


def luhn(digits: Column) -> Column:
    """MTH-09: card check digit."""
    return F.call_function("luhn_check", F.regexp_replace(digits, r"\D", ""))


def iban(c: Column) -> Column:
    """MTH-09: country and check digits first, remainder 1 modulo 97."""
    flat = F.upper(F.regexp_replace(c, r"\s", ""))
    moved = F.concat(F.substring(flat, 5, 100), F.substring(flat, 1, 4))
    digits = F.regexp_replace(moved, "[A-Z]", "")
    values = F.transform(F.filter(F.split(moved, ""), lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97).cast("int"))
    return flat.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (rest == 1) & digits.isNotNull()


def plain_number(c: Column) -> Column:
    """MTH-07: thousands and decimal marks settled; the text of the number, or the text itself."""
    s = F.regexp_replace(c, r"['\s]", "")
    dot_at, comma_at = F.length(s) - F.instr(F.reverse(s), "."), F.length(s) - F.instr(F.reverse(s), ",")
    has_dot, has_comma = s.contains("."), s.contains(",")
    both = F.when(dot_at > comma_at, F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    marks = F.length(F.regexp_replace(s, r"[^.,]", ""))
    after = F.length(F.regexp_extract(s, r"[.,]([^.,]*)$", 1))
    one = F.when((after == 3) & (marks == 1), F.regexp_replace(s, "[.,]", "")).otherwise(F.regexp_replace(s, ",", "."))
    one = F.when(F.length(F.regexp_replace(one, r"[^.]", "")) > 1, F.replace(one, F.lit("."), F.lit(""))).otherwise(one)
    value = F.when(has_dot & has_comma, both).when(has_dot | has_comma, one).otherwise(s)
    number = value.try_cast("double")
    text = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    return F.coalesce(text, c)


def tags_of_json(c: Column) -> Column:
    """JSN-01: an array of strings; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def age_bucket(at: Column, now_ms: int) -> Column:
    """DAT-01."""
    days = (F.lit(now_ms) - at) / DAY_MS
    return F.when(at.isNull() | (at <= 0), "no date").when(days < 1, "today").when(days < 7, "this week").when(days < 14, "1-2 weeks").when(days < 28, "2-4 weeks").otherwise("older")


def list_period(at: Column, now_ms: int) -> Column:
    """DAT-02: today, this week (six days back) or older, by midnight (UTC)."""
    midnight = F.lit(now_ms - now_ms % DAY_MS)
    return F.when(at >= midnight, "today").when(at >= midnight - 6 * DAY_MS, "this week").otherwise("older")


def relative_time(at: Column, now_ms: int) -> Column:
    """DAT-03."""
    seconds = F.floor((F.lit(now_ms) - at) / 1000)
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit(" min")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600), F.lit(" h")))
        .otherwise(F.concat(F.floor(seconds / 86400), F.lit(" d")))
    )


def epoch_of_iso(c: Column) -> Column:
    """DAT-04: milliseconds of an ISO date or time; null where it is none."""
    return F.unix_millis(F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))


def session_date(c: Column) -> Column:
    """DAT-05: milliseconds of ``YYYY/MM/DD ... HH:MM``."""
    day = F.regexp_extract(c, r"(\d{4}/\d{2}/\d{2})", 1)
    time = F.regexp_extract(c, r"(\d{2}:\d{2})", 1)
    return F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", day, F.when(time == "", "00:00").otherwise(time)), F.lit("yyyy/MM/dd HH:mm")))


def lens_column(at: Column, now_ms: int) -> Column:
    """DAT-07."""
    days = (F.lit(now_ms) - at) / DAY_MS
    return F.when(days > 90, "older").when(days > 30, "quarter").when(days > 7, "month").when(days > 2, "week").otherwise("now")


def starts(valid_from: Column, created_at: Column) -> Column:
    return F.coalesce(valid_from, created_at)


def visible_at(valid_from: Column, created_at: Column, valid_to: Column, at_ms: int) -> Column:
    """As-of predicate: the half-open validity window holds the instant."""
    return (starts(valid_from, created_at) <= at_ms) & (valid_to.isNull() | (valid_to > at_ms))

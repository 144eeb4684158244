"""Dates and durations as Columns; the session's time zone must be UTC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in order after the weekday is gone and zones are made numeric.
RFC822 = ("d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm XX", "d MMM yy HH:mm:ss XX", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMMM yyyy HH:mm:ss XX", "d MMM yyyy", "MMM d yyyy HH:mm:ss")
RFC3339 = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss XX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d HH:mm:ss", "yyyy/M/d", "M/d/yyyy HH:mm:ss", "M/d/yyyy", "yyyy-MM", "yyyy")
#: Names of zones, in hours from UTC.
ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "MSK": 3, "CET": 1, "CEST": 2}


def first_of(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def _trimmed(text: Column) -> Column:
    t = F.regexp_replace(F.trim(text), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r",(?=\s)", "")
    name = F.upper(F.regexp_extract(t, r"(?i)\s([A-Z]{1,4})$", 1))
    zone = F.create_map(*[F.lit(x) for k, h in ZONES.items() for x in (k, f"{'-' if h < 0 else '+'}{abs(h):02d}00")])[name]
    return F.when(zone.isNotNull(), F.concat(F.regexp_replace(t, r"(?i)\s[A-Z]{1,4}$", " "), zone)).otherwise(t)


def rfc822(text: Column) -> Column:
    """A mail date, else one of the other kind."""
    t = _trimmed(text)
    return F.coalesce(first_of(t, RFC822), first_of(F.trim(text), RFC3339))


def rfc3339(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(first_of(t, RFC3339), first_of(_trimmed(text), RFC822))


def diff_seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / 1_000_000.0


def plus_seconds(t: Column, seconds: Column) -> Column:
    """Parts of a microsecond are cut off."""
    return F.timestamp_micros(F.unix_micros(t) + (seconds * 1_000_000).cast("long"))


def add_year(t: Column) -> Column:
    """The same day next year; the 29th of February becomes the 1st of March."""
    next_ = t + F.expr("INTERVAL 1 YEAR")
    return F.when((F.month(t) == 2) & (F.dayofmonth(t) == 29), next_ + F.expr("INTERVAL 1 DAY")).otherwise(next_)


def clock_duration(text: Column) -> Column:
    """h:m:s, m:s or s in seconds."""
    parts = F.split(F.trim(text), ":")
    total = F.aggregate(F.transform(parts, lambda p: p.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a * 60 + x)
    return F.when(F.trim(text).rlike(r"^\d+(:\d+){0,2}$"), total)


def iso_duration(text: Column) -> Column:
    """PnYnMnWnDTnHnMnS in seconds, a month 30 and a year 365 days."""
    t = F.upper(F.trim(text))
    day = F.regexp_extract(t, r"^P([^T]*)", 1)
    clock = F.regexp_extract(t, r"T(.*)$", 1)
    number = lambda c, unit: F.coalesce(F.nullif(F.regexp_extract(c, rf"(\d+(?:\.\d+)?){unit}", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    units = ((day, "Y", 365 * 86400), (day, "M", 30 * 86400), (day, "W", 7 * 86400), (day, "D", 86400), (clock, "H", 3600), (clock, "M", 60), (clock, "S", 1))
    total = reduce(lambda a, b: a + b, (number(c, u) * s for c, u, s in units))
    return F.when(t.rlike(r"^P(?=.)([\d.]+[YMWD])*(T([\d.]+[HMS])+)?$"), total)


def rounded(t: Column, step_ms: int = 500) -> Column:
    """Down to a whole scan step."""
    step = step_ms * 1000
    return F.timestamp_micros(F.unix_micros(t) - F.pmod(F.unix_micros(t), F.lit(step)))


def as_rfc822(t: Column) -> Column:
    return F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def as_rfc3339(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def next_posts_scan(age: Column) -> Column:
    """Seconds until a feed whose last change is ``age`` seconds ago is read again."""
    hour, week, month = 3600.0, 7 * 86400.0, 30 * 86400.0
    later = F.least(F.lit(week), hour * (1 + 2 * age / month))
    return F.when(age < 3 * hour, 900.0 * (1 + age / hour)).when(age < week, hour * (1 + age / week)).when(age < month, hour * (2 + age / month)).otherwise(later)


def next_comments_scan(age: Column) -> Column:
    hour, day = 3600.0, 86400.0
    return F.when(age < 5 * hour, 1200.0 * (1 + age / hour)).otherwise(hour * (2 + age / day))


def rescan(now: Column, modified: Column, posts: Column, factor: Column, add_hours: Column, jitter: Column) -> Column:
    """When to read a url again: its interval times a factor, with hours added, a day less the jitter at most, and up to
    900 seconds of jitter on top, in steps of half a second."""
    since = F.greatest(diff_seconds(now, F.least(F.coalesce(modified, now), now)), F.lit(0.0))
    base = F.when(posts, next_posts_scan(since)).otherwise(next_comments_scan(since))
    return rounded(plus_seconds(now, F.least(F.lit(86400.0 - 900.0), base * factor + add_hours * 3600.0) + jitter))

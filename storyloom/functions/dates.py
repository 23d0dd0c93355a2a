"""Calendar functions: instants are UTC timestamps, the news day is New York's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.text import col

ZONE = "America/New_York"


def instant(text: Column | str) -> Column:
    """A timestamp of an ISO date or date and time, else null."""
    return F.coalesce(*(F.try_to_timestamp(col(text), F.lit(form)) for form in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))


def news_day(ts: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts).cast("timestamp"), ZONE))


def week_id(day: Column) -> Column:
    """ISO week of a day, as 2024-W05."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def midnight(day: Column) -> Column:
    """The instant at which this day starts in the zone."""
    return F.to_utc_timestamp(day.cast("timestamp"), ZONE)


def hours_between(early: Column, late: Column) -> Column:
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(3.6e9)


def minutes_between(early: Column, late: Column) -> Column:
    """Rounded, not negative, null where either is."""
    return F.greatest(F.lit(0), F.floor(hours_between(early, late) * 60 + 0.5)).cast("long")


def relative(ts: Column, now: Column) -> Column:
    m = F.floor(hours_between(ts, now) * 60)
    return (
        F.when(m < 1, F.lit("Just now"))
        .when(m < 60, F.concat(m.cast("string"), F.lit(" min ago")))
        .when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit(" hr ago")))
        .when(m < 2880, F.lit("Yesterday"))
        .otherwise(F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), ZONE), "MMM d"))
    )


def weeks_in_year(year: Column) -> Column:
    """52 or 53; the 28th of December lies in the last ISO week of its year."""
    return F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))


def parse_week(text: Column | str) -> Column:
    """The Monday of a week written as 2024-W05; null for anything else, a week that the year has not included."""
    part = lambda i: F.regexp_extract(col(text), r"^(\d{4})-W(\d{2})$", i).try_cast("int")
    year, week = part(1), part(2)
    monday = F.date_add(week_start(F.make_date(year, F.lit(1), F.lit(4))), (week - 1) * 7)
    return F.when((year >= 1) & (week >= 1) & (week <= weeks_in_year(year)), monday)


def shifted_week(text: Column | str, weeks: int) -> Column:
    """The id of the week so many weeks later, null for an invalid one."""
    return week_id(F.date_add(parse_week(text), 7 * weeks))


def week_label(monday: Column) -> Column:
    """The days of a week, as short as they can be written: Jan 5–11, 2026."""
    sunday = F.date_add(monday, 6)
    same_year, same_month = F.year(monday) == F.year(sunday), F.month(monday) == F.month(sunday)
    start = F.when(same_year, F.date_format(monday, "MMM d")).otherwise(F.date_format(monday, "MMM d, yyyy"))
    end = F.when(same_year & same_month, F.date_format(sunday, "d, yyyy")).otherwise(F.date_format(sunday, "MMM d, yyyy"))
    return F.concat(start, F.lit("–"), end)


def reportable_week(text: Column, now: Column, first: str) -> Column:
    """Whether a week is valid, not before the first one, and over on the news day's calendar."""
    return F.coalesce(parse_week(text).isNotNull() & (text >= first) & (text < week_id(news_day(now))), F.lit(False))

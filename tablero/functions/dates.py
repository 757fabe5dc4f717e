"""Column helpers for dates, ages and the Lima clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/Lima"
MINOR_YEARS, SHORT_YEAR_DAYS = 18, 360


def last_day(end_exclusive: Column) -> Column:
    """Last day of a half-open date range."""
    return F.date_sub(end_exclusive, 1)


def in_days(day: Column, first: Column, end_exclusive: Column) -> Column:
    """Whether a day lies in a half-open date range."""
    return (day >= first) & (day < end_exclusive)


def to_utc(local: Column) -> Column:
    """Wall clock of Lima as wall clock of UTC (both without zone)."""
    return F.convert_timezone(F.lit(LOCAL_ZONE), F.lit("UTC"), local)


def from_utc(utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), utc)


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes on the wall clock with their fractions, whatever the zone of the session."""

    def micros(moment: Column) -> Column:
        day = F.unix_date(F.to_date(moment)).cast("long") * 86_400
        whole = day + F.hour(moment) * 3_600 + F.minute(moment) * 60
        return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), moment) * 1_000_000).cast("long")

    return (micros(end) - micros(start)) / F.lit(60_000_000.0).cast("double")


def age_parts(birth: Column, as_of: date) -> tuple[Column, Column, Column]:
    """Years, months and days of age. A day short is borrowed from the length of the month of the earlier date."""
    today = F.lit(as_of)
    sign = F.when(birth <= today, 1).otherwise(-1)
    early, late = F.least(birth, today), F.greatest(birth, today)
    short = F.dayofmonth(late) < F.dayofmonth(early)
    months = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early) - short.cast("int")
    days = F.dayofmonth(late) - F.dayofmonth(early) + F.when(short, F.dayofmonth(F.last_day(early))).otherwise(0)
    known = birth.isNotNull()  # least and greatest would pass over a null
    return F.when(known, sign * F.floor(months / 12)), F.when(known, sign * (months % 12)), F.when(known, sign * days)


def age_text(years: Column, months: Column, days: Column) -> Column:
    """Age in words. Parts of zero are left out; a single final day keeps its English form, as users have always seen it."""

    def part(value: Column, one: str, many: str) -> Column:
        return F.when(value != 0, F.concat_ws(" ", value.cast("string"), F.when(value == 1, one).otherwise(many)))

    words = F.concat_ws(" ", part(years, "Años", "Años"), part(months, "Mes", "Meses"), part(days, "day", "Días"))
    return F.when(years.isNotNull(), F.when(words == "", "00:00:00").otherwise(words))


def is_minor(birth: Column, as_of: date) -> Column:
    """Under age counted in years of 360 days."""
    return F.datediff(F.lit(as_of), birth) / SHORT_YEAR_DAYS < MINOR_YEARS

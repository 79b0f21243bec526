"""Time is text in the stores: 'yyyy-MM-dd HH:mm', compared as text."""

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

from broadsheet.functions.text import once

MINUTE = "yyyy-MM-dd HH:mm"

# Zone names of mail dates and their offsets, in summer and winter alike.
MAIL_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minute_text(run_at: datetime) -> str:
    return run_at.strftime("%Y-%m-%d %H:%M")


def cutoff_text(run_at: datetime, hours: float) -> str:
    return minute_text(run_at - timedelta(hours=hours))


def timestamp_of(run_at: datetime) -> Column:
    """The run's time as a timestamp of the session's zone (UTC by convention)."""
    return F.lit(run_at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def exclusion_stamp(run_at: datetime) -> str:
    return run_at.strftime("%Y-%m-%dT%H:%M")


_CLOCK = r"(?:.(\d{2})(?::?(\d{2})(?::?\d{2}(?:[.,]\d{1,9})?)?)?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)?)?"
ISO_SHAPES = (
    r"^(\d{4})-(\d{2})-(\d{2})" + _CLOCK + "$", r"^(\d{4})(\d{2})(\d{2})" + _CLOCK + "$", r"^(\d{4})(?:-(\d{2}))?()()()$",
)


# Week and day of the year, dashed or compact; the clock follows after anything but a digit.
_LATER_CLOCK = _CLOCK.replace("(?:.(", "(?:[^0-9](", 1)
WEEK_SHAPES = (r"^(\d{4})-W(\d{2})(?:-(\d))?" + _LATER_CLOCK + "$", r"^(\d{4})W(\d{2})(\d)?" + _LATER_CLOCK + "$")
ORDINAL_SHAPES = (r"^(\d{4})-(\d{3})()" + _LATER_CLOCK + "$", r"^(\d{4})(\d{3})()" + _LATER_CLOCK + "$")


def _number(c: Column, empty: int) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(empty))


def _week_day(year: Column, week: Column, day: Column) -> Column:
    """The date of an ISO week's day; a week 53 that the year lacks runs on into the next."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    date = F.date_add(fourth, (week - 1) * 7 + day - 1 - F.weekday(fourth))
    return F.when(week.between(1, 53) & day.between(1, 7), date)


def _year_day(year: Column, day: Column) -> Column:
    date = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)
    return F.when((day >= 1) & (F.year(date) == year), date)


def iso_minute(c) -> Column:
    """ISO 8601 text to minute text. The offset is dropped, not applied.

    Dashed and compact dates, years and dashed months, weeks with or without a
    day, and days of the year are read whole, with a clock time down to the
    hour or none; what is left over, or is no calendar date, makes the text null.
    """
    text = _col(c)
    minute = F.lit(None).cast("string")

    def parts(shape: str) -> list[Column]:
        return [F.regexp_extract(text, shape, i) for i in range(1, 6)]

    def clock(hour: Column, minutes: Column) -> Column:
        return F.concat(F.lit(" "), F.coalesce(F.nullif(hour, F.lit("")), F.lit("00")), F.lit(":"), F.coalesce(F.nullif(minutes, F.lit("")), F.lit("00")))

    for shapes, date in (
        (WEEK_SHAPES, lambda year, week, day: _week_day(_number(year, 1), _number(week, 0), _number(day, 1))),
        (ORDINAL_SHAPES, lambda year, day, _: _year_day(_number(year, 1), _number(day, 0))),
    ):
        for shape in shapes:
            part = parts(shape)
            minute = F.when(text.rlike(shape), F.concat(date(*part[:3]).cast("string"), clock(*part[3:]))).otherwise(minute)
    for shape in reversed(ISO_SHAPES):
        part = parts(shape)
        filled = [part[0], *[F.coalesce(F.nullif(p, F.lit("")), F.lit("01")) for p in part[1:3]]]
        spelled = F.concat(filled[0], F.lit("-"), filled[1], F.lit("-"), filled[2], clock(*part[3:]))
        minute = F.when(text.rlike(shape), spelled).otherwise(minute)
    return F.when(F.try_to_timestamp(minute, F.lit(MINUTE)).isNotNull(), minute)


MAIL_SHAPE = r"^(?:[A-Za-z]{3,9},? +)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}|\d{2}) (\d{1,2}:\d{2})(:\d{2})? ?(.*)$"


def _mail_instant(text: Column) -> Column:
    """Mail date: one canonical spelling, parsed once; null if it is none."""
    day, month, year, clock, seconds, zone = (
        F.regexp_extract(text, MAIL_SHAPE, i) for i in range(1, 7)
    )
    named = F.create_map(*[F.lit(x) for pair in MAIL_ZONES.items() for x in pair])
    offset = (
        F.when(zone == "", "+0000")
        .when(zone.rlike(r"^[+-]\d{2}:?\d{2}$"), F.replace(zone, F.lit(":")))
        .otherwise(F.try_element_at(named, F.upper(zone)))
    )
    full = F.concat(
        day, F.lit(" "), F.initcap(month), F.lit(" "),
        F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year),
        F.lit(" "), clock, F.when(seconds == "", ":00").otherwise(seconds), F.lit(" "), offset,
    )
    return F.try_to_timestamp(full, F.lit("d MMM yyyy H:mm:ss Z"))


def _iso_instant(text: Column) -> Column:
    full = (
        F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.try_to_timestamp(full))


def _feed_instant(c) -> Column:
    text = F.regexp_replace(F.trim(_col(c)), r"\s+", " ")
    return once(text, lambda t: F.coalesce(_mail_instant(t), _iso_instant(t)))


def feed_minute(published, updated, run_at: datetime) -> Column:
    """First readable of published and updated as UTC minute text, else the run's time."""
    instant = F.coalesce(_feed_instant(published), _feed_instant(updated))
    utc = F.to_utc_timestamp(instant, F.current_timezone())
    return F.coalesce(F.date_format(utc, MINUTE), F.lit(minute_text(run_at)))

"""Dates as people and mail programs write them.

A text is cut into what a date consists of: a day with its month and year, a time, a zone.  Each is read by one pattern, and
numbers go into a timestamp only if they may stand there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.patterns import let

# Names and offsets as in RFC 2822.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
WEEKDAYS = "MON TUE WED THU FRI SAT SUN".split()
ZONE_HOURS = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

_MONTH = f"(?:{'|'.join(MONTHS)})[A-Z]*\\.?"
#: Heads of dates, with the places of year, month and day in them.
_HEADS = (
    (rf"^({_MONTH}) ([0-9]{{1,2}}) ([0-9]{{4}}|[0-9]{{2}})(?![0-9:/])", 3, 1, 2),
    (rf"^([0-9]{{1,2}})[ -]({_MONTH})[ -]([0-9]{{4}}|[0-9]{{2}})(?![0-9:/])", 3, 2, 1),
    (r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?![0-9:/])", 1, 2, 3),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})(?![0-9:/])", 3, 1, 2),
)
_TAIL = (r"^(?: (?:AT )?([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,9}))?)? ?(AM|PM)?)? ?"
         r"(Z|UTC|GMT|UT|" + "|".join(ZONE_HOURS) + r")? ?([+-][0-9]{1,2}(?::?[0-9]{2})?)?\z")


def iso_date(raw: Column) -> Column:
    """An ISO date or time as UTC with milliseconds, null where it is none."""
    stamp = F.when(F.regexp_like(raw, F.lit(r"^[0-9]{4}-[0-9]{2}(?:-[0-9]{2}.*)?\z")), F.try_to_timestamp(raw))
    return F.date_format(stamp, FORMAT)


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("long"))


def written_date(raw: Column) -> Column:
    """A date in words or with slashes as UTC with milliseconds, null where it is none.

    Month first with slashes unless the year is; two-digit years from 50 on are of the last century.  Weekdays and remarks in
    parentheses say nothing.  Without a zone a time is UTC.  A day behind the end of a month runs into the next one.
    """
    text = F.upper(F.regexp_replace(raw, r"\([^()]*\)", " "))
    text = F.regexp_replace(text, rf"\b(?:{'|'.join(WEEKDAYS)})[A-Z]*\b\.?", " ")
    return let(F.trim(F.regexp_replace(text, r"[\s,]+", " ")), lambda t: let(_head(t), lambda h: let(_parts(h), _stamp)))


def _head(text: Column) -> Column:
    """Year, month and day as numbers, and what follows them; null for another form."""
    out = F.lit(None)
    for head, y, m, d in reversed(_HEADS):
        part = lambda i, head=head: F.regexp_extract(text, head, i)
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.left(part(m), F.lit(3)))
        found = F.struct(
            _number(part(y)).alias("year"), (named if "JAN" in head else _number(part(m))).cast("long").alias("month"), _number(part(d)).alias("day"),
            F.substring(text, F.length(part(0)) + 1, F.length(text)).alias("tail"))
        out = F.when(F.regexp_like(text, F.lit(head)), found).otherwise(out)
    return out


def _parts(head: Column) -> Column:
    """All numbers of a date, the time's in minutes and milliseconds and the zone's in minutes; null where the rest is no time."""
    year, tail = head["year"], head["tail"]

    def read(g: Column) -> Column:
        hour, half, digits = F.coalesce(_number(g[0]), F.lit(0)), g[4], F.regexp_replace(g[6], "[^0-9]", "")
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0)).otherwise(F.lit(99))
        zone = F.lit(0)
        for name, hours in ZONE_HOURS.items():
            zone = F.when(g[5] == name, F.lit(60 * hours)).otherwise(zone)
        hours, rest = F.substring(F.lpad(digits, 4, "0"), 1, 2), F.right(digits, F.lit(2))
        shift = F.when(F.length(digits) > 2, _number(hours) * 60 + _number(rest)).otherwise(F.coalesce(_number(digits), F.lit(0)) * 60)
        return F.struct(
            F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year).alias("year"), head["month"].alias("month"), head["day"].alias("day"),
            hour.alias("hour"), F.coalesce(_number(g[1]), F.lit(0)).alias("minute"), F.coalesce(_number(g[2]), F.lit(0)).alias("second"),
            F.rpad(F.left(g[3], F.lit(3)), 3, "0").cast("long").alias("millis"),
            (zone + F.when(F.startswith(g[6], F.lit("-")), -shift).otherwise(shift)).alias("zone"))

    groups = F.array(*(F.regexp_extract(tail, _TAIL, i) for i in range(1, 8)))
    return F.when(F.regexp_like(tail, F.lit(_TAIL)), let(groups, read))


def _stamp(p: Column) -> Column:
    good = (p["month"].between(1, 12) & p["day"].between(1, 31) & p["year"].between(100, 9999) & (p["hour"] < 24) & (p["minute"] < 60) & (p["second"] < 60)
            & p["zone"].between(-24 * 60, 24 * 60))
    first = F.unix_date(F.make_date(p["year"].cast("int"), p["month"].cast("int"), F.lit(1))).cast("long")
    minutes = (first + p["day"] - 1) * 1440 + p["hour"] * 60 + p["minute"] - p["zone"]
    return F.when(good, F.date_format(F.timestamp_millis((minutes * 60 + p["second"]) * 1000 + p["millis"]), FORMAT))


def date_of(raw: Column) -> Column:
    """An ISO date, or one in another form, as UTC with milliseconds; null for anything else."""
    return F.coalesce(iso_date(raw), written_date(raw))

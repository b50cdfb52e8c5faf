"""Dates (X16): RFC 2822 text to a timestamp and whole days since then."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Zone names of RFC 2822 and their offsets; other letters mean UTC.
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
         "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_rfc2822(c) -> Column:
    """``Thu, 21 Mar 2024 18:32:48 +0000`` → timestamp (null when it does not
    parse).  Day name and seconds are optional, comments in parentheses are
    dropped, days have one or two digits, years two to four (obsolete forms:
    00–49 are 2000–2049, 50–999 count from 1900), and the zone is an offset or
    a name."""
    text = F.trim(F.regexp_replace(F.regexp_replace(_col(c), r"\([^()]*\)", " "), r"\s+", " "))
    form = (r"(?i)^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) ?, ?)?([0-9]{1,2}) ([a-z]{3}) ([0-9]{2,4}) "
            r"([0-9]{1,2}) ?: ?([0-9]{2})(?: ?: ?([0-9]{2}))? ?([+-][0-9]{4}|[a-z]{1,5})$")
    part = [F.regexp_extract(text, form, i) for i in range(1, 8)]
    year = part[2].cast("int")
    year = (F.when(F.length(part[2]) == 4, year).when((F.length(part[2]) == 2) & (year < 50), year + 2000)
            .otherwise(year + 1900))
    zone = F.upper(part[6])
    names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = F.when(zone.rlike("^[+-]"), zone).otherwise(F.coalesce(F.try_element_at(names, zone), F.lit("+0000")))
    full = F.concat_ws(" ", part[0], F.initcap(part[1]), F.lpad(year.cast("string"), 4, "0"),
                       F.concat_ws(":", F.lpad(part[3], 2, "0"), part[4],
                                   F.when(part[5] == "", F.lit("00")).otherwise(part[5])), offset)
    return F.when(part[0] != "", F.try_to_timestamp(full, F.lit("d MMM yyyy HH:mm:ss xx")))


def _utc_instant(text: str) -> Column:
    """A time written without an offset is taken as UTC."""
    t = text.strip()
    has_zone = t.endswith("Z") or (len(t) > 6 and t[-6] in "+-" and t[-3] == ":")
    return F.lit(t if has_zone else t + "Z").cast("timestamp")


def days_since(c, now) -> Column:
    """Whole 24-hour days from the date to ``now`` (truncated toward zero),
    0 when there is no date, null when the date does not parse.  A textual
    ``now`` without an offset is UTC."""
    now_col = _utc_instant(now) if isinstance(now, str) else now
    ts = parse_rfc2822(c)
    secs = F.unix_timestamp(now_col) - F.unix_timestamp(ts)
    days = (F.when(secs >= 0, F.floor(secs / 86400)).otherwise(F.ceil(secs / 86400))).cast("long")
    return F.when(_col(c).isNull(), F.lit(0).cast("long")).otherwise(days)

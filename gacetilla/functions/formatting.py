"""Text formats of reports and files (X14, X15, X17, X19, number text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Anchor slug pattern and formats.
ANCHOR_RUN = "[^a-z0-9]+"
ANCHOR_PREFIX = "#"
RFC2822_FORMAT = "EEE, dd MMM yyyy HH:mm:ss"
RUN_STAMP_FORMAT = "yyyy-MM-dd-HH-mm-ss"


def anchor(title) -> Column:
    """``#`` + lower-cased title, runs of non ``[a-z0-9]`` as ``-``,
    leading and trailing ``-`` trimmed."""
    slug = F.regexp_replace(F.lower(_col(title)), ANCHOR_RUN, "-")
    return F.concat(F.lit(ANCHOR_PREFIX), F.regexp_replace(slug, "^-+|-+$", ""))


def truncate_chars(c, n: int = 50) -> Column:
    """The first n characters."""
    return F.substring(_col(c), 1, n)


def number_text(c) -> Column:
    """Shortest text of a double without an exponent, whole numbers without a
    fraction (``30`` not ``30.0``, ``0.0005`` not ``5.0E-4``), as the reports
    print them."""
    parts = F.split(_col(c).cast("double").cast("string"), "E")
    mantissa, exponent = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).cast("int")
    sign = F.when(mantissa.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(mantissa, "[-.]", "")  # one digit stands before the point
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    padded = F.rpad(digits, F.greatest(exponent + 1, F.length(digits)), "0")
    large = F.concat(F.substring(padded, F.lit(1), exponent + 1), F.lit("."),
                     F.substring(padded, exponent + 2, F.length(padded)))
    plain = F.when(exponent.isNull(), mantissa).otherwise(
        F.concat(sign, F.when(exponent < 0, small).otherwise(large)))
    return F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def text_or_empty(c) -> Column:
    """A missing text is written as ''."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def _utc_wall_clock(ts) -> Column:
    # the instant's UTC wall-clock, whatever the session time zone
    return F.to_utc_timestamp(_col(ts), F.current_timezone())


def run_stamp(ts) -> Column:
    """Folder stamp ``yyyy-MM-dd-HH-mm-ss`` of a run time (UTC)."""
    return F.date_format(_utc_wall_clock(ts), RUN_STAMP_FORMAT)


def rfc2822(ts) -> Column:
    """RFC 2822 text of a time, in UTC (``Sun, 01 Jan 2017 12:00:00 +0000``)."""
    return F.concat(F.date_format(_utc_wall_clock(ts), RFC2822_FORMAT), F.lit(" +0000"))

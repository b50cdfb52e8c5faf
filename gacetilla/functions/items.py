"""Scalar expressions over item fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_pub_date(c) -> Column:
    """The time-zone name GMT is written as the offset +0000."""
    return F.replace(_col(c), F.lit("GMT"), F.lit("+0000"))


def join_categories(c) -> Column:
    """Lower-cased, comma-joined; null when the item has no category."""
    arr = _col(c)
    return F.when(F.size(arr) > 0, F.lower(F.array_join(arr, ",")))


def join_keywords(c) -> Column:
    """Lower-cased, comma-joined keywords; null when absent, and null as a
    whole when any keyword element carries no value."""
    arr = _col(c)
    complete = (F.size(F.array_compact(arr)) == F.size(arr)) & ~F.array_contains(arr, "")
    return F.when((F.size(arr) > 0) & complete, F.lower(F.array_join(arr, ",")))


def join_creators(c) -> Column:
    """Comma-joined creators as written, '' when there is none."""
    return F.coalesce(F.array_join(_col(c), ","), F.lit(""))


# Outlet markers, tested in this order on the upper-cased
# channel title; the first one contained wins.
CHANNEL_MARKERS = [
    ("EL PAÍS", "ElPais"),
    ("20MINUTOS", "VeinteMinutos"),
    ("ELDIARIO.ES", "ElDiario"),
    ("ELMUNDO", "ElMundo"),
]
OTHER_CHANNEL = "Other"


def channel_type(c) -> Column:
    """Outlet of a channel title."""
    up = F.upper(_col(c))
    expr = F.lit(OTHER_CHANNEL)
    for marker, name in reversed(CHANNEL_MARKERS):
        expr = F.when(up.contains(marker), F.lit(name)).otherwise(expr)
    return expr


# The error kinds; two of them carry a message.
ERROR_KINDS = ["EmptyString", "ParsingError", "NoContent", "NetworkError", "UnknownError"]
KINDS_WITH_MESSAGE = ["ParsingError", "NetworkError"]


def make_error(kind, message=None) -> Column:
    """An error value: STRUCT<kind STRING, message STRING>."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    m = F.lit(message).cast("string") if message is None or isinstance(message, str) else message
    return F.struct(k.alias("kind"), m.alias("message"))


def error_text(err) -> Column:
    """X12 long form: ``Kind(message)`` for kinds with a message, else ``Kind``."""
    e = _col(err)
    return F.when(e.isNull(), F.lit(None).cast("string")).when(
        e.getField("kind").isin(KINDS_WITH_MESSAGE),
        F.concat(e.getField("kind"), F.lit("("), F.coalesce(e.getField("message"), F.lit("")), F.lit(")")),
    ).otherwise(e.getField("kind"))


# Fixed value: stored form of an error that carries a message.
_ERROR_PATTERN = r"(?s)^(ParsingError|NetworkError)\((.*)\)$"


def parse_error(c) -> Column:
    """Decode a stored error text.

    ``None`` text or SQL null → no error; ``EmptyString`` / ``NoContent`` →
    that kind; ``ParsingError(msg)`` / ``NetworkError(msg)`` → kind and
    message; a bare kind name with a message kind → that kind, no message;
    anything else → ``UnknownError``.
    """
    t = _col(c)
    with_msg = F.regexp_extract(t, _ERROR_PATTERN, 1)
    msg = F.regexp_extract(t, _ERROR_PATTERN, 2)
    return (F.when(t.isNull() | (t == "None"), F.lit(None))
             .when(t.isin("EmptyString", "NoContent", "ParsingError", "NetworkError", "UnknownError"),
                   make_error(t, None))
             .when(with_msg != "", make_error(with_msg, msg))
             .otherwise(make_error("UnknownError", None)))


# Characters that a debug-printed string shows by number: controls, format
# characters, unassigned ones and separators other than the space; a combining
# mark only where nothing stands before it.
_SHOWN_BY_NUMBER = r"[\p{C}\p{Z}&&[^ ]]"
_COMBINING = r"^[\p{Mn}\p{Me}]"


def debug_escape(c) -> Column:
    """Escape text as a debug-printed string literal: backslash, double quote,
    the null, newline, carriage return and tab by name, other characters that
    don't print as ``\\u{hex}``."""
    t = _col(c)
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        t = F.replace(t, F.lit(raw), F.lit(escaped))

    def shown(x: Column) -> Column:
        return F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(x))), F.lit("}"))

    by_char = F.array_join(F.transform(
        F.regexp_extract_all(t, F.lit("(?s)."), 0),
        lambda x, i: F.when(x.rlike(_SHOWN_BY_NUMBER) | ((i == 0) & x.rlike(_COMBINING)), shown(x)).otherwise(x)), "")
    return F.when(t.rlike(_SHOWN_BY_NUMBER) | t.rlike(_COMBINING), by_char).otherwise(t)


def option_debug(c) -> Column:
    """``None`` or ``Some("text")`` with the text escaped."""
    t = _col(c)
    return F.when(t.isNull(), F.lit("None")).otherwise(F.concat(F.lit('Some("'), debug_escape(t), F.lit('")')))


def error_debug(err) -> Column:
    """X18 for errors: ``None``, ``Some(NoContent)``, ``Some(ParsingError("msg"))``."""
    e = _col(err)
    esc = debug_escape(F.coalesce(e.getField("message"), F.lit("")))
    return (F.when(e.isNull(), F.lit("None"))
             .when(e.getField("kind").isin(KINDS_WITH_MESSAGE),
                   F.concat(F.lit("Some("), e.getField("kind"), F.lit('("'), esc, F.lit('"))')))
             .otherwise(F.concat(F.lit("Some("), e.getField("kind"), F.lit(")"))))

"""Time stamps and the labels built from them.

All values are TIMESTAMP_NTZ. Labels are cut from the text form of the value, so
that no session time zone can shift a wall-clock time.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in labels.
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

_MONTH_FIRST = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d*)?)\s*$"


def parse_time(text: Column) -> Column:
    """``MM/dd/yyyy HH:mm:ss.SSS`` or ISO text as TIMESTAMP_NTZ; other text as null.

    Full-width dates, as logs have them, are rearranged without a regex.
    """

    def part(start: int, length: int) -> Column:
        return F.substring(text, start, length)

    rest = F.substring(text, F.lit(11), F.length(text))

    full_width = (part(3, 1) == "/") & (part(6, 1) == "/")
    iso = (
        F.when(full_width, F.concat(part(7, 4), F.lit("-"), part(1, 2), F.lit("-"), part(4, 2), rest))
        .when(F.contains(text, F.lit("/")), F.regexp_replace(text, _MONTH_FIRST, "$3-$1-$2 $4"))
        .when(F.contains(text, F.lit("-")), text)
    )
    return iso.try_cast("timestamp_ntz")


def day_label(ts: Column) -> Column:
    """``05-Feb``"""
    months = F.array(*[F.lit(m) for m in _MONTHS])
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, "0")
    return F.concat(day, F.lit("-"), F.get(months, F.month(ts) - 1))


def clock_label(ts: Column) -> Column:
    """``10:31``"""
    return F.substring(ts.cast("string"), 12, 5)


def duration_label(start: Column, end: Column) -> Column:
    return F.concat(F.lit("("), clock_label(start), F.lit(" - "), clock_label(end), F.lit(")"))


def column_label(day: Column, server: Column, stat: Column, start: Column, end: Column) -> Column:
    """Report column: day of the cut, server, statistic and time range, one per line.

    A missing server leaves its line blank.
    """
    return F.concat_ws(
        "\n", day_label(day), F.coalesce(server, F.lit("")), stat, duration_label(start, end)
    )

"""Cells of a log line and the time column of a header."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_CELL = r',("[^"]*(?:""[^"]*)*"|[^,]*)'
_BETWEEN = '","'


def raw_cells(line: Column) -> Column:
    """Cells of any comma-separated line as spelled, with their quotes."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))


def unquote(cell: Column) -> Column:
    inner = F.substring(cell, F.lit(2), F.length(cell) - 2)
    return F.when(
        F.startswith(cell, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))
    ).otherwise(cell)


def csv_cells(line: Column) -> Column:
    """Cells of any comma-separated line without their quotes."""
    return F.transform(raw_cells(line), unquote)


def quoted_cells(line: Column) -> Column:
    """Cells of a line that is quoted throughout, by one split; null for other lines.

    Without doubled quotes every '","' lies between two cells, so the split is
    exact when it finds as many cells as the header has.
    """
    plain = (
        F.startswith(line, F.lit('"'))
        & F.endswith(line, F.lit('"'))
        & ~F.contains(line, F.lit('""'))
    )
    return F.when(plain, F.split(F.substring(line, F.lit(2), F.length(line) - 2), _BETWEEN))


def is_time_header(name: Column) -> Column:
    """Header of the time column as counter exports write it, for any zone."""
    return (
        F.startswith(name, F.lit("(PDH-CSV 4.0) ("))
        & F.contains(name, F.lit("Time)("))
        & F.endswith(name, F.lit(")"))
    )


def time_position(cells: Column) -> Column:
    """0-based position of the first time header, else 0; null without any column."""
    marked = F.array_position(F.transform(cells, is_time_header), True)
    return F.when(F.size(cells) > 0, F.greatest(marked, F.lit(1)) - 1).cast("int")

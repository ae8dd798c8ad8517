"""Parts of a counter path ``\\\\SERVER\\Object(instance)\\Counter`` and of a file path."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = "\\\\"
_SLASH = "\\"


def _pair_at(path: Column) -> Column:
    return F.instr(path, _PAIR)


def _server_end(path: Column) -> Column:
    pair = _pair_at(path)
    start = F.when(pair > 0, pair + 2).otherwise(2)
    return F.position(F.lit(_SLASH), path, start)


def path_server(path: Column) -> Column:
    """Text between the first double backslash and the next one; null if there is none."""
    pair, end = _pair_at(path), _server_end(path)
    name = F.substring(path, pair + 2, end - pair - 2)
    return F.when((pair > 0) & (end > 0), F.nullif(name, F.lit("")))


def path_metric(path: Column) -> Column:
    """Counter path without the server; unchanged when there is nothing to strip."""
    end = _server_end(path)
    return F.when(end > 0, F.substring(path, end + 1, F.length(path))).otherwise(path)


def file_name(path: Column) -> Column:
    """Last part of a file path, with either kind of slash."""
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def contains_any(path: Column, patterns: list[str]) -> Column:
    """True when a literal, case-sensitive pattern occurs in ``path``."""
    hit = F.lit(False)
    for pattern in dict.fromkeys(patterns):
        hit = hit | F.contains(path, F.lit(pattern))
    return hit

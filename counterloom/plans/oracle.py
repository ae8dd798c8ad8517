"""The queries of the catalogue in SQL, for DuckDB on the same tables."""

_SAMPLES = r"""samples AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id, ts,
    CAST((user_id % 3) * 5 + list_position(['click', 'purchase', 'view', 'signup', 'error'], event_type) AS INTEGER) AS pos,
    '\\SRV' || (user_id % 3) || '\App(' || event_type || ')\' || CASE event_type
      WHEN 'click' THEN 'Request Execution Time' WHEN 'purchase' THEN 'Bytes Total/sec'
      WHEN 'view' THEN 'Requests/Sec' WHEN 'signup' THEN 'Current Queue Length'
      WHEN 'error' THEN '# of Exceps Thrown' END AS counter_path,
    round(value * 100) AS value, user_id, floor(value / 10) AS tens
  FROM events)"""

_COUNTERS = """counters AS (SELECT DISTINCT run_id, pos, counter_path FROM samples)"""

_PATTERNS = """patterns(pattern_no, pattern) AS (
  VALUES (0, 'Request'), (1, 'Bytes Total/sec'), (2, 'App(view)'), (3, 'Queue Length'), (4, 'No Such Counter'))"""

_MATCHES = """matches AS (
  SELECT c.*, pattern_no, pattern FROM counters c JOIN patterns ON contains(counter_path, pattern))"""

_SERVER = r"""nullif(regexp_extract({0}, '\\\\([^\\]*)\\', 1), '')"""
_METRIC = (
    r"""CASE WHEN contains({0}, '\\') THEN regexp_replace({0}, '^.*?\\\\[^\\]*\\', '')"""
    r""" ELSE regexp_replace({0}, '^.[^\\]*\\', '') END"""
)

_BASELINES = """baselines AS (
  SELECT run_id, min(pos) AS pos, arg_min(counter_path, pos) AS baseline_path
  FROM counters WHERE contains(counter_path, 'Request Execution Time') GROUP BY run_id)"""

_SERIES = """series AS (
  SELECT run_id, time_bucket(INTERVAL '5 minutes', ts) AS bin, avg(value) AS v
  FROM samples JOIN baselines USING (run_id, pos) GROUP BY ALL)"""

_BOUNDS = """bounds AS (
  SELECT run_id, min(ts) AS start_ts, max(ts) AS end_ts FROM samples GROUP BY run_id)"""

_CHANGES = """observed AS (
  SELECT *, lag(bin) OVER w AS prev_bin, lag(v) OVER w AS prev_v FROM series
  WHERE v IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY bin)),
later AS (
  SELECT *, lead(v) OVER (PARTITION BY run_id ORDER BY bin) AS next_v FROM observed WHERE v <> 0),
changes AS (SELECT *, abs((v - next_v) / next_v) * 100 AS diff_pct FROM later)"""

_CUTS = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY diff_pct DESC NULLS LAST, bin) AS place
  FROM changes),
cuts AS (
  SELECT run_id, bin + INTERVAL '{0} minutes' AS fall_ts, start_ts, end_ts,
    CASE WHEN prev_bin = bin - INTERVAL '{0} minutes' THEN prev_v END AS prev_value,
    v AS value, diff_pct,
    CASE WHEN diff_pct IS NULL THEN 'no_change'
      WHEN bin - INTERVAL '{0} minutes' < time_bucket(INTERVAL '{0} minutes', start_ts)
        OR (prev_bin = bin - INTERVAL '{0} minutes' AND prev_v = 0) THEN 'no_previous_bin'
      ELSE 'ok' END AS status
  FROM ranked JOIN bounds USING (run_id) WHERE place = 1)"""

_CUT = "SELECT run_id, fall_ts, start_ts, prev_value, value, diff_pct, status FROM cuts"


def _label(server: str, stat: str, start: str, end: str, day: str) -> str:
    return (
        f"strftime({day}, '%d-%b') || chr(10) || {server} || chr(10) || {stat} || chr(10)"
        f" || '(' || strftime({start}, '%H:%M') || ' - ' || strftime({end}, '%H:%M') || ')'"
    )


def _exact_mean(value: str) -> str:
    """Mean from a sum over whole units of 2^-62; the text of a sum becomes the nearest double."""
    units = f"CAST(sum(CAST(trunc({value} * 4611686018427387904) AS HUGEINT)) AS VARCHAR)"
    return f"CAST({units} AS DOUBLE) / 4611686018427387904 / count({value})"


def _statistics(keep: str) -> str:
    """Labelled statistics of the samples before or after each cut."""
    inside, start, end = ("<=", "start_ts", "fall_ts") if keep == "head" else (">=", "fall_ts", "end_ts")
    return f"""per_counter AS (
  SELECT run_id, pos, counter_path, fall_ts, start_ts, end_ts, avg(s.value) AS avg, max(s.value) AS max
  FROM samples s JOIN cuts c USING (run_id)
  WHERE status = 'ok' AND ts {inside} fall_ts AND (
    contains(counter_path, 'Request') OR contains(counter_path, 'Bytes Total/sec')
    OR contains(counter_path, 'App(view)') OR contains(counter_path, 'Queue Length'))
  GROUP BY ALL),
named AS (
  SELECT *, {_SERVER.format("counter_path")} AS server, {_METRIC.format("counter_path")} AS metric FROM per_counter),
widened AS (
  SELECT run_id, pos, server, metric, fall_ts, start_ts, end_ts, avg, max FROM named
  UNION ALL
  SELECT run_id, pos, server, replace(metric, 'Bytes', 'Mbps'), fall_ts, start_ts, end_ts,
    avg * 8 / 1000000, max * 8 / 1000000 FROM named WHERE contains(lower(metric), 'bytes total/sec')),
statistics AS (
  SELECT run_id, pos, metric, {_label("server", "'Avg.'", start, end, "fall_ts")} AS label, avg AS value FROM widened
  UNION ALL
  SELECT run_id, pos, metric, {_label("server", "'Max.'", start, end, "fall_ts")}, max FROM widened),
firsts AS (
  SELECT metric, label, arg_min(value, (run_id, pos)) AS value FROM statistics
  WHERE value IS NOT NULL GROUP BY metric, label),
cells AS (SELECT metric, label, round_even(value, 0) + 0.0 AS value FROM firsts)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_FIND = (_SAMPLES, _COUNTERS, _BASELINES, _SERIES, _BOUNDS, _CHANGES, _CUTS.format(5))
_HEAD = (*_FIND, _statistics("head"))
_TAIL = (*_FIND, _statistics("tail"))

_LINES = """readings AS (
  SELECT l_returnflag || '-' || l_linestatus || '-' || l_linenumber AS run_id, l_shipdate AS ts,
    l_orderkey, l_linenumber, nullif(round(l_discount * 100), 0) AS discount, round(l_tax * 100) AS tax
  FROM lineitem)"""

_TAXES = """samples AS (SELECT run_id, ts, tax AS value FROM readings)"""

_WIDE = """wide AS (
  SELECT strftime(l_shipdate, '%Y') AS run_id, l_shipdate AS ts, l_orderkey, l_linenumber,
    round(l_quantity * 100) AS "Quantity", round(l_extendedprice * 100) AS "Extended Price",
    round(l_discount * 100) AS "Discount", round(l_tax * 100) AS "Tax"
  FROM lineitem)"""

_RUNS = r"""user_samples AS (SELECT user_id || '/' || run_id AS run_id, ts, pos, counter_path, tens AS value FROM samples),
listed AS (
  SELECT run_id, max(time_column) AS time_column FROM (
    SELECT run_id, 'Time' AS time_column FROM user_samples
    UNION ALL
    SELECT o_custkey || '/' || strftime(o_orderdate, '%Y-%m-%d'),
      CASE WHEN o_orderstatus <> 'P' THEN 'Time' END FROM orders) GROUP BY run_id)"""

_STATUS = f"""counters AS (SELECT DISTINCT run_id, pos, counter_path FROM user_samples),
{_BASELINES},
{_SERIES.replace("FROM samples", "FROM user_samples")},
{_BOUNDS.replace("FROM samples", "FROM user_samples")},
{_CHANGES},
{_CUTS.format(5)},
statuses AS (
  SELECT run_id, time_column, coalesce(rows, 0) AS rows, baseline_path, fall_ts,
    CASE WHEN time_column IS NULL THEN 'no_time_column' WHEN coalesce(rows, 0) = 0 THEN 'empty'
      WHEN baseline_path IS NULL THEN 'no_baseline' WHEN c.status IS NULL THEN 'no_nonzero'
      ELSE c.status END AS status
  FROM listed
  LEFT JOIN (SELECT run_id, count(*) AS rows FROM user_samples GROUP BY run_id) USING (run_id)
  LEFT JOIN baselines USING (run_id) LEFT JOIN cuts c USING (run_id))"""

_PATHS = f"""paths AS (
  SELECT path, count(*) AS n FROM (
    SELECT CASE pos % 5 WHEN 0 THEN {_METRIC.format("counter_path")} WHEN 1 THEN counter_path || '\\' || run_id
      WHEN 2 THEN run_id ELSE counter_path END AS path FROM samples) GROUP BY path)"""

_FILES = r"""SELECT 'SRV1' AS server, 'Lines(a, b)\' || counter AS metric, count(value) AS readings,
  sum(value) AS total, max(value) AS top, min(ts) FILTER (value IS NOT NULL) AS start_ts
FROM (
  SELECT l_shipdate AS ts, 'Quantity' AS counter, nullif(round(l_quantity * 100), 0) AS value FROM lineitem
  UNION ALL SELECT l_shipdate, 'Extended Price', nullif(round(l_extendedprice * 100), 0) FROM lineitem
  UNION ALL SELECT l_shipdate, 'Discount', nullif(round(l_discount * 100), 0) FROM lineitem)
GROUP BY counter"""

_PLACE = "replace(array_to_string(string_split(label, chr(10))[1:3], ' '), '.', '')"


def _renamed_tail() -> str:
    """The tail statistics beside those of the head."""
    text = _statistics("tail")
    for name in ("per_counter", "named", "widened", "statistics", "firsts", "cells"):
        text = text.replace(f"{name} AS (", f"tail_{name} AS (").replace(f"FROM {name}", f"FROM tail_{name}")
    return text


_REPORT = (
    _with(*_HEAD)
    + f"""SELECT metric, metric = 'App(click)\\Request Execution Time' AS is_baseline, """
    + ", ".join(
        f"""max(value) FILTER (place = '{day:02d}-Jan SRV{server} {stat}') AS "{day:02d}-Jan SRV{server} {stat}\""""
        for day in range(1, 31)
        for server in range(3)
        for stat in ("Avg", "Max")
    )
    + f" FROM (SELECT metric, value, {_PLACE} AS place FROM cells) GROUP BY metric"
)

ORACLE = {
    "select_by_substring": _with(_SAMPLES, _COUNTERS)
    + "SELECT * FROM counters WHERE contains(counter_path, 'Bytes Total/sec')",
    "match_patterns": _with(_SAMPLES, _COUNTERS, _PATTERNS, _MATCHES) + "SELECT * FROM matches",
    "match_counts": _with(_SAMPLES, _COUNTERS, _PATTERNS, _MATCHES)
    + "SELECT run_id, count(*) AS matches FROM matches GROUP BY run_id",
    "dedupe_counters": _with(_SAMPLES, _COUNTERS, _PATTERNS, _MATCHES)
    + """SELECT run_id, counter_path, min(pattern_no) AS pattern_no, min(pos) AS pos,
  row_number() OVER (PARTITION BY run_id ORDER BY min(pattern_no), min(pos)) AS position
FROM matches GROUP BY run_id, counter_path""",
    "baseline_first_match": _with(_SAMPLES, _COUNTERS, _BASELINES) + "SELECT * FROM baselines",
    "extract_counters": _with(_SAMPLES, _PATTERNS)
    + """SELECT run_id, ts, pos, counter_path, value FROM samples
WHERE EXISTS (SELECT 1 FROM patterns WHERE contains(counter_path, pattern))""",
    "detect_time_column": _with(_SAMPLES, _COUNTERS, _PATTERNS)
    + """, named AS (
  SELECT run_id, 1 + row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS place, counter_path AS name FROM counters
  UNION ALL
  SELECT DISTINCT run_id, 0, CASE dayofweek(CAST(run_id AS DATE)) WHEN 0 THEN 'Sample'
    WHEN 6 THEN '(PDH-CSV 4.0) (Zulu)(0)' ELSE '(PDH-CSV 4.0) (GMT Standard Time)(0)' END FROM counters
  UNION ALL
  SELECT run_id, count(*) + 1, CASE dayofweek(CAST(run_id AS DATE)) WHEN 0
    THEN '(PDH-CSV 4.0) (Pacific Daylight Time)(420)' ELSE 'Note' END FROM counters GROUP BY run_id),
flagged AS (
  SELECT *, starts_with(name, '(PDH-CSV 4.0) (') AND contains(name, 'Time)(') AND ends_with(name, ')') AS marked
  FROM named),
timed AS (
  SELECT run_id, count(*) AS columns,
    coalesce(min(place) FILTER (marked), 0) AS time_pos,
    coalesce(arg_min(name, place) FILTER (marked), arg_min(name, place)) AS time_column,
    bool_or(marked) AS marked
  FROM flagged GROUP BY run_id)
SELECT run_id, columns, time_pos, time_column, marked,
  (SELECT count(*) FROM named n WHERE n.run_id = timed.run_id AND n.place <> timed.time_pos
    AND EXISTS (SELECT 1 FROM patterns WHERE contains(n.name, pattern))) AS wanted
FROM timed""",
    "coerce_numeric": r"""WITH words AS (
  SELECT doc_id, trim(unnest(string_split_regex(text, '[ \t\r\n]+')), chr(32) || chr(9) || chr(13) || chr(10)) AS word
  FROM documents),
numbers AS (
  SELECT doc_id, CASE WHEN regexp_full_match(word, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
    THEN try_cast(word AS DOUBLE) END AS number
  FROM words)
SELECT doc_id, count(*) AS words, count(number) FILTER (isfinite(number)) AS numbers,
  min(number) FILTER (isfinite(number)) AS smallest, max(number) FILTER (isfinite(number)) AS largest
FROM numbers GROUP BY doc_id""",
    "parse_timestamps": """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN ts
  ELSE date_trunc('second', ts) + to_microseconds(CAST(floor((epoch_us(ts) % 1000000) / 1000) * 1000 AS BIGINT)) END AS parsed
FROM events""",
    "path_server": _with(_SAMPLES, _PATHS) + f"SELECT *, {_SERVER.format('path')} AS server FROM paths",
    "path_metric": _with(_SAMPLES, _PATHS) + f"SELECT *, {_METRIC.format('path')} AS metric FROM paths",
    "run_name": r"""SELECT path, count(*) AS n, any_value(name) AS name FROM (
  SELECT name, CASE WHEN user_id % 2 = 0 THEN 'file:/logs/SRV' || user_id % 3 || '/' || name
    ELSE 'C:\logs\SRV' || user_id % 3 || '\' || name END AS path
  FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') || '_' || event_type || '.csv' AS name FROM events))
GROUP BY path""",
    "report_label": f"""WITH spans AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type, min(ts) AS start_ts, max(ts) AS end_ts
  FROM events GROUP BY ALL)
SELECT run_id, event_type, strftime(end_ts, '%d-%b') AS day, strftime(start_ts, '%H:%M') AS clock,
  '(' || strftime(start_ts, '%H:%M') || ' - ' || strftime(end_ts, '%H:%M') || ')' AS duration,
  {_label("event_type", "'Avg.'", "start_ts", "end_ts", "end_ts")} AS label
FROM spans""",
    "round_report": """SELECT price, signed, count(*) AS n, round_even(price, 0) + 0.0 AS rounded_price,
  round_even(signed, 0) + 0.0 AS rounded_signed
FROM (SELECT round(l_extendedprice * 2) / 2 AS price, l_quantity / 2 - 10 AS signed FROM lineitem)
GROUP BY price, signed""",
    "unpivot_wide": _with(_WIDE)
    + """SELECT * FROM (UNPIVOT wide ON "Quantity", "Extended Price", "Discount", "Tax" INTO NAME counter VALUE value)""",
    "union_runs": """SELECT 'orders' AS run_id, o_orderdate AS ts, o_orderkey AS orderkey, o_totalprice AS "Total Price"
FROM orders
UNION ALL BY NAME
SELECT 'lineitem' AS run_id, l_shipdate AS ts, l_orderkey AS orderkey, l_quantity AS "Quantity", l_tax AS "Tax"
FROM lineitem""",
    "drop_all_null_rows": _with(_LINES)
    + """SELECT run_id, ts, l_orderkey, l_linenumber, discount, nullif(tax, 0) AS tax
FROM readings WHERE discount IS NOT NULL OR tax <> 0""",
    "resample_mean_5m": _with(_SAMPLES)
    + """SELECT run_id, pos, counter_path, time_bucket(INTERVAL '5 minutes', ts) AS bin, avg(value) AS v
FROM samples GROUP BY ALL""",
    "nonzero_bins": _with(_LINES)
    + """SELECT run_id, time_bucket(INTERVAL '5 minutes', ts) AS bin, avg(tax) AS v
FROM readings GROUP BY ALL HAVING avg(tax) <> 0""",
    "nonzero_min": _with(_LINES)
    + "SELECT run_id, ts, min(tax) FILTER (tax <> 0) AS min_nonzero FROM readings GROUP BY run_id, ts",
    "run_bounds": _with(_SAMPLES, _BOUNDS) + "SELECT * FROM bounds",
    "pct_change": _with(*_FIND)
    + "SELECT run_id, bin, v, diff_pct FROM changes WHERE diff_pct IS NOT NULL",
    "find_cut": _with(*_FIND) + _CUT,
    "find_cut_gaps_and_zeros": _with(
        _LINES,
        _TAXES,
        "series AS (SELECT run_id, time_bucket(INTERVAL '1440 minutes', ts) AS bin, avg(value) AS v"
        " FROM samples GROUP BY ALL)",
        _BOUNDS,
        _CHANGES,
        _CUTS.format(1440),
    )
    + _CUT,
    "filter_to_cut": _with(*_FIND)
    + """SELECT s.run_id, ts, pos, counter_path, s.value FROM samples s JOIN cuts USING (run_id)
WHERE status = 'ok' AND ts <= fall_ts""",
    "filter_after_cut": _with(*_FIND)
    + """SELECT s.run_id, ts, pos, counter_path, s.value FROM samples s JOIN cuts USING (run_id)
WHERE status = 'ok' AND ts >= fall_ts""",
    "counter_stats": _with(_SAMPLES)
    + "SELECT run_id, pos, counter_path, avg(value) AS avg, max(value) AS max FROM samples GROUP BY ALL",
    "exact_means": _with(
        _SAMPLES.replace("round(value * 100) AS value", "value / 7 - sqrt(value) AS value")
    )
    + f"""SELECT run_id, pos, {_exact_mean("value")} AS avg, max(value) AS max FROM samples GROUP BY run_id, pos
UNION ALL
SELECT run_id, NULL, {_exact_mean("value")}, max(value) FROM samples GROUP BY run_id
UNION ALL
SELECT run_id, -1, {_exact_mean("v")}, max(v) FROM (
  SELECT run_id, {_exact_mean("value")} AS v FROM samples
  GROUP BY run_id, time_bucket(INTERVAL '5 minutes', ts)) GROUP BY run_id""",
    "counter_stats_nonnull": _with(_LINES)
    + """SELECT run_id, ts, avg(discount) AS avg, max(discount) AS max
FROM readings WHERE discount IS NOT NULL GROUP BY run_id, ts""",
    "pooled_stats": _with(_SAMPLES, _PATTERNS)
    + """, matched AS (SELECT run_id, pattern, counter_path, value FROM samples JOIN patterns ON contains(counter_path, pattern)),
pools AS (SELECT run_id, pattern, avg(value) AS avg, max(value) AS max FROM matched GROUP BY run_id, pattern)
SELECT DISTINCT run_id, pattern, counter_path, avg, max FROM matched JOIN pools USING (run_id, pattern)""",
    "mbps_rows": _with(_SAMPLES)
    + f""", found AS (
  SELECT run_id, pos, counter_path, avg(value) AS avg, max(value) AS max,
    {_SERVER.format("counter_path")} AS server, {_METRIC.format("counter_path")} AS metric
  FROM samples GROUP BY run_id, pos, counter_path)
SELECT * FROM found
UNION ALL
SELECT run_id, pos, counter_path, avg * 8 / 1000000, max * 8 / 1000000, server, replace(metric, 'Bytes', 'Mbps')
FROM found WHERE contains(lower(metric), 'bytes total/sec')""",
    "pattern_statistics": _with(_SAMPLES)
    + f""", matched AS (
  SELECT *, min(ts) OVER (PARTITION BY run_id) AS start_ts, max(ts) OVER (PARTITION BY run_id) AS end_ts
  FROM samples WHERE contains(counter_path, 'Bytes Total/sec')),
found AS (
  SELECT run_id, pos, start_ts, end_ts, avg(value) AS avg, max(value) AS max,
    {_SERVER.format("counter_path")} AS server, {_METRIC.format("counter_path")} AS metric
  FROM matched GROUP BY run_id, pos, counter_path, start_ts, end_ts),
widened AS (
  SELECT * FROM found
  UNION ALL
  SELECT run_id, pos, start_ts, end_ts, avg * 8 / 1000000, max * 8 / 1000000, server,
    replace(metric, 'Bytes', 'Mbps') FROM found)
SELECT run_id, pos, server, metric, 'Avg.' AS stat,
  {_label("server", "'Avg.'", "start_ts", "end_ts", "end_ts")} AS label, avg AS value FROM widened
UNION ALL
SELECT run_id, pos, server, metric, 'Max.', {_label("server", "'Max.'", "start_ts", "end_ts", "end_ts")}, max
FROM widened""",
    "run_counts": _with(*_HEAD)
    + "SELECT count(DISTINCT run_id) AS runs, count(*) AS statistics FROM statistics",
    "first_by_label": _with(*_HEAD) + "SELECT * FROM firsts",
    "report_long": _with(*_HEAD) + "SELECT * FROM cells",
    "report": _REPORT,
    "report_places": _with(*_HEAD)
    + r"""SELECT metric, metric = 'App(click)\Request Execution Time' AS is_baseline,
  CAST(row_number() OVER (ORDER BY metric = 'App(click)\Request Execution Time' DESC, metric) AS INTEGER) AS place
FROM (SELECT DISTINCT metric FROM cells)""",
    "report_roundtrip": _REPORT,
    "report_found_columns": _with(*_HEAD)
    + """, labels AS (
  SELECT label, row_number() OVER (ORDER BY label) AS "column" FROM (SELECT DISTINCT label FROM cells)),
metrics AS (SELECT DISTINCT metric FROM cells)
SELECT metric, "column", label, value FROM metrics CROSS JOIN labels LEFT JOIN cells USING (metric, label)""",
    "report_unlisted_cells": _with(*_HEAD)
    + f"""SELECT label, count(*) AS cells FROM (SELECT DISTINCT metric, {_PLACE} AS label FROM cells)
WHERE left(label, 2) > '10' GROUP BY label""",
    "report_empty_not_written": _with(*_HEAD)
    + """SELECT 'all' AS report, count(DISTINCT metric) AS rows, count(*) > 0 AS written, count(*) > 0 AS aligned FROM cells
UNION ALL SELECT 'none', 0, false, false""",
    "report_from_logs": _with(*_HEAD) + "SELECT * FROM cells",
    "report_from_store": _with(*_HEAD) + "SELECT * FROM cells",
    "first_of_head_and_tail": _with(
        *_FIND,
        _statistics("head").replace("firsts AS", "unused_firsts AS").replace("cells AS", "unused AS").replace("FROM firsts", "FROM unused_firsts"),
        _renamed_tail(),
    )
    + f"""SELECT metric, place AS label, arg_min(value, (run_id, pos)) AS value FROM (
  SELECT run_id, pos, metric, {_PLACE} AS place, value FROM statistics
  UNION ALL
  SELECT run_id || '/tail', pos, metric, {_PLACE}, value FROM tail_statistics)
WHERE value IS NOT NULL GROUP BY metric, place""",
    "report_tail": _with(*_TAIL) + "SELECT * FROM cells",
    "report_filter_sort": _with(*_HEAD)
    + "SELECT * FROM cells WHERE contains(label, 'SRV1' || chr(10)) ORDER BY value DESC, metric, label",
    "run_status": _with(_SAMPLES, _RUNS, _STATUS) + "SELECT * FROM statuses",
    "ingest_report": _with(_SAMPLES, _RUNS, _STATUS)
    + "SELECT status, count(*) AS runs, CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows FROM statuses GROUP BY status",
    "new_files_antijoin": _with(_SAMPLES, _RUNS)
    + """SELECT * FROM listed
WHERE run_id NOT IN (SELECT run_id FROM user_samples WHERE ts < TIMESTAMP '2024-01-16')""",
    "scan_counter_lines": _with(_WIDE)
    + r""", cells AS (
  SELECT run_id, ts, 1 AS pos, 'Quantity' AS counter, nullif("Quantity", 0) AS value FROM wide
  UNION ALL SELECT run_id, ts, 2, 'Extended Price', nullif("Extended Price", 0) FROM wide
  UNION ALL SELECT run_id, ts, 3, 'Discount', nullif("Discount", 0) FROM wide)
SELECT run_id, pos, count(*) AS rows, count(value) AS readings, sum(value) AS total, max(value) AS top,
  min(ts) AS start_ts, '\\SRV' || run_id || '\Lines\' || counter AS counter_path,
  'SRV' || run_id AS server, 'Lines\' || counter AS metric
FROM cells WHERE value IS NOT NULL GROUP BY run_id, pos, counter
UNION ALL
SELECT run_id, -1, count(*), 0, NULL, NULL, min(ts), NULL, NULL, NULL FROM wide GROUP BY run_id""",
    "read_counter_files": _FILES,
    "incremental_ingest": _FILES,
    "streaming_ingest": _FILES,
    "mixed_ingest": _with(*_HEAD) + "SELECT * FROM cells",
    "ingest_telemetry": _with(_SAMPLES, _PATTERNS)
    + """SELECT CAST(ceil(count(DISTINCT run_id) / 7) AS BIGINT) AS batches, count(DISTINCT run_id) AS files,
  count(*) AS rows, 0 AS bad_rows, true AS bytes_known, count(*) FILTER (
    EXISTS (SELECT 1 FROM patterns WHERE contains(counter_path, pattern))) AS readings
FROM samples""",
    "concurrent_ingest": _with(*_HEAD) + "SELECT * FROM cells",
    "grown_logs": _with(*_HEAD) + "SELECT * FROM cells",
    "compacted_store": _with(*_HEAD)
    + "SELECT *, 'before' AS store FROM cells UNION ALL SELECT *, 'after' FROM cells",
    "ingest_summary": """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
counts AS (SELECT count(*) FILTER (day(day) <= 10) AS early, count(*) AS whole FROM days)
SELECT 1::INTEGER AS call, early AS found, early AS new, 0::BIGINT AS skipped, 0::BIGINT AS failed FROM counts
UNION ALL SELECT 2, whole, whole - early, early, 0 FROM counts
UNION ALL SELECT 3, whole, 0, whole, 0 FROM counts""",
}

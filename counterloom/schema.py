"""Table layouts, run statuses and default parameters."""

# Long format: one row per reading. ``pos`` is the 0-based column of the counter
# in its log; names live in the counter dictionary, keyed by run and position.
SAMPLES = "run_id string, ts timestamp_ntz, pos int, value double"
BINS = (
    "run_id string, pos int, bin timestamp_ntz, on_start boolean, rows long, total double,"
    " units decimal(38,0), n long,"
    " top double, first_ts timestamp_ntz, last_ts timestamp_ntz"
)
COUNTERS = "run_id string, pos int, counter_path string, server string, metric string"
RUNS = (
    "run_id string, size_bytes long, rows long, bad_rows long, counters int, null_cells long,"
    " time_column string, baseline_path string, fall_ts timestamp_ntz, status string,"
    " ingested_at timestamp"
)

CLAIMS = "run_id string, size_bytes long, modified_us long, taken_us long"
COMMITS = (
    "files long, bytes long, rows long, bad_rows long, readings long,"
    " replaces array<string>, committed_at timestamp"
)
FAILURES = "run_id string, status string, error string, failed_at timestamp"

# Every data line of a log also yields one row with this position. Tick rows
# carry the time stamp of lines whose counters are all blank, so run bounds and
# row counts come from the same scan as the readings.
TICK = -1
# Lines without data (header, blank ones) where the bytes of a scan are accounted for.
NO_DATA = -2

OK = "ok"
EMPTY = "empty"
UNREADABLE = "unreadable"
NO_TIME_COLUMN = "no_time_column"
NO_BASELINE = "no_baseline"
NO_NONZERO = "no_nonzero"
NO_CHANGE = "no_change"
NO_PREVIOUS_BIN = "no_previous_bin"

AVG = "Avg."
MAX = "Max."

# The counters a report covers by default, matched as substrings
# of the counter path.
DEFAULT_PATTERNS = [
    "Request Execution Time",
    "# of Exceps Thrown",
    "# of current logical Threads",
    "# of current physical Threads",
    "Contention Rate / sec",
    "Current Queue Length",
    "Queue Length Peak",
    "% Time in GC",
    "NumberOfActiveConnectionPools",
    "NumberOfActiveConnections",
    "NumberOfPooledConnections",
    "Total Application Pool Recycles",
    "% Managed Processor Time (estimated)",
    "Managed Memory Used (estimated)",
    "Request Wait Time",
    "Requests Failed",
    "Requests/Sec",
    "ArrivalRate",
    "CurrentQueueSize",
    "Network Adapter(vmxnet3 Ethernet Adapter _2)\\Bytes Total/sec",
    "Network Adapter(vmxnet3 Ethernet Adapter _2)\\Current Bandwidth",
    "Network Adapter(vmxnet3 Ethernet Adapter _2)\\TCP RSC Coalesced Packets/sec",
    "NUMA Node Memory(0)\\Available MBytes",
    "NUMA Node Memory(1)\\Available MBytes",
    "(_Total)\\% Processor Time",
]
DEFAULT_BASELINE = "ASP.NET Applications(__Total__)\\Request Execution Time"

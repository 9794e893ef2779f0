"""Code-to-label maps of the reports.

FIXED VALUES. These labels must equal the source reports' labels for the
results to match, so they are written out plainly, in the source's order.
"""

# queue manager control code -> state (no default: other codes give NULL)
QUEUE_CONTROL = {
    "D": "DEACTIVATING", "E": "DEACTIVATED", "N": "NODE UNAVAILABLE", "A": "ACTIVATING",
    "X": "TERMINATED", "T": "TERMINATING", "V": "VERIFYING", "O": "SUSPENDING",
    "P": "SUSPENDED", "Q": "RESUMING", "R": "RESTARTING",
}

# long-running requests: only R is relabelled, other codes pass through
RUNNING_STATUS = {"R": "R:RUNNING"}

# failed requests (no default)
FAILED_STATUS = {"E": "ERROR", "G": "WARNING"}

# request summary, phase and status (no default)
SUMMARY_PHASE = {"R": "Running", "I": "Inactive", "C": "Completed", "P": "Pending"}
SUMMARY_STATUS = {
    "D": "Cancelled", "U": "Disabled", "E": "Error", "M": "NoManager", "R": "Normal",
    "I": "Normal", "C": "Normal", "H": "OnHold", "W": "Paused", "B": "Resuming",
    "P": "Scheduled", "Q": "Standby", "S": "Suspended", "X": "Terminated",
    "T": "Terminating", "A": "Waiting", "Z": "Waiting", "G": "Warning",
}

# program runs, phase and status, with defaults
RUN_PHASE = {
    "P": "Pending", "R": "Running", "C": "Completed", "I": "Inactive", "B": "Blocked",
    "G": "Waiting", "H": "On Hold", "E": "Error", "D": "Cancelled", "Q": "Standby",
    "Z": "Paused",
}
RUN_PHASE_DEFAULT = "Unknown Phase"
RUN_STATUS = {
    "A": "Waiting", "B": "Resuming", "C": "Normal", "D": "Cancelled", "E": "Error",
    "F": "Scheduled", "G": "Warning", "H": "On Hold", "I": "Normal", "M": "No Manager",
    "Q": "Standby", "S": "Suspended", "T": "Terminating", "U": "Disabled", "W": "Paused",
    "X": "Terminated", "Z": "Waiting",
}
RUN_STATUS_DEFAULT = "Unknown Status"

# profile option level id -> level name, with default
PROFILE_LEVEL = {
    10001: "Site", 10002: "Application", 10003: "Responsibility", 10004: "User",
    10005: "Server", 10006: "Organization", 10007: "Server+Resp",
}
PROFILE_LEVEL_DEFAULT = "No idea, boss"

# resource limits shown by the utilisation report
RESOURCE_NAMES = ("processes", "sessions", "parallel_max_servers", "enqueue_resources")

# parameter-name tokens of the three parameter listings
PARAMETER_TOKENS = ("sga", "pga", "processes")

# application-tier names used as filters
GUEST_USER = "GUEST"
APPS_USER = "APPS"
REPORT_SET = "Report Set"
GATHER_STATS_PROGRAM = "Gather Schema Statistics"
PUSH_PROVIDER_TYPE = "FND_MCS_PUSH_NTF_PROVIDER"
SERVICE_HANDLE = "FNDCPGSC"
THREAD_COUNT_PARAMETER = "PROCESSOR_IN_THREAD_COUNT"
MAILER_TYPE = "WF_MAILER"
SYNC_UPDATED = "UPDATED"
ROOT_CONTAINER_LABEL = "CDB$ROOT"
MISSING_CONTAINER_LABEL = "CDB"
ERROR_PATTERN = "%ORA-%"

# host checks
CAPACITY_THRESHOLD = 90.0
FS_EXCLUDE_PATTERN = "tmpfs|cdrom"
WATCHED_PROCESS_WORDS = ("smon", "tnslsnr")
SERVER_PROCESS_KINDS = ("oacore_server", "forms_server", "oafm_server")
WATCHED_PORTS = (7052, 8050, 1571)
TOP_PROCESSES = 4
LOG_TAIL_LINES = 30
# vmstat columns, in output order
VMSTAT_COLUMNS = (
    "run", "block", "swap", "free_mem", "buff_mem", "cache_mem", "swp_in", "swp_out",
    "blk_in", "blk_out", "interrupts", "ctx_switch", "usr", "sys", "idle", "wait",
    "steal", "date", "time",
)

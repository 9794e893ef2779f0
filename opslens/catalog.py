"""Registry of named queries: each a Spark DataFrame over a snapshot directory,
paired with independent DuckDB SQL over the raw tables (the oracle).

The oracle SQL reaches the same rows by another route than the operators
(membership tests and lookups for joins, one conditional aggregate over a
tagged union, windows for groups and limits) and states every label and list
of names itself, so that a wrong one in the operators shows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.functions.exprs import parse_as_of
from opslens.operators import activity, components, database, hosts, requests, settings, storage
from opslens.operators import findings as fnd
from opslens.oracle_views import with_views
from opslens.session import landing_path
from opslens.sources import command_output as co
from opslens.sources import log_files
from opslens.sources.fixtures import Snapshot
from opslens.streaming import alerts, streams

AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = f"timestamp '{AS_OF}'"
#: A moment with contacts in the half hour before it.
AS_OF_BUSY = "2024-01-30 12:00:00"
GIB_SQL = "/1024/1024/1024"


@dataclass(frozen=True)
class Query:
    build: Callable[[Snapshot], DataFrame]
    sql: str | None


def _fmt(col: str) -> str:
    return f"upper(strftime({col}, '%d-%b-%Y %H:%M:%S'))"


def _fmt_short(col: str) -> str:
    return f"upper(strftime({col}, '%d-%b-%y %H:%M:%S'))"


# ------------------------------------------------------------ SQL bodies

SQL: dict[str, str] = {}

SQL["r01_database_details"] = "select dbid, name, created, log_mode, open_mode from db_info"
SQL["r02_instance_details"] = "select instance_name, host_name, version, status from instance_info"

# per-container totals of one file table, labelled with the PDB name ('CDB' when absent)
_SIZE_PART = """select files.con_id, coalesce(pdb.name, 'CDB') as database_name, {agg} as size_gb
    from {tbl} as files left join pdbs as pdb using (con_id)
    group by files.con_id, coalesce(pdb.name, 'CDB')"""
_SIZE = """select con_id, database_name, sum(size_gb) as total_size_gb
    from ({data} {op} {temp}) as parts
    group by con_id, database_name"""
for _name, _op in (("r03_database_size", "union"), ("r03_database_size_union_all", "union all")):
    SQL[_name] = _SIZE.format(
        data=_SIZE_PART.format(agg=f"sum(files.bytes){GIB_SQL}", tbl="data_files"), op=_op,
        temp=_SIZE_PART.format(agg=f"round(sum(files.bytes){GIB_SQL})", tbl="temp_files"))

# root files under their own label, the others under whatever name their container has
SQL["r04_datafile_details"] = """select 'CDB$ROOT' as container_name, tablespace_name, file_name, status,
        autoextensible as autoextend
    from data_files where con_id = 1
    union all
    select (select max(p.name) from pdbs p where p.con_id = d.con_id), tablespace_name, file_name, status, autoextensible
    from data_files d where con_id is distinct from 1"""

# one pass over all extents and files, told apart by a tag
_EXTENTS = """select con_id, tablespace_name, kind = 'temp' as is_temp,
        sum(case kind when 'free' then bytes end) as free_bytes,
        sum(case kind when 'free' then 0 else bytes end) as all_bytes, max(top) as top_bytes,
        bool_or(kind = 'free') as has_free, bool_or(kind = 'file') as has_file
    from (select con_id, tablespace_name, 'free' as kind, bytes, null as top from free_space
          union all select con_id, tablespace_name, 'file', bytes, maxbytes from data_files
          union all select con_id, tablespace_name, 'temp', bytes, maxbytes from temp_files) as tagged
    group by con_id, tablespace_name, kind = 'temp'"""


def _capacity_sql(condition: str, free: str = "free_bytes", more: str = "") -> str:
    return f"""select e.con_id, k.name as con_name, e.tablespace_name,
        case when is_temp then null else {free} / 1073741824e0 end as free_space_gb,
        all_bytes / 1073741824e0 as allocated_space_gb, top_bytes / 1073741824e0 as max_allocated_gb{more}
    from ({_EXTENTS}) as e, containers as k where k.con_id = e.con_id and ({condition})"""


SQL["r05_capacity_usage"] = _capacity_sql("is_temp or (has_free and has_file)")
SQL["r05_capacity_usage_keep_full"] = _capacity_sql("is_temp or has_file", free="coalesce(free_bytes, 0)")
_USED = "100e0 * (1e0 * (all_bytes - free_bytes) / nullif(all_bytes, 0))"
_ALERTS = _capacity_sql(f"not is_temp and has_free and has_file and {_USED} > 90", more=f", {_USED} as used_percentage")
SQL["a1_capacity_alerts"] = _ALERTS
SQL["a1_capacity_alerts_with_temp"] = _capacity_sql(
    f"(is_temp and all_bytes > 0) or (has_free and has_file and {_USED} > 90)",
    more=f", case when not is_temp then {_USED} end as used_percentage")

SQL["r06_resource_utilization"] = """select resource_name, current_utilization, max_utilization,
        initial_allocation, limit_value
    from resource_limit
    where resource_name in ('processes', 'sessions', 'parallel_max_servers', 'enqueue_resources')"""
_ARCHIVE = f"""select date_trunc('day', completion_time) as day,
        round(sum(blocks * block_size){GIB_SQL}) as gb, count(*) as archives_generated_per_day
    from archived_log where completion_time > {{lower}}
    group by 1"""
SQL["r07_archive_per_day"] = _ARCHIVE.format(lower=f"{AS_OF_SQL} - interval 6 day")
SQL["r07_archive_per_day_whole_days"] = _ARCHIVE.format(
    lower=f"date_trunc('day', {AS_OF_SQL} - interval 6 day)")
# every file counts once for each tablespace row of its number; used blocks are laid against the file block size
_TEMP_USE = """select u.tablespace_name, any_value(f.total) / 1073741824e0 as total_size_gb,
        any_value(u.blocks) * f.block_size / 1073741824e0 as used_size_gb
    from (select distinct tablespace_name, sum(used_blocks) over (partition by tablespace_name) as blocks from sort_segment) as u,
         (select name, block_size, sum(bytes * copies) as total
          from temp_files as t, (select name, {key}, count(*) as copies from tablespaces group by all) as n
          where {match} group by all) as f
    where f.name = u.tablespace_name
    group by u.tablespace_name, f.block_size, f.total"""
SQL["r08_temp_usage"] = _TEMP_USE.format(key="ts_no", match="n.ts_no = t.ts_no")
SQL["r08_temp_usage_by_container"] = _TEMP_USE.format(
    key="ts_no, con_id", match="n.ts_no = t.ts_no and n.con_id = t.con_id")
SQL["r09_block_corruption"] = """select file_no, block_no, blocks, corruption_change_no, corruption_type
    from block_corruption"""
SQL["r10_invalid_objects"] = """select con_id, owner, object_name, object_type, last_ddl_time as last_ddl_run
    from db_objects where status = 'INVALID'"""
SQL["r16_invalid_objects_pdb"] = """select owner, object_name, object_type, last_ddl_time as last_ddl_run
    from db_objects where status = 'INVALID' and con_id = 3"""
SQL["r16_invalid_object_counts"] = """select con_id, owner, object_type, count(*) as invalid_objects
    from db_objects where status = 'INVALID' group by con_id, owner, object_type"""
SQL["r11_backup_summary"] = f"""select session_key, {_fmt('job.start_time')} as start_time,
        {_fmt('job.end_time')} as end_time, status, autobackup_done, autobackup_count, input_type,
        elapsed_seconds
    from backup_jobs as job where job.start_time > {AS_OF_SQL} - interval 5 day"""
SQL["r12_alert_log_errors"] = f"""select {_fmt('originating_timestamp')} as "timestamp", message_text
    from alert_log
    where originating_timestamp > {AS_OF_SQL} - interval 12 hour and message_text like '%ORA-%'"""
# who is still inside the time-out (microseconds since the last contact), by membership tests
def _live(columns: str, timeout_us: str, as_of: str = AS_OF_SQL, tail: str = "") -> str:
    return f"""select {columns} from app_sessions as a
    where a.user_id in (select user_id from app_users where user_name is distinct from 'GUEST' and user_name is not null)
      and a.disabled_flag in ('N') and a.pseudo_flag in ('N') and a.limit_connects - a.counter > 0
      and epoch_us({as_of}) - epoch_us(a.last_connect) < {timeout_us} {tail}"""


_WHO = """a.session_id, a.user_id, (select max(n.user_name) from app_users n where n.user_id = a.user_id) as user_name,
        (select max(n.description) from app_users n where n.user_id = a.user_id) as description"""
SQL["r13_online_users"] = _live(_WHO, "a.limit_time * 3600000000", tail="group by all")
SQL["r13_online_users_timeout_30m"] = _live(_WHO, "30 * 60000000", f"timestamp '{AS_OF_BUSY}'", "group by all")
# nested lookups, most particular level first
_TIMEOUTS = """select a.*, coalesce(u.t, n.t, site.t) as timeout_minutes,
        case when u.t is not null then 10004 when n.t is not null then 10003 when site.t is not null then 10001 end as timeout_minutes_level
    from app_sessions as a
    left join (select c_custkey, c_nationkey, case when c_acctbal > 5000 then floor(c_acctbal / 4) end as t from customer) as u on u.c_custkey = a.user_id
    left join (select n_nationkey, case when n_regionkey > 1 then 600e0 + 60 * n_nationkey end as t from nation) as n on n.n_nationkey = u.c_nationkey
    left join (select 90e0 + max(r_regionkey) as t from region) as site on true"""
SQL["f16_session_timeouts"] = f"select session_id, user_id, timeout_minutes, timeout_minutes_level from ({_TIMEOUTS}) as s"
SQL["r13_online_users_by_profile"] = _live(_WHO, "a.timeout_minutes * 60000000", f"timestamp '{AS_OF_BUSY}'", "group by all").replace(
    "from app_sessions as a", f"from ({_TIMEOUTS}) as a")
SQL["r14_online_user_count"] = _live("count(a.session_id) as online_users", "a.limit_time * 3600000000")
_IDLE = """select {keys}, count(*) as session_count
    from db_sessions
    where status = 'INACTIVE' and username = 'APPS' and last_call_et > 86400
    group by {keys}"""
SQL["r15_inactive_sessions"] = _IDLE.format(keys="sid, serial_no, status, module, program, machine")
SQL["r15_inactive_session_summary"] = _IDLE.format(keys="status, module, program, machine")
SQL["r17_recovery_area"] = f"""select name, space_limit{GIB_SQL} as total_space_gb,
        space_used{GIB_SQL} as used_space_gb,
        round(space_limit{GIB_SQL} - space_used{GIB_SQL}) as free_space_gb
    from recovery_dest"""
for _tok in ("sga", "pga", "processes"):
    SQL[f"r18_parameters_{_tok}"] = (f"select name, type, value from parameters "
                                     f"where contains(lower(name), '{_tok}')")
SQL["r19_redo_members"] = "select group_no, member from redo_members"
SQL["r20_log_tail"] = """select host, line_no, line from host_log
    qualify row_number() over (partition by host order by line_no desc) <= 30"""
# Labels, written out here a second time so that a wrong one in the reports shows.
_QUEUE_STATE = """(values ('D', 'DEACTIVATING'), ('E', 'DEACTIVATED'), ('N', 'NODE UNAVAILABLE'), ('A', 'ACTIVATING'),
    ('X', 'TERMINATED'), ('T', 'TERMINATING'), ('V', 'VERIFYING'), ('O', 'SUSPENDING'), ('P', 'SUSPENDED'),
    ('Q', 'RESUMING'), ('R', 'RESTARTING')) as state(code, label)"""
_SUMMARY_PHASE = "(values ('R', 'Running'), ('I', 'Inactive'), ('C', 'Completed'), ('P', 'Pending')) as ph(code, label)"
_SUMMARY_STATUS = """(values ('D', 'Cancelled'), ('U', 'Disabled'), ('E', 'Error'), ('M', 'NoManager'), ('R', 'Normal'),
    ('I', 'Normal'), ('C', 'Normal'), ('H', 'OnHold'), ('W', 'Paused'), ('B', 'Resuming'), ('P', 'Scheduled'),
    ('Q', 'Standby'), ('S', 'Suspended'), ('X', 'Terminated'), ('T', 'Terminating'), ('A', 'Waiting'), ('Z', 'Waiting'),
    ('G', 'Warning')) as st(code, label)"""
_RUN_PHASE = """(values ('P', 'Pending'), ('R', 'Running'), ('C', 'Completed'), ('I', 'Inactive'), ('B', 'Blocked'),
    ('G', 'Waiting'), ('H', 'On Hold'), ('E', 'Error'), ('D', 'Cancelled'), ('Q', 'Standby'), ('Z', 'Paused')) as ph(code, label)"""
_RUN_STATUS = """(values ('A', 'Waiting'), ('B', 'Resuming'), ('C', 'Normal'), ('D', 'Cancelled'), ('E', 'Error'),
    ('F', 'Scheduled'), ('G', 'Warning'), ('H', 'On Hold'), ('I', 'Normal'), ('M', 'No Manager'), ('Q', 'Standby'),
    ('S', 'Suspended'), ('T', 'Terminating'), ('U', 'Disabled'), ('W', 'Paused'), ('X', 'Terminated'), ('Z', 'Waiting')) as st(code, label)"""
_LEVELS = """(values (10001, 'Site'), (10002, 'Application'), (10003, 'Responsibility'), (10004, 'User'), (10005, 'Server'),
    (10006, 'Organization'), (10007, 'Server+Resp')) as lv(id, label)"""


def _label(table: str, key: str, column: str = "code") -> str:
    return f"(select max(label) from {table} where {column} = {key})"


_QUEUES = f"""select v.user_queue_name as concurrent_manager, m.target_node as server_node,
        m.running_processes as actual, m.max_processes as target, {_label(_QUEUE_STATE, 'v.control_code')} as status
    from queues_vl as v, queues as m where m.queue_id = v.queue_id {{only}} group by all"""
SQL["r21_queue_status"] = _QUEUES.format(only="and m.max_processes - m.running_processes = 0")
SQL["r21_queue_status_all"] = _QUEUES.format(only="")
# the running requests first, then every name by lookup; a request whose name is missing drops out

def _ranked(order: str, columns: str, rows: str) -> str:
    """``columns`` of ``rows`` with their places: ties by the columns, nulls last."""
    ties = ", ".join(f"{c.strip()} asc nulls last" for c in columns.split(","))
    return f"select row_number() over (order by {order}, {ties}) as rank, {columns} from ({rows}) as listed"


SQL["o1_block_corruption_ranked"] = _ranked(
    "file_no desc nulls first, block_no asc nulls last", "file_no, block_no, blocks, corruption_change_no, corruption_type",
    SQL["r09_block_corruption"])
SQL["o2_backup_summary_ranked"] = _ranked(
    "start_time desc nulls first, session_key asc nulls last",
    "session_key, start_time, end_time, status, autobackup_done, autobackup_count, input_type, elapsed_seconds",
    SQL["r11_backup_summary"])
SQL["o3_queue_status_ranked"] = _ranked(
    "target desc nulls first, concurrent_manager asc nulls last, server_node asc nulls last",
    "concurrent_manager, server_node, actual, target, status", SQL["r21_queue_status_all"])
SQL["o4_datafile_details_ranked"] = _ranked(
    "container_name asc nulls last, file_id asc nulls last", "container_name, tablespace_name, file_name, status, autoextend",
    """select case when con_id = 1 then 'CDB$ROOT' else (select max(p.name) from pdbs p where p.con_id = d.con_id) end as container_name,
        tablespace_name, file_name, status, autoextensible as autoextend, file_id from data_files d""")

SQL["r22_long_running_requests"] = f"""with slow as (
        select *, round((epoch_us({AS_OF_SQL}) - epoch_us(actual_start_date)) / 6e7, 2) as mins
        from requests where status_code = 'R'),
    named as (
        select request_id as requestid, (select max(user_name) from app_users where user_id = slow.requested_by) as username,
            (select max(responsibility_name) from responsibilities t where t.responsibility_id = slow.responsibility_id)
                as responsibility_name,
            (select max(user_program_name) from programs t
             where t.program_id = slow.program_id and t.application_id = slow.application_id) as program_name,
            {_fmt('actual_start_date')} as start_datetime, 'R:RUNNING' as status, mins as runtime_min,
            argument_text as report_arguments
        from slow where mins > 60)
    select * from named
    where username is not null and responsibility_name is not null and program_name is not null group by all"""
# counted by a window over each raw group, one row of it kept
SQL["r23_failed_requests"] = f"""select case when n.user_program_name <> 'Report Set' then n.user_program_name else f.description end
        as program_name,
        case f.status_code when 'E' then 'ERROR' else 'WARNING' end as status, f.completion_text as error_message,
        f.actual_start_date as start_date,
        count(*) over (partition by n.user_program_name, f.description, f.status_code, f.completion_text, f.actual_start_date)
            as request_count
    from (select * from requests where list_contains(['E', 'G'], status_code)
          and epoch_us({AS_OF_SQL}) - epoch_us(requested_start_date) < 12 * 3600000000) as f,
         (select * from programs where language = 'US') as n
    where n.program_id = f.program_id
    qualify row_number() over (partition by n.user_program_name, f.description, f.status_code, f.completion_text,
        f.actual_start_date) = 1"""
_RECENT = f"""(select phase_code, status_code, count(*) as n from requests
    where requested_start_date > {AS_OF_SQL} - interval 12 hour group by all)"""
SQL["r24_request_summary"] = f"""select concat({_label(_SUMMARY_PHASE, 'r.phase_code')}, ' With ',
        {_label(_SUMMARY_STATUS, 'r.status_code')}) as status, n as request_count from {_RECENT} as r"""
SQL["r24_request_summary_by_label"] = f"""select status, cast(sum(request_count) as bigint) as request_count
    from ({SQL["r24_request_summary"]}) as s group by status"""
SQL["r25_program_runs"] = f"""with runs as (
        select * from requests
        where len(string_split(argument_text, ',')) > 8
          and cast(actual_completion_date as date) > cast({AS_OF_SQL} as date) - 30
          and program_id in (select program_id from programs where user_program_name = 'Gather Schema Statistics')
          and requested_by in (select user_id from app_users))
    select request_id as requestid, 'Gather Schema Statistics' as program_name,
        round((epoch_us(actual_completion_date) - epoch_us(actual_start_date)) / 6e7, 2) as process_time,
        {_fmt_short('request_date')} as requestdate, {_fmt_short('actual_start_date')} as startdate,
        {_fmt_short('actual_completion_date')} as completedate,
        (select max(user_name) from app_users u where u.user_id = runs.requested_by) as username,
        coalesce({_label(_RUN_PHASE, 'runs.phase_code')}, 'Unknown Phase') as phasecode,
        coalesce({_label(_RUN_STATUS, 'runs.status_code')}, 'Unknown Status') as statuscode, argument_text as program_arg
    from runs group by all"""
# every change in every language, numbered newest first
_CHANGES = f"""select t.user_profile_option_name as profile_option,
        coalesce({_label(_LEVELS, 'c.level_id', 'id')}, 'No idea, boss') as option_level,
        c.profile_option_value as profile_value, c.last_update_date as change_date, u.user_name, t.language
    from profile_options_tl as t, profile_options as o, profile_values as c, app_users as u
    where o.profile_option_name = t.profile_option_name and c.profile_option_id = o.profile_option_id
      and c.last_updated_by = u.user_id"""
_NEWEST = """select profile_option, option_level, profile_value, change_date, user_name from (
        select *, row_number() over (order by change_date desc nulls first, profile_option, option_level, profile_value, user_name) as nth
        from ({changes}) as x where {only}) as numbered
    where nth <= 2 group by all"""
SQL["r26_latest_profile_changes"] = _NEWEST.format(changes=_CHANGES, only="true")
SQL["r26_latest_profile_changes_us"] = _NEWEST.format(changes=_CHANGES, only="language = 'US'")
SQL["r26_profile_changes_last_2_days"] = f"""select profile_option, option_level, profile_value, change_date, user_name
    from ({_CHANGES}) as x where epoch_us({AS_OF_SQL}) - epoch_us(change_date) < 48 * 3600000000 group by all"""
# membership tests for what only restricts the components, a lookup for the queue's flag
_KEPT = """c.sync_state = 'UPDATED' and not (c.component_type = 'FND_MCS_PUSH_NTF_PROVIDER')
      and exists (select 1 from component_params p
                  where p.component_id = c.component_id and p.parameter_name = 'PROCESSOR_IN_THREAD_COUNT')
      and exists (select 1 from queues q, services s
                  where q.queue_id = c.queue_id and s.service_id = q.manager_type and s.service_handle = 'FNDCPGSC')"""
_COMPONENT = """c.component_id, c.component_name, c.component_status as status,
        (select max(q.enabled_flag) from queues q where q.queue_id = c.queue_id) as enabled,
        c.inbound_agent_name, c.outbound_agent_name, c.startup_mode, c.last_update_date as updated"""
SQL["r27_component_status"] = f"select {_COMPONENT} from components c where {_KEPT} group by all"
SQL["r27_component_status_with_processes"] = f"""select {_COMPONENT},
        (select count(*) from processes a, queues q where q.queue_id = c.queue_id and a.queue_id = q.queue_id
            and a.application_id = q.application_id and a.process_status_code = 'A') as active_processes
    from components c where {_KEPT}"""
SQL["r28_mailer_status"] = """select component_name,
        case when component_status = 'RUNNING' then 'RUNNING' else 'DOWN' end as component_status
    from components where component_type = 'WF_MAILER' and sync_state = 'UPDATED'"""

# hosts
SQL["m01_probe_status"] = """select host, url, ts, http_status,
    case when http_status = 200 then 'SUCCESS' else 'ERROR' end as outcome from probe_results"""
SQL["m01_availability"] = """select url, count(*) as probes,
    cast(sum(case when http_status = 200 then 1 else 0 end) as bigint) as successes,
    round(cast(sum(case when http_status = 200 then 1 else 0 end) as bigint) / count(*) * 100e0, 2)
        as availability_pct
    from probe_results group by url"""
SQL["m18_latest_probe_status"] = """select url, max(ts) as last_probe_ts, arg_max(http_status, ts) as http_status
    from probe_results group by url"""
SQL["m02_cpu_usage"] = """select host, prev_ts as start_ts, ts as end_ts,
    case when dt > 0 and di >= 0 and di <= dt then round((dt - di) / dt * 100e0, 2) end as cpu_pct
    from (select host, ts, lag(ts) over w as prev_ts, total - lag(total) over w as dt,
                 idle_t - lag(idle_t) over w as di
          from (select host, ts, "user" + nice + system + idle + iowait + irq + softirq + steal as total,
                       idle + iowait as idle_t from cpu_samples) s
          window w as (partition by host order by ts)) d
    where prev_ts is not null"""
SQL["m03_memory_usage"] = """select host, ts, round(mem_pct, 2) as mem_pct,
    round(avg(mem_pct) over (partition by host order by ts rows between 4 preceding and current row), 2)
        as mem_pct_avg
    from (select host, ts, mem_used * 100e0 / mem_total as mem_pct from mem_samples) s"""
SQL["m04_swap_usage"] = """select host, ts, round(swap_pct, 2) as swap_pct,
    round(avg(swap_pct) over (partition by host order by ts rows between 4 preceding and current row), 2)
        as swap_pct_avg,
    case when swap_total > 0 then 'Enabled' else 'Not Enabled' end as swap_state
    from (select host, ts, swap_total,
                 case when swap_total > 0 then swap_used * 100e0 / swap_total end as swap_pct
          from mem_samples) s"""
SQL["m03_recent_memory"] = """select host, count(*) as samples,
    round(avg(mem_used * 100e0 / mem_total), 2) as mem_pct_avg,
    round(avg(case when swap_total > 0 then swap_used * 100e0 / swap_total end), 2) as swap_pct_avg,
    case when max(case when swap_total > 0 then 1 else 0 end) = 1 then 'Enabled' else 'Not Enabled' end
        as swap_state
    from (select *, row_number() over (partition by host order by ts desc) as r from mem_samples) s
    where r <= 5 group by host"""
SQL["m05_filesystem_alerts"] = """select host, filesystem, use_pct from fs_usage
    where not regexp_matches(filesystem, 'tmpfs|cdrom') and use_pct >= 90"""
SQL["m06_filesystem_usage"] = """select host, filesystem, size, used, available, use_pct, mounted_on from fs_usage
    where filesystem not like '%tmpfs%'"""
SQL["m07_load_average"] = """select host, ts,
    try_cast(trim(string_split(string_split_regex(line, '[a-z]:')[2], ',')[1]) as double) as load_1,
    try_cast(trim(string_split(string_split_regex(line, '[a-z]:')[2], ',')[2]) as double) as load_5,
    try_cast(trim(string_split(string_split_regex(line, '[a-z]:')[2], ',')[3]) as double) as load_15
    from uptime_lines"""
SQL["m08_uptime_by_host"] = f"""select host, arg_max(boot_time, ts) as boot_time,
    (epoch_us({AS_OF_SQL}) - epoch_us(arg_max(boot_time, ts))) / 3.6e9 as uptime_hours
    from boot_samples group by host"""
_TOP = """select host, "rank", ruser, pid, ppid, nice, wchan, pmem, pcpu, cpu_time, euser, state, flags, start_time,
    thcount, comm from (
    select *, cast(row_number() over (partition by host order by {by} desc nulls last, pid) as integer) as "rank"
    from proc_snapshot) t where "rank" <= 4"""
SQL["m09_top_cpu_processes"] = _TOP.format(by="pcpu")
SQL["m10_top_memory_processes"] = _TOP.format(by="pmem")
SQL["m11_zombie_processes"] = "select host, pid, comm, state from proc_snapshot where state like 'Z%'"
SQL["m12_processes_matching"] = r"""select host, pid, comm from proc_snapshot
    where regexp_matches(comm, '\b(smon|tnslsnr)\b')"""
SQL["m12_processes_matching_token"] = """select host, pid, comm from proc_snapshot
    where list_has_any(string_split_regex(comm, '[^A-Za-z0-9]+'), ['smon', 'tnslsnr'])"""
SQL["m13_thread_count"] = """select u.host, u.processes, u.threads, l.max_user_processes,
    round(u.threads * 100e0 / l.max_user_processes, 2) as used_pct
    from (select host, count(*) as processes, cast(sum(thcount) as bigint) as threads
          from proc_snapshot group by host) u left join host_limits l on u.host = l.host"""
SQL["m14_listening_ports"] = """select host, proto, port from listeners
    where regexp_matches(cast(port as varchar), '7052|8050|1571')"""
SQL["m14_listening_ports_exact"] = """select host, proto, port from listeners
    where port in (7052, 8050, 1571)"""
SQL["m14_missing_ports"] = """select h.host, p.port from (select distinct host from proc_snapshot) h,
    (select unnest([7052, 8050, 1571]) as port) p
    where not exists (select 1 from listeners l where l.host = h.host and l.port = p.port)"""
SQL["m15_disk_average"] = """select host, device, count(*) as samples, round(avg(tps), 2) as avg_tps,
    round(avg(rkb_s), 2) as avg_rkb_s, round(avg(wkb_s), 2) as avg_wkb_s, round(avg(areq_sz), 2) as avg_areq_sz,
    round(avg(aqu_sz), 2) as avg_aqu_sz, round(avg(await_ms), 2) as avg_await_ms, round(avg(util), 2) as avg_util
    from disk_samples group by host, device"""
_VM = ", ".join(
    (f"string_split_regex(trim(line), '\\s+')[{i + 1}] as {c}" if c in ("date", "time") else
     f"try_cast(string_split_regex(trim(line), '\\s+')[{i + 1}] as bigint) as {c}")
    for i, c in enumerate(("run", "block", "swap", "free_mem", "buff_mem", "cache_mem", "swp_in", "swp_out", "blk_in", "blk_out",
                           "interrupts", "ctx_switch", "usr", "sys", "idle", "wait", "steal", "date", "time")))
SQL["m16_vmstat_samples"] = (f"select host, line_no, {_VM} from vmstat_lines "
                             "where regexp_matches(line, '^\\s*[0-9]') and len(string_split_regex(trim(line), '\\s+')) >= 19")
SQL["m17_server_process_counts"] = "select host, " + ", ".join(
    f"count(*) filter (where comm like '%{k}%') as {k}" for k in ("oacore_server", "forms_server", "oafm_server")
) + " from proc_snapshot group by host"
SQL["m19_logged_on_users"] = r"""select host, regexp_extract(line, '^(\S+)', 1) as user_name,
    count(*) as sessions from who_lines group by host, regexp_extract(line, '^(\S+)', 1)"""

SQL["m19_logged_on_sessions"] = r"""select host, f[1] as user_name, f[2] as terminal, f[3] || ' ' || f[4] as login_time, f[5] as idle,
    cast(f[6] as bigint) as pid from (select host, string_split_regex(line, '\s+') as f from who_lines) w"""
SQL["s4_core_counts"] = """select distinct host, cast(1 + cast(substr(host, 5) as int) % 4 as bigint) as cores from cpu_samples"""
SQL["s4_rejected_df_lines"] = """select host, count(*) + 3 as data_lines, cast(3 as bigint) as rejected from fs_usage group by host"""

# text parsers: parsing the rendered command output must give back the
# sample tables, so the oracle is the same report over those tables
SQL["s4_cpu_usage_from_proc_stat"] = SQL["m02_cpu_usage"]
SQL["s4_memory_usage_from_free"] = SQL["m03_memory_usage"]
SQL["s4_swap_usage_from_meminfo"] = SQL["m04_swap_usage"]
SQL["f13_filesystem_alerts_from_df"] = SQL["m05_filesystem_alerts"]
SQL["s3_top_cpu_processes_from_ps"] = SQL["m09_top_cpu_processes"]
SQL["s3_top_cpu_processes_from_files"] = SQL["m09_top_cpu_processes"]
# lines numbered in their day's log, the newest 30 of each host over all days
SQL["s3_log_tail_from_files"] = """select host, cast(row_number() over newest as int) as rank, stamp, line, line_no
    from (select concat('host', (user_id // 2)::varchar) as host, strftime(ts, '%Y-%m-%d') as stamp, event_type || ' ' || props as line, ts, event_id,
                 row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts, event_id) as line_no from events) as numbered
    window newest as (partition by host order by stamp desc, line_no desc)
    qualify rank <= 30"""
SQL["s3_listening_ports_from_netstat"] = SQL["m14_listening_ports"]
SQL["s4_disk_average_from_sar"] = SQL["m15_disk_average"]
SQL["s4_uptime_from_uptime_p"] = SQL["m08_uptime_by_host"]

# streaming reports, batch form
SQL["t1_error_counts_hourly"] = """select date_trunc('hour', originating_timestamp) as window_start,
    date_trunc('hour', originating_timestamp) + interval 1 hour as window_end, count(*) as errors
    from alert_log where message_text like '%ORA-%' group by date_trunc('hour', originating_timestamp)"""
SQL["t2_memory_window_avg"] = """select host, ws as window_start, ws + interval 1 hour as window_end,
    count(*) as samples, round(avg(v), 2) as avg_value
    from (select host, mem_used * 100e0 / mem_total as v,
                 time_bucket(interval 15 minute, ts) - k * interval 15 minute as ws
          from mem_samples, (select unnest([0, 1, 2, 3]) as k) kk) s
    group by host, ws"""
SQL["t3_alerts_with_timeouts"] = f"""with s as (
        select 'memory' as "check", host, ts, mem_used * 100.0 / mem_total as value, mem_used * 100.0 / mem_total >= 90 as above from mem_samples where mem_total <> 0
        union all select 'disk', host, ts, util, util >= 30 from disk_samples),
    p as (select *, lag(above) over w as was, lag(ts) over w + interval 12 hour as ends, lead(ts) over w as following
          from s window w as (partition by "check", host order by ts, value))
    select "check", host, ends as ts, 'CLEARED' as event, null::double as value from p where was and ts > ends
    union all select "check", host, ts, if(above, 'RAISED', 'CLEARED'), value from p where above <> (coalesce(was, false) and ts <= ends)
    union all select "check", host, ts + interval 12 hour, 'CLEARED', null from p
    where above and following is null and ts + interval 12 hour < {AS_OF_SQL}"""
SQL["t3_memory_threshold_transitions"] = """select host, ts,
    case when above then 'RAISED' else 'CLEARED' end as event, value
    from (select host, ts, value, above, lag(above) over (partition by host order by ts) as prev
          from (select host, ts, mem_used * 100e0 / mem_total as value,
                       mem_used * 100e0 / mem_total >= 90 as above from mem_samples) s) d
    where above != coalesce(prev, false)"""

_F = "select '{check}' as \"check\", '{sev}' as severity, cast({entity} as varchar) as entity, " \
     "'{metric}' as metric, cast({value} as double) as value, cast({thr} as double) as threshold, " \
     + AS_OF_SQL + " as as_of from ({{body}}) x"
SQL["s7_findings"] = "\nunion all\n".join([
    _F.format(check="tablespace_usage", sev="WARNING", entity="concat_ws('/', con_name, tablespace_name)",
              metric="used_percentage", value="used_percentage", thr="90").format(body=_ALERTS),
    _F.format(check="filesystem_usage", sev="WARNING", entity="concat_ws(':', host, filesystem)",
              metric="use_pct", value="use_pct", thr="90").format(body=SQL["m05_filesystem_alerts"]),
    _F.format(check="long_running_request", sev="INFO", entity="requestid", metric="runtime_min",
              value="runtime_min", thr="60").format(body=SQL["r22_long_running_requests"]),
    _F.format(check="failed_request", sev="WARNING", entity="concat_ws(' | ', program_name, status)",
              metric="request_count", value="request_count", thr="null").format(body=SQL["r23_failed_requests"]),
    _F.format(check="mailer_down", sev="CRITICAL", entity="component_name", metric="component_status",
              value="null", thr="null").format(
        body=SQL["r28_mailer_status"] + " and component_status is distinct from 'RUNNING'"),
    _F.format(check="zombie_process", sev="WARNING", entity="concat_ws(':', host, cast(pid as varchar))",
              metric="state", value="null", thr="null").format(body=SQL["m11_zombie_processes"]),
    _F.format(check="port_not_listening", sev="CRITICAL",
              entity="concat_ws(':', host, cast(port as varchar))", metric="port", value="port",
              thr="null").format(body=SQL["m14_missing_ports"]),
])


# ------------------------------------------------------------ Spark side

def _users(s: Snapshot) -> DataFrame:
    return s.app_users


def _alert_samples(s: Snapshot) -> DataFrame:
    memory = F.try_divide(F.col("mem_used") * F.lit(100.0), F.col("mem_total"))
    return (alerts.check_samples(s.mem_samples, "memory", memory, 90.0)
            .unionByName(alerts.check_samples(s.disk_samples, "disk", F.col("util"), 30.0)))


def _session_timeouts(s: Snapshot) -> DataFrame:
    sessions = s.app_sessions.join(s.session_responsibilities, "user_id", "left")
    return settings.with_setting(sessions, s.profile_settings, "SESSION_TIMEOUT", "timeout_minutes")


def _tail_from_files(s: Snapshot) -> DataFrame:
    """The host log written as a collector's rotated text files, one stamp a day, and read back."""
    path = landing_path(s.spark, "host-log")
    log_files.write_log(s.collected_log, path, F.date_format("ts", "yyyy-MM-dd"), [F.col("ts"), F.col("event_id")])
    return log_files.log_tail(log_files.number_lines(log_files.read_log(s.spark, path)), codes.LOG_TAIL_LINES, keep=["line_no"])


def _top_from_files(s: Snapshot) -> DataFrame:
    """`ps` output captured to text files of many hosts' lines, and read back."""
    path = landing_path(s.spark, "ps")
    log_files.write_log(s.ps_lines, path, F.lit("now"), [F.col("host"), F.col("line")])
    return hosts.top_processes(co.ps_snapshot(log_files.read_log(s.spark, path).select("host", "line")), "pcpu")


def _mem_pct(s: Snapshot) -> DataFrame:
    return s.mem_samples.withColumn("mem_pct", F.col("mem_used") * F.lit(100.0) / F.col("mem_total"))


def _usage(s: Snapshot, keep_full: bool = False, ordered: bool = True) -> DataFrame:
    return storage.capacity_usage(s.data_files, s.free_space, s.temp_files, s.containers, keep_full, ordered)


def _findings(s: Snapshot) -> DataFrame:
    return fnd.standard_findings(
        as_of=AS_OF,
        # a union needs none of the listings' orders
        capacity_alerts=storage.capacity_alerts(_usage(s, ordered=False), ordered=False),
        filesystem_alerts=hosts.filesystem_alerts(s.fs_usage),
        long_running=requests.long_running_requests(s.requests, _users(s), s.responsibilities,
                                                    s.programs, AS_OF, ordered=False),
        failed_requests=requests.failed_requests(s.requests, s.programs, AS_OF, ordered=False),
        mailer_status=components.mailer_status(s.components),
        zombies=hosts.zombie_processes(s.proc_snapshot),
        missing_ports=hosts.missing_ports(s.listeners, s.proc_snapshot))


BUILDERS: dict[str, Callable[[Snapshot], DataFrame]] = {
    "r01_database_details": lambda s: database.database_details(s.db_info),
    "r02_instance_details": lambda s: database.instance_details(s.instance_info),
    "r03_database_size": lambda s: storage.database_size(s.data_files, s.temp_files, s.pdbs),
    "r03_database_size_union_all": lambda s: storage.database_size(s.data_files, s.temp_files, s.pdbs,
                                                                   union_all=True),
    "r04_datafile_details": lambda s: storage.datafile_details(s.data_files, s.pdbs),
    "r05_capacity_usage": lambda s: _usage(s),
    "r05_capacity_usage_keep_full": lambda s: _usage(s, keep_full=True),
    "a1_capacity_alerts": lambda s: storage.capacity_alerts(_usage(s, ordered=False)),
    "a1_capacity_alerts_with_temp": lambda s: storage.capacity_alerts(_usage(s, ordered=False), include_temp=True),
    "r06_resource_utilization": lambda s: database.resource_utilization(s.resource_limit),
    "r07_archive_per_day": lambda s: storage.archive_per_day(s.archived_log, AS_OF),
    "r08_temp_usage": lambda s: storage.temp_usage(s.sort_segment, s.tablespaces, s.temp_files),
    "r08_temp_usage_by_container": lambda s: storage.temp_usage(s.sort_segment, s.tablespaces, s.temp_files,
                                                                by_container=True),
    "r07_archive_per_day_whole_days": lambda s: storage.archive_per_day(s.archived_log, AS_OF, whole_days=True),
    "r09_block_corruption": lambda s: storage.block_corruption(s.block_corruption),
    "r10_invalid_objects": lambda s: database.invalid_objects(s.db_objects),
    "r16_invalid_objects_pdb": lambda s: database.invalid_objects(s.db_objects, con_id=3),
    "r16_invalid_object_counts": lambda s: database.invalid_object_counts(s.db_objects),
    "r11_backup_summary": lambda s: database.backup_summary(s.backup_jobs, AS_OF),
    "r12_alert_log_errors": lambda s: database.alert_log_errors(s.alert_log, AS_OF),
    "r13_online_users": lambda s: activity.online_users(s.app_sessions, s.app_users, AS_OF),
    "r13_online_users_timeout_30m": lambda s: activity.online_users(s.app_sessions, s.app_users, AS_OF_BUSY,
                                                                    timeout_minutes=30),
    "f16_session_timeouts": lambda s: _session_timeouts(s).select("session_id", "user_id", "timeout_minutes", "timeout_minutes_level"),
    "r13_online_users_by_profile": lambda s: activity.online_users(_session_timeouts(s), s.app_users, AS_OF_BUSY,
                                                                   timeout_minutes=F.col("timeout_minutes")),
    "r14_online_user_count": lambda s: activity.online_user_count(s.app_sessions, s.app_users, AS_OF),
    "r15_inactive_sessions": lambda s: activity.inactive_sessions(s.db_sessions),
    "r15_inactive_session_summary": lambda s: activity.inactive_sessions(s.db_sessions, by_session=False),
    "r17_recovery_area": lambda s: storage.recovery_area(s.recovery_dest),
    **{f"r18_parameters_{t}": (lambda t: lambda s: database.parameters_like(s.parameters, t))(t)
       for t in codes.PARAMETER_TOKENS},
    "r19_redo_members": lambda s: database.redo_members(s.redo_members),
    "r20_log_tail": lambda s: hosts.log_tail(s.host_log),
    "r21_queue_status": lambda s: requests.queue_status(s.queues, s.queues_vl),
    "r21_queue_status_all": lambda s: requests.queue_status(s.queues, s.queues_vl, only_at_target=False),
    "r22_long_running_requests": lambda s: requests.long_running_requests(
        s.requests, _users(s), s.responsibilities, s.programs, AS_OF),
    "r23_failed_requests": lambda s: requests.failed_requests(s.requests, s.programs, AS_OF),
    "r24_request_summary": lambda s: requests.request_summary(s.requests, AS_OF),
    "r24_request_summary_by_label": lambda s: requests.request_summary(s.requests, AS_OF, merge_labels=True),
    "r25_program_runs": lambda s: requests.program_runs(s.requests, s.programs, _users(s), AS_OF),
    "r26_latest_profile_changes": lambda s: requests.latest_profile_changes(
        s.profile_options, s.profile_values, s.profile_options_tl, _users(s)),
    "r26_latest_profile_changes_us": lambda s: requests.latest_profile_changes(
        s.profile_options, s.profile_values, s.profile_options_tl, _users(s), language="US"),
    "r26_profile_changes_last_2_days": lambda s: requests.latest_profile_changes(
        s.profile_options, s.profile_values, s.profile_options_tl, _users(s), days=2, as_of=AS_OF),
    "r27_component_status": lambda s: components.component_status(
        s.components, s.component_params, s.queues, s.services, s.param_defs, s.processes),
    "r27_component_status_with_processes": lambda s: components.component_status(
        s.components, s.component_params, s.queues, s.services, processes=s.processes,
        count_active_processes=True),
    "r28_mailer_status": lambda s: components.mailer_status(s.components),
    "m01_probe_status": lambda s: hosts.probe_status(s.probe_results),
    "m01_availability": lambda s: hosts.availability(s.probe_results),
    "m18_latest_probe_status": lambda s: hosts.latest_probe_status(s.probe_results),
    "m02_cpu_usage": lambda s: hosts.cpu_usage(s.cpu_samples),
    "m03_memory_usage": lambda s: hosts.memory_usage(s.mem_samples),
    "m04_swap_usage": lambda s: hosts.swap_usage(s.mem_samples),
    "m03_recent_memory": lambda s: hosts.recent_memory(s.mem_samples),
    "m05_filesystem_alerts": lambda s: hosts.filesystem_alerts(s.fs_usage),
    "m06_filesystem_usage": lambda s: hosts.filesystem_usage(s.fs_usage),
    "m07_load_average": lambda s: hosts.load_average(s.uptime_lines),
    "m08_uptime_by_host": lambda s: hosts.uptime_by_host(s.boot_samples, AS_OF),
    "m09_top_cpu_processes": lambda s: hosts.top_processes(s.proc_snapshot, "pcpu"),
    "m10_top_memory_processes": lambda s: hosts.top_processes(s.proc_snapshot, "pmem"),
    "m11_zombie_processes": lambda s: hosts.zombie_processes(s.proc_snapshot),
    "m12_processes_matching": lambda s: hosts.processes_matching(s.proc_snapshot),
    "m12_processes_matching_token": lambda s: hosts.processes_matching(s.proc_snapshot, token=True),
    "m13_thread_count": lambda s: hosts.thread_count(s.proc_snapshot, s.host_limits),
    "m14_listening_ports": lambda s: hosts.listening_ports(s.listeners),
    "m14_listening_ports_exact": lambda s: hosts.listening_ports(s.listeners, exact=True),
    "m14_missing_ports": lambda s: hosts.missing_ports(s.listeners, s.proc_snapshot),
    "m15_disk_average": lambda s: hosts.disk_average(s.disk_samples),
    "m16_vmstat_samples": lambda s: hosts.vmstat_samples(s.vmstat_lines),
    "m17_server_process_counts": lambda s: hosts.server_process_counts(s.proc_snapshot),
    "m19_logged_on_users": lambda s: hosts.logged_on_users(s.who_lines),
    "m19_logged_on_sessions": lambda s: co.who_sessions(s.who_lines),
    "s4_core_counts": lambda s: co.core_counts(s.proc_stat_lines),
    "s4_rejected_df_lines": lambda s: co.rejected_lines(s.df_lines, "df"),
    "s4_swap_usage_from_meminfo": lambda s: hosts.swap_usage(co.meminfo(s.meminfo_lines)),
    "s4_cpu_usage_from_proc_stat": lambda s: hosts.cpu_usage(co.proc_stat_cpu(s.proc_stat_lines)),
    "s4_memory_usage_from_free": lambda s: hosts.memory_usage(co.free_memory(s.free_lines)),
    "f13_filesystem_alerts_from_df": lambda s: hosts.filesystem_alerts(co.df_usage(s.df_lines)),
    "s3_top_cpu_processes_from_ps": lambda s: hosts.top_processes(co.ps_snapshot(s.ps_lines), "pcpu"),
    "s3_top_cpu_processes_from_files": lambda s: _top_from_files(s),
    "s3_log_tail_from_files": lambda s: _tail_from_files(s),
    "s3_listening_ports_from_netstat": lambda s: hosts.listening_ports(co.netstat_listeners(s.netstat_lines)),
    "s4_disk_average_from_sar": lambda s: hosts.disk_average(co.sar_disk(s.sar_lines)),
    "s4_uptime_from_uptime_p": lambda s: hosts.uptime_by_host(co.uptime_pretty(s.uptime_pretty_lines), AS_OF),
    "t1_error_counts_hourly": lambda s: streams.error_counts(s.alert_log),
    "t2_memory_window_avg": lambda s: streams.metric_window_avg(_mem_pct(s), "mem_pct"),
    "t3_memory_threshold_transitions": lambda s: streams.threshold_transitions_batch(
        _mem_pct(s), "mem_pct", 90.0),
    "t3_alerts_with_timeouts": lambda s: alerts.alert_transitions_batch(
        _alert_samples(s), silent=dt.timedelta(hours=12), now=parse_as_of(AS_OF)),
    "o1_block_corruption_ranked": lambda s: storage.block_corruption(s.block_corruption, ranked=True),
    "o2_backup_summary_ranked": lambda s: database.backup_summary(s.backup_jobs, AS_OF, ranked=True),
    "o3_queue_status_ranked": lambda s: requests.queue_status(s.queues, s.queues_vl, only_at_target=False, ranked=True),
    "o4_datafile_details_ranked": lambda s: storage.datafile_details(s.data_files, s.pdbs, ranked=True),
    "s7_findings": _findings,
}

QUERIES: dict[str, Query] = {name: Query(build, SQL.get(name)) for name, build in BUILDERS.items()}


def snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The logical tables of ``sf_dir``, defined anew so that files that have
    arrived since are read (the raw schemas are declared: no footer is read)."""
    return Snapshot(spark, sf_dir)


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = QUERIES[name].build
    return lambda spark, sf_dir: build(snapshot(spark, sf_dir))


def oracle(name: str) -> str | None:
    sql = QUERIES[name].sql
    return with_views(sql) if sql is not None else None

"""Declared schemas of the logical snapshot tables.

Operators read columns by name; ``conform`` checks a frame against its
declared schema at the edge (analysis only, no job): every declared column
must be present with a type that casts safely, extra columns are dropped, and
columns come out in declared order with the declared types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "containers": "con_id int, name string",
    "pdbs": "con_id int, name string",
    "data_files": "con_id int, tablespace_name string, file_id bigint, file_name string, status string, "
                  "autoextensible string, bytes bigint, maxbytes bigint",
    "free_space": "con_id int, tablespace_name string, bytes bigint",
    "temp_files": "con_id int, ts_no int, tablespace_name string, bytes bigint, maxbytes bigint, "
                  "block_size bigint",
    "tablespaces": "con_id int, ts_no int, name string",
    "sort_segment": "con_id int, tablespace_name string, used_blocks bigint",
    "archived_log": "completion_time timestamp_ntz, blocks bigint, block_size bigint",
    "recovery_dest": "name string, space_limit bigint, space_used bigint",
    "db_info": "dbid bigint, name string, created timestamp_ntz, log_mode string, open_mode string",
    "instance_info": "instance_name string, host_name string, version string, status string",
    "resource_limit": "resource_name string, current_utilization bigint, max_utilization bigint, "
                      "initial_allocation string, limit_value string",
    "block_corruption": "file_no bigint, block_no bigint, blocks bigint, corruption_change_no bigint, "
                        "corruption_type string",
    "db_objects": "con_id int, owner string, object_name string, object_type string, "
                  "last_ddl_time timestamp_ntz, status string",
    "backup_jobs": "session_key bigint, start_time timestamp_ntz, end_time timestamp_ntz, status string, "
                   "autobackup_done string, autobackup_count int, input_type string, elapsed_seconds bigint",
    "alert_log": "originating_timestamp timestamp_ntz, message_text string",
    "parameters": "name string, type string, value string",
    "redo_members": "group_no int, member string",
    "app_sessions": "session_id bigint, user_id bigint, last_connect timestamp_ntz, disabled_flag string, "
                    "pseudo_flag string, limit_time int, counter int, limit_connects int",
    "app_users": "user_id bigint, user_name string, description string",
    "db_sessions": "sid bigint, serial_no bigint, status string, username string, module string, "
                   "program string, machine string, last_call_et bigint",
    "queues": "queue_id bigint, application_id int, target_node string, running_processes int, "
              "max_processes int, enabled_flag string, manager_type int",
    "queues_vl": "queue_id bigint, user_queue_name string, control_code string",
    "requests": "request_id bigint, requested_by bigint, program_id bigint, application_id int, "
                "responsibility_id int, phase_code string, status_code string, request_date timestamp_ntz, "
                "requested_start_date timestamp_ntz, actual_start_date timestamp_ntz, "
                "actual_completion_date timestamp_ntz, completion_text string, description string, "
                "argument_text string",
    "programs": "program_id bigint, application_id int, language string, user_program_name string",
    "responsibilities": "responsibility_id int, responsibility_name string",
    "profile_options": "profile_option_id bigint, profile_option_name string",
    "profile_options_tl": "profile_option_name string, language string, user_profile_option_name string",
    "profile_values": "profile_option_id bigint, level_id int, profile_option_value string, "
                      "last_update_date timestamp_ntz, last_updated_by bigint",
    "components": "component_id bigint, component_name string, component_type string, "
                  "component_status string, inbound_agent_name string, outbound_agent_name string, "
                  "startup_mode string, sync_state string, queue_id bigint, last_update_date timestamp_ntz",
    "component_params": "component_id bigint, parameter_id bigint, parameter_name string",
    "param_defs": "parameter_id bigint",
    "services": "service_id int, service_handle string",
    "processes": "queue_id bigint, application_id int, process_status_code string",
    "probe_results": "host string, url string, ts timestamp_ntz, http_status int",
    "cpu_samples": "host string, ts timestamp_ntz, user bigint, nice bigint, system bigint, idle bigint, "
                   "iowait bigint, irq bigint, softirq bigint, steal bigint",
    "mem_samples": "host string, ts timestamp_ntz, mem_total bigint, mem_used bigint, swap_total bigint, "
                   "swap_used bigint",
    "fs_usage": "host string, filesystem string, size string, used string, available string, use_pct int, "
                "mounted_on string",
    "proc_snapshot": "host string, ruser string, pid bigint, ppid bigint, nice int, wchan string, pmem double, "
                     "pcpu double, cpu_time string, euser string, state string, flags string, start_time string, "
                     "thcount int, comm string",
    "listeners": "host string, proto string, port int",
    "disk_samples": "host string, ts timestamp_ntz, device string, tps double, rkb_s double, wkb_s double, "
                    "areq_sz double, aqu_sz double, await_ms double, util double",
    "host_log": "host string, line_no bigint, line string",
    "host_limits": "host string, max_user_processes bigint",
    "boot_samples": "host string, ts timestamp_ntz, boot_time timestamp_ntz",
    "uptime_lines": "host string, ts timestamp_ntz, line string",
    "vmstat_lines": "host string, line_no bigint, line string",
    "who_lines": "host string, line string",
}

NAMES = tuple(_DDL)


def schema(name: str) -> StructType:
    """Declared schema of a logical table (parsed on demand: DDL parsing
    needs an active session)."""
    return StructType.fromDDL(_DDL[name])

# widening casts that never lose information
_SAFE = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double"),
         ("int", "double"), ("bigint", "double")}


class SchemaError(ValueError):
    pass


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` projected onto the declared schema of logical table ``name``."""
    want = schema(name)
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = []
    for f in want.fields:
        t = f.dataType.simpleString()
        if f.name not in have:
            problems.append(f"missing {f.name} {t}")
        elif have[f.name] != t and (have[f.name], t) not in _SAFE:
            problems.append(f"{f.name}: {have[f.name]} is not {t}")
    if problems:
        raise SchemaError(f"{name}: " + "; ".join(problems))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields])

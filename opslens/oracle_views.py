"""The logical snapshot tables as SQL, for the independent DuckDB oracle.

Each entry is the SELECT that defines one logical table over the raw tables
(the same projection ``opslens.sources.fixtures.Snapshot`` builds with the
DataFrame API). ``with_views`` prefixes a query with the CTEs it needs, in
dependency order, so every oracle query runs on the raw tables alone.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    # storage
    "containers": "select r_regionkey + 1 as con_id, r_name as name from region",
    "pdbs": "select con_id, name from containers where con_id > 1",
    "li": """select n_regionkey + 1 as con_id, 'TS' || cast(l_partkey as varchar) as tablespace_name, l.*
        from lineitem l join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey""",
    "data_files": """select con_id, tablespace_name, l_orderkey * 10 + l_linenumber as file_id,
        '/data/' || cast(l_orderkey as varchar) || '_' || cast(l_linenumber as varchar) || '.dbf' as file_name,
        case when l_linestatus = 'O' then 'AVAILABLE' else 'INVALID' end as status,
        case when l_returnflag = 'A' then 'YES' else 'NO' end as autoextensible,
        cast(l_quantity as bigint) * 1048576 as bytes,
        cast(l_quantity as bigint) * 2097152 as maxbytes from li""",
    "free_space": """select con_id, tablespace_name, cast(l_quantity as bigint) * 1048576 as bytes
        from li where l_returnflag = 'R'""",
    "temp_files": """select n_regionkey + 1 as con_id, cast(s_suppkey % 3 as int) as ts_no,
        'TEMP' || cast(s_suppkey % 3 as varchar) as tablespace_name,
        (s_suppkey + 1) * 67108864 as bytes, (s_suppkey + 1) * 134217728 as maxbytes,
        cast(8192 as bigint) as block_size
        from supplier join nation on n_nationkey = s_nationkey""",
    "tablespaces": "select distinct con_id, ts_no, tablespace_name as name from temp_files",
    "sort_segment": """select con_id, tablespace_name, cast(count(*) * 1000 as bigint) as used_blocks
        from temp_files group by con_id, tablespace_name""",
    "archived_log": """select ts as completion_time, cast(floor(value * 100) as bigint) as blocks,
        cast(8192 as bigint) as block_size from events""",
    "recovery_dest": """select s_name as name, (s_suppkey + 10) * 1073741824 as space_limit,
        (s_suppkey + 10) * 536870912 as space_used from supplier""",
    # instance, objects, log
    "db_info": """select cast(n_nationkey as bigint) as dbid, n_name as name,
        timestamp '2024-01-01 00:00:00' as created,
        case when n_nationkey % 2 = 0 then 'ARCHIVELOG' else 'NOARCHIVELOG' end as log_mode,
        'READ WRITE' as open_mode from nation""",
    "instance_info": """select n_name as instance_name, 'host' || cast(n_nationkey as varchar) as host_name,
        '19.0' as version, 'OPEN' as status from nation""",
    "resource_limit": """select case cast(p_partkey % 6 as int) when 0 then 'processes' when 1 then 'sessions'
            when 2 then 'parallel_max_servers' when 3 then 'enqueue_resources' when 4 then 'transactions'
            else 'branches' end as resource_name,
        cast(p_size as bigint) as current_utilization, cast(p_size as bigint) + 10 as max_utilization,
        '100' as initial_allocation,
        case when p_partkey % 7 = 0 then ' UNLIMITED' else '200' end as limit_value from part""",
    "block_corruption": """select l_orderkey as file_no, cast(l_linenumber as bigint) as block_no,
        cast(l_quantity as bigint) as blocks, l_partkey as corruption_change_no,
        'CHECKSUM' as corruption_type from lineitem where l_quantity = 50 and l_returnflag = 'A'""",
    "db_objects": """select cast(o_custkey % 5 as int) + 1 as con_id, 'OWNER' || cast(o_custkey // 8 as varchar) as owner,
        'OBJ' || cast(o_orderkey as varchar) as object_name,
        case when o_orderkey % 2 = 0 then 'VIEW' else 'PACKAGE BODY' end as object_type,
        o_orderdate as last_ddl_time,
        case when o_orderstatus = 'P' then 'INVALID' else 'VALID' end as status from orders""",
    "backup_jobs": """select event_id as session_key, ts as start_time,
        ts + (event_id % 90) * interval '1' minute as end_time,
        case when event_type = 'error' then 'FAILED' else 'COMPLETED' end as status,
        case when event_id % 2 = 0 then 'YES' else 'NO' end as autobackup_done,
        cast(event_id % 3 as int) as autobackup_count, 'DB INCR' as input_type,
        (event_id % 90) * 60 as elapsed_seconds from events""",
    "alert_log": """select ts as originating_timestamp,
        case when event_type = 'error'
             then 'ORA-' || lpad(cast(event_id % 1000 as varchar), 5, '0') || ': ' || props
             else event_type || ' ' || props end as message_text from events""",
    "parameters": """select case when p_size % 4 = 0 then 'sga_target_' when p_size % 4 = 1 then 'pga_aggregate_'
            when p_size % 4 = 2 then 'job_queue_processes_' else 'open_cursors_' end
            || cast(p_partkey as varchar) as name,
        'big integer' as type, cast(p_size as varchar) as value from part""",
    "redo_members": """select cast(s_suppkey % 4 as int) as group_no, '/redo/' || s_name as member
        from supplier""",
    # application tier
    "app_sessions": """select event_id as session_id, user_id, ts as last_connect,
        case when event_id % 17 = 0 then null when event_id % 10 = 0 then 'Y' else 'N' end as disabled_flag,
        case when event_type = 'signup' then 'Y' else 'N' end as pseudo_flag,
        cast(4 + event_id % 40 as int) as limit_time, cast(event_id % 50 as int) as counter,
        45 as limit_connects from events""",
    "app_users": """select c_custkey as user_id, case when c_custkey = 0 then 'GUEST' else c_name end as user_name,
        c_mktsegment as description from customer""",
    "db_sessions": """select o_orderkey as sid, o_custkey as serial_no,
        case o_orderstatus when 'O' then 'INACTIVE' else 'ACTIVE' end as status,
        case when o_custkey % 2 = 0 then 'APPS' else 'SYS' end as username,
        o_orderpriority as module, 'prog' || cast(o_custkey % 7 as varchar) as program,
        'host' || cast(o_custkey // 8 as varchar) as machine,
        cast(floor(o_totalprice) as bigint) as last_call_et from orders""",
    "queues": """select s_suppkey as queue_id, cast(s_suppkey % 2 as int) as application_id,
        'node' || cast(s_nationkey % 3 as varchar) as target_node,
        cast(s_nationkey % 3 as int) as running_processes, cast(s_suppkey % 3 as int) as max_processes,
        'Y' as enabled_flag, cast(s_suppkey % 2 as int) as manager_type from supplier""",
    "queues_vl": """select s_suppkey as queue_id, s_name as user_queue_name,
        case when s_suppkey % 4 = 0 then null
             else substr('DENAXTVOPQR', cast(s_suppkey % 11 + 1 as int), 1) end as control_code
        from supplier""",
    "requests": """select event_id as request_id, user_id as requested_by, user_id as program_id,
        cast(event_id % 2 as int) as application_id, cast(event_id % 25 as int) as responsibility_id,
        case when event_id % 4 = 3 then null else substr('RIC', cast(event_id % 4 + 1 as int), 1) end as phase_code,
        substr('DUEMRICHWBPQSXTAZG', cast(event_id % 18 + 1 as int), 1) as status_code,
        ts - interval '5' minute as request_date, ts as requested_start_date,
        ts + (event_id % 30) * interval '1' minute as actual_start_date,
        ts + (event_id % 30 + 7) * interval '1' minute as actual_completion_date,
        event_type || ' done' as completion_text, 'set ' || cast(event_id % 5 as varchar) as description,
        case when event_id % 3 = 0 then 'a,b,c,d,e,f,g,h,i' else 'a,b' end as argument_text from events""",
    "programs": """select p_partkey as program_id, cast(p_partkey % 2 as int) as application_id,
        case when p_size % 2 = 0 then 'US' else 'D' end as language,
        case when p_partkey % 10 = 3 then 'Report Set' when p_partkey % 10 = 4 then 'Gather Schema Statistics'
             else p_name end as user_program_name from part""",
    "responsibilities": """select n_nationkey as responsibility_id, n_name as responsibility_name
        from nation""",
    "profile_options": """select p_partkey as profile_option_id,
        'OPT' || cast(p_partkey as varchar) as profile_option_name from part""",
    "profile_options_tl": """select 'OPT' || cast(p_partkey as varchar) as profile_option_name,
        lang as language, p_name || ' ' || lang as user_profile_option_name
        from part, (select 'US' as lang union all select 'D' as lang) l""",
    "profile_values": """select user_id as profile_option_id, cast(10001 + event_id % 8 as int) as level_id,
        props as profile_option_value, ts as last_update_date, user_id as last_updated_by from events""",
    "components": """select s_suppkey as component_id, 'comp ' || s_name as component_name,
        case when s_suppkey % 5 = 0 then 'WF_MAILER' when s_suppkey % 5 = 1 then 'FND_MCS_PUSH_NTF_PROVIDER'
             else 'WF_AGENT_LISTENER' end as component_type,
        case when s_acctbal > 3000 then 'RUNNING' when s_acctbal > 0 then 'STOPPED' else null end
            as component_status,
        'IN' as inbound_agent_name, 'OUT' as outbound_agent_name, 'AUTOMATIC' as startup_mode,
        case when s_suppkey % 10 = 9 then 'STALE' else 'UPDATED' end as sync_state,
        s_suppkey as queue_id, timestamp '2024-01-15 00:00:00' as last_update_date from supplier""",
    "component_params": """select s_suppkey as component_id, s_suppkey * 10 + k as parameter_id,
        case when k = 0 then 'PROCESSOR_IN_THREAD_COUNT' else 'OTHER' end as parameter_name
        from supplier, (select 0 as k union all select 1 as k) x""",
    "param_defs": "select parameter_id from component_params",
    "services": """select 0 as service_id, 'FNDCPGSC' as service_handle
        union all select 1 as service_id, 'OTHER' as service_handle""",
    "processes": """select s_suppkey as queue_id, cast(s_suppkey % 2 as int) as application_id,
        case when k = 0 then 'A' else 'K' end as process_status_code
        from supplier, (select 0 as k union all select 1 as k union all select 2 as k) x""",
    # hosts
    "probe_results": """select 'host' || cast(user_id // 2 as varchar) as host,
        'http://host' || cast(user_id // 2 as varchar) || '/u' || cast(event_id % 2 as varchar) as url, ts,
        case event_type when 'error' then 503 when 'signup' then 404 else 200 end as http_status
        from events""",
    "cpu_samples": """select 'host' || cast(user_id // 2 as varchar) as host, ts, event_id * 3 as "user",
        event_id as nice, event_id * 2 as system, event_id * 7 as idle, event_id as iowait,
        cast(0 as bigint) as irq, event_id as softirq, cast(0 as bigint) as steal from events""",
    "mem_samples": """select 'host' || cast(user_id // 2 as varchar) as host, ts,
        cast(16384 as bigint) as mem_total, event_id * 37 % 16384 as mem_used,
        case when (user_id // 2) % 10 = 0 then 0 else 4096 end as swap_total,
        event_id * 11 % 4096 as swap_used from events""",
    "fs_usage": """select 'host' || cast(c_custkey // 8 as varchar) as host,
        case when c_custkey % 9 = 0 then 'tmpfs' when c_custkey % 11 = 0 then '/dev/cdrom'
             else '/dev/sd' || cast(c_custkey as varchar) end as filesystem,
        '100G' as size, cast(c_custkey % 101 as varchar) || 'G' as used, cast(100 - c_custkey % 101 as varchar) || 'G' as available,
        cast(c_custkey % 101 as int) as use_pct,
        '/mnt/' || case when c_custkey % 9 = 0 then 'tmpfs' when c_custkey % 11 = 0 then '_dev_cdrom'
             else '_dev_sd' || cast(c_custkey as varchar) end as mounted_on from customer""",
    "proc_snapshot": """select 'host' || cast(o_custkey // 8 as varchar) as host, o_orderkey as pid,
        case o_orderkey % 2 when 0 then 'oracle' else 'applmgr' end as ruser, cast(o_custkey as bigint) as ppid,
        cast(o_orderkey % 20 as int) as nice, case o_orderkey % 3 when 0 then '-' else 'ep_poll' end as wchan,
        lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':00' as cpu_time,
        case o_orderkey % 2 when 0 then 'oracle' else 'applmgr' end as euser, cast(o_orderkey % 5 as varchar) as flags,
        lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') as start_time,
        o_totalprice / 10000 as pcpu, o_totalprice / 20000 as pmem,
        case when o_orderkey % 50 = 0 then 'Z' else 'S' end as state,
        cast(o_orderkey % 12 as int) as thcount,
        case cast(o_orderkey % 6 as int) when 0 then 'smon' when 1 then 'ora_smon_X' when 2 then 'tnslsnr'
             when 3 then 'oacore_server' when 4 then 'forms_server' else 'oafm_server' end as comm
        from orders""",
    "listeners": """select 'host' || cast(p_partkey // 8 as varchar) as host, 'tcp' as proto,
        case cast(p_size % 5 as int) when 0 then 7052 when 1 then 8050 when 2 then 1571
             when 3 then 17052 else 22 end as port from part""",
    "disk_samples": """select 'host' || cast(user_id // 2 as varchar) as host, ts,
        'sd' || cast(event_id % 3 as varchar) as device, value as tps, value * 8 as rkb_s, value * 4 as wkb_s,
        value / 2 as areq_sz, value / 64 as aqu_sz, value / 16 as await_ms, value / 5 as util from events""",
    "host_log": """select 'host' || cast(user_id // 2 as varchar) as host, event_id as line_no,
        event_type || ' ' || props as line from events""",
    "uptime_lines": """select 'host' || cast(user_id // 2 as varchar) as host, ts,
        ' 10:00:00 up ' || cast(event_id % 30 as varchar) || ' days, '
        || cast(user_id % 5 + 1 as varchar) || ' users,  load average: '
        || cast(event_id % 7 as varchar) || '.' || lpad(cast(event_id % 100 as varchar), 2, '0') || ', '
        || cast(event_id % 5 as varchar) || '.' || lpad(cast(event_id % 100 as varchar), 2, '0') || ', '
        || cast(event_id % 3 as varchar) || '.' || lpad(cast(event_id % 100 as varchar), 2, '0') as line
        from events""",
    "boot_samples": """select 'host' || cast(user_id // 2 as varchar) as host, ts,
        ts - cast(event_id % 97 as int) * interval '1' hour as boot_time from events""",
    "host_limits": """select distinct 'host' || cast(c_custkey // 8 as varchar) as host,
        cast(4096 * (1 + (c_custkey // 8) % 3) as bigint) as max_user_processes from customer""",
    "vmstat_lines": """select 'host' || cast(user_id // 2 as varchar) as host, event_id as line_no,
        ' ' || concat_ws('  ', cast(event_id % 5 as varchar), cast(event_id % 2 as varchar), '0',
            cast(1000 + event_id % 500 as varchar), '100', cast(2000 + event_id % 300 as varchar), '0', '0',
            cast(event_id % 50 as varchar), cast(event_id % 70 as varchar),
            cast(500 + event_id % 100 as varchar), cast(900 + event_id % 200 as varchar),
            cast(event_id % 40 as varchar), cast(event_id % 10 as varchar),
            cast(100 - event_id % 40 - event_id % 10 as varchar), '0', '0')
        || ' ' || strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') as line from events
        union all
        select h.host, cast(k as bigint) as line_no,
            case when k = -2 then '--procs-- -----------memory---------- ---swap-- -----io---- -system-- --------cpu-------- -----timestamp-----'
                 else ' r  b  swpd  free  buff  cache  si  so  bi  bo  in  cs us sy id wa st UTC' end as line
        from (select distinct 'host' || cast(user_id // 2 as varchar) as host from events) h,
             (select -2 as k union all select -1 as k) hk
        union all
        select distinct 'host' || cast(user_id // 2 as varchar), cast(-3 as bigint), ' 1  0  1000' from events""",
    "who_lines": """select 'host' || cast(user_id // 2 as varchar) as host,
        'u' || cast(user_id % 3 as varchar) || '   pts/' || cast(event_id % 4 as varchar) || '  '
        || strftime(ts, '%Y-%m-%d %H:%M') || ' 00:' || lpad(cast(event_id % 60 as varchar), 2, '0') || '   '
        || cast(event_id as varchar) as line from events""",
}

_WORD = re.compile(r"[a-z_]+")


def _deps(name: str) -> list[str]:
    words = set(_WORD.findall(VIEWS[name].lower()))
    return [v for v in VIEWS if v != name and v in words]


def with_views(body: str) -> str:
    """``WITH <needed views> <body>``: every logical table named in ``body``
    (and the ones those need) becomes a CTE over the raw tables."""
    words = set(_WORD.findall(body.lower()))
    order: list[str] = []

    def visit(v: str) -> None:
        if v in order:
            return
        for d in _deps(v):
            visit(d)
        order.append(v)

    for v in VIEWS:
        if v in words:
            visit(v)
    if not order:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order)
    stripped = body.lstrip()
    if stripped[:4].lower() == "with" and not stripped[4:5].isalnum():
        return f"WITH {ctes},\n{stripped[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"

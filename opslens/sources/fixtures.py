"""Logical snapshot tables derived from the raw tables by projection.

The reports read catalog views of databases (data files, sessions, requests
...) and samples of hosts. For tests and the bench these tables are derived
from the raw snapshot tables by pure projections (joins only where a column
has to come from a dimension), so that the same derivation can be written in
SQL for the independent oracle. Each property is lazy: nothing is read until
an operator's plan runs, and Catalyst prunes every column the report does not
use.

Joins to ``nation`` / ``region`` use ``broadcast_if_small``: both are fixed
size by construction, and the size is still checked against the plan's
statistics before the hint is given.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.plans.joins import broadcast_if_small
from opslens.sources.tables import read_table

MIB = 1048576


def _s(c: str | Column) -> Column:
    """Integer column as text."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


#: Users, customers, orders' customers and parts of one host: hosts grow with the tables.
USERS_PER_HOST, KEYS_PER_HOST = 2, 8


def _host(c: str) -> Column:
    each = USERS_PER_HOST if c == "user_id" else KEYS_PER_HOST
    return F.concat(F.lit("host"), _s(F.floor(F.col(c) / each).cast("bigint"))).alias("host")


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def _explode_ints(name: str, values: list[int]) -> Column:
    """A small constant fan-out (k = 0..n-1) without a cross join."""
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


class Snapshot:
    """All logical tables of one snapshot directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, overrides: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        # raw tables supplied by the caller instead of read from ``sf_dir``;
        # a streaming ``events`` frame makes every event-derived table a stream
        self.overrides = dict(overrides or {})

    def raw(self, name: str) -> DataFrame:
        if name in self.overrides:
            return self.overrides[name]
        return read_table(self.spark, self.sf_dir, name)

    def register_views(self, names=None) -> list[str]:
        """Register logical tables as temporary views so reports can also be
        written in Spark SQL (the plans are the same as the DataFrame ones)."""
        from opslens.sources.schemas import NAMES
        out = []
        for n in names or NAMES:
            getattr(self, n).createOrReplaceTempView(n)
            out.append(n)
        return out

    # ------------------------------------------------------------- storage

    @cached_property
    def containers(self) -> DataFrame:
        r = self.raw("region")
        return r.select((F.col("r_regionkey") + 1).alias("con_id"), F.col("r_name").alias("name"))

    @cached_property
    def pdbs(self) -> DataFrame:
        return self.containers.where(F.col("con_id") > 1)

    @cached_property
    def _supplier_region(self) -> DataFrame:
        n = broadcast_if_small(self.raw("nation").select("n_nationkey", "n_regionkey"))
        s = self.raw("supplier")
        return s.join(n, s.s_nationkey == n.n_nationkey).withColumn(
            "con_id", F.col("n_regionkey") + 1)

    @cached_property
    def _li(self) -> DataFrame:
        """Files and free extents: a tablespace per part, so some have few
        files and some of these no free extent."""
        li = self.raw("lineitem").withColumn("tablespace_name", F.concat(F.lit("TS"), _s("l_partkey")))
        sr = self._supplier_region.select("s_suppkey", "con_id")
        return li.join(sr, li.l_suppkey == sr.s_suppkey)

    @cached_property
    def data_files(self) -> DataFrame:
        q = F.col("l_quantity").cast("bigint")
        return self._li.select(
            "con_id", "tablespace_name",
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"),
            F.concat(F.lit("/data/"), _s("l_orderkey"), F.lit("_"), _s("l_linenumber"),
                     F.lit(".dbf")).alias("file_name"),
            F.when(F.col("l_linestatus") == "O", "AVAILABLE").otherwise("INVALID").alias("status"),
            F.when(F.col("l_returnflag") == "A", "YES").otherwise("NO").alias("autoextensible"),
            (q * MIB).alias("bytes"),
            (q * 2 * MIB).alias("maxbytes"))

    @cached_property
    def free_space(self) -> DataFrame:
        return (self._li
                .where(F.col("l_returnflag") == "R")
                .select("con_id", "tablespace_name",
                        (F.col("l_quantity").cast("bigint") * MIB).alias("bytes")))

    @cached_property
    def temp_files(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self._supplier_region.select(
            "con_id", (k % 3).cast("int").alias("ts_no"),
            F.concat(F.lit("TEMP"), _s(k % 3)).alias("tablespace_name"),
            ((k + 1) * 67108864).alias("bytes"), ((k + 1) * 134217728).alias("maxbytes"),
            F.lit(8192).cast("bigint").alias("block_size"))

    @cached_property
    def tablespaces(self) -> DataFrame:
        return self.temp_files.select("con_id", "ts_no", F.col("tablespace_name").alias("name")).distinct()

    @cached_property
    def sort_segment(self) -> DataFrame:
        return (self.temp_files.groupBy("con_id", "tablespace_name")
                .agg((F.count(F.lit(1)) * 1000).cast("bigint").alias("used_blocks")))

    @cached_property
    def archived_log(self) -> DataFrame:
        return self.raw("events").select(
            F.col("ts").alias("completion_time"),
            F.floor(F.col("value") * 100).cast("bigint").alias("blocks"),
            F.lit(8192).cast("bigint").alias("block_size"))

    @cached_property
    def recovery_dest(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            F.col("s_name").alias("name"), ((k + 10) * 1073741824).alias("space_limit"),
            ((k + 10) * 536870912).alias("space_used"))

    # ------------------------------------------------ instance, objects, log

    @cached_property
    def db_info(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.raw("nation").select(
            k.cast("bigint").alias("dbid"), F.col("n_name").alias("name"),
            F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("created"),
            F.when(k % 2 == 0, "ARCHIVELOG").otherwise("NOARCHIVELOG").alias("log_mode"),
            F.lit("READ WRITE").alias("open_mode"))

    @cached_property
    def instance_info(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_name").alias("instance_name"),
            F.concat(F.lit("host"), _s("n_nationkey")).alias("host_name"),
            F.lit("19.0").alias("version"), F.lit("OPEN").alias("status"))

    @cached_property
    def resource_limit(self) -> DataFrame:
        k = F.col("p_partkey")
        m = (k % 6).cast("int")
        name = (F.when(m == 0, "processes").when(m == 1, "sessions")
                 .when(m == 2, "parallel_max_servers").when(m == 3, "enqueue_resources")
                 .when(m == 4, "transactions").otherwise("branches"))
        size = F.col("p_size").cast("bigint")
        return self.raw("part").select(
            name.alias("resource_name"), size.alias("current_utilization"),
            (size + 10).alias("max_utilization"), F.lit("100").alias("initial_allocation"),
            F.when(k % 7 == 0, " UNLIMITED").otherwise("200").alias("limit_value"))

    @cached_property
    def block_corruption(self) -> DataFrame:
        """Corrupt blocks are few on any database: here the full-quantity
        returned lines, about one line in 200."""
        li = self.raw("lineitem")
        return li.where((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "A")).select(
            F.col("l_orderkey").alias("file_no"), F.col("l_linenumber").cast("bigint").alias("block_no"),
            F.col("l_quantity").cast("bigint").alias("blocks"),
            F.col("l_partkey").alias("corruption_change_no"),
            F.lit("CHECKSUM").alias("corruption_type"))

    @cached_property
    def db_objects(self) -> DataFrame:
        c, o = F.col("o_custkey"), F.col("o_orderkey")
        return self.raw("orders").select(
            ((c % 5).cast("int") + 1).alias("con_id"),
            F.concat(F.lit("OWNER"), _s(F.floor(c / KEYS_PER_HOST).cast("bigint"))).alias("owner"),
            F.concat(F.lit("OBJ"), _s(o)).alias("object_name"),
            F.when(o % 2 == 0, "VIEW").otherwise("PACKAGE BODY").alias("object_type"),
            F.col("o_orderdate").alias("last_ddl_time"),
            F.when(F.col("o_orderstatus") == "P", "INVALID").otherwise("VALID").alias("status"))

    @cached_property
    def backup_jobs(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            e.alias("session_key"), F.col("ts").alias("start_time"),
            (F.col("ts") + _minutes(e % 90)).alias("end_time"),
            F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"),
            F.when(e % 2 == 0, "YES").otherwise("NO").alias("autobackup_done"),
            (e % 3).cast("int").alias("autobackup_count"), F.lit("DB INCR").alias("input_type"),
            ((e % 90) * 60).alias("elapsed_seconds"))

    @cached_property
    def alert_log(self) -> DataFrame:
        e = F.col("event_id")
        msg = F.when(F.col("event_type") == "error",
                     F.concat(F.lit("ORA-"), F.lpad(_s(e % 1000), 5, "0"), F.lit(": "), F.col("props"))
                     ).otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("props")))
        return self.raw("events").select(F.col("ts").alias("originating_timestamp"),
                                         msg.alias("message_text"))

    @cached_property
    def parameters(self) -> DataFrame:
        m = F.col("p_size") % 4
        prefix = (F.when(m == 0, "sga_target_").when(m == 1, "pga_aggregate_")
                   .when(m == 2, "job_queue_processes_").otherwise("open_cursors_"))
        return self.raw("part").select(
            F.concat(prefix, _s("p_partkey")).alias("name"), F.lit("big integer").alias("type"),
            _s("p_size").alias("value"))

    @cached_property
    def redo_members(self) -> DataFrame:
        return self.raw("supplier").select(
            (F.col("s_suppkey") % 4).cast("int").alias("group_no"),
            F.concat(F.lit("/redo/"), F.col("s_name")).alias("member"))

    # --------------------------------------------------- application tier

    @cached_property
    def app_sessions(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            e.alias("session_id"), "user_id", F.col("ts").alias("last_connect"),
            F.when(e % 17 == 0, F.lit(None).cast("string")).when(e % 10 == 0, "Y")
             .otherwise("N").alias("disabled_flag"),
            F.when(F.col("event_type") == "signup", "Y").otherwise("N").alias("pseudo_flag"),
            (4 + e % 40).cast("int").alias("limit_time"), (e % 50).cast("int").alias("counter"),
            F.lit(45).alias("limit_connects"))

    @cached_property
    def session_responsibilities(self) -> DataFrame:
        """The responsibility each user works under."""
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("responsibility_id"))

    @cached_property
    def profile_settings(self) -> DataFrame:
        """Session time-outs in minutes, set for users in credit (but not for all of them), for some
        responsibilities, and for the site; another setting beside them."""
        c, n = self.raw("customer"), self.raw("nation")
        per_user = c.select(F.lit("SESSION_TIMEOUT").alias("setting"), F.lit(10004).alias("level_id"), F.col("c_custkey").alias("level_value"),
                            F.when(F.col("c_acctbal") > 5000, F.floor(F.col("c_acctbal") / 4).cast("double")).alias("value"))
        per_resp = n.select(F.lit("SESSION_TIMEOUT"), F.lit(10003), F.col("n_nationkey").cast("bigint"),
                            F.when(F.col("n_regionkey") > 1, 600.0 + 60 * F.col("n_nationkey")))
        site = self.raw("region").groupBy().agg(F.lit("SESSION_TIMEOUT"), F.lit(10001), F.lit(0).cast("bigint"), 90.0 + F.max("r_regionkey"))
        other = c.select(F.lit("OTHER"), F.lit(10004), F.col("c_custkey"), F.lit(1.0))
        return per_user.union(per_resp).union(site).union(other)

    @cached_property
    def app_users(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.raw("customer").select(
            c.alias("user_id"), F.when(c == 0, "GUEST").otherwise(F.col("c_name")).alias("user_name"),
            F.col("c_mktsegment").alias("description"))

    @cached_property
    def db_sessions(self) -> DataFrame:
        c = F.col("o_custkey")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("sid"), c.alias("serial_no"),
            F.when(F.col("o_orderstatus") == "O", "INACTIVE").otherwise("ACTIVE").alias("status"),
            F.when(c % 2 == 0, "APPS").otherwise("SYS").alias("username"),
            F.col("o_orderpriority").alias("module"),
            F.concat(F.lit("prog"), _s(c % 7)).alias("program"),
            _host("o_custkey").alias("machine"),
            F.floor("o_totalprice").cast("bigint").alias("last_call_et"))

    @cached_property
    def queues(self) -> DataFrame:
        k, n = F.col("s_suppkey"), F.col("s_nationkey")
        return self.raw("supplier").select(
            k.alias("queue_id"), (k % 2).cast("int").alias("application_id"),
            F.concat(F.lit("node"), _s(n % 3)).alias("target_node"),
            (n % 3).cast("int").alias("running_processes"), (k % 3).cast("int").alias("max_processes"),
            F.lit("Y").alias("enabled_flag"), (k % 2).cast("int").alias("manager_type"))

    @cached_property
    def queues_vl(self) -> DataFrame:
        k = F.col("s_suppkey")
        code = F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(
            F.substring(F.lit("DENAXTVOPQR"), (k % 11 + 1).cast("int"), 1))
        return self.raw("supplier").select(k.alias("queue_id"), F.col("s_name").alias("user_queue_name"),
                                           code.alias("control_code"))

    @cached_property
    def requests(self) -> DataFrame:
        e, ts = F.col("event_id"), F.col("ts")
        phase = F.when(e % 4 == 3, F.lit(None).cast("string")).otherwise(
            F.substring(F.lit("RIC"), (e % 4 + 1).cast("int"), 1))
        status = F.substring(F.lit("DUEMRICHWBPQSXTAZG"), (e % 18 + 1).cast("int"), 1)
        return self.raw("events").select(
            e.alias("request_id"), F.col("user_id").alias("requested_by"),
            F.col("user_id").alias("program_id"), (e % 2).cast("int").alias("application_id"),
            (e % 25).cast("int").alias("responsibility_id"),
            phase.alias("phase_code"), status.alias("status_code"),
            (ts - _minutes(F.lit(5))).alias("request_date"), ts.alias("requested_start_date"),
            (ts + _minutes(e % 30)).alias("actual_start_date"),
            (ts + _minutes(e % 30 + 7)).alias("actual_completion_date"),
            F.concat(F.col("event_type"), F.lit(" done")).alias("completion_text"),
            F.concat(F.lit("set "), _s(e % 5)).alias("description"),
            F.when(e % 3 == 0, "a,b,c,d,e,f,g,h,i").otherwise("a,b").alias("argument_text"))

    @cached_property
    def programs(self) -> DataFrame:
        k = F.col("p_partkey")
        name = (F.when(k % 10 == 3, "Report Set").when(k % 10 == 4, "Gather Schema Statistics")
                 .otherwise(F.col("p_name")))
        return self.raw("part").select(
            k.alias("program_id"), (k % 2).cast("int").alias("application_id"),
            F.when(F.col("p_size") % 2 == 0, "US").otherwise("D").alias("language"),
            name.alias("user_program_name"))

    @cached_property
    def responsibilities(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("responsibility_id"),
                                         F.col("n_name").alias("responsibility_name"))

    @cached_property
    def profile_options(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("profile_option_id"),
            F.concat(F.lit("OPT"), _s("p_partkey")).alias("profile_option_name"))

    @cached_property
    def profile_options_tl(self) -> DataFrame:
        langs = F.explode(F.array(F.lit("US"), F.lit("D"))).alias("language")
        return (self.raw("part").select("p_partkey", "p_name", langs)
                .select(F.concat(F.lit("OPT"), _s("p_partkey")).alias("profile_option_name"),
                        "language",
                        F.concat(F.col("p_name"), F.lit(" "), F.col("language"))
                        .alias("user_profile_option_name")))

    @cached_property
    def profile_values(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            F.col("user_id").alias("profile_option_id"), (10001 + e % 8).cast("int").alias("level_id"),
            F.col("props").alias("profile_option_value"), F.col("ts").alias("last_update_date"),
            F.col("user_id").alias("last_updated_by"))

    @cached_property
    def components(self) -> DataFrame:
        k, bal = F.col("s_suppkey"), F.col("s_acctbal")
        ctype = (F.when(k % 5 == 0, "WF_MAILER").when(k % 5 == 1, "FND_MCS_PUSH_NTF_PROVIDER")
                  .otherwise("WF_AGENT_LISTENER"))
        status = F.when(bal > 3000, "RUNNING").when(bal > 0, "STOPPED").otherwise(F.lit(None).cast("string"))
        return self.raw("supplier").select(
            k.alias("component_id"), F.concat(F.lit("comp "), F.col("s_name")).alias("component_name"),
            ctype.alias("component_type"), status.alias("component_status"),
            F.lit("IN").alias("inbound_agent_name"), F.lit("OUT").alias("outbound_agent_name"),
            F.lit("AUTOMATIC").alias("startup_mode"),
            F.when(k % 10 == 9, "STALE").otherwise("UPDATED").alias("sync_state"),
            k.alias("queue_id"),
            F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'").alias("last_update_date"))

    @cached_property
    def component_params(self) -> DataFrame:
        return (self.raw("supplier").select("s_suppkey", _explode_ints("k", [0, 1]))
                .select(F.col("s_suppkey").alias("component_id"),
                        (F.col("s_suppkey") * 10 + F.col("k")).alias("parameter_id"),
                        F.when(F.col("k") == 0, "PROCESSOR_IN_THREAD_COUNT").otherwise("OTHER")
                        .alias("parameter_name")))

    @cached_property
    def param_defs(self) -> DataFrame:
        return self.component_params.select("parameter_id")

    @cached_property
    def services(self) -> DataFrame:
        # a two-row service catalog (fixed by the fixture definition)
        return self.spark.createDataFrame([(0, "FNDCPGSC"), (1, "OTHER")],
                                          "service_id int, service_handle string")

    @cached_property
    def processes(self) -> DataFrame:
        return (self.raw("supplier").select("s_suppkey", _explode_ints("k", [0, 1, 2]))
                .select(F.col("s_suppkey").alias("queue_id"),
                        (F.col("s_suppkey") % 2).cast("int").alias("application_id"),
                        F.when(F.col("k") == 0, "A").otherwise("K").alias("process_status_code")))

    # -------------------------------------------------------------- hosts

    @cached_property
    def probe_results(self) -> DataFrame:
        t = F.col("event_type")
        return self.raw("events").select(
            _host("user_id"), F.concat(F.lit("http://"), _host("user_id"), F.lit("/u"), _s(F.col("event_id") % 2)).alias("url"), "ts",
            F.when(t == "error", 503).when(t == "signup", 404).otherwise(200).alias("http_status"))

    @cached_property
    def cpu_samples(self) -> DataFrame:
        e = F.col("event_id")
        zero = F.lit(0).cast("bigint")
        return self.raw("events").select(
            _host("user_id"), "ts", (e * 3).alias("user"), e.alias("nice"), (e * 2).alias("system"),
            (e * 7).alias("idle"), e.alias("iowait"), zero.alias("irq"), e.alias("softirq"),
            zero.alias("steal"))

    @cached_property
    def mem_samples(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            _host("user_id"), "ts", F.lit(16384).cast("bigint").alias("mem_total"),
            (e * 37 % 16384).alias("mem_used"),
            F.when(F.floor(F.col("user_id") / USERS_PER_HOST) % 10 == 0, 0).otherwise(4096).alias("swap_total"),
            (e * 11 % 4096).alias("swap_used"))

    @cached_property
    def fs_usage(self) -> DataFrame:
        c = F.col("c_custkey")
        fs = (F.when(c % 9 == 0, "tmpfs").when(c % 11 == 0, "/dev/cdrom")
               .otherwise(F.concat(F.lit("/dev/sd"), _s(c))))
        pct = (c % 101).cast("int")
        return self.raw("customer").select(
            _host("c_custkey"), fs.alias("filesystem"), F.lit("100G").alias("size"), F.concat(_s(pct), F.lit("G")).alias("used"),
            F.concat(_s(100 - pct), F.lit("G")).alias("available"), pct.alias("use_pct"),
            F.concat(F.lit("/mnt/"), F.regexp_replace(fs, "/", "_")).alias("mounted_on"))

    @cached_property
    def proc_snapshot(self) -> DataFrame:
        o = F.col("o_orderkey")
        m = (o % 6).cast("int")
        comm = (F.when(m == 0, "smon").when(m == 1, "ora_smon_X").when(m == 2, "tnslsnr")
                 .when(m == 3, "oacore_server").when(m == 4, "forms_server").otherwise("oafm_server"))
        user = F.when(o % 2 == 0, "oracle").otherwise("applmgr")
        clock = F.concat(F.lpad(_s(o % 24), 2, "0"), F.lit(":"), F.lpad(_s(o % 60), 2, "0"))
        return self.raw("orders").select(
            _host("o_custkey"), user.alias("ruser"), o.alias("pid"), F.col("o_custkey").cast("bigint").alias("ppid"),
            (o % 20).cast("int").alias("nice"), F.when(o % 3 == 0, "-").otherwise("ep_poll").alias("wchan"),
            (F.col("o_totalprice") / 20000).alias("pmem"), (F.col("o_totalprice") / 10000).alias("pcpu"),
            F.concat(clock, F.lit(":00")).alias("cpu_time"), user.alias("euser"),
            F.when(o % 50 == 0, "Z").otherwise("S").alias("state"), _s(o % 5).alias("flags"), clock.alias("start_time"),
            (o % 12).cast("int").alias("thcount"), comm.alias("comm"))

    @cached_property
    def listeners(self) -> DataFrame:
        m = (F.col("p_size") % 5).cast("int")
        port = (F.when(m == 0, 7052).when(m == 1, 8050).when(m == 2, 1571).when(m == 3, 17052)
                 .otherwise(22))
        return self.raw("part").select(_host("p_partkey"), F.lit("tcp").alias("proto"), port.alias("port"))

    @cached_property
    def disk_samples(self) -> DataFrame:
        return self.raw("events").select(
            _host("user_id"), "ts", F.concat(F.lit("sd"), _s(F.col("event_id") % 3)).alias("device"),
            F.col("value").alias("tps"), (F.col("value") * 8).alias("rkb_s"), (F.col("value") * 4).alias("wkb_s"),
            (F.col("value") / 2).alias("areq_sz"), (F.col("value") / 64).alias("aqu_sz"), (F.col("value") / 16).alias("await_ms"),
            (F.col("value") / 5).alias("util"))

    @cached_property
    def host_log(self) -> DataFrame:
        return self.raw("events").select(
            _host("user_id"), F.col("event_id").alias("line_no"),
            F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("line"))

    @cached_property
    def collected_log(self) -> DataFrame:
        """The host log with the time and number that order it in a collector."""
        return self.raw("events").select(
            _host("user_id"), F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("line"), "ts", "event_id")

    # Captured command output for the parsing checks. Not in the fixture
    # document: these derive text lines from the event rows so that the
    # parsers run over data that grows with the snapshot.

    @cached_property
    def uptime_lines(self) -> DataFrame:
        """One `uptime` line per sample."""
        e = F.col("event_id")

        def load(mod: int) -> Column:
            return F.concat(_s(e % mod), F.lit("."), F.lpad(_s(e % 100), 2, "0"))

        line = F.concat(F.lit(" 10:00:00 up "), _s(e % 30), F.lit(" days, "),
                        _s(F.col("user_id") % 5 + 1), F.lit(" users,  load average: "),
                        load(7), F.lit(", "), load(5), F.lit(", "), load(3))
        return self.raw("events").select(_host("user_id"), "ts", line.alias("line"))

    @cached_property
    def boot_samples(self) -> DataFrame:
        """Boot time as reported with each sample."""
        return self.raw("events").select(
            _host("user_id"), "ts",
            (F.col("ts") - F.make_dt_interval(F.lit(0), (F.col("event_id") % 97).cast("int"),
                                              F.lit(0), F.lit(0))).alias("boot_time"))

    @cached_property
    def host_limits(self) -> DataFrame:
        """Per-host hard limit on user processes, for every host that runs any."""
        k = F.regexp_extract("host", "[0-9]+$", 0).cast("bigint")
        return self.raw("customer").select(_host("c_custkey")).distinct().select(
            "host", (F.lit(4096) * (1 + k % 3)).cast("bigint").alias("max_user_processes"))

    @cached_property
    def vmstat_lines(self) -> DataFrame:
        """`vmstat -t -w` output: two header lines per host, then data lines."""
        e = F.col("event_id")
        us, sy = e % 40, e % 10
        fields = [e % 5, e % 2, F.lit(0), 1000 + e % 500, F.lit(100), 2000 + e % 300, F.lit(0),
                  F.lit(0), e % 50, e % 70, 500 + e % 100, 900 + e % 200, us, sy, 100 - us - sy,
                  F.lit(0), F.lit(0)]
        ev = self.raw("events")
        data = ev.select(
            _host("user_id"), e.alias("line_no"),
            F.concat(F.lit(" "), F.concat_ws("  ", *[_s(f) for f in fields]), F.lit(" "),
                     F.date_format("ts", "yyyy-MM-dd"), F.lit(" "),
                     F.date_format("ts", "HH:mm:ss")).alias("line"))
        hosts = ev.select(_host("user_id")).distinct()
        head = hosts.select("host", _explode_ints("line_no", [-2, -1])).select(
            "host", F.col("line_no").cast("bigint").alias("line_no"),
            F.when(F.col("line_no") == -2,
                   "--procs-- -----------memory---------- ---swap-- -----io---- -system-- "
                   "--------cpu-------- -----timestamp-----")
             .otherwise(" r  b  swpd  free  buff  cache  si  so  bi  bo  in  cs us sy id wa st"
                        " UTC").alias("line"))
        torn = hosts.select("host", F.lit(-3).cast("bigint").alias("line_no"), F.lit(" 1  0  1000").alias("line"))
        return data.unionByName(head).unionByName(torn)

    @cached_property
    def who_lines(self) -> DataFrame:
        """`who -u` output lines: user, terminal, login time, idle time, pid."""
        e = F.col("event_id")
        line = F.concat(F.lit("u"), _s(F.col("user_id") % 3), F.lit("   pts/"), _s(e % 4),
                        F.lit("  "), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" 00:"), F.lpad(_s(e % 60), 2, "0"),
                        F.lit("   "), _s(e))
        return self.raw("events").select(_host("user_id"), line.alias("line"))

    # Command output rendered from the sample tables, for the text parsers:
    # parsing these lines must give the sample tables back.

    def _hosts_of(self, df: DataFrame) -> DataFrame:
        return df.select("host").distinct()

    def _with_torn(self, lines: DataFrame, *torn: str) -> DataFrame:
        """``lines`` plus, once per host, lines that were cut short or wrapped;
        the parsers must leave these out."""
        keys = [c for c in ("host", "ts") if c in lines.columns]
        once = lines.groupBy("host").agg(*[F.max(c).alias(c) for c in keys[1:]]) if len(keys) > 1 else self._hosts_of(lines)
        return lines.unionByName(once.select(*keys, F.explode(F.array(*[F.lit(t) for t in torn])).alias("line")))

    @cached_property
    def proc_stat_lines(self) -> DataFrame:
        """/proc/stat: the aggregate cpu line, one per-core line and an
        unrelated counter line per sample."""
        c = self.cpu_samples
        host_no = F.regexp_extract("host", "[0-9]+$", 0).cast("int")
        nums = F.concat_ws(" ", *[_s(x) for x in ("user", "nice", "system", "idle", "iowait", "irq",
                                                  "softirq", "steal")], F.lit("0"), F.lit("0"))
        # the counter text is built once per sample, then used by two lines
        cores = F.transform(F.sequence(F.lit(0), host_no % 4), lambda k: F.concat(F.lit("cpu"), k.cast("string"), F.lit(" "), F.col("_nums")))
        whole = (c.select("host", "ts", "user", nums.alias("_nums"))
                 .select("host", "ts", F.explode(F.concat(F.array(
                     F.concat(F.lit("cpu  "), F.col("_nums")), F.concat(F.lit("intr "), _s("user"))), cores)).alias("line")))
        return self._with_torn(whole, "cpu", "cpu  12 3")

    @cached_property
    def free_lines(self) -> DataFrame:
        """`free` output: header, Mem: and Swap: lines per sample."""
        m = self.mem_samples
        mem = F.concat(F.lit("Mem:     "), _s("mem_total"), F.lit("  "), _s("mem_used"), F.lit("  "),
                       _s(F.col("mem_total") - F.col("mem_used")), F.lit("  0  0  0"))
        swap = F.concat(F.lit("Swap:    "), _s("swap_total"), F.lit("  "), _s("swap_used"), F.lit("  "),
                        _s(F.col("swap_total") - F.col("swap_used")))
        head = F.lit("               total        used        free      shared  buff/cache   available")
        return self._with_torn(m.select("host", "ts", F.explode(F.array(head, mem, swap)).alias("line")), "Mem:", "Swap:    40")

    @cached_property
    def meminfo_lines(self) -> DataFrame:
        """/proc/meminfo lines of every memory sample."""
        m = self.mem_samples

        def line(name: str, value: Column) -> Column:
            return F.concat(F.lit(f"{name}:      "), _s(value), F.lit(" kB"))

        lines = m.select("host", "ts", F.explode(F.array(
            line("MemTotal", F.col("mem_total")), line("MemFree", F.lit(1)), line("MemAvailable", F.col("mem_total") - F.col("mem_used")),
            line("SwapTotal", F.col("swap_total")), line("SwapFree", F.col("swap_total") - F.col("swap_used")))).alias("line"))
        return self._with_torn(lines, "MemTotal:", "SwapFree:   kB")

    @cached_property
    def df_lines(self) -> DataFrame:
        """`df -H` output: a header per host, then one line per file system."""
        f = self.fs_usage
        data = f.select("host", F.concat_ws("   ", "filesystem", "size", "used", "available",
                                            F.concat(_s("use_pct"), F.lit("%")), "mounted_on").alias("line"))
        head = self._hosts_of(f).select(
            "host", F.lit("Filesystem      Size  Used Avail Use% Mounted on").alias("line"))
        return self._with_torn(data.unionByName(head), "/dev/mapper/a_very_long_volume_name", "                 100G   95G   5G  95% /wrapped", "/dev/sdx  10G")

    @cached_property
    def ps_lines(self) -> DataFrame:
        """`ps -eo ruser,pid,...,comm` output (14 columns) with a header per host."""
        p = self.proc_snapshot
        data = p.select("host", F.concat_ws("  ", *[_s(c) for c in p.columns if c != "host"]).alias("line"))
        head = self._hosts_of(p).select(
            "host", F.lit("RUSER PID PPID NI WCHAN %MEM %CPU TIME EUSER S F STIME THCNT COMMAND").alias("line"))
        return self._with_torn(data.unionByName(head), "oracle  77", "oracle  pid  1 0 - 1 1 0 a S 0 0 1 cmd")

    @cached_property
    def netstat_lines(self) -> DataFrame:
        """`netstat -tuln` output with its two header lines per host."""
        lst = self.listeners
        data = lst.select("host", F.concat(F.col("proto"), F.lit("        0      0 0.0.0.0:"), _s("port"),
                                           F.lit("            0.0.0.0:*               LISTEN")).alias("line"))
        head = self._hosts_of(lst).select("host", F.explode(F.array(
            F.lit("Active Internet connections (only servers)"),
            F.lit("Proto Recv-Q Send-Q Local Address           Foreign Address         State"))).alias("line"))
        return self._with_torn(data.unionByName(head), "tcp        0", "tcp  0  0  0.0.0.0:")

    @cached_property
    def sar_lines(self) -> DataFrame:
        """`sar -pd` output: a header per sample time and one line per device
        sample (no Average lines: sar prints those only at the end)."""
        d = self.disk_samples
        t = F.date_format("ts", "HH:mm:ss")
        data = d.select("host", "ts", F.concat_ws(
            "  ", t, F.col("device"), *[_s(c) for c in ("tps", "rkb_s", "wkb_s", "areq_sz", "aqu_sz", "await_ms", "util")]).alias("line"))
        head = d.select("host", "ts", F.concat(
            t, F.lit("  DEV  tps  rkB/s  wkB/s  areq-sz  aqu-sz  await  %util")).alias("line"))
        return self._with_torn(data.unionByName(head), "10:00:00  sda  1.0")

    @cached_property
    def uptime_pretty_lines(self) -> DataFrame:
        """`uptime -p` output at each sample. The uptime is the whole number
        of hours ``boot_samples`` subtracts (event_id % 97), rendered as
        '[N days, ]M hours' (the 'up 0 hours' case reads 'up 0 minutes')."""
        h = (F.col("event_id") % 97).cast("int")
        days, hours = (h / 24).cast("int"), h % 24

        def part(n: Column, unit: str) -> Column:
            return F.when(n > 0, F.concat(_s(n), F.lit(f" {unit}"),
                                          F.when(n > 1, F.lit("s")).otherwise(F.lit(""))))

        body = F.concat_ws(", ", part(days, "day"), part(hours, "hour"))
        text = F.concat(F.lit("up "), F.when(h == 0, F.lit("0 minutes")).otherwise(body))
        return self.raw("events").select(_host("user_id"), "ts", text.alias("line"))

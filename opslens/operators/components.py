"""Service components: agent listeners with their queue, and the mailer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.plans.joins import broadcast_if_small


def component_status(components: DataFrame, params: DataFrame, queues: DataFrame,
                     services: DataFrame, param_defs: DataFrame | None = None,
                     processes: DataFrame | None = None,
                     count_active_processes: bool = False) -> DataFrame:
    """Components (not push providers, sync state UPDATED) that have the
    thread-count parameter and whose queue's manager is the service-handle
    kind, with the queue's enabled flag. Distinct rows.

    The source query reaches the parameter and service tables through outer
    joins but then filters on their columns, which makes those joins inner;
    they contribute no output column, so they are semi joins here and cannot
    fan rows out. The parameter-definition and process tables only ever fan
    rows out that the DISTINCT removes again; they are accepted for interface
    parity and not joined.
    With ``count_active_processes=True`` the process table is used after all:
    the source's outer join to it carries a constant (status 'A') in its ON
    clause, which on a left join restricts the right side only; the count of
    such processes per queue and application is added as ``active_processes``
    (0 when none). The processes are counted per key before the join, so a
    queue with many processes adds one row, not many.
    Columns: component_id, component_name, status, enabled,
    inbound_agent_name, outbound_agent_name, startup_mode, updated
    [, active_processes]."""
    del param_defs  # provably no effect on the distinct result (see above)
    comp = components.where((F.col("component_type") != codes.PUSH_PROVIDER_TYPE)
                            & (F.col("sync_state") == codes.SYNC_UPDATED))
    with_param = params.where(F.col("parameter_name") == codes.THREAD_COUNT_PARAMETER) \
                       .select("component_id")
    comp = comp.join(with_param, "component_id", "left_semi")
    svc = broadcast_if_small(services.where(F.col("service_handle") == codes.SERVICE_HANDLE)
                             .select(F.col("service_id").alias("manager_type")))
    q = (queues.join(svc, "manager_type", "left_semi")
         .select("queue_id", "application_id", "enabled_flag"))
    out = comp.join(broadcast_if_small(q), "queue_id")
    cols = ["component_id", "component_name", F.col("component_status").alias("status"),
            F.col("enabled_flag").alias("enabled"), "inbound_agent_name", "outbound_agent_name",
            "startup_mode", F.col("last_update_date").alias("updated")]
    if count_active_processes and processes is not None:
        active = (processes.where(F.col("process_status_code") == "A")
                  .groupBy("queue_id", "application_id").agg(F.count(F.lit(1)).alias("active_processes")))
        out = out.join(active, ["queue_id", "application_id"], "left")
        cols.append(F.coalesce("active_processes", F.lit(0).cast("bigint")).alias("active_processes"))
    return out.select(*cols).distinct()


def mailer_status(components: DataFrame) -> DataFrame:
    """Mailer components (sync state UPDATED): RUNNING or DOWN (anything
    else, NULL included, is DOWN).
    Columns: component_name, component_status."""
    return (components.where((F.col("component_type") == codes.MAILER_TYPE)
                             & (F.col("sync_state") == codes.SYNC_UPDATED))
            .select("component_name",
                    F.when(F.col("component_status") == "RUNNING", "RUNNING").otherwise("DOWN")
                    .alias("component_status")))

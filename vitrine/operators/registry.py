"""A registry of keys: current rows, blocks, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_per_machine(keys: DataFrame) -> DataFrame:
    """The latest active row of each machine.  keys: license_id, machine_id, issued_at, status."""
    known = keys.where((F.col("status") == "active") & (F.trim("machine_id") != ""))
    order = Window.partitionBy(F.trim("machine_id")).orderBy(F.col("issued_at").desc(), F.col("license_id").desc())
    return known.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def blocked_machines(keys: DataFrame, unblocked: DataFrame) -> DataFrame:
    """Machines with a cancelled row and no unblock row; blank ones and * are never blocked."""
    cancelled = keys.where(F.col("status") == "cancelled").select(F.trim("machine_id").alias("machine_id")).where(~F.col("machine_id").isin("", "*")).distinct()
    return cancelled.join(unblocked.select("machine_id"), "machine_id", "left_anti")


def registry_filter(keys: DataFrame, status: str = "all", trial: bool | None = None, text: str = "") -> DataFrame:
    out = keys if status == "all" else keys.where(F.col("status") == status)
    if trial is not None:
        is_trial = F.ilike(F.col("license_type"), F.lit("%trial%"))
        out = out.where(is_trial if trial else ~is_trial)
    if text:
        like = F.lit("%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")
        out = out.where(F.ilike(F.concat_ws("\x00", "license_id", "machine_id", "license_type"), like))
    return out


def registry_stats(keys: DataFrame, today: str, within: int = 30) -> DataFrame:
    active, trial = F.col("status") == "active", F.ilike(F.col("license_type"), F.lit("%trial%"))
    soon = F.col("expires_at").between(F.to_date(F.lit(today)), F.date_add(F.to_date(F.lit(today)), within))
    return keys.agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.count_if(active & trial).alias("active_trial"), F.count_if(active & ~trial).alias("active_official"), F.count_if(active & soon).alias("expiring"),
    )


def registry_lifecycle(events: DataFrame) -> DataFrame:
    """The keys that stand after all events: license_id, machine_id, status, notes, blocked.

    events: at (unique order), action (issue, cancel, delete, unblock),
    license_id, machine_id, supersedes (a key that an issue replaces), reason.
    An id is issued once, later issues of it change nothing; cancelling and
    superseding touch keys that exist; only a cancelled key can be deleted, and
    it stays deleted.  A machine is blocked while it has a cancelled key that
    no unblock follows; a blank machine and * never are.  Null actions and ids
    are passed over.
    """
    own = events.where("action in ('issue', 'cancel', 'delete')").select("license_id", "at", "action", "machine_id", "reason")
    old = events.where("action = 'issue' and supersedes is not null").select(F.col("supersedes").alias("license_id"), "at", F.lit("supersede").alias("action"), F.lit(None).cast("string").alias("machine_id"), F.lit(None).cast("string").alias("reason"))
    changes = own.unionByName(old).where("license_id is not null")
    # a key's changes in order; the first issue opens it, and only what follows counts
    before = Window.partitionBy("license_id").orderBy("at", F.col("action") == "issue").rowsBetween(Window.unboundedPreceding, -1)
    status = F.when(F.col("action") == "issue", "active").when(F.col("action") == "cancel", "cancelled").when(F.col("action") == "supersede", "superseded")
    born = F.min(F.when(F.col("action") == "issue", F.col("at"))).over(Window.partitionBy("license_id"))
    changes = changes.withColumn("born", born).where("at >= born and (action <> 'issue' or at = born) and not (action = 'supersede' and at = born)").withColumn("status", status)
    changes = changes.withColumn("gone", (F.col("action") == "delete") & (F.last("status", True).over(before) == "cancelled"))
    note = F.when(F.col("action") == "supersede", " Replaced by newer key.").when(F.col("action") == "cancel", F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" Cancelled: "), "reason")).otherwise(" Cancelled."))
    gone_at = F.min(F.when(F.col("gone"), F.col("at"))).over(Window.partitionBy("license_id"))
    changes = changes.withColumn("note", note).withColumn("gone_at", gone_at).where("gone_at is null or at < gone_at")
    keys = changes.groupBy("license_id").agg(
        F.max(F.when(F.col("action") == "issue", F.trim("machine_id"))).alias("machine_id"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("at"))).alias("status"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("at", "note")))), lambda n: n["note"])).alias("notes"),
        F.max(F.when(F.col("action") == "cancel", F.col("at"))).alias("cancelled_at"), F.max("gone_at").alias("gone_at"),
    )
    unblocks = events.where("action = 'unblock'").groupBy(F.trim("machine_id").alias("machine_id")).agg(F.max("at").alias("unblocked_at"))
    machines = keys.groupBy("machine_id").agg(F.max("cancelled_at").alias("cancelled_at"), F.bool_or((F.col("status") == "cancelled") & F.col("gone_at").isNull()).alias("stopped"))
    machines = machines.join(unblocks, "machine_id", "left").where("stopped and machine_id not in ('', '*') and coalesce(unblocked_at < cancelled_at, true)").select("machine_id", F.lit(True).alias("blocked"))
    kept = keys.where("gone_at is null").select("license_id", "machine_id", "status", "notes")
    return kept.join(machines, "machine_id", "left").select("license_id", "machine_id", "status", "notes", F.coalesce("blocked", F.lit(False)).alias("blocked"))

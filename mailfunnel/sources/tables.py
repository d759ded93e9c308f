"""Keyed writes as DataFrames: inserts, upserts, edits, deletions, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys


def insert_events(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` and those of ``new`` whose (user_id, message_id) is not there yet; of several the earliest is kept, ties by card and stage."""
    first = Window.partitionBy("user_id", "message_id").orderBy("email_at", *[c for c in ("application_id", "stage") if c in new.columns])
    once = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    fresh = once.join(existing.select("user_id", "message_id"), ["user_id", "message_id"], "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert_applications(existing: DataFrame, touched: DataFrame) -> DataFrame:
    """Touched cards replace those with their id (a locked card keeps its stage); the others stay."""
    was = existing.select("id", F.col("locked").alias("_locked"), F.col("stage").alias("_stage"))
    new = touched.join(was, "id", "left").withColumns({"stage": F.when(F.col("_locked"), F.col("_stage")).otherwise(F.col("stage")), "locked": F.coalesce("_locked", "locked", F.lit(False))})
    return existing.join(touched.select("id"), "id", "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def upsert_sync_state(existing: DataFrame, users: DataFrame, now) -> DataFrame:
    done = users.select("user_id").distinct().select("user_id", F.lit(now).cast("timestamp").alias("last_synced_at"), F.lit("ok").alias("status"))
    return existing.join(done, "user_id", "left_anti").select("user_id", "last_synced_at", "status").unionByName(done)


def applications_with_events(apps: DataFrame, events: DataFrame) -> DataFrame:
    """Cards with their events nested, newest first; cards by last mail, newest first."""
    one = F.struct("email_at", "message_id", "stage")
    nested = events.groupBy(F.col("application_id").alias("id")).agg(F.reverse(F.array_sort(F.collect_list(one))).alias("application_events"))
    return apps.join(nested, "id", "left").orderBy(F.desc("last_email_at"), "id")


def event_timeline(events: DataFrame) -> DataFrame:
    """Place of each event on its card, newest first."""
    order = Window.partitionBy("application_id").orderBy(F.desc("email_at"), F.desc("message_id"))
    return events.withColumn("place", F.row_number().over(order))


def apply_edits(apps: DataFrame, edits: DataFrame) -> DataFrame:
    """The latest edit of each card by its owner: a stage locks it, a non-blank company replaces it, a blank role clears it; null changes nothing."""
    latest = Window.partitionBy("id").orderBy(F.desc("edited_at"))
    last = edits.join(apps.select("id", "user_id"), ["id", "user_id"], "left_semi").withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    last = last.select("id", F.col("stage").alias("_s"), F.trim("company").alias("_c"), F.trim("role").alias("_r"))
    out = apps.join(last, "id", "left")
    named, roled = F.coalesce(F.col("_c") != "", F.lit(False)), F.col("_r").isNotNull()
    out = out.withColumns({"locked": F.coalesce("locked", F.lit(False)) | F.col("_s").isNotNull(), "stage": F.coalesce("_s", "stage"), "company": F.when(named, F.col("_c")).otherwise(F.col("company")), "role": F.when(roled, F.nullif(F.col("_r"), F.lit(""))).otherwise(F.col("role"))})
    return out.withColumns({"company_key": F.when(named, keys.norm_company(F.col("company"))).otherwise(F.col("company_key")), "role_key": F.when(roled, keys.norm_role(F.col("role"))).otherwise(F.col("role_key"))}).select(*apps.columns)


def purge_users(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    gone = users.select("user_id")
    return {name: df.join(gone, "user_id", "left_anti").select(*df.columns) for name, df in tables.items()}


def delete_applications(apps: DataFrame, events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ids(user_id, id)``: the owner's cards go, and their events with them."""
    gone = ids.join(apps.select("user_id", "id"), ["user_id", "id"], "left_semi").select("id")
    return apps.join(gone, "id", "left_anti").select(*apps.columns), events.join(gone.withColumnRenamed("id", "application_id"), "application_id", "left_anti").select(*events.columns)

"""Folding a card's stages into one, rollups and merges (R2, A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions import lexicon as lx


def group_by_key(classified: DataFrame) -> DataFrame:
    """Exact identity: one row per (user, dedup key)."""
    keyed = classified.withColumn("dedup_key", keys.dedup_key(F.col("company"), F.col("role"), F.col("req")))
    return keyed.groupBy("user_id", "dedup_key").agg(F.min("email_at").alias("first_email_at"), F.max("email_at").alias("last_email_at"), F.count("*").alias("emails"))


def fold_stages(events: DataFrame, by: list[str], seq: list[str] | None = None, rolled: bool = False) -> DataFrame:
    """``events(*by, stage, email_at, *seq)`` -> one stage per card, by a ratchet in order of arrival; ``rolled``: with first and last time and count.

    A higher rank wins; a mail strictly newer than all before it reopens a rejected card unless it is a rejection. Closed form:
    with any stage from offer up, or no rejection, the highest rank; else what follows the first strictly newer mail
    after the last rejection, or rejected if there is none. Two windows over one shuffle.
    """
    seq = seq or ["email_at", "message_id"]
    order = Window.partitionBy(*by).orderBy(*seq)
    whole = Window.partitionBy(*by)
    rank = keys.rank_of(F.col("stage"))
    e = events.select(*by, "stage", "email_at", *[c for c in seq if c not in ("email_at", "stage", *by)]).withColumns({"_rank": rank, "_n": F.row_number().over(order), "_before": F.max("email_at").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    e = e.withColumn("_r", F.max(F.when(F.col("stage") == "rejected", F.col("_n"))).over(whole))
    e = e.withColumn("_k", F.min(F.when((F.col("_n") > F.col("_r")) & (F.col("email_at") > F.col("_before")), F.col("_n"))).over(whole))
    top = F.max("_rank")
    since = F.max(F.when(F.col("_n") >= F.col("_k"), F.col("_rank")))
    won = F.when((top >= lx.PROGRESSION["offer"]) | F.max("_r").isNull(), top).otherwise(F.coalesce(since, F.lit(lx.PROGRESSION["rejected"])))
    names = F.create_map(*[F.lit(x) for k, v in lx.PROGRESSION.items() for x in (v, k)])
    rolls = [F.min("email_at").alias("first_email_at"), F.max("email_at").alias("last_email_at"), F.count("*").alias("emails")] if rolled else []
    return e.groupBy(*by).agg(won.alias("_w"), *rolls).select(*by, names[F.col("_w")].alias("stage"), *(["first_email_at", "last_email_at", "emails"] if rolled else []))


def rollup_cards(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.min("email_at").alias("first_email_at"), F.max("email_at").alias("last_email_at"), F.count("*").alias("emails"))


def merge_cards(apps: DataFrame, events: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs(user_id, target_id, source_id)``: the source's events move to the target, which takes the highest stage unless locked.

    Pairs of one card, of unknown cards or of another user's are ignored; a source named twice goes to the smallest target, and a
    target that is itself a source is not followed.
    """
    own = apps.select("id", "user_id")
    ok = pairs.where("target_id <> source_id").join(own.select(F.col("id").alias("target_id"), "user_id"), ["target_id", "user_id"], "left_semi").join(own.select(F.col("id").alias("source_id"), "user_id"), ["source_id", "user_id"], "left_semi")
    ok = ok.groupBy("user_id", "source_id").agg(F.min("target_id").alias("target_id"))
    ok = ok.join(ok.select("user_id", F.col("source_id").alias("target_id")), ["user_id", "target_id"], "left_anti")
    moved = events.join(ok.select("user_id", F.col("source_id").alias("application_id"), "target_id"), ["user_id", "application_id"], "left").withColumn("application_id", F.coalesce("target_id", "application_id")).select(*events.columns)
    source = ok.join(apps.select(F.col("id").alias("source_id"), F.col("role").alias("_role"), F.col("first_email_at").alias("_f")), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min_by("_role", F.struct("_f", "source_id")).alias("_role"))
    seen = moved.join(ok.select(F.col("target_id").alias("application_id")).distinct(), "application_id", "left_semi").groupBy(F.col("application_id").alias("id")).agg(F.max(keys.rank_of(F.col("stage"))).alias("_rank"), F.min("email_at").alias("_first"), F.max("email_at").alias("_last"))
    names = F.create_map(*[F.lit(x) for k, v in lx.PROGRESSION.items() for x in (v, k)])
    kept = apps.join(ok.select(F.col("source_id").alias("id")), "id", "left_anti").join(source, "id", "left").join(seen, "id", "left")
    best = names[F.greatest(keys.rank_of(F.col("stage")), F.col("_rank"))]
    new = {"stage": F.when(F.coalesce("locked", F.lit(False)) | F.col("_rank").isNull(), F.col("stage")).otherwise(best), "role": F.coalesce("role", "_role"), "first_email_at": F.coalesce("_first", "first_email_at"), "last_email_at": F.coalesce("_last", "last_email_at")}
    return kept.withColumns(new).select(*apps.columns), moved

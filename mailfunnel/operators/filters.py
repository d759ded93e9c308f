"""Filters and keyed joins on mails."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions import lexicon as lx


def is_candidate(text: Column, email: Column, labels: Column) -> Column:
    """A phrase of the list in the text or a known sender, and none of the excluded labels and senders."""
    phrase = F.lower(text).rlike("|".join(re.escape(p) for p in lx.CANDIDATE_PHRASES))
    domain = keys.domain_of(email)
    ends = lambda names: domain.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(n) for n in names) + r")\z")
    shut = F.arrays_overlap(F.coalesce(labels, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in lx.EXCLUDED_LABELS]))
    return (phrase | ends(lx.CANDIDATE_SENDERS)) & ~shut & ~ends(lx.EXCLUDED_SENDERS)


def candidate_filter(mail: DataFrame) -> DataFrame:
    text = F.concat_ws("\n", "subject", "snippet", "body")
    return mail.where(is_candidate(text, F.col("from_email"), F.col("labels") if "labels" in mail.columns else F.array().cast("array<string>")))


def drop_own_mail(mail: DataFrame, accounts: DataFrame) -> DataFrame:
    """Without mails from the user's own address, where that is known."""
    own = accounts.select("user_id", F.lower("email").alias("from_email")).where("from_email is not null").distinct()
    return mail.join(own, ["user_id", "from_email"], "left_anti").select(*mail.columns)


def since_last_sync(mail: DataFrame, sync_state: DataFrame, overlap_seconds: int = 2 * 86400) -> DataFrame:
    """Mails after the user's last sync less the overlap, in whole seconds; users never synced keep all."""
    state = sync_state.groupBy("user_id").agg((F.unix_timestamp(F.max("last_synced_at")) - overlap_seconds).alias("_after"))
    return mail.join(state, "user_id", "left").where(F.col("_after").isNull() | (F.unix_timestamp("email_at") > F.col("_after"))).select(*mail.columns)


def cap_per_user(mail: DataFrame, n: float = 300) -> DataFrame:
    """The newest n mails of every user; n is rounded and kept within 10 and 1000."""
    n = min(1000, max(10, int(n + 0.5)))
    order = Window.partitionBy("user_id").orderBy(F.desc("email_at"), F.desc("message_id"))
    return mail.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def drop_seen(mail: DataFrame, events: DataFrame) -> DataFrame:
    return mail.join(events.select("user_id", "message_id"), ["user_id", "message_id"], "left_anti").select(*mail.columns)


def connected_only(df: DataFrame, accounts: DataFrame) -> DataFrame:
    return df.join(accounts.select("user_id"), "user_id", "left_semi").select(*df.columns)


def scope_to_user(df: DataFrame, user_id: int) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def validate_stages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with one of the seven stages, the others)."""
    good = F.coalesce(F.col("stage").isin(*lx.STAGES), F.lit(False))
    return df.where(good), df.where(~good)


def search_board(apps: DataFrame, text: str = "", column: str | None = None, sort: str = "recent") -> DataFrame:
    """Cards whose company or role holds the text in any case, in one board column, sorted recent / oldest / company."""
    if text:
        needle = text.lower()
        apps = apps.where(F.lower("company").contains(needle) | F.lower(F.coalesce("role", F.lit(""))).contains(needle))
    if column:
        apps = apps.where(keys.board_column(F.col("stage")) == column)
    order = {"recent": F.desc("last_email_at"), "oldest": F.asc("last_email_at"), "company": F.collate("company", "UNICODE")}
    return apps.orderBy(order[sort], "id")

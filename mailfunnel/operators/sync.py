"""Mails of many users to their cards, events, sync states and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decode
from ..functions.steps import checkpointed
from ..sources.schemas import EVENTS
from ..sources.tables import insert_events, upsert_applications, upsert_sync_state
from . import filters
from .classify import attributable, classify_mail
from .reports import sync_summary
from .resolve import cards_of, resolve_mail

TOLD = {"subject": "string", "from_name": "string", "from_email": "string", "snippet": "string", "body": "string"}


def events_of(resolved: DataFrame, mail: DataFrame) -> DataFrame:
    """X11: the events of resolved mails. Only keys went through the resolver; sender, subject, snippet and body join here, late and once.

    The stage of an event is its mail's own, not its card's. Mails that come without these texts give events without them.
    """
    for c, kind in TOLD.items():
        if c not in mail.columns:
            mail = mail.withColumn(c, F.lit(None).cast(kind))
    sender, snippet, body = decode.event_projection(F.col("from_name"), F.col("from_email"), F.col("snippet"), F.col("body"))
    texts = mail.select("user_id", "message_id", "subject", sender, snippet, body)
    mine = resolved.select("user_id", "message_id", F.col("card").alias("application_id"), F.col("mail_stage").alias("stage"), F.col("mail_at").alias("email_at"))
    return mine.join(texts, ["user_id", "message_id"]).select(*[c.split()[0] for c in EVENTS.split(", ")])


def sync_batch(mail: DataFrame, apps: DataFrame, events: DataFrame, classified: bool = False) -> tuple[DataFrame, DataFrame]:
    """One batch of mails against stored cards and events -> (cards, events) after it.

    Stored mails are left out; where ``mail`` has a flag ``late``, only those with the flag are looked up (the others are known to be new).
    """
    if "late" in mail.columns:
        fresh = F.coalesce(~F.col("late"), F.lit(False))
        old = mail.where(~fresh).drop("late")
        mail = mail.where(fresh).drop("late").unionByName(filters.drop_seen(old, events))
    else:
        mail = filters.drop_seen(mail, events)
    resolved = checkpointed(resolve_mail(mail if classified else attributable(classify_mail(mail)), apps))
    return upsert_applications(apps, cards_of(resolved)), insert_events(events, events_of(resolved, mail))


def sync_users(mail: DataFrame, accounts: DataFrame, was: dict[str, DataFrame], now, n: float = 300) -> dict[str, DataFrame]:
    """The whole job for all connected users: ``accounts(user_id, email)``, ``was``: applications, events and sync_state.

    Each user's newest ``n`` candidates since the last sync, without those stored already and the user's own, are classified and
    resolved. Returns the three tables after it and ``summary``: user_id, scanned, new_events, applications_touched, a row for every
    connected user, zeros too. Cards and events of other users stay as they are.
    """
    recent = filters.since_last_sync(filters.connected_only(mail, accounts), was["sync_state"])
    listed = filters.cap_per_user(filters.candidate_filter(recent), n)
    todo = filters.drop_own_mail(filters.drop_seen(listed, was["events"]), accounts)
    resolved = checkpointed(resolve_mail(attributable(classify_mail(todo)), was["applications"]))
    users = accounts.select("user_id").distinct()
    return {
        "applications": upsert_applications(was["applications"], cards_of(resolved)),
        "events": insert_events(was["events"], events_of(resolved, todo)),
        "sync_state": upsert_sync_state(was["sync_state"], users, now),
        "summary": users.join(sync_summary(listed, resolved), "user_id", "left").na.fill(0),
    }

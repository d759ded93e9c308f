"""Structured Streaming forms (T1-T4): stateless classification, keyed dedupe, and cards per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.classify import attributable, classify_mail
from ..operators.sync import sync_batch
from ..sources.store import Tables
from ..sources.tables import upsert_sync_state
from .state import once_or_late


def stream_classify(mail_stream: DataFrame) -> DataFrame:
    """The batch expressions on a stream; no state."""
    return attributable(classify_mail(mail_stream))


def stream_dedupe(mail_stream: DataFrame, overlap: str = "2 days") -> DataFrame:
    """Each message id once within the overlap. Rows older than the watermark are dropped, so a backfill must not pass here."""
    return mail_stream.withWatermark("email_at", overlap).dropDuplicatesWithinWatermark(["user_id", "message_id"])


def stream_cards(mail_stream: DataFrame, tables: Tables, checkpoint: str, now, classified: bool = False):
    """Each micro-batch runs the batch job against the stored tables of its users. Late mail (T4) is resolved like any other.

    Mails of the last days come once by state; only older ones (``late``) are looked up in the stored events. A batch that stands in the
    tables already is skipped by its id, one that was cut off is completed.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if tables.recover(batch_id):
            return
        slots = tables.slots_of(batch)
        if not slots:
            return
        was = tables.current(slots)
        apps, events = sync_batch(batch, was["applications"], was["events"], classified)
        tables.commit(batch_id, {"applications": apps, "events": events, "sync_state": upsert_sync_state(was["sync_state"], batch, now)}, slots)

    return once_or_late(mail_stream).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)

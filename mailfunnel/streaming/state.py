"""Cards and seen mails as keyed state of a stream.

Needs the RocksDB state store: ``configured`` sets it for the session. State grows with users, companies and cards, and with the
mails of the last days only; it is kept in Spark's checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import resolve

KEYED = "user_id long, message_id string, at long, company string, company_key string, role string, role_key string, req string, stage string"
BUCKETED = KEYED + ", bucket string"
CARD = "id string, company string, role string, role_key string, req string, stage string, first long, last long, locked boolean"
_CARD = [x.split()[0] for x in CARD.split(", ")]


def configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """A key's rows of one micro-batch, oldest first, ties by message id, without repeats; rows without a time last."""
    all_rows = pd.concat(list(rows))
    all_rows = all_rows.astype(object).where(all_rows.notna(), None)
    seen = set()
    for r in sorted(all_rows[columns].itertuples(index=False, name=None), key=lambda r: (r[2] is None, int(r[2] or 0), r[1])):
        if r[1] not in seen:
            seen.add(r[1])
            yield r


class SettleCompanies(StatefulProcessor):
    """Keyed by user: which bucket each company key belongs to. The buckets in order of appearance are the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getListState("buckets", "name string")
        self.keys = handle.getMapState("keys", "company_key string", "bucket string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [r[0] for r in self.buckets.get()] if self.buckets.exists() else []
        own, out = resolve.Buckets(names), []
        for r in _in_order(rows, [x.split()[0] for x in KEYED.split(", ")]):
            k = (r[4],)
            if self.keys.containsKey(k):
                bucket = self.keys.getValue(k)[0]
            else:
                bucket = own.of(r[4])
                self.keys.updateValue(k, (bucket,))
            out.append((*r, bucket))
        if new := own.names[len(names) :]:
            self.buckets.appendList([(n,) for n in new])
        yield pd.DataFrame(out, columns=[x.split()[0] for x in BUCKETED.split(", ")])

    def close(self) -> None:
        pass


class KeepCards(StatefulProcessor):
    """Keyed by user and company bucket: the cards are the state; each mail comes out with its card as it is after the micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cards = handle.getListState("cards", CARD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        user, bucket = int(key[0]), key[1]
        cards = [dict(zip(_CARD, c)) | {"new": False} for c in self.cards.get()] if self.cards.exists() else []
        taken = {}
        for _, message, at, company, _, role, role_key, req, stage, _ in _in_order(rows, [x.split()[0] for x in BUCKETED.split(", ")]):
            at = None if at is None else int(at)
            taken[message] = resolve.assign(cards, user, bucket, message, at, company, role, role_key, req, stage), stage, at
        self.cards.put([tuple(c[n] for n in _CARD) for c in cards])
        out = pd.DataFrame([resolve.resolved_row(user, m, bucket, *found) for m, found in taken.items()], columns=[*resolve.NAMES, "mail_stage", "mail_at"])
        yield out.astype({"first_email_at": "Int64", "last_email_at": "Int64", "mail_at": "Int64"})

    def close(self) -> None:
        pass


class FlagLate(StatefulProcessor):
    """Keyed by user: each mail of the last days once. What is older than the user's newest mail less the overlap goes on, flagged ``late``, for it may stand in the tables."""

    def __init__(self, overlap_seconds: int, columns: list[str]):
        self.overlap, self.columns = overlap_seconds * 1_000_000, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at long")
        self.seen = handle.getMapState("seen", "message_id string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        all_rows = pd.concat(list(rows)).sort_values(["at", "message_id"], na_position="last")
        late = []
        for message, at in zip(all_rows["message_id"], all_rows["at"]):
            at = None if pd.isna(at) else int(at)
            # judged by the newest mail of earlier micro-batches, so the order within one does not matter
            if at is None or newest is not None and at < newest - self.overlap:
                late.append(True)
            elif self.seen.containsKey((message,)):
                late.append(None)
            else:
                self.seen.updateValue((message,), (at,))
                late.append(newest is None)  # the tables may be older than this state
        top = all_rows["at"].max()
        if not pd.isna(top) and (newest is None or top > newest):
            self.newest.update((int(top),))
            for (message,), (at,) in list(self.seen.iterator()):
                if at < int(top) - self.overlap:
                    self.seen.removeKey((message,))
        all_rows["late"] = pd.array(late, dtype="boolean")
        yield all_rows[all_rows["late"].notna()][[*self.columns, "late"]]

    def close(self) -> None:
        pass


def once_or_late(mail_stream: DataFrame, overlap_seconds: int = 2 * 86400) -> DataFrame:
    """T2 with T4: ``mail_stream`` with ``late``. A mail within the overlap comes once, by state; an older one comes flagged and may be a repeat, so it must meet the stored keys. None is dropped by its age.

    A mail without a time counts as late, and so do all of a user's first micro-batch, for the tables may be older than the state.
    """
    configured(mail_stream.sparkSession)
    columns = [*mail_stream.columns, "at"]
    timed = mail_stream.withColumn("at", resolve.micros("email_at"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.schema.fields)
    out = timed.groupBy("user_id").transformWithStateInPandas(FlagLate(overlap_seconds, columns), f"{kinds}, late boolean", "append", "none")
    return out.drop("at")


def cards_by_state(classified_stream: DataFrame) -> DataFrame:
    """Attributable mails of a stream with their cards (columns as of ``resolve_mail``), cards kept as state by user and company.

    A mail must come once (``once_or_late``). Micro-batches are taken as they come: a late mail (T4) widens its card's times and may
    raise its stage, but never reopens it. The rows of a card's last mail hold its newest state.
    """
    configured(classified_stream.sparkSession)
    keyed = resolve.with_keys(classified_stream).withColumn("at", resolve.micros("email_at")).select(*[x.split()[0] for x in KEYED.split(", ")])
    settled = keyed.groupBy("user_id").transformWithStateInPandas(SettleCompanies(), BUCKETED, "append", "none")
    raw = settled.groupBy("user_id", "bucket").transformWithStateInPandas(KeepCards(), resolve.RAW, "append", "none")
    return resolve.with_times(raw)

"""Greedy entity resolution of mails to cards.

The state of a card depends on earlier assignments, so the step is Python; Spark sorts, and a task reads its partition
once, in order, with the state of one user's company at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.lexicon import PROGRESSION

RESOLVED = "user_id long, message_id string, card string, is_new boolean, company string, company_key string, role string, role_key string, req string, stage string, first_email_at timestamp, last_email_at timestamp, locked boolean"
NAMES = [x.split()[0] for x in RESOLVED.split(", ")]
#: The same with times in microseconds, as tasks see them, and the mail's own stage and time.
RAW = RESOLVED.replace("timestamp", "long") + ", mail_stage string, mail_at long"


def _alike(a: str, b: str) -> bool:
    ta, tb = set(a.split()), set(b.split())
    both = len(ta & tb)
    return a == b or bool(ta) and bool(tb) and (both == min(len(ta), len(tb)) or both / len(ta | tb) >= 0.6)


def folded(now: str, stage: str, newer: bool) -> str:
    """One step of the ratchet."""
    if now == "rejected" and stage != "rejected" and newer:
        return stage
    return stage if PROGRESSION[stage] > PROGRESSION[now] else now


class Buckets:
    """The company buckets of one user, in order of appearance.

    A key belongs to the first bucket whose words lie in its own or hold all of them (of two keys the one with fewer words is
    the inner one). Keys of up to six words, all different, find it by their sets of words; longer ones and those that
    repeat a word are compared one by one.
    """

    def __init__(self, stored: Iterable[str] = ()):
        self.names: list[str] = []
        self.place: dict[str, int] = {}
        self.exact: dict[frozenset, int] = {}
        self.within: dict[frozenset, int] = {}
        self.odd: list[int] = []
        for name in stored:
            self._open(name)

    @staticmethod
    def _sets(key: str) -> list[frozenset] | None:
        words = key.split()
        if len(words) > 6 or len(set(words)) < len(words):
            return None
        return [frozenset(c) for n in range(1, len(words) + 1) for c in combinations(words, n)]

    @staticmethod
    def _contained(a: str, b: str) -> bool:
        ta, tb = a.split(), b.split()
        small, big = (ta, tb) if len(ta) <= len(tb) else (tb, ta)
        return a == b or bool(small) and set(small) <= set(big)

    def _open(self, key: str) -> str:
        if key not in self.place:
            i, sets = len(self.names), self._sets(key)
            self.place[key] = i
            self.names.append(key)
            if sets is None:
                self.odd.append(i)
            elif sets:
                self.exact.setdefault(sets[-1], i)
                for s in sets:
                    self.within.setdefault(s, i)
        return key

    def of(self, key: str) -> str:
        """The bucket of a key that is new to the user; its own where none is alike."""
        if key in self.place:
            return key
        sets = self._sets(key)
        if sets is None:
            found = [next((i for i, b in enumerate(self.names) if self._contained(b, key)), None)]
        else:
            found = [self.exact.get(s) for s in sets]
            found += [self.within.get(sets[-1])] if sets else []
            found.append(next((i for i in self.odd if self._contained(self.names[i], key)), None))
        first = min((i for i in found if i is not None), default=None)
        return self._open(key) if first is None else self.names[first]


def _find(cards: list[dict], role: str, req: str | None) -> dict | None:
    """The card of a mail among its company's: same requisition, then same, similar or missing role; without a role the latest one that fits."""
    if req and (hit := next((c for c in cards if c["req"] == req), None)):
        return hit
    fits = [c for c in cards if not c["req"] or not req or c["req"] == req]
    if not role:
        return max(fits, key=lambda c: -1 << 63 if c["last"] is None else c["last"], default=None)
    tests = [lambda c: c["role_key"] == role, lambda c: c["role_key"] and _alike(c["role_key"], role), lambda c: not c["role_key"]]
    return next((c for test in tests for c in fits if test(c)), None)


def assign(cards: list[dict], user_id: int, bucket: str, message_id: str, at: int, company: str, role: str | None, role_key: str | None, req: str | None, stage: str) -> dict:
    """The card of the next mail, updated by it; a new one is added to ``cards``. A mail without a time changes no time and is never newer."""
    role_key, req = role_key or "", req or None
    card = _find(cards, role_key, req)
    if card is None:
        name = hashlib.sha256(f"{user_id}|{message_id}".encode()).hexdigest()
        card = {"id": name, "new": True, "company": company, "role": role, "role_key": role_key, "req": req, "stage": stage, "first": at, "last": at, "locked": False}
        cards.append(card)
        return card
    if not card["locked"]:
        card["stage"] = folded(card["stage"], stage, at is not None and (card["last"] is None or at > card["last"]))
    if at is not None:
        card["first"] = at if card["first"] is None else min(card["first"], at)
        card["last"] = at if card["last"] is None else max(card["last"], at)
    if not card["role_key"] and role_key:
        card["role"], card["role_key"] = role, role_key
    card["req"] = card["req"] or req
    return card


def resolved_row(user_id: int, message_id: str, bucket: str, c: dict, stage: str, at: int | None) -> tuple:
    return (user_id, message_id, c["id"], c["new"], c["company"], bucket, c["role"], c["role_key"], c["req"], c["stage"], c["first"], c["last"], c["locked"], stage, at)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], size: int = 8192) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for r in rows:
        some.append(r)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)


def micros(c) -> Column:
    """Microseconds of a time, with or without a zone (the session's)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_RAW_KINDS = [_KINDS[x.split()[1]] for x in RAW.split(", ")]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``user_id, company_key, stored`` in order -> the bucket of each key. Stored keys are buckets of their own."""

    def of():
        for user, rows in groupby(_rows(batches), key=lambda r: r[0]):
            buckets = Buckets()
            for _, key, stored in rows:
                yield user, key, buckets._open(key) if stored else buckets.of(key)

    return _batches(of(), ["user_id", "company_key", "bucket"], [pa.int64(), pa.string(), pa.string()])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of COLUMNS in order, a company's stored cards before its mails -> RAW. Holds one company of one user."""

    def of():
        for (user, bucket), rows in groupby(_rows(batches), key=lambda r: r[:2]):
            cards, taken = [], {}
            for _, _, stored, at, name, company, role, role_key, req, stage, last, locked in rows:
                if stored:
                    cards.append({"id": name, "new": False, "company": company, "role": role, "role_key": role_key or "", "req": req or None, "stage": stage, "first": at, "last": last, "locked": bool(locked)})
                else:
                    taken[name] = assign(cards, user, bucket, name, at, company, role, role_key, req, stage), stage, at
            for message, (card, stage, at) in taken.items():
                yield resolved_row(user, message, bucket, card, stage, at)

    return _batches(of(), [*NAMES, "mail_stage", "mail_at"], _RAW_KINDS)


def with_keys(classified: DataFrame) -> DataFrame:
    """What the resolver needs of a mail: keys and short strings."""
    return classified.select("user_id", "message_id", "email_at", "company", keys.norm_company(F.col("company")).alias("company_key"), "role", keys.norm_role(F.col("role")).alias("role_key"), "req", "stage")


def resolve_cards(classified: DataFrame, existing: DataFrame) -> DataFrame:
    """``resolve_mail`` without the mail's own columns (columns as RESOLVED)."""
    return resolve_mail(classified, existing).select(*NAMES)


def resolve_mail(classified: DataFrame, existing: DataFrame) -> DataFrame:
    """Each attributable mail with its card and the card's state after all mails (columns as RESOLVED), and ``mail_stage`` and ``mail_at``, the mail's own.

    Company keys are settled first: a key's bucket depends on the order of first appearance only, so each user's
    distinct keys are enough. Cards never cross buckets: mails and stored cards of a user's company are sorted into one
    run of a partition. Only keys and short strings reach the tasks. Mails are taken oldest first, ties by message id;
    existing cards by first mail and id; a time that is null comes last.
    """
    mails = with_keys(classified).dropDuplicates(["user_id", "message_id"])
    cards = existing.select("id", "user_id", "company", "company_key", "role", "role_key", "stage", "locked", F.get(F.split("dedup_key", "::"), F.lit(2)).alias("req"), "first_email_at", "last_email_at")

    first = lambda at, name: F.min(F.struct(F.coalesce(micros(at), F.lit(2**62)).alias("at"), F.col(name).alias("id"))).alias("m")
    seen = mails.groupBy("user_id", "company_key").agg(first("email_at", "message_id")).select("user_id", "company_key", "m.*", F.lit(False).alias("stored"))
    kept = cards.groupBy("user_id", "company_key").agg(first("first_email_at", "id")).select("user_id", "company_key", "m.*", F.lit(True).alias("stored"))
    known = seen.union(kept).groupBy("user_id", "company_key").agg(F.min(F.struct((~F.col("stored")).alias("late"), "at", "id")).alias("m")).select("user_id", "company_key", "m.*")
    in_order = known.repartition("user_id").sortWithinPartitions("user_id", "late", "at", "id").select("user_id", "company_key", (~F.col("late")).alias("stored"))
    settled = in_order.mapInArrow(_settle, "user_id long, company_key string, bucket string")

    none = lambda kind: F.lit(None).cast(kind)
    told = mails.join(settled, ["user_id", "company_key"]).select("user_id", "bucket", F.lit(False).alias("stored"), micros("email_at").alias("at"), F.col("message_id").alias("id"), "company", "role", "role_key", "req", "stage", none("long").alias("last"), none("boolean").alias("locked"))
    had = cards.select("user_id", F.col("company_key").alias("bucket"), F.lit(True).alias("stored"), micros("first_email_at").alias("at"), "id", "company", "role", "role_key", "req", "stage", micros("last_email_at").alias("last"), "locked")
    runs = had.union(told).repartition("user_id", "bucket").sortWithinPartitions("user_id", "bucket", F.desc("stored"), F.asc_nulls_last("at"), "id")
    return with_times(runs.mapInArrow(_resolve, RAW))


def with_times(raw: DataFrame) -> DataFrame:
    return raw.withColumns({c: F.timestamp_micros(c) for c in ("first_email_at", "last_email_at", "mail_at") if c in raw.columns})


def cards_of(resolved: DataFrame) -> DataFrame:
    """The touched cards, one row each, as applications."""
    one = resolved.dropDuplicates(["user_id", "card"])
    key = F.concat_ws("::", "company_key", "role_key", F.coalesce("req", F.lit("")))
    return one.select(F.col("card").alias("id"), "user_id", "company", "company_key", "role", "role_key", "stage", "locked", key.alias("dedup_key"), "first_email_at", "last_email_at")

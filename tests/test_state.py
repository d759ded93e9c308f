"""Streams with keyed state against the batch jobs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mailfunnel.operators import resolve
from mailfunnel.sources import schemas
from mailfunnel.streaming import state

CLASSIFIED = "user_id long, message_id string, email_at timestamp, company string, role string, req string, stage string"
T0 = datetime(2026, 1, 1)


def put(spark, path, i, rows):
    spark.createDataFrame(rows, CLASSIFIED).coalesce(1).write.parquet(f"{path}/{i}")


def run(spark, path, of, name):
    stream = spark.readStream.schema(CLASSIFIED).parquet(f"{path}/*")
    of(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}-c-{name}").trigger(availableNow=True).start(f"{path}-o-{name}").awaitTermination()
    return spark.read.parquet(f"{path}-o-{name}")


def mails(seed, n):
    rng = random.Random(seed)
    return [(rng.randint(1, 4), f"m{i}", T0 + timedelta(hours=i), rng.choice(["Acme", "Acme Foods", "Bank of Ems", "Ems Bank"]), rng.choice(["Data Analyst", "Nurse", None]), rng.choice([None, None, "R1234"]), rng.choice(["applied", "oa", "rejected", "interview"])) for i in range(n)]


def cards_of_mails(resolved):
    return {(r.user_id, r.message_id): r.card for r in resolved.collect()}


def test_state_is_the_replay_with_restarts(spark, tmp_path):
    """Mails in order, three runs with the same checkpoint: cards as in one batch over all."""
    rows, path = mails(1, 90), str(tmp_path / "in")
    for i, part in enumerate((rows[:30], rows[30:50], rows[50:])):
        put(spark, path, i, part)
        got = run(spark, path, state.cards_by_state, "cards")  # a new query each time
    want = resolve.resolve_cards(spark.createDataFrame(rows, CLASSIFIED), spark.createDataFrame([], schemas.APPLICATIONS))
    assert cards_of_mails(got) == cards_of_mails(want) and got.count() == len(rows)
    newest = got.groupBy("card").agg(F.max_by(F.struct("stage", "role", "req", "company_key", "first_email_at", "last_email_at"), "last_email_at").alias("s"))
    final = want.select("card", F.struct("stage", "role", "req", "company_key", "first_email_at", "last_email_at").alias("s")).distinct()
    assert sorted(map(str, newest.collect())) == sorted(map(str, final.collect()))


def test_late_mail_reaches_its_card_and_reopens_nothing(spark, tmp_path):
    path, one = str(tmp_path / "in"), lambda i, day, stage: (1, i, T0 + timedelta(days=day), "Acme", "Nurse", None, stage)
    put(spark, path, 0, [one("b", 5, "rejected")])
    run(spark, path, state.cards_by_state, "cards")
    put(spark, path, 1, [one("a", 0, "interview")])  # late: no reopening, first time moves
    got = {r.message_id: r for r in run(spark, path, state.cards_by_state, "cards").collect()}
    assert got["a"].card == got["b"].card and got["a"].stage == "rejected" and got["a"].first_email_at == T0 and got["a"].last_email_at == T0 + timedelta(days=5)
    put(spark, path, 2, [one("c", 6, "oa")])
    got = {r.message_id: r for r in run(spark, path, state.cards_by_state, "cards").collect()}
    assert got["c"].stage == "oa" and not got["c"].is_new


def test_no_mail_is_lost_or_doubled_by_its_age(spark, tmp_path):
    path, one = str(tmp_path / "in"), lambda i, day: (1, i, T0 + timedelta(days=day), "Acme", "Nurse", None, "applied")
    put(spark, path, 0, [one("a", 0), one("b", 9), one("b", 9)])
    assert sorted((r.message_id, r.late) for r in run(spark, path, state.once_or_late, "once").collect()) == [("a", True), ("b", True)]
    put(spark, path, 1, [one("b", 9), one("old", 1), one("a", 0), one("c", 8)])
    got = run(spark, path, state.once_or_late, "once")
    rows = sorted((r.message_id, r.late) for r in got.collect())
    # a and old are older than the watermark: both come, flagged; the stored keys tell them apart
    assert rows == [("a", True), ("a", True), ("b", True), ("c", False), ("old", True)]
    assert got.columns == [*[x.split()[0] for x in CLASSIFIED.split(", ")], "late"]

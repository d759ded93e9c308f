"""Tables kept by bucket of user: what a batch leaves alone, what a cut-off batch leaves behind, and plans without a shuffle."""

import os
from datetime import datetime

import pytest

from mailfunnel.operators import filters
from mailfunnel.sources import schemas
from mailfunnel.sources.store import Tables
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)


def events(spark, rows):
    cols = [c.split()[0] for c in schemas.EVENTS.split(", ")]
    known = {"email_at": T0, "stage": "applied", "application_id": "x"}
    return spark.createDataFrame([tuple(({"user_id": u, "message_id": m} | known).get(c) for c in cols) for u, m in rows], schemas.EVENTS)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_batch_of_few_users_leaves_the_other_slots_files(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), slots=8)
    all_rows = [(u, f"m{u}") for u in range(100)]
    t.commit(0, {"events": events(spark, all_rows)})
    before = files(tmp_path / "t" / "events")
    few = spark.createDataFrame([(3,), (4,)], "user_id long")
    slots = t.slots_of(few)
    was = t.table("events", slots)
    t.commit(1, {"events": was.unionByName(events(spark, [(3, "new"), (4, "new")]))}, slots)
    after = files(tmp_path / "t" / "events")
    own = {f for f in before if any(f"slot={s}{os.sep}" in f for s in slots)}
    assert {f: v for f, v in after.items() if f in before} == {f: v for f, v in before.items() if f not in own}
    assert sorted((r.user_id, r.message_id) for r in t.table("events").collect()) == sorted([*all_rows, (3, "new"), (4, "new")])
    assert {r.user_id for r in t.of_user("events", 3).collect()} == {3} and t.of_user("events", 3).count() == 2
    # a slot that loses all its rows
    gone = t.table("events", slots).where("false")
    t.commit(2, {"events": gone}, slots)
    assert t.table("events").count() == 100 - was.sparkSession.createDataFrame(all_rows, "user_id long, m string").where(t.slot().isin(*slots)).count()
    again = Tables(spark, str(tmp_path / "t"), slots=8)
    assert again.done() == 2 and again.table("events").count() == t.table("events").count()


def test_a_cut_off_batch_is_completed(spark, tmp_path, monkeypatch):
    t = Tables(spark, str(tmp_path / "t"), slots=4)
    t.commit(0, {"events": events(spark, [(u, "a") for u in range(20)])})
    state = spark.createDataFrame([(1, T0, "ok")], schemas.SYNC_STATE)
    with monkeypatch.context() as m:
        m.setattr(Tables, "_apply", lambda self, batch: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.commit(1, {"events": events(spark, [(u, "b") for u in range(20)]), "sync_state": state})
    assert t.done() == 0 and {r.message_id for r in t.table("events").collect()} == {"a"}
    assert t.recover(1) and t.done() == 1 and t.recover(1) and not t.recover(2)
    assert {r.message_id for r in t.table("events").collect()} == {"b"} and t.table("sync_state").count() == 1


def test_stored_events_are_not_shuffled(spark, tmp_path):
    """J1 reads the stored side as it lies; F10 reads one slot's files."""
    t = Tables(spark, str(tmp_path / "t"), slots=8)
    t.commit(0, {"events": events(spark, [(u, f"m{i}") for u in range(40) for i in range(5)])})
    mail = spark.range(400).select((F.col("id") % 40).alias("user_id"), F.concat(F.lit("m"), (F.col("id") % 10).cast("string")).alias("message_id"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = filters.drop_seen(mail, t.table("events"))
        assert left.count() == 200
        left.collect()
        plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange") == 1, plan  # the new mails only
        scan = t.of_user("events", 7)._jdf.queryExecution().executedPlan().toString()
        filters_at = scan[scan.index("PartitionFilters") :].split("]")[0]
        assert f"= {t._slot_of(7)})" in filters_at and "Exchange" not in scan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)

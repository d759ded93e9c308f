"""The resolver's own parts: buckets by sets of words, runs over many partitions, times without values."""

import random
from datetime import datetime, timedelta

from mailfunnel.operators import resolve
from mailfunnel.sources import schemas

CLASSIFIED = "user_id long, message_id string, email_at timestamp, company string, role string, req string, stage string"
T0 = datetime(2026, 1, 1)


def test_buckets_as_one_by_one():
    rng, words = random.Random(4), ["acme", "foods", "bank", "north", "x", "y", "z"]
    for _ in range(300):
        keys = [" ".join(rng.choices(words, k=rng.choice([0, 1, 1, 2, 2, 3, 5, 8]))) for _ in range(25)]
        stored, new = keys[:3], keys[3:]
        had, want = list(dict.fromkeys(stored)), {}
        for k in new:
            if k not in had:
                want[k] = next((b for b in had if resolve.Buckets._contained(b, k)), k)
                if want[k] == k:
                    had.append(k)
        own = resolve.Buckets(stored)
        assert {k: own.of(k) for k in new if k not in stored} == {k: want.get(k, k) for k in new if k not in stored}


def test_large_company_and_many_users(spark):
    """One company of one user holds a third of all mails; partitions hold runs of many users."""
    rng = random.Random(1)
    rows = [(0, f"h{i}", T0 + timedelta(hours=i), "Acme Foods", rng.choice(["Data Analyst", "Nurse", None]), None, rng.choice(["applied", "oa"])) for i in range(600)]
    rows += [(rng.randint(1, 60), f"m{i}", T0 + timedelta(hours=rng.randint(0, 50)), rng.choice(["Acme", "Acme Bank", "Bank"]), rng.choice(["Data Analyst", None]), rng.choice([None, "R123", "R9999"]), rng.choice(["applied", "rejected", "interview"])) for i in range(1200)]
    rows += [(61, "late", None, "Acme", None, None, "applied"), (61, "first", T0, "Acme", "Nurse", None, "oa")]
    got = {r.message_id: r for r in resolve.resolve_cards(spark.createDataFrame(rows, CLASSIFIED), spark.createDataFrame([], schemas.APPLICATIONS)).collect() }
    assert got["late"].card == got["first"].card and got["late"].last_email_at == T0 and got["late"].stage == "oa"
    users = {}
    for u, m, at, company, role, req, stage in sorted((r for r in rows if r[0] != 61), key=lambda r: (r[0], r[2], r[1])):
        users.setdefault(u, []).append((m, at, company, role, req, stage))
    norm = {"Data Analyst": "analyst data", "Nurse": "nurse", None: ""}
    for u, mails in users.items():
        buckets, cards, card_of = resolve.Buckets(), {}, {}
        for m, at, company, role, req, stage in mails:
            b = buckets.of(company.lower())
            card_of[m] = resolve.assign(cards.setdefault(b, []), u, b, m, at, company, role, norm[role], req, stage)
        for m, c in card_of.items():
            r = got[m]
            assert (r.card, r.stage, r.role, r.req, r.first_email_at, r.last_email_at) == (c["id"], c["stage"], c["role"], c["req"], c["first"], c["last"])


def test_plan_has_no_call_per_group(spark):
    df = resolve.resolve_cards(spark.createDataFrame([], CLASSIFIED), spark.createDataFrame([], schemas.APPLICATIONS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("MapInArrow") == 2 and df.count() == 0

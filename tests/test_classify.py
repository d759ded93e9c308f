"""Classification of many mails: patterns tried only where their words are, contents that read alike classified once."""

import os
import random
import re

import pytest
from mailfunnel.functions import gates, names, patterns, stages
from mailfunnel.operators import classify
from mailfunnel.plans import queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SCHEMA = "user_id long, message_id string, subject string, from_name string, from_email string, snippet string, body string"
STAGED = [stages._FLAGS + p for family in stages.PATTERNS.values() for p in family]
GATED = [stages._FLAGS + p for p in gates.MARKETING + gates.EVENT + gates.EDUCATION] + [p for name, p in vars(gates).items() if name.isupper() and isinstance(p, str)]
PARTS = ["We regret to inform you", "we will not be moving forward", "your APPLICATION to Acme Foods", "pleased to offer you", "an offer letter", "invite you to interview", "online assessment", "thank you for applying", "is under review", "unsubscribe", "50% off", "earn $", "İK Kelvin", "won't be able to offer you", "the role of Data Analyst", "REQ-12345", "role: Nurse Practitioner", "Acme Foods invited you", "the Orchid Team", "a McKinsey recruiter", "verify your account", "lease apartment", "graduate school", "; however", "if selected", "see the portal page", "\n", ". ", "take-home", "pick up where you left off", "Wren Talent Acquisition\n", "&amp;lt;", "“quoted” ’s"]


def made(seed, n, k=8):
    rng = random.Random(seed)
    words = sorted({w for p in STAGED + GATED for w in re.findall(r"[a-z][a-z ']{2,}", p)})
    some = lambda: "".join(rng.choice(PARTS if rng.random() < 0.6 else words) + rng.choice([" ", ". ", ", ", "\n"]) for _ in range(rng.randint(1, k)))
    return [some() for _ in range(n)]


def test_words_are_needed(spark):
    every = STAGED + GATED + names.COMPANY_PHRASES + names.SIGNATURES + names.WEAK + names.ROLE_PHRASES
    df = spark.createDataFrame([(t,) for t in made(1, 500)], "t string").withColumn("low", F.lower("t")).repartition(4).cache()
    for i in range(0, len(every), 40):
        some = every[i : i + 40]
        differ = [F.count_if(patterns.hit(F.col("t"), p, "low") != F.col("t").rlike(p)).alias(f"d{j}") for j, p in enumerate(some)]
        met = [F.count_if(F.col("t").rlike(p)).alias(f"m{j}") for j, p in enumerate(some)]
        got = df.agg(*differ, *met).first()
        assert [p for j, p in enumerate(some) if got[f"d{j}"]] == []
    df.unpersist()


def test_most_patterns_have_words():
    assert sum(bool(patterns.needed(p)) for p in STAGED) == len(STAGED)
    assert patterns.needed(r"(?is)\b(?:decided|chosen)\b[^.]{0,9}\bother\b") == [["other"], ["chosen", "decided"]]
    assert patterns.needed(r"(?:abc)?\d+|x") == [] and patterns.needed(r"thanks?(?=now)") == [["thank"]]


def test_contents_once(spark):
    texts, rng = made(2, 60), random.Random(3)
    rows = [(i % 5, str(i), rng.choice([*PARTS[:6], "", None]), rng.choice(["Acme Foods", "Ann Lee", "", None]), rng.choice(["jobs@acme.com", "a@gmail.com", "x@greenhouse.io", "", None]), rng.choice([*PARTS[:4], "", None]), rng.choice([*texts, "", None])) for i in range(600)]
    rows += [(u, f"{u}-{r[1]}", *r[2:]) for u in range(6, 9) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    each, once = classify.classify_mail(df), classify.classify_once(df)
    assert sorted(each.columns) == sorted(once.columns)
    assert sorted(map(repr, once.select(each.columns).collect())) == sorted(map(repr, each.collect()))
    kept = classify.classify_once(df, keep_evidence=True, stored=True)
    assert kept.select(*each.columns).exceptAll(each).isEmpty() and {"_text", "_low", "_kind", "_gates"} <= set(kept.columns)


def copies(df):
    """How many classifications a plan holds."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("has )?invited you")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["reconcile_branches", "reconcile_verdicts"])
def test_rules_are_worked_out_once(spark, name):
    assert copies(queries.queries()[name](spark, DATA)) == 0  # classified contents are stored, both branches read them


def one_hash(df):
    """Whether a plan hashes contents in projections only: a null filter on the hash would work out every text once more."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return any("sha2(" in line for line in plan) and not any("Filter" in line and "sha2(" in line for line in plan)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["score_summary", "classified_mail", "mail_to_board", "cards_by_key"])
def test_contents_are_hashed_once(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert copies(df) == 1 and one_hash(df)

"""Mails derived from the ``events`` table by rules that Spark and SQL share, so that expected values are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANIES = ["Northwind Robotics", "Acme Foods", "Bluefin Health", "Cedar Energy", "Delta Media", "Evergreen Motors"]
ROLES = ["Software Engineer Intern", "Data Analyst", "Product Designer"]
STAGE = {"signup": "applied", "view": "oa", "click": "interview", "purchase": "offer", "error": "rejected"}
SUBJECT = {"applied": "Your application to {c}", "oa": "Online assessment for {c}", "interview": "Interview with {c}", "offer": "Offer from {c}", "rejected": "Your application to {c}"}
BODY = {
    "applied": "Hi, thank you for applying to {c}. We received your application.",
    "oa": "Hi, please complete the online assessment for your application to {c}.",
    "interview": "Hi, we invite you to interview with {c}.",
    "offer": "Hi, congratulations. We are pleased to offer you a job at {c}.",
    "rejected": "Hi, thank you for applying to {c}. We regret to inform you that we will not be moving forward with your application.",
}


def _case(value: str, pairs) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs) + " END"


def _text(template: str) -> str:
    return " || ".join(["'" + part + "'" for part in template.split("{c}")]).replace(" || ", " || company || ", 1) if "{c}" in template else f"'{template}'"


#: Expressions over ``events`` that both engines read.
COMPANY = _case("event_id % 6", ((i, f"'{c}'") for i, c in enumerate(COMPANIES)))
NOISE = "(event_id % 11 = 0)"
ROLE = f"CASE WHEN event_id % 4 <> 0 THEN {_case('(event_id + user_id) % 3', ((i, repr(r)) for i, r in enumerate(ROLES)))} END"
REQ = "CASE WHEN event_id % 7 = 0 THEN 'REQ-' || CAST(10000 + user_id % 900 AS VARCHAR(20)) END"
TRUE_STAGE = _case("event_type", ((f"'{k}'", f"'{v}'") for k, v in STAGE.items()))

BASE_SQL = f"""SELECT event_id, user_id, CAST(event_id AS VARCHAR(20)) AS message_id, ts AS email_at, {NOISE} AS noise, {COMPANY} AS company, {ROLE} AS role, {REQ} AS req_text, {TRUE_STAGE} AS stage FROM events"""
MAIL_SQL = f"""SELECT event_id, user_id, message_id, 't' || CAST(event_id % 1000 AS VARCHAR(20)) AS thread_id, email_at, noise, company, role, req_text, stage,
  CASE WHEN noise THEN 'Morning briefing' ELSE {_case('stage', ((f"'{k}'", _text(v)) for k, v in SUBJECT.items()))} END AS subject,
  CASE WHEN noise THEN 'The Times' ELSE company || ' Recruiting' END AS from_name,
  CASE WHEN noise THEN 'news@nytimes.com' ELSE 'careers@' || lower(replace(company, ' ', '')) || '.com' END AS from_email,
  CASE WHEN noise THEN 'Top stories and trending topics. Read more in our newsletter or unsubscribe.' ELSE
    {_case('stage', ((f"'{k}'", _text(v)) for k, v in BODY.items()))} || coalesce(' This is about the ' || role || ' position.', '') || coalesce(' Job number ' || req_text || '.', '') END AS body
FROM base"""
#: What classification must find.
EXPECTED_SQL = "SELECT *, NOT noise AS relevant, replace(req_text, 'REQ-', '') AS req FROM mail"


def with_sql(last: str) -> str:
    return f"WITH base AS ({BASE_SQL}), mail AS ({MAIL_SQL}), want AS ({EXPECTED_SQL}) {last}"


def testmail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, message_id, thread_id, subject, from_name, from_email, email_at, snippet, body, labels of every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = spark.sql(BASE_SQL.replace("FROM events", "FROM {e}"), e=events)
    mail = spark.sql(MAIL_SQL.replace("FROM base", "FROM {b}"), b=base)
    labels = F.when(F.col("event_id") % 13 == 0, F.array(F.lit("CATEGORY_PROMOTIONS"))).otherwise(F.array(F.lit("INBOX")))
    return mail.select("user_id", "message_id", "thread_id", "subject", "from_name", "from_email", "email_at", F.substring("body", 1, 200).alias("snippet"), "body", labels.alias("labels"))


def templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mails as already classified rows: user_id, message_id, email_at, stage, company, role, req."""
    base = spark.sql(BASE_SQL.replace("FROM events", "FROM {e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return base.where("not noise").select("user_id", "message_id", "email_at", "stage", "company", "role", F.regexp_replace("req_text", "REQ-", "").alias("req"))


CARD_SQL = """SELECT CAST(o_orderkey AS VARCHAR(20)) AS id, o_custkey AS user_id, 'Company ' || CAST(o_orderkey % 7 AS VARCHAR(20)) || CASE WHEN o_orderkey % 2 = 0 THEN ' Inc' ELSE '' END AS company, 'Engineer' AS role,
  CASE o_orderstatus WHEN 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'oa' ELSE 'interview' END WHEN 'F' THEN CASE o_orderkey % 4 WHEN 0 THEN 'offer' ELSE 'rejected' END ELSE CASE o_orderkey % 2 WHEN 0 THEN 'accepted' ELSE 'declined' END END AS stage,
  o_orderdate AS first_email_at, o_orderdate AS last_email_at, o_orderkey % 5 = 0 AS locked FROM orders"""
EVENT_SQL = """SELECT CAST(l_orderkey AS VARCHAR(20)) AS application_id, CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) AS message_id,
  CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'interview' WHEN 1 THEN 'offer' WHEN 2 THEN 'oa' ELSE 'applied' END AS stage, l_shipdate AS email_at FROM lineitem"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made cards: every order."""
    return spark.sql(CARD_SQL.replace("FROM orders", "FROM {o}"), o=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def card_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their events: every order line."""
    return spark.sql(EVENT_SQL.replace("FROM lineitem", "FROM {l}"), l=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))

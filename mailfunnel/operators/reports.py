"""Boards, rates, weekly activity and funnel per user (A5-A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions import lexicon as lx


def board_counts(apps: DataFrame) -> DataFrame:
    col = keys.board_column(F.col("stage"))
    return apps.groupBy("user_id").agg(F.count("*").alias("total"), *[F.count_if(col == s).alias(s) for s in lx.BOARD])


def _percent(n: Column) -> Column:
    return F.when(F.count("*") > 0, F.floor(n * 100 / F.count("*") + 0.5)).otherwise(0).cast("int")


def insights(apps: DataFrame) -> DataFrame:
    s = F.col("stage")
    return apps.groupBy("user_id").agg(_percent(F.count_if(s != "applied")).alias("response_rate"), _percent(F.count_if(s.isin("interview", "offer", "accepted", "declined"))).alias("interview_rate"), _percent(F.count_if(keys.board_column(s) == "offer")).alias("offer_rate"))


def weekly_activity(apps: DataFrame, as_of: Column, weeks: int = 10) -> DataFrame:
    """A row for every user and week, oldest first, zeros filled in: ``user_id, weeks_ago, cards, max_week``."""
    ago = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("first_email_at")) / (7 * 86400))
    counts = apps.select("user_id", ago.alias("b")).groupBy("user_id").agg(*[F.count_if(F.col("b") == w).alias(f"w{w}") for w in range(weeks)])
    every = F.array(*[F.struct(F.lit(w).alias("weeks_ago"), F.col(f"w{w}").alias("cards")) for w in reversed(range(weeks))])
    most = F.greatest(F.lit(1), F.array_max(F.array(*[F.col(f"w{w}") for w in range(weeks)])))
    return counts.select("user_id", F.explode(every).alias("x"), most.alias("max_week")).select("user_id", "x.weeks_ago", "x.cards", "max_week")


def funnel_counts(apps: DataFrame, events: DataFrame) -> DataFrame:
    """Nine counts per user. Events are reduced to two flags per card before they meet the cards."""
    late = ["offer", "accepted", "declined"]
    has = lambda names: F.bool_or(F.col("stage").isin(*names))
    past = events.groupBy(F.col("application_id").alias("id")).agg(has(["interview", *late]).alias("i"), has(late).alias("o"))
    s = F.col("stage")
    a = apps.join(past, "id", "left").select("user_id", s, (s.isin("interview", *late) | F.coalesce("i", F.lit(False))).alias("i"), (s.isin(*late) | F.coalesce("o", F.lit(False))).alias("o"))
    i, o, r = F.col("i"), F.col("o"), s == "rejected"
    flags = {"interviewed": i, "rejected": ~i & r, "awaiting": ~i & ~r, "offers": i & o, "no_offer": i & ~o & r, "interviewing": i & ~o & ~r, "accepted": o & (s == "accepted"), "declined": o & (s == "declined"), "offer_pending": o & ~s.isin("accepted", "declined")}
    return a.groupBy("user_id").agg(F.count("*").alias("apps"), *[F.count_if(c).alias(n) for n, c in flags.items()])


NODES = [("apps", 0), ("interviewed", 1), ("awaiting", 1), ("rejected", 1), ("offers", 2), ("interviewing", 2), ("no_offer", 2), ("accepted", 3), ("declined", 3), ("offer_pending", 3)]
LINKS = [("apps", "interviewed"), ("apps", "awaiting"), ("apps", "rejected"), ("interviewed", "offers"), ("interviewed", "interviewing"), ("interviewed", "no_offer"), ("offers", "accepted"), ("offers", "declined"), ("offers", "offer_pending")]


def funnel_nodes(counts: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(layer).alias("layer"), F.col(n).alias("value")) for n, layer in NODES])
    return counts.select("user_id", F.explode(rows).alias("x")).select("user_id", "x.*").where("value > 0")


def funnel_links(counts: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(b).alias("value")) for a, b in LINKS])
    return counts.select("user_id", F.explode(rows).alias("x")).select("user_id", "x.*").where("value > 0")


def sync_summary(mail: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per user: mails scanned, events made, cards touched."""
    scanned = mail.groupBy("user_id").agg(F.count("*").alias("scanned"))
    made = resolved.groupBy("user_id").agg(F.count("*").alias("new_events"), F.count_distinct("card").alias("applications_touched"))
    return scanned.join(made, "user_id", "left").na.fill(0)

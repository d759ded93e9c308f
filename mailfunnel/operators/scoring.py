"""Scores of classifications against labelled mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys


def _accepted(expect: Column, name: str, found: Column, norm) -> Column:
    """null: not scored (the field is absent); else whether the value agrees with any accepted variant (null must be empty)."""
    raw = expect[name]
    variants = F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))
    agree = F.exists(variants, lambda x: F.coalesce(norm(x) == norm(found), x.isNull() & (F.coalesce(found, F.lit("")) == "")))
    empty = F.coalesce(found, F.lit("")).isin("", "Unknown Company")
    return F.when(F.map_contains_key(expect, name), F.when(raw.isNull(), empty).otherwise(F.coalesce(agree, F.lit(False))))


def score_predictions(predicted: DataFrame, fixtures: DataFrame) -> DataFrame:
    want = fixtures.select(F.col("id").alias("message_id"), F.col("split"), F.col("source").alias("origin"), F.from_json("expect", "map<string,string>").alias("e"))
    j = predicted.join(want, "message_id")
    relevant = F.col("e")["relevant"].cast("boolean")
    both = relevant & F.col("relevant")
    stage = F.when(both & F.map_contains_key(F.col("e"), "stage"), F.col("e")["stage"] == F.col("stage"))
    out = j.select("message_id", "split", "origin", "source", (relevant == F.col("relevant")).alias("relevant_ok"), stage.alias("stage_ok"), F.when(both, _accepted(F.col("e"), "company", F.col("company"), keys.norm_company)).alias("company_ok"), F.when(both, _accepted(F.col("e"), "role", F.col("role"), keys.norm_role)).alias("role_ok"))
    parts = [F.coalesce(c, F.lit(True)) for c in ("stage_ok", "company_ok", "role_ok")]
    return out.withColumn("passed", F.col("relevant_ok") & parts[0] & parts[1] & parts[2])


def score_summary(scores: DataFrame) -> DataFrame:
    """Passed and total by split and origin with subtotals; ``llm`` counts mails with a model's verdict."""
    return scores.rollup("split", "origin").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.count_if(F.col("source") == "llm").alias("llm"))

"""Model requests and verdicts (L1-L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates, keys, names, stages
from ..functions import lexicon as lx
from ..functions.steps import step


def build_prompt_batches(mail: DataFrame, size: int = 10) -> DataFrame:
    """``user_id, batch, message_ids, prompt``: a user's mails oldest first, ``size`` to a batch, each as a numbered block."""
    order = Window.partitionBy("user_id").orderBy("email_at", "message_id")
    n = F.row_number().over(order) - 1
    m = mail.withColumn("_n", n).withColumns({"batch": F.floor(F.col("_n") / size), "i": F.col("_n") % size})
    block = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] From: "), F.coalesce("from_name", F.lit("")), F.lit(" <"), "from_email", F.lit(">\nSubject: "), "subject", F.lit("\n"), F.substring(F.coalesce("body", F.lit("")), 1, 2000))
    rows = F.array_sort(F.collect_list(F.struct("i", "message_id", block.alias("block"))))
    out = m.groupBy("user_id", "batch").agg(rows.alias("r"))
    return out.select("user_id", "batch", F.transform("r", lambda x: x["message_id"]).alias("message_ids"), F.array_join(F.transform("r", lambda x: x["block"]), "\n\n").alias("prompt"))


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """``responses(batch_id, n, response)`` -> a row per valid verdict.

    Malformed JSON gives none; entries with an index outside 0..n-1 or a relevance that is no boolean are left out; an unknown
    stage becomes applied and a blank company unknown; of several for an index the last counts. An absent role and a null one
    differ: ``has_role``.
    """
    each = responses.select("batch_id", "n", F.posexplode(F.try_parse_json("response").cast("array<variant>")).alias("pos", "v"))
    field = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    kind = lambda name: F.schema_of_variant(field(name, "variant"))
    each = each.select("batch_id", "n", "pos", field("index", "int").alias("index"), kind("index").alias("_i"), kind("relevant").alias("_b"), field("relevant", "boolean").alias("relevant"), field("stage", "string").alias("_s"), F.trim(field("company", "string")).alias("_c"), field("role", "string").alias("role"), field("role", "variant").isNotNull().alias("has_role"), field("req", "string").alias("req"))
    ok = each.where((F.col("_b") == "BOOLEAN") & F.col("_i").isin("BIGINT", "INT", "TINYINT", "SMALLINT") & (F.col("index") >= 0) & (F.col("index") < F.col("n")))
    last = Window.partitionBy("batch_id", "index").orderBy(F.desc("pos"))
    ok = ok.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return ok.select("batch_id", "index", "relevant", F.when(F.col("_s").isin(*lx.STAGES), F.col("_s")).otherwise("applied").alias("stage"), F.coalesce(F.nullif(F.col("_c"), F.lit("")), F.lit(lx.UNKNOWN)).alias("company"), "role", "has_role", "req")


def reconcile_verdicts(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rules`` (classify_mail with its evidence) and ``verdicts(message_id, ...)`` to one classification a mail."""
    v = verdicts.select("message_id", *[F.col(c).alias(f"v_{c}") for c in ("relevant", "stage", "company", "role", "has_role", "req")])
    j = rules.join(v, "message_id", "left")
    has, text, k = F.col("v_relevant").isNotNull(), F.col("_text"), F.col("_kind")
    shut = gates.hard_irrelevant(text, F.col("_gates"), "_low")
    company = F.coalesce(F.when(F.col("v_company") != lx.UNKNOWN, names.plausible_company(F.col("v_company"))), F.col("company"))
    role = F.when(~F.col("v_has_role"), F.col("role")).otherwise(names.sanitize_role(F.col("v_role")))
    req = F.upper(F.regexp_replace("v_req", "[^A-Za-z0-9]", ""))
    req = F.when(F.length(req).between(4, 16) & ~req.rlike(r"^20\d\d$") & F.upper(text).contains(F.upper("v_req")), req)
    ordinary = ~(k["board"] | k["noise"] | k["freemail"])
    rescued = ~F.col("v_relevant") & F.col("relevant") & F.col("stage").isin("rejected", "offer") & (F.col("confidence") >= 0.7) & ordinary
    use = has & ~rescued
    new = {"relevant": F.when(use, F.col("v_relevant") & ~shut).otherwise(F.col("relevant")), "company": F.when(use, company).otherwise(F.col("company")), "role": F.when(use, role).otherwise(F.col("role")), "req": F.when(use, req).otherwise(F.col("req")), "stage": F.when(use, stages.guard_stage(F.col("v_stage"), text, "_low")).otherwise(F.col("stage")), "confidence": F.when(use, 0.92).otherwise(F.col("confidence")), "source": F.when(use, "llm").otherwise(F.col("source"))}
    return step(j, new).select(*[c for c in rules.columns if not c.startswith("_")])

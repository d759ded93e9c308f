"""Classification of mails by rules (C19), staged so that no expression is worked out twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode, gates, keys, names, stages
from ..functions.steps import checkpointed, step

#: What classification reads of a mail.
CONTENT = ["subject", "from_name", "from_email", "snippet", "body"]
READ = 20000


def spread(mail: DataFrame) -> DataFrame:
    """Mails over at least as many partitions as shuffles have, unless the plan's own estimate fills these already: the work is in the
    patterns, not in the bytes. Nothing is run to find out. Streams stay as they are."""
    if mail.isStreaming:
        return mail
    n = int(mail.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = mail._jdf.queryExecution()
    size, each = int(str(plan.optimizedPlan().stats().sizeInBytes())), int(plan.sparkSession().sessionState().conf().filesMaxPartitionBytes())
    return mail if size >= n * each else mail.repartition(n)


def evidence(mail: DataFrame) -> DataFrame:
    """Adds the text that is judged, its decisive and unhedged parts, the sender's classes, the evidence flags and the gates."""
    mail = spread(mail)
    body = F.coalesce("body", F.lit(""))
    text = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.when(body == "", F.coalesce("snippet", F.lit(""))).otherwise(F.substring(body, 1, 2000)))
    out = step(mail, {"_text": decode.decode_entities(text), "_domain": keys.domain_of(F.col("from_email"))})
    out = step(out, {"_low": F.lower("_text"), "_clauses": stages.unhedged_clauses(F.col("_text")), "_kind": keys.sender_class(F.col("_domain"))})
    out = step(out, {"_decisive": stages.decisive_text(F.col("_clauses")), "_unhedged": stages.unhedged_text(F.col("_clauses"))}).drop("_clauses")
    out = step(out, {"_low_d": F.lower("_decisive"), "_low_u": F.lower("_unhedged")})
    out = step(out, {"_hits": stages.stage_hits(F.col("_text"), F.col("_decisive"), F.col("_unhedged"), ("_low", "_low_d", "_low_u"))}).drop("_decisive", "_unhedged", "_low_d", "_low_u")
    out = step(out, {"_flags": gates.flags(F.col("_text"), "_low", F.col("_hits")), "_stage": stages.detect_stage(F.col("_hits"))})
    out = step(out, {"_flags": gates.decisions(F.col("_flags"))})
    return step(out, {"_gates": gates.relevance_gates(F.col("_text"), "_low", F.coalesce("subject", F.lit("")), F.coalesce("from_email", F.lit("")), F.col("_domain"), F.col("_kind"), F.col("_flags"))})


def classify_mail(mail: DataFrame, keep_evidence: bool = False) -> DataFrame:
    """Adds relevant, stage (applied by default), company, role, req, confidence and source to every mail."""
    out = evidence(mail)
    subject, body = decode.decode_entities(F.coalesce("subject", F.lit(""))), decode.decode_entities(F.substring(F.coalesce("body", F.lit("")), 1, READ))
    kind, found = F.col("_kind"), F.col("_stage")
    out = step(out, {"_subject": subject, "_body": body})
    out = step(out, {"_named": names.company_text(F.col("_subject"), F.col("_body")), "_titled": names.role_text(F.col("_subject"), F.col("_body"))})
    out = step(out, {"_low_n": F.lower("_named"), "_low_t": F.lower("_titled")})
    out = step(
        out,
        {
            "relevant": gates.is_relevant(found["stage"], kind, F.col("_gates")),
            "stage": F.coalesce(found["stage"], F.lit("applied")),
            "company": names.extract_company(F.col("_named"), "_low_n", F.col("_body"), F.coalesce("from_name", F.lit("")), F.coalesce("from_email", F.lit("")), F.col("_domain"), kind),
            "_role": names.extract_role(F.col("_titled"), "_low_t"),
            "req": stages.extract_req_id(F.concat_ws("\n", F.col("_subject"), F.substring("_body", 1, 1200))),
            "confidence": F.coalesce(found["confidence"], F.when(kind["ats"], 0.4).otherwise(0.2)),
            "source": F.lit("rules"),
        },
    )
    out = step(out, {"_role": names.strip_leading_company(F.col("_role"), F.col("company"))})
    out = step(out, {"role": F.when(~names.role_is_just_company(keys.norm_role(F.col("_role")), keys.norm_company(F.col("company"))), F.col("_role"))})
    return out if keep_evidence else out.select(*[c for c in out.columns if not c.startswith("_")])


def content_of(mail: DataFrame) -> dict[str, Column]:
    """CONTENT as far as it is read: nulls as '', the snippet only where there is no body."""
    read = {c: F.coalesce(F.col(c), F.lit("")) for c in CONTENT}
    return read | {"snippet": F.when(read["body"] == "", read["snippet"]).otherwise(""), "body": F.substring(read["body"], 1, READ)}


def classify_once(mail: DataFrame, keep_evidence: bool = False, stored: bool = False) -> DataFrame:
    """``classify_mail`` for tables of many mailboxes in which mails read alike (templates, mass mailings): each distinct content is classified once.

    Contents are made distinct before and within the shuffle, classified, and joined to their mails by SHA-256, so no text goes with the
    mails. ``mail`` is read twice; where no two mails read alike, ``classify_mail`` is the cheaper one. ``stored``: the
    classified contents are kept in the shared folder, for plans that use the result more than once. Streams are classified mail by mail.
    """
    if mail.isStreaming:
        return classify_mail(mail, keep_evidence)
    read = content_of(mail)
    # never null, as Spark sees: else the join's null filter is pushed below ``distinct`` with all texts copied into it
    key = F.coalesce(F.sha2(F.concat_ws(":", *[F.length(c) for c in read.values()], *read.values()), 256), F.lit(""))
    found = classify_mail(mail.select(*[c.alias(n) for n, c in read.items()]).distinct().withColumn("content", key), keep_evidence).drop(*CONTENT)
    found = checkpointed(found) if stored else found
    return step(mail, {"content": key}).join(found.hint("merge"), "content").drop("content")


def attributable(classified: DataFrame) -> DataFrame:
    """F8: relevant mails of a known company."""
    from ..functions.lexicon import UNKNOWN

    return classified.where(F.col("relevant") & (F.col("company") != UNKNOWN))

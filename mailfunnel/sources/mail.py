"""Sources S1 and S2 and the decoding of raw messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode
from ..functions.steps import checkpointed
from .schemas import FIXTURE, raw_schema


def read_raw_mail(spark: SparkSession, path: str, depth: int = 5) -> DataFrame:
    return spark.read.schema(raw_schema(depth)).json(path)


def deep_bodies(raw: DataFrame) -> DataFrame:
    """``raw(_row, payload)`` with parts of any depth -> ``_row, _body``.

    Parts are opened a level a round until none has parts of its own; a part's path of places keeps the order of the document:
    the first part of a kind, depth first, is the one with the least path.
    """
    front = raw.select("_row", F.array().cast("array<int>").alias("path"), F.to_variant_object("payload").alias("node"))
    get = lambda path, kind: F.try_variant_get("node", path, kind)
    found = None
    while front is not None:
        own = front.select("_row", "path", F.lower(get("$.mimeType", "string")).alias("mime"), get("$.body.data", "string").alias("data"))
        found = own if found is None else found.union(own)
        inner = front.select("_row", "path", F.posexplode(get("$.parts", "array<variant>")).alias("i", "part"))
        inner = checkpointed(inner.select("_row", F.concat("path", F.array("i")).alias("path"), F.col("part").alias("node")))
        front = None if inner.isEmpty() else inner
    first = lambda mime: F.min_by("data", F.when((F.col("mime") == mime) & (F.length("data") > 0), F.col("path")))
    best = found.groupBy("_row").agg(first("text/plain").alias("plain"), first("text/html").alias("html"), F.max(F.when(F.size("path") == 0, F.col("data"))).alias("root"))
    return best.select("_row", decode.body_of(F.col("plain"), F.col("html"), F.col("root")).alias("_body"))


def parse_messages(raw: DataFrame, now, depth: int = 5) -> DataFrame:
    """Raw messages to mails: headers, sender, time, body without quoted text. ``now`` stands in where no date is known.

    Messages whose parts end within ``depth`` are one projection. Others, of any depth, are looked for in a job of their own and opened
    level by level; a stream takes their parts down to ``depth``.
    """
    h = lambda name: decode.header(F.col("payload.headers"), name)
    sender = decode.parse_from(h("From"))

    def mails(rows: DataFrame, body: Column) -> DataFrame:
        return rows.select(
            "user_id", F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"), h("Subject").alias("subject"), sender["name"].alias("from_name"), sender["email"].alias("from_email"),
            decode.message_time(F.col("internalDate"), h("Date"), now if not isinstance(now, str) else F.lit(now).cast("timestamp")).alias("email_at"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
            decode.strip_quoted(body).alias("body"),
        )

    typed = decode.extract_body(F.col("payload"), depth)
    if raw.isStreaming:
        return mails(raw, typed)
    is_deep = F.coalesce(decode.has_deeper(F.col("payload"), depth), F.lit(False))
    deep = checkpointed(raw.where(is_deep).withColumn("_row", F.monotonically_increasing_id()))
    if deep.isEmpty():
        return mails(raw, typed)
    return mails(raw.where(~is_deep), typed).union(mails(deep.join(deep_bodies(deep), "_row"), F.col("_body")))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Labelled mails of all JSON files; ``expect`` stays JSON text, so that an absent field and null differ. A repeated id is an error."""
    rows = spark.read.option("multiLine", True).schema(FIXTURE).json(path)
    twice = rows.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated fixture ids: {[r.id for r in twice]}")
    return rows


def fixture_mail(fixtures: DataFrame) -> DataFrame:
    body = F.coalesce("email.body", F.lit(""))
    return fixtures.select(F.lit(0).cast("long").alias("user_id"), F.col("id").alias("message_id"), F.lit("").alias("thread_id"), F.col("email.subject").alias("subject"), F.col("email.fromName").alias("from_name"), F.col("email.fromEmail").alias("from_email"), F.lit("2026-01-15 12:00:00").cast("timestamp").alias("email_at"), F.substring(body, 1, 200).alias("snippet"), body.alias("body"))

"""The registered queries of the mail jobs and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, keys, stages
from ..functions import lexicon as lx
from ..operators import classify, filters, reports, resolve, scoring, similarity, sync, verdicts
from ..operators import stages as folding
from ..sources import tables
from ..sources.mail import parse_messages
from ..sources.schemas import raw_schema
from .testmail import CARD_SQL, EVENT_SQL, card_events, cards, templated, testmail, with_sql

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        REGISTERED[f.__name__.removeprefix("q_")] = (f, sql)
        return f

    return put


def _rank(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.PROGRESSION.items()) + " END"


def _stage_of(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in lx.PROGRESSION.items()) + " END"


def fold_sql(source: str, by: str, seq: str) -> str:
    """The ratchet over ``source(by, stage, email_at, seq)`` in SQL."""
    return f"""(WITH a AS (SELECT *, {_rank('stage')} AS rk, row_number() OVER (PARTITION BY {by} ORDER BY {seq}) AS n, max(email_at) OVER (PARTITION BY {by} ORDER BY {seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM {source}),
b AS (SELECT *, max(CASE WHEN stage = 'rejected' THEN n END) OVER (PARTITION BY {by}) AS r FROM a),
c AS (SELECT *, min(CASE WHEN n > r AND email_at > bef THEN n END) OVER (PARTITION BY {by}) AS k FROM b)
SELECT {by}, {_stage_of('w')} AS stage, first_email_at, last_email_at, emails FROM (SELECT {by}, min(email_at) AS first_email_at, max(email_at) AS last_email_at, count(*) AS emails,
  CASE WHEN max(rk) >= 5 OR max(r) IS NULL THEN max(rk) ELSE coalesce(max(CASE WHEN n >= k THEN rk END), 4) END AS w FROM c GROUP BY {by}))"""


def _key(company: str = "company", role: str = "role", req: str = "req") -> str:
    words = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), '\\b({'|'.join(lx.COMPANY_SUFFIXES)})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    same = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.ROLE_SYNONYMS.items())
    stop = ", ".join(f"'{w}'" for w in lx.ROLE_STOPWORDS)
    roles = f"coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(lower({role}), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda t: CASE t {same} ELSE t END), lambda t: length(t) > 1 AND t NOT IN ({stop}) AND NOT regexp_matches(t, '[0-9]')))), ' '), '')"
    return f"{words(company)} || '::' || {roles} || '::' || coalesce({req}, '')"


KEYED = with_sql(f"SELECT user_id, {_key()} AS dedup_key, stage, email_at, message_id FROM want WHERE relevant")
FOLDED = fold_sql(f"({KEYED})", "user_id, dedup_key", "email_at, message_id")


@query(with_sql("SELECT user_id, message_id, relevant, CASE WHEN relevant THEN stage END AS stage, CASE WHEN relevant THEN company END AS company, CASE WHEN relevant THEN role END AS role, CASE WHEN relevant THEN req END AS req FROM want"))
def q_classified_mail(spark, d):
    """C19 with F5-F7 and C1-C9: every mail classified."""
    out = classify.classify_once(testmail(spark, d))
    only = lambda c: F.when(F.col("relevant"), F.col(c)).alias(c)
    return out.select("user_id", "message_id", "relevant", *[only(c) for c in ("stage", "company", "role", "req")])


def _keyed(spark, d) -> DataFrame:
    good = classify.attributable(classify.classify_once(testmail(spark, d)))
    return good.withColumn("dedup_key", keys.dedup_key(F.col("company"), F.col("role"), F.col("req")))


@query(f"SELECT user_id, dedup_key, stage, first_email_at, last_email_at, emails FROM {FOLDED}")
def q_cards_by_key(spark, d):
    """R2, A1, A2: mails grouped by exact key, stages folded, times and counts rolled up."""
    return folding.fold_stages(_keyed(spark, d), ["user_id", "dedup_key"], rolled=True)


@query("SELECT user_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (CASE WHEN stage IN ('accepted', 'declined') THEN 'offer' ELSE stage END = '{s}') AS {s}" for s in lx.BOARD) + f" FROM {FOLDED} GROUP BY user_id")
def q_mail_to_board(spark, d):
    """The flagship: mails to boards."""
    return reports.board_counts(folding.fold_stages(_keyed(spark, d), ["user_id", "dedup_key"]))


@query("SELECT user_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (CASE WHEN stage IN ('accepted', 'declined') THEN 'offer' ELSE stage END = '{s}') AS {s}" for s in lx.BOARD) + f" FROM ({CARD_SQL}) GROUP BY user_id")
def q_board_counts(spark, d):
    return reports.board_counts(cards(spark, d))


@query(f"""SELECT user_id, CAST(floor(count(*) FILTER (stage <> 'applied') * 100 / count(*) + 0.5) AS INTEGER) AS response_rate,
CAST(floor(count(*) FILTER (stage IN ('interview', 'offer', 'accepted', 'declined')) * 100 / count(*) + 0.5) AS INTEGER) AS interview_rate,
CAST(floor(count(*) FILTER (stage IN ('offer', 'accepted', 'declined')) * 100 / count(*) + 0.5) AS INTEGER) AS offer_rate FROM ({CARD_SQL}) GROUP BY user_id""")
def q_insights(spark, d):
    return reports.insights(cards(spark, d))


AS_OF = "TIMESTAMP '1998-08-02 00:00:00'"


@query(f"""WITH c AS (SELECT user_id, CAST(floor((epoch({AS_OF}) - epoch(first_email_at)) / 604800) AS INTEGER) AS b FROM ({CARD_SQL})),
w AS (SELECT user_id, weeks_ago, (SELECT count(*) FROM c x WHERE x.user_id = u.user_id AND x.b = weeks_ago) AS cards FROM (SELECT DISTINCT user_id FROM c) u, (SELECT unnest(range(10)) AS weeks_ago))
SELECT user_id, CAST(weeks_ago AS INTEGER) AS weeks_ago, cards, greatest(1, max(cards) OVER (PARTITION BY user_id)) AS max_week FROM w""")
def q_weekly_activity(spark, d):
    return reports.weekly_activity(cards(spark, d), F.expr(AS_OF))


FUNNEL = f"""(WITH p AS (SELECT application_id AS id, bool_or(stage IN ('interview', 'offer', 'accepted', 'declined')) AS i, bool_or(stage IN ('offer', 'accepted', 'declined')) AS o FROM ({EVENT_SQL}) GROUP BY 1),
a AS (SELECT user_id, stage, stage IN ('interview', 'offer', 'accepted', 'declined') OR coalesce(i, false) AS i, stage IN ('offer', 'accepted', 'declined') OR coalesce(o, false) AS o, stage = 'rejected' AS r FROM ({CARD_SQL}) c LEFT JOIN p USING (id))
SELECT user_id, count(*) AS apps, count(*) FILTER (i) AS interviewed, count(*) FILTER (NOT i AND r) AS rejected, count(*) FILTER (NOT i AND NOT r) AS awaiting, count(*) FILTER (i AND o) AS offers, count(*) FILTER (i AND NOT o AND r) AS no_offer,
count(*) FILTER (i AND NOT o AND NOT r) AS interviewing, count(*) FILTER (o AND stage = 'accepted') AS accepted, count(*) FILTER (o AND stage = 'declined') AS declined, count(*) FILTER (o AND stage NOT IN ('accepted', 'declined')) AS offer_pending FROM a GROUP BY user_id)"""


@query(f"SELECT * FROM {FUNNEL}")
def q_funnel_counts(spark, d):
    return reports.funnel_counts(cards(spark, d), card_events(spark, d))


@query(" UNION ALL ".join(f"SELECT user_id, '{n}' AS node, {layer} AS layer, {n} AS value FROM {FUNNEL} WHERE {n} > 0" for n, layer in reports.NODES))
def q_funnel_nodes(spark, d):
    return reports.funnel_nodes(reports.funnel_counts(cards(spark, d), card_events(spark, d)))


@query(" UNION ALL ".join(f"SELECT user_id, '{a}' AS source, '{b}' AS target, {b} AS value FROM {FUNNEL} WHERE {b} > 0" for a, b in reports.LINKS))
def q_funnel_links(spark, d):
    return reports.funnel_links(reports.funnel_counts(cards(spark, d), card_events(spark, d)))


def _replaced(c: str, steps: list[tuple[str, str]]) -> str:
    for p, to in steps:
        p, to = (x.replace("'", "''") for x in (p, to))
        c = f"regexp_replace({c}, '{p}', '{to}', 'g')"
    return c


_S = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
HTML = _replaced("html", [("(?is)<style[^>]*>.*?</style>", " "), ("(?is)<script[^>]*>.*?</script>", " "), ("(?i)</(?:p|div|tr|li|h[1-6])>", "\n"), (r"(?i)<br\s*/?>", "\n"), ("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&(?:#39|apos);", "'"), ("[ \t]+", " "), ("\n{3,}", "\n\n"), (f"^[{_S}]+|[{_S}]+\\z", "")])


@query(f"SELECT page_id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, {HTML} AS t FROM pages)")
def q_html_to_text(spark, d):
    t = decode.html_to_text(F.col("html"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.alias("t")).select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").alias("n"))


@query("WITH q AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, trim(regexp_replace(text, E'\\n{3,}', E'\\n\\n', 'g'), E' \\n\\t\\r') AS body FROM q")
def q_strip_quoted(spark, d):
    """Each turn with the turn before quoted under it comes back as itself."""
    from pyspark.sql import Window

    t = spark.read.parquet(f"{d}/conversations.parquet")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    quoted = F.concat(F.col("text"), F.coalesce(F.concat(F.lit("\n\nOn Monday someone wrote:\n> "), F.replace(before, F.lit("\n"), F.lit("\n> "))), F.lit("")))
    return t.select("conv_id", "turn", decode.strip_quoted(quoted).alias("body"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def q_decode_base64url(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    coded = F.rtrim(F.translate(F.base64(F.col("text").cast("binary")), "+/\r\n", "-_"), F.lit("="))
    return t.select("doc_id", F.md5(decode.decode_base64url(coded).cast("binary")).alias("digest"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '‘’“”', '''''""'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&(?:quot|ldquo|rdquo|#34);', '"', 'g'), '(?i)&(?:apos|lsquo|rsquo|#0?39|#x27);', '''', 'g'), '(?i)&(?:[a-z]+|#\\d+|#x[0-9a-f]+);', ' ', 'g')) AS digest FROM documents""")
def q_decode_entities(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(decode.decode_entities(F.col("text")).cast("binary")).alias("digest"))


PHRASE = "|".join(re.escape(p) for p in lx.CANDIDATE_PHRASES).replace("\\ ", " ").replace("\\-", "-")


@query(with_sql(f"SELECT user_id, message_id FROM mail WHERE NOT noise AND event_id % 13 <> 0 AND regexp_matches(lower(subject || ' ' || body), '{PHRASE}')"))
def q_candidate_filter(spark, d):
    return filters.candidate_filter(testmail(spark, d)).select("user_id", "message_id")


@query("SELECT user_id, CAST(event_id AS VARCHAR) AS message_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events) WHERE n <= 25")
def q_cap_per_user(spark, d):
    return filters.cap_per_user(testmail(spark, d), 25).select("user_id", "message_id")


STATE = "SELECT user_id, max(ts) - INTERVAL 3 DAY AS last_synced_at FROM events WHERE user_id % 3 <> 0 GROUP BY user_id"


@query(f"WITH s AS ({STATE}) SELECT e.user_id, CAST(event_id AS VARCHAR) AS message_id FROM events e LEFT JOIN s ON e.user_id = s.user_id WHERE s.user_id IS NULL OR floor(epoch(ts)) > floor(epoch(last_synced_at)) - 172800")
def q_since_last_sync(spark, d):
    mail = testmail(spark, d)
    state = mail.where("user_id % 3 <> 0").groupBy("user_id").agg((F.max("email_at") - F.expr("INTERVAL 3 DAYS")).alias("last_synced_at"))
    return filters.since_last_sync(mail, state).select("user_id", "message_id")


@query(with_sql("SELECT user_id, message_id FROM mail WHERE NOT (user_id % 2 = 0 AND NOT noise AND company = 'Acme Foods')"))
def q_drop_own_mail(spark, d):
    mail = testmail(spark, d)
    accounts = mail.where("user_id % 2 = 0").select("user_id").distinct().withColumn("email", F.lit("Careers@AcmeFoods.com"))
    return filters.drop_own_mail(mail, accounts).select("user_id", "message_id")


@query("SELECT user_id, CAST(event_id AS VARCHAR) AS message_id FROM events WHERE event_id % 3 <> 0 AND user_id IN (SELECT c_custkey FROM customer)")
def q_unseen_of_connected(spark, d):
    """Mails not stored yet, of users with an account."""
    mail = testmail(spark, d)
    seen = mail.where("cast(message_id as long) % 3 = 0")
    accounts = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return filters.connected_only(filters.drop_seen(mail, seen), accounts).select("user_id", "message_id")


@query(f"SELECT id, user_id FROM ({CARD_SQL}) WHERE contains(lower(company), 'company 3') AND stage IN ('offer', 'accepted', 'declined')")
def q_search_board(spark, d):
    return filters.search_board(cards(spark, d), "Company 3", "offer", "company").select("id", "user_id")


@query(f"SELECT id, user_id, stage FROM ({CARD_SQL}) WHERE user_id = 7")
def q_scope_to_user(spark, d):
    good, _ = filters.validate_stages(filters.scope_to_user(cards(spark, d), 7))
    return good.select("id", "user_id", "stage")


@query(f"SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' WHEN s < 2592000 THEN CAST(s // 86400 AS VARCHAR) || 'd ago' ELSE strftime(last_email_at, '%Y-%m-%d') END AS ago, CASE WHEN stage IN ('accepted', 'declined') THEN 'offer' ELSE stage END AS col FROM (SELECT *, CAST(epoch({AS_OF}) - epoch(last_email_at) AS BIGINT) AS s FROM ({CARD_SQL}))")
def q_time_ago(spark, d):
    """C16 and C17 for every card."""
    return cards(spark, d).select("id", keys.time_ago(F.col("last_email_at"), F.expr(AS_OF)).alias("ago"), keys.board_column(F.col("stage")).alias("col"))


@query(with_sql(f"SELECT message_id, {_key()} AS dedup_key FROM want WHERE relevant"))
def q_dedup_keys(spark, d):
    """C10-C12 for every mail."""
    return templated(spark, d).select("message_id", keys.dedup_key(F.col("company"), F.col("role"), F.col("req")).alias("dedup_key"))


@query(f"SELECT a.user_id, a.id, b.id AS other_id FROM ({CARD_SQL}) a JOIN ({CARD_SQL}) b ON a.user_id = b.user_id AND a.id <> b.id AND replace(a.company, ' Inc', '') = replace(b.company, ' Inc', '')")
def q_duplicate_candidates(spark, d):
    return similarity.duplicate_candidates(cards(spark, d).withColumn("company", F.replace("company", F.lit("Company "), F.lit("Firm"))))


@query(with_sql("""SELECT user_id, message_id, coalesce(role, last_value(role IGNORE NULLS) OVER (PARTITION BY user_id, company ORDER BY email_at, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS card FROM want WHERE relevant"""))
def q_attach_roleless(spark, d):
    m = templated(spark, d).withColumns({"company_key": keys.norm_company(F.col("company")), "card": F.col("role")})
    return similarity.attach_roleless(m).select("user_id", "message_id", "card")


@query(f"""WITH v AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN company ELSE CASE event_id % 3 WHEN 1 THEN split_part(company, ' ', 1) ELSE company || ' Group' END END AS name, email_at FROM ({with_sql('SELECT * FROM want WHERE relevant')})),
k AS (SELECT user_id, lower(replace(name, ' Group', '')) AS company_key, min(email_at) AS first_at FROM v GROUP BY ALL)
SELECT user_id, company_key, first(company_key) OVER (PARTITION BY user_id, split_part(company_key, ' ', 1) ORDER BY first_at, company_key) AS bucket FROM k""")
def q_company_variants(spark, d):
    """J4: 'Acme', 'Acme Foods' and 'Acme Foods Group' of one user share a bucket."""
    id3 = F.col("message_id").cast("long") % 3
    name = F.when(id3 == 0, F.col("company")).when(id3 == 1, F.split("company", " ")[0]).otherwise(F.concat("company", F.lit(" Group")))
    seen = templated(spark, d).select("user_id", keys.norm_company(name).alias("company_key"), "email_at").groupBy("user_id", "company_key").agg(F.min("email_at").alias("first_at"))
    return similarity.company_variants(seen).select("user_id", "company_key", "bucket")


def _empty_cards(spark) -> DataFrame:
    from ..sources.schemas import APPLICATIONS

    return spark.createDataFrame([], APPLICATIONS)


def _fits(c: str, more: str = "true") -> str:
    return f"coalesce(({c}.req IS NULL OR s.req IS NULL OR {c}.req = s.req) AND {more}, false)"


def _place(test: str) -> str:
    """The first card of the list for which ``test`` on ``c`` holds; null if there is none."""
    return f"nullif(list_position(list_transform(cards, lambda c: {test}), true), 0)"


_STEP = f"CASE WHEN c.stage = 'rejected' AND s.stage <> 'rejected' AND s.email_at > c.last THEN s.stage WHEN {_rank('s.stage')} > {_rank('c.stage')} THEN s.stage ELSE c.stage END"
def replayed(last: str, source: str = "(SELECT * FROM want WHERE relevant)", before: str = "") -> str:
    """R1 as a replay of ``source``, mail by mail of a user and company: the list of cards is the state. ``last`` reads ``told``: a row a mail."""
    return with_sql("LAST").replace("WITH base", "WITH RECURSIVE base", 1).replace(" LAST", f"""{before}, m AS (SELECT user_id, company, message_id, email_at, role, req, stage, row_number() OVER (PARTITION BY user_id, company ORDER BY email_at, message_id) AS n FROM {source}),
replay AS (SELECT DISTINCT user_id, company, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id VARCHAR, role VARCHAR, req VARCHAR, stage VARCHAR, "first" TIMESTAMP, "last" TIMESTAMP, mails VARCHAR[])[]) AS cards FROM m
UNION ALL SELECT user_id, company, n, CASE WHEN i IS NULL THEN list_append(cards, {{'id': message_id, 'role': role, 'req': req, 'stage': stage, 'first': email_at, 'last': email_at, 'mails': [message_id]}})
  ELSE list_transform(cards, lambda c, k: CASE WHEN k = i THEN {{'id': c.id, 'role': coalesce(c.role, s.role), 'req': coalesce(c.req, s.req), 'stage': {_STEP}, 'first': least(c.first, s.email_at), 'last': greatest(c.last, s.email_at), 'mails': list_append(c.mails, s.message_id)}} ELSE c END) END
FROM (SELECT s.*, coalesce({_place('coalesce(c.req = s.req, false)')}, CASE WHEN role IS NULL THEN {_place(_fits('c', 'c.last = s.latest'))} ELSE coalesce({_place(_fits('c', 'c.role = s.role'))}, {_place(_fits('c', 'c.role IS NULL'))}) END) AS i
FROM (SELECT s.*, list_max(list_transform(list_filter(cards, lambda c: {_fits('c')}), lambda c: c.last)) AS latest FROM (SELECT m.*, r.cards FROM replay r JOIN m ON m.user_id = r.user_id AND m.company = r.company AND m.n = r.n + 1) s) s) s),
cards AS (SELECT user_id, company, unnest(cards) AS c FROM (SELECT *, row_number() OVER (PARTITION BY user_id, company ORDER BY n DESC) AS back FROM replay) WHERE back = 1),
told AS (SELECT user_id, unnest(c.mails) AS message_id, sha256(user_id || '|' || c.id) AS card, true AS is_new, company, lower(company) AS company_key, c.role AS role, split_part({_key('company', 'c.role', 'c.req')}, '::', 2) AS role_key, c.req AS req, c.stage AS stage, c.first AS first_email_at, c.last AS last_email_at, false AS locked FROM cards)
{last}""", 1)


REPLAY = replayed("SELECT * FROM told")


@query(REPLAY)
def q_resolve_cards(spark, d):
    """R1 over all users, against a replay mail by mail."""
    return resolve.resolve_cards(templated(spark, d), _empty_cards(spark))


@query(replayed("SELECT w.user_id, count(*) AS scanned, count(*) FILTER (relevant) AS new_events, (SELECT count(DISTINCT card) FROM told t WHERE t.user_id = w.user_id) AS applications_touched FROM want w GROUP BY w.user_id"))
def q_sync_summary(spark, d):
    """A10 with R1, all three counts."""
    return reports.sync_summary(testmail(spark, d), resolve.resolve_cards(templated(spark, d), _empty_cards(spark)))


#: W1 over the test mails: what is listed for each customer, and what of it is new.
JOB = f""", st AS ({STATE}),
listed AS (SELECT * FROM (SELECT want.*, row_number() OVER (PARTITION BY want.user_id ORDER BY email_at DESC, message_id DESC) AS newest FROM want LEFT JOIN st ON st.user_id = want.user_id
  WHERE want.user_id IN (SELECT c_custkey FROM customer) AND NOT noise AND event_id % 13 <> 0 AND regexp_matches(lower(subject || ' ' || body), '{PHRASE}') AND (st.user_id IS NULL OR floor(epoch(email_at)) > floor(epoch(last_synced_at)) - 172800)) WHERE newest <= 25),
todo AS (SELECT * FROM listed WHERE event_id % 3 <> 0 AND NOT (user_id % 2 = 0 AND company = 'Acme Foods'))"""


def _synced(spark, d) -> dict[str, DataFrame]:
    """The job for all customers: a third of the mails is stored, two thirds of the users were synced before, half of them have an address that some mails come from."""
    mail = testmail(spark, d)
    n = F.col("message_id").cast("long")
    stored = mail.where(n % 3 == 0).select("user_id", "message_id", F.lit("old").alias("application_id"), F.lit("applied").alias("stage"), F.col("email_at").cast("timestamp").alias("email_at"), *[F.lit("").alias(c) for c in ("subject", "sender", "snippet", "body")])
    state = mail.where("user_id % 3 <> 0").groupBy("user_id").agg((F.max("email_at") - F.expr("INTERVAL 3 DAYS")).cast("timestamp").alias("last_synced_at")).withColumn("status", F.lit("ok"))
    accounts = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, "Careers@AcmeFoods.com").alias("email"))
    return sync.sync_users(mail, accounts, {"applications": _empty_cards(spark), "events": stored, "sync_state": state}, "2026-02-01 00:00:00", 25)


@query(replayed("""SELECT t.message_id, t.card AS application_id, todo.stage, todo.subject, todo.from_name || ' <' || todo.from_email || '>' AS sender, substr(todo.body, 1, 200) AS snippet, md5(todo.body) AS body
FROM told t JOIN todo ON todo.message_id = t.message_id""", "todo", JOB))
def q_sync_events(spark, d):
    """W1 with F1-F4, J1, J2, C19, F8, R1, X11 and S3: the events that the job adds, with sender, subject, snippet and body."""
    new = _synced(spark, d)["events"].where("application_id <> 'old'")
    return new.select("message_id", "application_id", "stage", "subject", "sender", "snippet", F.md5(F.col("body").cast("binary")).alias("body"))


@query(replayed("""SELECT c_custkey AS user_id, (SELECT count(*) FROM listed l WHERE l.user_id = c_custkey) AS scanned, (SELECT count(*) FROM todo x WHERE x.user_id = c_custkey) AS new_events,
(SELECT count(DISTINCT card) FROM told t WHERE t.user_id = c_custkey) AS applications_touched FROM customer""", "todo", JOB))
def q_sync_job(spark, d):
    """W1's summary (A10), a row for every customer."""
    return _synced(spark, d)["summary"]


@query(f"SELECT id, count(*) OVER (PARTITION BY application_id) AS n, row_number() OVER (PARTITION BY application_id ORDER BY email_at DESC, id DESC) AS place FROM (SELECT *, message_id AS id FROM ({EVENT_SQL}))")
def q_event_timeline(spark, d):
    from pyspark.sql import Window

    e = tables.event_timeline(card_events(spark, d))
    return e.select(F.col("message_id").alias("id"), F.count("*").over(Window.partitionBy("application_id")).alias("n"), "place")


@query(f"SELECT c.id, count(e.message_id) AS n, max(e.email_at) AS newest FROM ({CARD_SQL}) c LEFT JOIN ({EVENT_SQL}) e ON e.application_id = c.id GROUP BY c.id")
def q_applications_with_events(spark, d):
    a = tables.applications_with_events(cards(spark, d), card_events(spark, d))
    return a.select("id", F.coalesce(F.size("application_events"), F.lit(0)).cast("long").alias("n"), F.get("application_events", F.lit(0))["email_at"].alias("newest"))


@query(f"SELECT DISTINCT message_id, stage FROM ({EVENT_SQL})")
def q_insert_events(spark, d):
    """S3: half of the events stored, all of them inserted: each once."""
    e = card_events(spark, d).dropDuplicates(["message_id"]).withColumn("user_id", F.col("application_id").cast("long"))
    return tables.insert_events(e.where("user_id % 2 = 0"), e.union(e)).select("message_id", "stage")


@query(f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 AND NOT locked THEN 'interview' ELSE stage END AS stage, locked FROM ({CARD_SQL})")
def q_upsert_applications(spark, d):
    c = cards(spark, d)
    return tables.upsert_applications(c, c.where("cast(id as long) % 3 = 0").withColumn("stage", F.lit("interview"))).select("id", "stage", "locked")


@query(f"SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN {AS_OF} ELSE TIMESTAMP '1990-01-01 00:00:00' END AS last_synced_at, 'ok' AS status FROM ({CARD_SQL})")
def q_upsert_sync_state(spark, d):
    users = cards(spark, d).select("user_id").distinct()
    was = users.select("user_id", F.expr("TIMESTAMP '1990-01-01 00:00:00'").alias("last_synced_at"), F.lit("ok").alias("status"))
    return tables.upsert_sync_state(was, users.where("user_id % 2 = 0"), "1998-08-02 00:00:00")


@query(f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'declined' ELSE stage END AS stage, locked OR CAST(id AS BIGINT) % 4 = 0 AS locked, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'Renamed Ltd' ELSE company END AS company, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN NULL ELSE role END AS role FROM ({CARD_SQL})")
def q_apply_edits(spark, d):
    c = cards(spark, d).withColumns({"company_key": keys.norm_company(F.col("company")), "role_key": keys.norm_role(F.col("role"))})
    first = c.where("cast(id as long) % 4 = 0").select("id", "user_id", F.lit("oa").alias("stage"), F.lit("Old").alias("company"), F.lit("x").alias("role"), F.expr("timestamp '2020-01-01'").alias("edited_at"))
    later = first.withColumns({"stage": F.lit("declined"), "company": F.lit(" Renamed Ltd "), "role": F.lit(" "), "edited_at": F.expr("timestamp '2020-01-02'")})
    return tables.apply_edits(c, first.union(later)).select("id", "stage", "locked", "company", "role")


MERGED = "CAST(id AS BIGINT) % 8 = 1"


@query(f"""WITH c AS ({CARD_SQL}), e AS ({EVENT_SQL}), p AS (SELECT a.id AS target, b.id AS source FROM c a JOIN c b ON a.user_id = b.user_id AND CAST(b.id AS BIGINT) % 8 = 1 AND CAST(a.id AS BIGINT) % 8 = 2),
o AS (SELECT source, min(target) AS target FROM p GROUP BY source), m AS (SELECT coalesce(o.target, e.application_id) AS id, e.stage, e.email_at FROM e LEFT JOIN o ON o.source = e.application_id),
s AS (SELECT id, max({_rank('stage')}) AS rk, min(email_at) AS f, max(email_at) AS l FROM m WHERE id IN (SELECT target FROM o) GROUP BY id)
SELECT c.id, CASE WHEN locked OR rk IS NULL THEN stage ELSE {_stage_of('greatest(rk, ' + _rank('stage') + ')')} END AS stage, coalesce(f, first_email_at) AS first_email_at, coalesce(l, last_email_at) AS last_email_at FROM c LEFT JOIN s ON s.id = c.id WHERE c.id NOT IN (SELECT source FROM o)""")
def q_merge_cards(spark, d):
    c, e = cards(spark, d), card_events(spark, d)
    e = e.join(c.select(F.col("id").alias("application_id"), "user_id"), "application_id")
    n = F.col("id").cast("long") % 8
    pairs = c.where(n == 2).select("user_id", F.col("id").alias("target_id")).join(c.where(n == 1).select("user_id", F.col("id").alias("source_id")), "user_id")
    return folding.merge_cards(c, e, pairs)[0].select("id", "stage", "first_email_at", "last_email_at")


@query(f"SELECT e.message_id FROM ({EVENT_SQL}) e JOIN ({CARD_SQL}) c ON c.id = e.application_id WHERE c.user_id % 5 <> 0 AND CAST(c.id AS BIGINT) % 3 <> 0")
def q_delete_and_purge(spark, d):
    """Users and cards deleted, their events with them."""
    c, e = cards(spark, d), card_events(spark, d)
    e = e.join(c.select(F.col("id").alias("application_id"), "user_id"), "application_id")
    left = tables.purge_users({"a": c, "e": e}, c.where("user_id % 5 = 0").select("user_id").distinct())
    return tables.delete_applications(left["a"], left["e"], c.where("cast(id as long) % 3 = 0").select("user_id", "id"))[1].select("message_id")


@query("SELECT user_id, batch, array_to_string(list(message_id ORDER BY n), ' ') AS ids FROM (SELECT user_id, CAST(event_id AS VARCHAR) AS message_id, n, (n - 1) // 10 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM events)) GROUP BY user_id, batch")
def q_prompt_batches(spark, d):
    return verdicts.build_prompt_batches(testmail(spark, d)).select("user_id", "batch", F.array_join("message_ids", " ").alias("ids"))


@query("SELECT event_id AS batch_id, 1 AS index, event_id % 2 = 0 AS relevant, CASE WHEN event_id % 3 = 0 THEN 'offer' ELSE 'applied' END AS stage, CASE WHEN event_id % 5 = 0 THEN 'Unknown Company' ELSE 'Firm' END AS company FROM events WHERE event_id % 7 <> 0")
def q_parse_verdicts(spark, d):
    """L2: valid, invalid and repeated entries in a response for every event."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("batch_id"))
    entry = F.expr("""concat('{"index": 1, "relevant": ', cast(batch_id % 2 = 0 as string), ', "stage": "', if(batch_id % 3 = 0, 'offer', 'hired'), '", "company": "', if(batch_id % 5 = 0, ' ', 'Firm'), '"}')""")
    text = F.concat(F.lit('[{"index": 1, "relevant": true, "company": "First"}, {"index": 9, "relevant": true}, {"index": 0, "relevant": "yes"}, '), entry, F.when(F.col("batch_id") % 7 == 0, "").otherwise("]"))
    return verdicts.parse_verdicts(e.select("batch_id", F.lit(3).alias("n"), text.alias("response"))).select("batch_id", "index", "relevant", "stage", "company")


@query(with_sql("SELECT message_id, CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE 'rules' END AS source, true AS relevant, CASE WHEN event_id % 2 = 0 THEN 'Verdict Works' ELSE company END AS company FROM want WHERE CASE WHEN noise THEN event_id % 2 = 0 ELSE stage NOT IN ('rejected', 'offer') END"))
def q_reconcile_verdicts(spark, d):
    """L3: every second mail has a verdict of another company."""
    rules = classify.classify_once(testmail(spark, d), keep_evidence=True, stored=True)
    v = rules.where("cast(message_id as long) % 2 = 0").select("message_id", F.lit(True).alias("relevant"), "stage", F.lit("Verdict Works").alias("company"), F.lit(None).cast("string").alias("role"), F.lit(False).alias("has_role"), F.lit(None).cast("string").alias("req"))
    out = verdicts.reconcile_verdicts(rules, v).where("relevant and stage not in ('rejected', 'offer')")
    return out.select("message_id", "source", "relevant", "company")


@query(with_sql("SELECT message_id, stage FROM want WHERE relevant"))
def q_guard_stage(spark, d):
    """A verdict 'accepted by text' stays, one that the text does not hold is lowered; here all stay."""
    m = testmail(spark, d).where("subject <> 'Morning briefing'").join(templated(spark, d).select("message_id", "stage"), "message_id")
    return m.select("message_id", stages.guard_stage(F.col("stage"), F.concat_ws("\n", "subject", "body")).alias("stage"))


#: What the text of a test mail supports of a stage, by the mail's true stage.
GUARDED = "CASE {s} WHEN 'interview' THEN CASE stage WHEN 'interview' THEN 'interview' WHEN 'oa' THEN 'oa' ELSE 'applied' END WHEN 'oa' THEN CASE stage WHEN 'oa' THEN 'oa' WHEN 'interview' THEN 'interview' ELSE 'applied' END WHEN 'offer' THEN CASE stage WHEN 'offer' THEN 'offer' ELSE 'applied' END WHEN 'rejected' THEN CASE stage WHEN 'rejected' THEN 'rejected' ELSE 'applied' END ELSE {s} END"
CLAIMS = ("interview", "oa", "offer", "rejected", "applied", "accepted", "declined")
CLAIM = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLAIMS)) + " END"


@query(with_sql(f"SELECT message_id, {CLAIM} AS claimed, {GUARDED.format(s=CLAIM)} AS stage FROM want WHERE relevant"))
def q_guard_stage_lowered(spark, d):
    """Every stage claimed of texts of every stage; those that a text does not support are lowered."""
    m = testmail(spark, d).where("subject <> 'Morning briefing'").withColumn("claimed", F.element_at(F.array(*[F.lit(c) for c in CLAIMS]), (F.col("message_id").cast("long") % 7 + 1).cast("int")))
    return m.select("message_id", "claimed", stages.guard_stage(F.col("claimed"), F.concat_ws("\n", "subject", "body")).alias("stage"))


@query(with_sql(f"""SELECT message_id, CASE WHEN used THEN 'llm' ELSE 'rules' END AS source, NOT (used AND m = 1) AS relevant, CASE WHEN used AND m <> 7 THEN 'Verdict Works' ELSE company END AS company,
CASE WHEN used AND m = 3 THEN 'Data Scientist' WHEN used AND m = 4 THEN NULL ELSE role END AS role, CASE WHEN NOT used THEN req WHEN m = 5 THEN req END AS req, CASE WHEN used AND m = 6 THEN {GUARDED.format(s="'offer'")} ELSE stage END AS stage
FROM (SELECT *, event_id % 8 AS m, event_id % 8 <> 0 AND NOT (event_id % 8 = 1 AND stage IN ('rejected', 'offer')) AS used FROM want WHERE relevant)"""))
def q_reconcile_branches(spark, d):
    """L3, every branch: no verdict; one against a mail (rules' rejections and offers are rescued); a role, an empty role; an id that the text holds or not; a stage too high; a company that is none."""
    rules = classify.classify_once(testmail(spark, d), keep_evidence=True, stored=True).where("relevant")
    m, none = F.col("message_id").cast("long") % 8, F.lit(None).cast("string")
    v = rules.where(m != 0).select(
        "message_id", (m != 1).alias("relevant"), F.when(m == 6, "offer").otherwise(F.col("stage")).alias("stage"), F.when(m == 7, "Please click here").otherwise("Verdict Works").alias("company"),
        F.when(m == 3, "Data Scientist").when(m == 4, "").otherwise(none).alias("role"), m.isin(3, 4).alias("has_role"), F.when(m == 5, F.coalesce("req", F.lit("99999"))).otherwise(none).alias("req"),
    )
    return verdicts.reconcile_verdicts(rules, v).select("message_id", "source", "relevant", "company", "role", "req", "stage")


@query(with_sql("""SELECT message_id, subject, from_name, from_email, strftime(email_at, '%Y-%m-%d %H:%M:%S') AS sent, CASE WHEN event_id % 5 = 0 THEN '' ELSE body END AS body FROM mail"""))
def q_raw_mail(spark, d):
    """X1-X4, X12 on payloads of S1's schema: plain and HTML parts, nested or not, quoted text, dates of both kinds, mails without a body."""
    n, part = F.col("message_id").cast("long"), "struct('{}' AS mimeType, struct({} AS data) AS body)"
    coded = lambda c: F.rtrim(F.translate(F.base64(F.encode(c, "utf-8")), "+/\r\n", "-_"), F.lit("="))
    at = F.col("email_at").cast("timestamp")
    mail = testmail(spark, d).select(
        "user_id", "message_id", "subject", n.alias("n"), coded(F.concat("body", F.lit("\n\nOn Monday Ann wrote:\n> before"))).alias("plain"), coded(F.concat(F.lit("<style>p {}</style><p>"), "body", F.lit("</p><script>x</script>"))).alias("html"),
        F.when(n % 2 == 0, F.concat(F.lit('"'), "from_name", F.lit('" <'), F.upper("from_email"), F.lit("> "))).otherwise(F.concat("from_name", F.lit(" <"), "from_email", F.lit(">"))).alias("sender"),
        F.when(n % 3 > 0, F.unix_millis(at).cast("string")).alias("ms"), F.date_format(at, "E, d MMM yyyy HH:mm:ss Z").alias("day"),
    )
    both = f"array({part.format('text/html', 'html')}, {part.format('TEXT/Plain', 'if(n % 4 = 0, plain, cast(null AS string))')})"
    payload = f"""struct('multipart/mixed' AS mimeType, array(struct('FROM' AS name, sender AS value), struct('subject' AS name, subject AS value), struct('Date' AS name, day AS value)) AS headers,
        CASE n % 5 WHEN 0 THEN null WHEN 1 THEN to_json({both}) ELSE to_json(array(struct('multipart/alternative' AS mimeType, {both} AS parts))) END AS parts)"""
    raw = mail.selectExpr("user_id", "message_id AS id", "ms AS internalDate", f"{payload} AS p").selectExpr("user_id", "id", "to_json(named_struct('user_id', user_id, 'id', id, 'internalDate', internalDate)) AS head", "to_json(struct(p.mimeType, p.headers)) AS top", "p.parts AS parts")
    text = F.expr("""concat(left(head, length(head) - 1), ', "payload": ', left(top, length(top) - 1), if(parts IS NULL, '', concat(', "parts": ', parts)), '}}')""")
    got = parse_messages(raw.select(F.from_json(text, raw_schema()).alias("r")).select("r.*"), "2026-02-01 00:00:00")
    return got.select("message_id", "subject", "from_name", "from_email", F.date_format("email_at", "yyyy-MM-dd HH:mm:ss").alias("sent"), "body")


@query("SELECT doc_id, trim(coalesce(source, '') || ' <' || lang || '@x.com>') AS sender, md5(substr(text, 1, 300)) AS snippet, md5(CASE WHEN text <> '' THEN substr(text, 1, 20000) END) AS body FROM documents")
def q_event_projection(spark, d):
    """X11: what an event keeps of a mail; the limits of 300 and 20,000 characters are the feature."""
    e = spark.read.parquet(f"{d}/documents.parquet")
    sender, snippet, body = decode.event_projection(F.col("source"), F.concat("lang", F.lit("@x.com")), F.col("text"), F.col("text"))
    return e.select("doc_id", sender, snippet, body).withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("snippet", "body")})


@query(f"SELECT id, coalesce(replace(company, ' Inc', '') = lag(replace(company, ' Inc', '')) OVER (PARTITION BY user_id ORDER BY CAST(id AS BIGINT)), false) AS same FROM ({CARD_SQL})")
def q_same_company(spark, d):
    """Each card's company against the one of the user's card before."""
    from pyspark.sql import Window

    c = cards(spark, d).withColumn("company", F.replace("company", F.lit("Company "), F.lit("Firm")))
    before = F.lag("company").over(Window.partitionBy("user_id").orderBy(F.col("id").cast("long")))
    return c.withColumn("before", before).select("id", F.coalesce(keys.looks_same_company(F.col("company"), F.col("before")), F.lit(False)).alias("same"))


@query(f"SELECT user_id, dedup_key, min(email_at) AS first_email_at, max(email_at) AS last_email_at, count(*) AS emails FROM ({KEYED}) GROUP BY user_id, dedup_key")
def q_group_by_key(spark, d):
    """R2 alone, on classified rows."""
    return folding.group_by_key(templated(spark, d))


@query(with_sql("""SELECT a.user_id, a.id AS a_id, b.id AS b_id FROM (SELECT user_id, company, role, req, min(message_id) AS id FROM want WHERE relevant AND role IS NOT NULL GROUP BY ALL) a JOIN (SELECT user_id, company, role, req, min(message_id) AS id FROM want WHERE relevant AND role IS NOT NULL GROUP BY ALL) b ON a.user_id = b.user_id AND a.company = b.company AND a.role = b.role AND (a.req IS NULL OR b.req IS NULL OR a.req = b.req)"""))
def q_role_matches(spark, d):
    """Roles against the same roles with a word more or less ('Analyst' and 'Data Analyst'), requisitions compatible."""
    one = templated(spark, d).where("role is not null").groupBy("user_id", keys.norm_company(F.col("company")).alias("company_key"), "role", "req").agg(F.min("message_id").alias("id"))
    short = F.when(F.col("id").cast("long") % 2 == 0, F.split("role", " ")[1]).otherwise(F.concat(F.lit("Remote "), "role"))
    put = lambda role: one.withColumn("role_key", keys.norm_role(role))
    return similarity.role_matches(put(F.col("role")), put(short)).select("user_id", "a_id", "b_id")


@query(with_sql("""SELECT split, origin, count(*) FILTER (CASE WHEN event_id % 17 = 0 THEN false WHEN noise THEN true ELSE event_id % 5 <> 0 END) AS passed, count(*) AS total, count(*) FILTER (event_id % 2 = 0) AS llm
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split, CASE WHEN user_id % 2 = 0 THEN 'own' ELSE 'made' END AS origin FROM want) GROUP BY ROLLUP (split, origin)"""))
def q_score_summary(spark, d):
    """Every classified mail against its label; labels with variants, without a role, with another company and with the other relevance."""
    n = F.col("message_id").cast("long")
    known = testmail(spark, d).select("user_id", "message_id").join(templated(spark, d).drop("user_id", "email_at"), "message_id", "left")
    parts = [
        F.concat(F.lit('"relevant": '), (F.col("stage").isNotNull() != (n % 17 == 0)).cast("string")), F.concat(F.lit('"stage": "'), "stage", F.lit('"')),
        F.concat(F.lit('"company": ["'), F.when(n % 5 == 0, "Elsewhere").otherwise(F.col("company")), F.lit('", "Nobody"]')), F.when(F.col("role").isNotNull() & (n % 2 == 0), F.concat(F.lit('"role": "'), "role", F.lit('"'))),
    ]
    labels = known.select(F.col("message_id").alias("id"), F.when(n % 3 == 0, "holdout").otherwise("dev").alias("split"), F.when(F.col("user_id") % 2 == 0, "own").otherwise("made").alias("source"), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("expect"))
    found = classify.classify_once(testmail(spark, d)).withColumn("source", F.when(n % 2 == 0, "llm").otherwise("rules"))
    return scoring.score_summary(scoring.score_predictions(found.select("message_id", "relevant", "stage", "company", "role", "source"), labels))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}

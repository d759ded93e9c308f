"""Operators of the mail jobs on small hand-made rows."""

import base64
import json
import random
from datetime import datetime, timedelta

import pytest
from mailfunnel.functions import decode, keys, lexicon, stages
from mailfunnel.operators import classify, filters, resolve, scoring, similarity
from mailfunnel.operators import stages as folding
from mailfunnel.sources import mail, schemas
from mailfunnel.streaming import jobs
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)


def one(spark, value, of):
    return spark.createDataFrame([(value,)], "c string").select(of(F.col("c")).alias("x")).first().x


def url64(text):
    return base64.urlsafe_b64encode(text if isinstance(text, bytes) else text.encode()).decode().rstrip("=")


def test_raw_messages(spark, tmp_path):
    plain = {"mimeType": "text/plain", "body": {"data": url64("Hello ✓\n\nOn Mon, Ann wrote:\n> old")}}
    html = {"mimeType": "text/html", "body": {"data": url64("<style>x</style><p>A&amp;B<br>c&nbsp;d</p>")}}
    head = [{"name": "FROM", "value": '"Ann Lee" <Ann@X.com>'}, {"name": "Subject", "value": "Hi"}, {"name": "Date", "value": "Thu, 1 Jan 2026 10:00:00 +0000"}]
    rows = [
        {"user_id": 1, "id": "a", "threadId": "t", "internalDate": "1767225600000", "payload": {"mimeType": "multipart/mixed", "headers": head, "parts": [{"mimeType": "multipart/alternative", "parts": [html, plain]}]}},
        {"user_id": 1, "id": "b", "payload": {"mimeType": "multipart/mixed", "headers": head, "parts": [html]}},
        {"user_id": 2, "id": "c", "payload": {"mimeType": "text/plain", "headers": [{"name": "From", "value": "Bob@Y.com"}], "body": {"data": url64(b"bad \xff byte")}}},
        {"user_id": 2, "id": "d"},
    ]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r.message_id: r for r in mail.parse_messages(mail.read_raw_mail(spark, str(tmp_path)), "2026-02-01 00:00:00").collect()}
    assert got["a"].body == "Hello ✓" and got["a"].from_name == "Ann Lee" and got["a"].from_email == "ann@x.com" and got["a"].email_at == T0
    assert got["b"].body == "A&B\nc d" and got["b"].email_at == datetime(2026, 1, 1, 10)
    assert got["c"].body == "bad � byte" and got["c"].from_email == "bob@y.com" and got["c"].email_at == datetime(2026, 2, 1)
    assert got["d"].body == "" and got["d"].subject == ""


def test_keys(spark):
    assert one(spark, "The Acme Robotics, Inc.", keys.norm_company) == "acme robotics"
    assert one(spark, "SWE Intern (ML) - Summer 2026", keys.norm_role) == "engineer machinelearning"
    assert one(spark, None, keys.norm_role) == ""
    pair = lambda a, b, f: spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]
    assert pair("impulse", "impulse space", keys.company_similar) and not pair("apple", "applebees", keys.company_similar) and not pair("", "x", keys.company_similar)
    assert pair("engineer software", "engineer", keys.role_similar) and not pair("data", "design", keys.role_similar)
    assert one(spark, "&amp;lt;b&gt; café &#8212;", decode.decode_entities) == "<b> café  "


@pytest.mark.parametrize("text,want", [("Job ID: 123456", "123456"), ("REQ-2026", None), ("role R-2026-6318 here", "20266318"), ("717004BR", "717004"), ("Austin TX 78712", None)])
def test_requisitions(spark, text, want):
    assert one(spark, text, stages.extract_req_id) == want


MAILS = [  # subject, name, address, body, relevant, stage, company, role
    ("Application received", "Orchid Systems", "no-reply@greenhouse.io", "Thank you for applying to Orchid Systems. If selected, we will invite you to an interview.", True, "applied", "orchid", None),
    ("Next step", "HackerRank", "support@hackerrank.com", "Quillon invited you to take the Software Engineer Intern coding challenge.", True, "oa", "quillon", None),
    ("Update on your application", "Palisade Careers", "careers@palisade.com", "Unfortunately, we have decided to move forward with other candidates for the Data Analyst position.", True, "rejected", "palisade", "analyst data"),
    ("Your offer", "Marlow Bank", "hr@marlow.co.uk", "Congratulations! We are pleased to offer you the Risk Analyst position at Marlow.", True, "offer", "marlow", "analyst risk"),
    ("Interview", "Tern Energy", "jobs@tern.com", "We would like to invite you to interview with Tern Energy for the Process Engineer role.", True, "interview", "tern energy", "engineer process"),
    ("Top stories", "Digest", "hello@news.example.com", "Top stories and trending. Read more. Unsubscribe.", False, None, None, None),
    ("Finish your application", "Hollis", "jobs@hollis.com", "You started an application but it remains incomplete. Complete your application today.", False, None, None, None),
    ("Automatic reply: hello", "Sam Poe", "sam@corp.com", "I am out of the office.", False, None, None, None),
    ("My application", "Pat", "pat@gmail.com", "my application is under review", False, None, None, None),
    ("Re: interview times", "Mo Quist", "mo.quist@brindle.com", "Hello, I booked your interview for Friday with two of our engineers. Regards, Mo", True, "interview", "brindle", None),
    ("We have your application", "Tallow Insurance", "careers@tallow.com", "Thank you for applying to the Claims Analyst position at Tallow Insurance. Candidates not selected will be contacted by mail after the search ends.", True, "applied", "tallow insurance", "analyst claims"),
    ("Your application to Site Reliability Engineer at Plover Labs", "JobPort", "no-reply@jobport.com", "Your application was received by Plover Labs.", True, "applied", "plover", "engineer reliability site"),
    ("Thanks for finishing the Larkspur test", "HackerRank", "support@hackerrank.com", "Your coding test is complete. We passed your results to Larkspur and they will be in touch.", True, "oa", "larkspur", None),
    ("Application received", "Wren - Workday", "wren@myworkday.com", "Your application has been received and is under review.\n\nWren Campus Recruiting", True, "applied", "wren", None),
    ("Meet our teams", "Oriole Careers", "careers-news@oriole.com", "Thanks for your interest in Oriole! Browse our open positions: Data Analyst and more. You are receiving this because you joined our list. Unsubscribe.", False, None, None, None),
    ("Your monthly practice recap", "KataGym", "hello@katagym.com", "Hi there! Try the new coding challenge and read interview questions of last month.", False, None, None, None),
    ("Beware of hiring scammers", "Safe Jobs", "news@safejobs.com", "Fake offer letters are about: check every offer of employment. Apply today with firms we trust. Unsubscribe | Update preferences", False, None, None, None),
    ("Wes and others reacted to a post", "LinkedIn", "updates@linkedin.com", "Ida shared a post: my technical interview went badly. Suggested for you.", False, None, None, None),
    ("Scholarship application received", "Fenwick Foundation", "office@fenwickfund.org", "Your scholarship application has been received by the Fenwick Foundation.", False, None, None, None),
    ("Next year's program", "Gannet Campus Recruiting", "campus@gannet.com", "Applications for our summer analyst program will open on Monday. Thank you for your interest in Gannet.", False, None, None, None),
    ("Your application to Maker Summit was received", "Maker Summit", "hi@makersummit.org", "Your application was accepted. Join all attendees for a day of talks.", False, None, None, None),
    ("Housing application", "Elm Court", "leasing@elmcourt.com", "Your apartment application was received. The lease and deposit are due.", False, None, None, None),
]


def test_classification(spark):
    rows = [(1, str(i), "t", s, n, a, T0, b[:200], b) for i, (s, n, a, b, *_) in enumerate(MAILS)]
    df = spark.createDataFrame(rows, "user_id long, message_id string, thread_id string, subject string, from_name string, from_email string, email_at timestamp, snippet string, body string")
    got = classify.classify_mail(df).withColumns({"ck": keys.norm_company(F.col("company")), "rk": keys.norm_role(F.col("role"))})
    for r in got.collect():
        *_, relevant, stage, company, role = MAILS[int(r.message_id)]
        assert r.relevant == relevant, r
        if relevant:
            assert r.stage == stage and r.ck == company and (role is None or r.rk == role), r


def ratchet(events):
    """The rule step by step."""
    now, latest = None, None
    for at, stage in events:
        now = stage if now is None else resolve.folded(now, stage, at > latest)
        latest = at if latest is None else max(latest, at)
    return now


def test_fold_is_the_step_rule(spark):
    rng, rows, want = random.Random(2), [], {}
    for card in range(400):
        own = [(T0 + timedelta(days=rng.randint(0, 6)), rng.choice(lexicon.STAGES)) for _ in range(rng.randint(1, 7))]
        want[card] = ratchet(own)
        rows += [(card, s, t, i) for i, (t, s) in enumerate(own)]
    df = spark.createDataFrame(rows, "card int, stage string, email_at timestamp, seq int")
    got = {r.card: r.stage for r in folding.fold_stages(df, ["card"], ["seq"]).collect()}
    # rank order alone misses nothing once a rejection is reopened by a mail of any stage
    assert got == want


CLASSIFIED = "user_id long, message_id string, email_at timestamp, company string, role string, req string, stage string"


def test_resolver(spark):
    at = lambda d: T0 + timedelta(days=d)
    rows = [
        (1, "a", at(0), "Acme Robotics", "Software Engineer Intern", None, "applied"), (1, "b", at(1), "Acme Robotics Inc", "Software Engineering Intern", "R123", "oa"), (1, "c", at(2), "Acme", None, None, "interview"),
        (1, "d", at(3), "Acme Robotics", "Data Analyst", "R999", "applied"), (1, "e", at(4), "Acme Robotics", "Software Engineer", "R999", "rejected"), (2, "f", at(0), "Acme", None, None, "applied"), (2, "g", at(1), "Acme", "Nurse", None, "oa"),
    ]
    none = spark.createDataFrame([], schemas.APPLICATIONS)
    got = {r.message_id: r for r in resolve.resolve_cards(spark.createDataFrame(rows, CLASSIFIED), none).collect()}
    assert got["a"].card == got["b"].card == got["c"].card != got["d"].card == got["e"].card
    assert got["a"].stage == "interview" and got["d"].stage == "rejected" and got["a"].req == "R123"
    assert got["f"].card == got["g"].card and got["f"].role == "Nurse"
    # incremental runs agree with one replay when mails arrive in order
    first = resolve.resolve_cards(spark.createDataFrame(rows[:3], CLASSIFIED), none)
    later = {r.message_id: r for r in resolve.resolve_cards(spark.createDataFrame(rows[3:5], CLASSIFIED), resolve.cards_of(first)).collect()}
    assert later["d"].card == got["d"].card and later["e"].stage == got["e"].stage


def test_stage_quarantine_and_roles(spark):
    df = spark.createDataFrame([("x",), ("oa",), (None,)], "stage string")
    good, bad = filters.validate_stages(df)
    assert good.count() == 1 and bad.count() == 2
    a = spark.createDataFrame([(1, "acme", "1", "engineer", None), (1, "acme", "2", "nurse", "R1")], "user_id long, company_key string, id string, role_key string, req string")
    b = spark.createDataFrame([(1, "acme", "9", "engineer software", "R2"), (1, "acme", "8", "nurse", "R2")], "user_id long, company_key string, id string, role_key string, req string")
    assert [(r.a_id, r.b_id) for r in similarity.role_matches(a, b).collect()] == [("1", "9")]


def test_scoring(spark, tmp_path):
    cases = [{"id": "1", "source": "own", "split": "dev", "email": {"subject": "s", "fromName": "n", "fromEmail": "a@b.c", "body": "b"}, "expect": {"relevant": True, "company": ["Acme", "Acme Inc"], "role": None}}, {"id": "2", "source": "own", "split": "holdout", "email": {}, "expect": {"relevant": False}}]
    (tmp_path / "f.json").write_text(json.dumps(cases))
    fx = mail.read_fixtures(spark, str(tmp_path))
    predicted = spark.createDataFrame([("1", True, "oa", "ACME", None, "rules"), ("2", True, "oa", "X", None, "llm")], "message_id string, relevant boolean, stage string, company string, role string, source string")
    got = {r.message_id: r for r in scoring.score_predictions(predicted, fx).collect()}
    assert got["1"].passed and got["1"].company_ok and got["1"].role_ok and got["1"].stage_ok is None and not got["2"].passed
    total = scoring.score_summary(scoring.score_predictions(predicted, fx)).where("split is null").first()
    assert (total.passed, total.total, total.llm) == (1, 2, 1)
    (tmp_path / "g.json").write_text(json.dumps(cases[:1]))
    with pytest.raises(ValueError):
        mail.read_fixtures(spark, str(tmp_path))


def test_streams(spark, tmp_path):
    rows = [(1, "a", T0, "Acme", "Nurse", None, "applied"), (1, "a", T0, "Acme", "Nurse", None, "applied"), (1, "b", T0 + timedelta(days=1), "Acme", "Nurse", None, "rejected")]
    src = tmp_path / "in"
    spark.createDataFrame(rows[:2], CLASSIFIED).coalesce(1).write.parquet(str(src / "1"))
    stream = lambda: spark.readStream.schema(CLASSIFIED).parquet(str(src / "*"))
    q = jobs.stream_dedupe(stream()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    tables = jobs.Tables(spark, str(tmp_path / "t"), schemas.APPLICATIONS)
    run = lambda: jobs.stream_cards(stream(), tables, str(tmp_path / "c2"), "2026-02-01 00:00:00", classified=True).trigger(availableNow=True).start().awaitTermination()
    run()
    assert tables.current()["applications"].first().stage == "applied"
    spark.createDataFrame(rows[1:], CLASSIFIED).coalesce(1).write.parquet(str(src / "2"))
    run()
    now = tables.current()
    assert [(r.stage, r.user_id) for r in now["applications"].collect()] == [("rejected", 1)] and now["events"].count() == 2 and now["sync_state"].first().status == "ok"


def _mails(spark, rows):
    return spark.createDataFrame([(1, str(i), datetime(2026, 1, i + 1), company, role, req, stage) for i, (company, role, req, stage) in enumerate(rows)], "user_id long, message_id string, email_at timestamp, company string, role string, req string, stage string")


def test_a_mail_without_role_goes_to_the_latest_card_that_fits_its_requisition(spark):
    none = spark.createDataFrame([], schemas.APPLICATIONS)
    got = resolve.resolve_cards(_mails(spark, [("Acme", "Data Analyst", None, "applied"), ("Acme", None, "R12345", "oa"), ("Acme", None, "R99999", "applied"), ("Acme", None, None, "interview")]), none).collect()
    card = {r.message_id: r.card for r in got}
    assert card["0"] == card["1"] and card["2"] != card["0"] and card["3"] == card["2"]


def test_stored_companies_stay_apart(spark):
    names = [x.split()[0] for x in schemas.APPLICATIONS.split(", ")]
    row = lambda i, key: [{"id": i, "user_id": 1, "company": key, "company_key": key, "role": "Engineer", "role_key": "engineer", "stage": "applied", "locked": False, "dedup_key": f"{key}::engineer::", "first_email_at": datetime(2025, 1, int(i)), "last_email_at": datetime(2025, 1, int(i))}.get(n) for n in names]
    stored = spark.createDataFrame([row("1", "acme"), row("2", "acme foods")], schemas.APPLICATIONS)
    got = {r.message_id: r.card for r in resolve.resolve_cards(_mails(spark, [("Acme Foods", "Engineer", None, "oa"), ("Acme", "Engineer", None, "oa"), ("Acme Foods Holding", "Engineer", None, "oa")]), stored).collect()}
    assert got == {"0": "2", "1": "1", "2": "1"}


def test_senders_and_quotes(spark):
    one = spark.range(1)
    sender = lambda x: tuple(one.select(decode.parse_from(F.lit(x)).alias("s")).first().s)
    assert sender('"Ann" <A@x.com> ') == ("Ann", "a@x.com") and sender("Ann <a@x.com> tail") == ("", "ann <a@x.com> tail")
    for line in ("On Monday Ann wrote:", "-- Original Message --", "----- Forwarded message -----", "_" * 12, "From: Ann", "Sent from my phone", "Get Outlook for iOS"):
        assert one.select(decode.strip_quoted(F.lit(f"mine\n{line}\ntheirs"))).first()[0] == "mine"
    for line in ("On Monday we wrote: this", "- Original Message", "_" * 5, "from here", "He wrote:"):
        assert "theirs" in one.select(decode.strip_quoted(F.lit(f"mine\n{line}\ntheirs"))).first()[0]


@pytest.mark.parametrize("text, want", [("REQ-12345", "12345"), ("jr 98765", "98765"), ("R-2026-63180", "202663180"), ("see R0114671.", "0114671"), ("717004BR", "717004"), ("code C-GE-112", "CGE112"), ("(ID: 12345)", "12345"), ("Requisition ID: A4567", "A4567"), ("position of 80123", "80123"), ("application 72366 - Software Intern", "72366"), ("Austin TX 78712 - Building A", None), ("in 2026 - Summer", None), ("R2026", None), ("Ref: 2026", None)])
def test_requisition_ids(spark, text, want):
    assert spark.range(1).select(stages.extract_req_id(F.lit(text))).first()[0] == want


def _streamed(spark, tmp_path, name, batches):
    """The stored tables after each of the batches came as a file of its own."""
    tables = jobs.Tables(spark, str(tmp_path / name), schemas.APPLICATIONS)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CLASSIFIED).coalesce(1).write.parquet(str(tmp_path / f"{name}-in" / str(i)))
        stream = spark.readStream.schema(CLASSIFIED).parquet(str(tmp_path / f"{name}-in" / "*"))
        jobs.stream_cards(stream, tables, str(tmp_path / f"{name}-c"), "2026-02-01 00:00:00", classified=True).trigger(availableNow=True).start().awaitTermination()
    now = tables.current()
    return now["applications"].first(), now["events"].count()


def test_late_mail_in_both_orders(spark, tmp_path):
    """T4: late mail widens a card's times and counts once; a late mail does not reopen a rejected card, a newer one does."""
    mail = lambda i, day, stage: (1, i, T0 + timedelta(days=day), "Acme", "Nurse", None, stage)
    applied, rejected, oa = mail("a", 0, "applied"), mail("b", 2, "rejected"), mail("c", 1, "oa")
    in_order, n = _streamed(spark, tmp_path, "o", [[applied, oa], [rejected]])
    late, m = _streamed(spark, tmp_path, "l", [[applied, rejected], [oa, rejected]])
    assert (in_order.stage, n) == (late.stage, m) == ("rejected", 3)
    assert (late.first_email_at, late.last_email_at) == (in_order.first_email_at, in_order.last_email_at) == (T0, T0 + timedelta(days=2))
    before, _ = _streamed(spark, tmp_path, "b", [[rejected], [applied]])
    after, _ = _streamed(spark, tmp_path, "a", [[rejected], [mail("d", 3, "interview")]])
    assert before.stage == "rejected" and before.first_email_at == T0 and after.stage == "interview"


def test_stream_of_mails_is_classified_as_the_batch(spark, tmp_path):
    """T1."""
    schema = "user_id long, message_id string, thread_id string, subject string, from_name string, from_email string, email_at timestamp, snippet string, body string"
    rows = [(1, str(i), "t", s, n, a, T0, b[:200], b) for i, (s, n, a, b, *_) in enumerate(MAILS)]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    out = jobs.stream_classify(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    out.select("message_id", "stage", "company").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    want = classify.attributable(classify.classify_mail(df)).select("message_id", "stage", "company")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want.collect())


def test_parts_at_any_depth(spark, tmp_path):
    """Parts far below the typed levels are found, in the order of the document."""
    leaf = lambda mime, text: {"mimeType": mime, "body": {"data": url64(text)}}

    def nested(depth, inner):
        return inner if depth == 0 else {"mimeType": "multipart/mixed", "parts": [nested(depth - 1, inner)]}

    rows = [
        {"user_id": 1, "id": "nine", "payload": nested(9, leaf("text/plain", "deep down"))},
        {"user_id": 1, "id": "first", "payload": {"mimeType": "multipart/mixed", "parts": [nested(8, leaf("TEXT/plain", "deep but first")), leaf("text/plain", "shallow but second")]}},
        {"user_id": 1, "id": "html", "payload": {"mimeType": "multipart/mixed", "parts": [leaf("text/plain", ""), nested(7, leaf("text/html", "<p>A&amp;B</p>"))]}},
        {"user_id": 1, "id": "flat", "payload": leaf("text/plain", "flat")},
        {"user_id": 1, "id": "edge", "payload": nested(5, leaf("text/plain", "five"))},
        {"user_id": 1, "id": "six", "payload": nested(6, leaf("text/plain", "six"))},
        {"user_id": 1, "id": "flat", "payload": leaf("text/plain", "the same id twice")},
        {"user_id": 1, "id": "nine", "payload": nested(9, leaf("text/plain", "again"))},
        {"user_id": 1, "id": "none", "payload": {"mimeType": "multipart/mixed", "body": {"data": url64("root")}, "parts": [nested(7, {"mimeType": "image/png"})]}},
    ]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = sorted((r.message_id, r.body) for r in mail.parse_messages(mail.read_raw_mail(spark, str(tmp_path)), "2026-02-01 00:00:00").collect())
    assert got == sorted([("nine", "deep down"), ("nine", "again"), ("first", "deep but first"), ("html", "A&B"), ("flat", "flat"), ("flat", "the same id twice"), ("edge", "five"), ("six", "six"), ("none", "root")])


def test_planning_a_classification_runs_nothing(spark):
    rows = spark.range(50).selectExpr("id % 3 as user_id", "cast(id as string) as message_id", "'s' as subject", "'n' as from_name", "'a@b.com' as from_email", "timestamp '2026-01-01' as email_at", "'' as snippet", "'hello' as body")
    grouped = rows.groupBy(*rows.columns).count().drop("count")
    spark.sparkContext.setJobGroup("planning", "no job is wanted")
    out = classify.classify_mail(grouped)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("other", "")
    assert out.count() == 50

"""Relevance gates (F5-F7): own wording for each family; all boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import TITLE_NOUN
from .patterns import hit
from .stages import any_hit, count_hits

MARKETING = [r"\bunsubscribe\b", r"\bnewsletter\b", r"\bwebinar\b", r"\bdiscount\b", r"\b\d+% off\b", r"\bsale\b", r"\bpromo(?:tion|code)?\b", r"\bsubscribe\b", r"\bsponsor(?:ed)?\b", r"\bjob alerts?\b", r"\brecommended (?:jobs|for you)\b", r"\bnew jobs\b", r"\btalent (?:community|network)\b", r"\bview in browser\b", r"\b(?:manage|update) (?:your )?(?:email )?preferences\b", r"\bbrowse (?:all |our )?(?:open )?(?:roles|jobs|positions|openings)\b", r"\breceiving this\b[^.]{0,20}\bbecause\b", r"\bapply today\b", r"\blimited time\b", r"\bfree trial\b", r"\bupgrade\b", r"\btop stories\b", r"\btrending\b", r"\bread more\b", r"\bearn \$", r"\bhow to (?:land|ace|get)\b", r"\btips for\b", r"\bcareer fair\b", r"\bapply now\b", r"\bhiring (?:event|near you)\b"]
DIGEST = r"(?i)\b(?:daily|weekly|monthly)\b[^.\n]{0,20}\b(?:digest|round-?up|recap|newsletter)\b"
OPENING = r"(?i)\bapplications?\b[^.]{0,120}\b(?:will (?:be )?open|open(?:ing)? soon|(?:are )?now open|go(?:es)? live)\b"
SCHOLARSHIP = r"(?i)\b(?:scholarship|grant|bursary)s? (?:application|portal|award|committee|fund)"
SCAM = r"(?i)\b(?:scam(?:s|mers?|ming)?|fraud(?:ulent)?|phishing)\b"
UNFINISHED = r"(?i)\b(?:finish|complete|continue|resume) (?:your|the) (?:application|profile)\b|\b(?:incomplete|unfinished|started but|not yet submitted)\b|\bpick up where you left off\b|\bapplication (?:is|remains) (?:incomplete|in progress)\b"
SUBMITTED = r"(?i)\bthank(?:s| you)[^.]{0,20}for (?:applying|your application|submitting)|\b(?:application|submission)\b[^.]{0,30}\b(?:received|submitted)\b|\breceived your (?:application|submission)\b|\bsuccessfully (?:applied|submitted)\b"
AUTO_SUBJECT = r"(?i)^\s*(?:automatic reply|auto-?reply|out of office|autosvar)"
AUTO_TEXT = r"(?i)\b(?:out of (?:the )?office|automatic reply|auto-?reply|away from my (?:desk|email)|on leave until)\b"
REPLY_SUBJECT = r"(?i)^\s*(?:re|fwd?)\s*:"
ACCOUNT = r"(?i)\b(?:verify your (?:email|account)|confirm your email|reset your password|password reset|verification code|one-time (?:code|password)|account (?:created|activated)|security alert|sign-in attempt)\b"
SOCIAL = r"(?i)\b(?:connection request|people you may know|viewed your profile|who's viewed|endorsed you|trending posts|your network|new followers?|mentioned you|(?:reacted to|liked|commented on) (?:this|your|a post)|shared a post|suggested for you)\b"
VOCABULARY = r"(?i)\b(?:appl(?:y|ied|ying|ication|icant)|candida(?:te|cy)|interview|assessment|position|role|recruit|hiring|offer|requisition|resume|internship|challenge)"
HOUSING = r"(?i)\b(?:lease|apartment|rental|tenant|landlord|housing|roommate|move-in|deposit)\b"
EDUCATION = [r"\badmissions?\b", r"\b(?:graduate|undergraduate) (?:school|program|admission)", r"\btranscripts?\b", r"\bfinancial aid\b", r"\bscholarships?\b", r"\bsemester\b", r"\btuition\b", r"\bfaculty\b"]
EVENT = [r"\bhackathon\b", r"\bworkshop\b", r"\bconference\b", r"\bregistration\b", r"\brsvp\b", r"\battend(?:ees?|ing)?\b", r"\btickets?\b", r"\bspeaker\b", r"\bmeetup\b", r"\b(?:boot)?camp\b", r"\btalks\b", r"\bsummit\b"]
PERSONAL = r"(?i)\b(?:dear|hi|hello)\s+[A-Z]?[a-z]+|\binvite you\b|\byour (?:interview|assessment)\b"


def flags(full: Column, low: str, hits: Column) -> Column:
    """The evidence that the gates weigh; ``low``: the column of the text in lower case, ``hits``: patterns hit per stage."""
    return F.struct((hits["rejected"] > 0).alias("reject"), *[any_hit(full, s, low=low).alias(s) for s in ("offer", "oa", "interview")], hit(full, SUBMITTED, low).alias("submitted"), hit(full, SCAM, low).alias("scam"))


def decisions(f: Column) -> Column:
    """The flags with what follows from them."""
    decision = f["reject"] | f["offer"] | f["oa"] | f["interview"]
    return F.struct(*[f[c].alias(c) for c in ("reject", "offer", "oa", "interview", "submitted", "scam")], decision.alias("decision"), (decision | f["submitted"]).alias("status"))


def relevance_gates(full: Column, low: str, subject: Column, email: Column, domain: Column, kind: Column, f: Column) -> Column:
    """struct(marketing, incomplete, autoreply, nonjob)."""
    scam, title = f["scam"], full.rlike(TITLE_NOUN)
    social = (kind["board"] | kind["noise"]) & hit(full, SOCIAL, low)
    protected = ((f["reject"] | f["offer"]) & ~kind["noise"] & ~scam) | ((f["oa"] | f["interview"]) & hit(full, PERSONAL, low) & ~kind["board"] & ~kind["noise"]) | (f["submitted"] & ~kind["board"] & ~kind["noise"] & ~scam)
    markers = count_hits(full, MARKETING, low)
    marketing = (~kind["ats"] & ~kind["vendor"] & ~protected & (markers >= 2)) | (kind["board"] & ~f["decision"] & ~full.rlike(r"(?i)\byour application|\bappl(?:ied|ication)\b")) | (~full.rlike(VOCABULARY) & ~(f["oa"] & kind["vendor"]))
    sent = f["submitted"] | f["reject"] | kind["ats"] | kind["vendor"]
    marketing = marketing | (~sent & (hit(full, DIGEST, low) | (hit(full, OPENING, low) & ~f["offer"])))
    account = hit(full, ACCOUNT, low)
    autoreply = subject.rlike(AUTO_SUBJECT) | (subject.rlike(REPLY_SUBJECT) & (~f["decision"] | hit(full, AUTO_TEXT, low))) | (kind["freemail"] & ~f["decision"]) | (~f["decision"] & ~f["submitted"] & account)
    admissions = email.rlike("(?i)^(?:admissions?|gradschool|apply|enroll)[^@]*@.*") & domain.rlike(r"\.edu\z")
    housing = F.size(F.regexp_extract_all(full, F.lit(HOUSING), F.lit(0)))
    nonjob = ((admissions | (domain.rlike(r"\.edu\z") & ~title)) & ~f["oa"] & ~f["interview"]) | (((~f["decision"] & ((housing >= 2) | (count_hits(full, EVENT, low) >= 2))) | (count_hits(full, EDUCATION, low) >= 2) | hit(full, SCHOLARSHIP, low)) & ~title) | social
    return F.struct(marketing.alias("marketing"), (~f["status"] & hit(full, UNFINISHED, low)).alias("incomplete"), autoreply.alias("autoreply"), nonjob.alias("nonjob"))


def is_relevant(stage: Column, kind: Column, gates: Column) -> Column:
    shut = gates["marketing"] | gates["incomplete"] | gates["autoreply"] | gates["nonjob"]
    return (stage.isNotNull() | kind["ats"] | kind["vendor"]) & ~(kind["noise"] & stage.isNull()) & ~shut


def hard_irrelevant(full: Column, gates: Column, low: str | None = None) -> Column:
    """What a model's 'relevant' may not override."""
    return gates["nonjob"] | (hit(full, ACCOUNT, low) & ~hit(full, SUBMITTED, low))

"""Employer and role of a mail (C5-C9): ladders of own patterns, each a native array of candidates of which the first plausible one counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .patterns import may_hit
from .stages import ID_WORDS

#: What every word of ID_WORDS holds.
DIGITS = r"[0-9](?:[A-Za-z-]*[0-9]){2}"
# A capitalised name of up to 41 characters: words that start with a capital or digit, with small joining words inside.
NAME = r"([A-Z0-9](?:[\w&'+-]|\.(?=\w))*(?: (?:(?:of|and|the|for|de|&) )?[A-Z0-9](?:[\w&'+-]|\.(?=\w))*){0,4})"
_STOP = r"(?=[\s,.!?:;)('\"|-]|\z)"

#: Case-sensitive on purpose: a name is recognised by its capitals.
COMPANY_PHRASES = [
    rf"{NAME} (?:has )?invited you\b", rf"\bon behalf of {NAME}{_STOP}", rf"\b[Aa]pplication (?:to|with|at) {NAME}{_STOP}", rf"\b[Ii]nterview(?:ing)? (?:with|at) {NAME}{_STOP}", rf"\b[Nn]ext steps? (?:with|at) {NAME}{_STOP}", rf"\b[Aa]ppl(?:ying|ied) (?:to|at|with) {NAME}{_STOP}",
    rf"\b[Ii]nterest in (?:a career (?:at|with)|joining|working (?:at|with)) {NAME}{_STOP}", rf"\b(?:role|position|internship|opportunity|job|opening) (?:at|with) {NAME}{_STOP}", rf"\bthe {NAME} (?:position|role) of\b", rf"\b(?:[Jj]oining|[Ww]elcome to) {NAME}{_STOP}", rf"\b[Tt]eam at {NAME}{_STOP}", rf"\ba(?:n)? {NAME} recruiter\b", rf"\b[Ff]rom {NAME} -",
    rf"\b[Aa]pplication (?:to|for) [^.\n]{{3,60}} at {NAME}{_STOP}", rf"\b[Oo]ffer (?:from|to join) {NAME}{_STOP}", rf"\b[Aa]ssessment (?:for|from|with) {NAME}{_STOP}", rf"\b[Uu]pdate from {NAME}{_STOP}", rf"\b(?:submission|answers|results|responses) (?:to|with) {NAME}{_STOP}",
]
SIGNATURES = [rf"(?m)^\s*(?:[Tt]he )?{NAME} (?:Talent Acquisition|Recruiting|Recruitment|Hiring|People|Careers)(?: Team| Department)?\s*$", rf"{NAME},? (?:Inc|LLC|Corporation|Ltd|GmbH)\b"]
WEAK = [rf"\b[Tt]he {NAME} [Tt]eam\b", rf"\b[Ii]nterest in {NAME}{_STOP}"]
MACHINERY = r"(?i)\b(?:talent acquisition|(?:university|campus|student|early) (?:programs?|talent|recruit\w*|relations|careers?|hiring|team)|recruit(?:ing|ment|ers?)|careers?|jobs?|hiring|talent|hr|human resources|people operations|no-?reply|do not reply|notifications?|team|department|application|workday|greenhouse|via .*)\b"
TITLE_END = r"(?i)\b(?:intern(?:ship)?|co-?op|engineer|developer|analyst|scientist|designer|manager|coordinator|specialist|trainee)\z"
PROSE = r"(?i)\b(?:you|your|our|we|us|this|that|please|thank|thanks|dear|hello|hi|click|here|will|have|has|is|are|was|were|been|unfortunately|application|position|role|interview|update|status)\b"

TITLE_NOUN = r"(?i)\b(?:intern(?:ship)?s?|co-?op|engineers?|engineering|developers?|scientists?|analysts?|architects?|designers?|researchers?|consultants?|specialists?|managers?|associates?|fellows?|apprentices?|technicians?|programmers?|administrators?|strategists?|trainees?|assistants?|coordinators?|accountants?|auditors?|clerks?|recruiters?|advisors?|traders?|underwriters?|technologists?|statisticians?|economists?|attorneys?|paralegals?|nurses?|teachers?|instructors?|therapists?|actuar(?:y|ies))\b"
ROLE_PROSE = r"(?i)\b(?:you|your|our|we|us|this|that|only|about|thanks?|appreciate|interest(?:ed)?|apply(?:ing)?|application|status|update|regarding|received|submitted|consider(?:ation)?|please|welcome|unfortunately|interviews?|invit(?:e|ation)s?|availability|positions?|following|complet(?:e|ed|ing))\b"
T = r"([A-Z][A-Za-z0-9&/,+#' -]{2,80}?)"
_TAIL = r"(?=\s*(?:\.|!|\?|\n|;|:|\(|\bat\b|\bwith\b|\bposition\b|\brole\b|\band\b|\bhas\b|\bis\b|\bwas\b|\bhere\b|\z))"
ROLE_PHRASES = [
    rf"(?:[Rr]ole|[Pp]osition|[Jj]ob [Tt]itle|[Jj]ob)\s*:\s*{T}(?=\s*(?:\n|\.|;|\(|\z))", rf"(?:[Pp]osition|[Rr]ole|[Jj]ob) of {T}{_TAIL}", rf"\b[Aa]ppl(?:ying|ied) (?:for|to) (?:the |our |a |an )?{T}{_TAIL}", rf"\b(?:the|our) {T} (?:role|position|internship|opening|opportunity)\b", rf"\b[Aa]pplication (?:for|to) (?:the |our )?{T}{_TAIL}", rf"\b[Ii]nterest in (?:the |our )?{T}{_TAIL}",
    rf"\b(?:[Aa]ssessment|[Ii]nvitation|[Ii]nterview) for (?:the |our )?{T}{_TAIL}", rf"\b[Aa]pplication\s*[-–:]\s*{T}(?=\s*(?:\n|\z|[-–|]))", r"\b((?:[A-Z][A-Za-z&/+#-]*,? ){0,5}(?:Intern(?:ship)?|Engineer|Developer|Scientist|Analyst|Designer|Researcher|Consultant|Manager|Associate|Specialist|Architect))\b",
]


def let(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_company(c: Column) -> Column:
    """Without recruiting words (three rounds), 'from X' and 'via X', legal tails and edge punctuation; lower-case names get capitals."""
    c = _squeeze(F.regexp_replace(c, r"(?i)^(?:from|the)\s+|\s+via\s+.*$", ""))
    less = lambda x: _squeeze(F.regexp_replace(F.regexp_replace(x, MACHINERY, " "), r"^[\s,.:;|@-]+|[\s,.:;|@-]+\z", ""))
    c = let(c, lambda x: let(less(x), lambda y: F.when(y == x, y).otherwise(less(less(y)))))
    c = _squeeze(F.regexp_replace(c, r"(?i),?\s+(?:inc|llc|ltd|corp|corporation|gmbh|plc|usa|u\.s\.)\.?\z", ""))
    return let(c, lambda x: F.when(x == F.lower(x), F.initcap(x)).otherwise(x))


def is_plausible_company(c: Column) -> Column:
    """No sentence and no job title, at most 5 words and 40 characters, fewer than 4 digits, no vendor, no 'Last, First'."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return (F.length(c) > 1) & (F.length(c) <= 40) & (F.size(F.split(c, " ")) <= 5) & (digits < 4) & ~plain.isin(*lx.VENDOR_NAMES) & ~c.rlike(PROSE) & ~c.rlike(TITLE_END) & ~c.rlike(r"^[A-Z][a-z]+, [A-Z][a-z]+\z") & c.rlike("[A-Za-z]")


def looks_like_person(name: Column, email: Column) -> Column:
    """A display name of two words whose first stands in the mailbox name; one of two letters must open it and be followed by a dot."""
    box = F.lower(F.get(F.split(email, "@"), F.lit(0)))
    first = F.lower(F.get(F.split(name, " "), F.lit(0)))
    return (((F.length(first) > 2) & box.contains(first)) | ((F.length(first) == 2) & box.startswith(F.concat(first, F.lit("."))))) & (F.size(F.split(name, " ")) == 2)


def _first(text: Column, low: str, patterns: list[str], judged, ahead: bool = False) -> Column:
    """Pattern by pattern, the first match that ``judged`` makes a name of; those after it are not judged. ``low``: the column of the text in lower case, ``ahead``: matches may overlap."""

    def found(p: str) -> Column:
        may, each = may_hit(low, p), F.regexp_extract_all(text, F.lit(f"(?={p})" if ahead else p), F.lit(1))
        return each if may is None else F.when(may, each).otherwise(F.array().cast("array<string>"))

    return F.aggregate(F.concat(*[found(p) for p in patterns]), F.lit(None).cast("string"), lambda got, x: F.coalesce(got, judged(x)))


def plausible_company(c: Column) -> Column:
    """The cleaned name if it is plausible, else null."""
    return let(clean_company(c), lambda x: F.when(is_plausible_company(x), x))


def root_of(domain: Column) -> Column:
    """The name part of a domain, aware of two-level endings such as co.uk."""
    labels = F.split(domain, r"\.")
    two = domain.rlike(r"\.(?:co|com|org|ac|gov|net)\.[a-z]{2}\z")
    return F.initcap(F.get(labels, F.size(labels) - F.when(two, 3).otherwise(2)))


def company_text(subject: Column, body: Column) -> Column:
    """Where an employer is looked for: the subject, the body's start and its end."""
    n = F.length(body)
    return F.concat_ws("\n", subject, F.substring(body, 1, 1400), F.when(n > 1400, F.substring(body, F.greatest(F.lit(1401), n - 599), F.lit(600))))


def extract_company(text: Column, low: str, body: Column, from_name: Column, from_email: Column, domain: Column, kind: Column) -> Column:
    """Relationship phrases, signatures, display name against weak phrases, careers URL, sender domain, tenant mailbox, 'Unknown Company'.

    ``text``: the mail's ``company_text``, ``low``: the column of the same in lower case.
    """
    good = is_plausible_company
    shown = F.when(from_name.rlike(r"\(([^)]+)\)") & kind["vendor"], F.regexp_extract(from_name, r"\(([^)]+)\)", 1)).otherwise(from_name)
    shown = clean_company(shown)
    own_name = let(shown, lambda x: F.when(good(x), x))
    own_name = F.when(~looks_like_person(from_name, from_email) & ~kind["board"] & ~kind["freemail"], own_name)
    weak = _first(text, low, WEAK, plausible_company)
    url = F.initcap(F.regexp_extract(F.substring(body, 1, 4000), r"(?i)https?://(?:careers|jobs)\.([a-z0-9-]+)\.", 1))
    direct = F.when(~(kind["ats"] | kind["vendor"] | kind["board"] | kind["noise"] | kind["freemail"]) & (domain != ""), root_of(domain))
    tenant = F.when(kind["ats"], F.initcap(F.regexp_extract(from_email, r"^([a-z0-9-]+)@", 1)))
    tenant = let(tenant, lambda x: F.when(~F.lower(x).rlike(r"^(?:no-?reply|donotreply|notifications?|jobs|careers|recruiting|talent|hello|info|mail)$") & good(x), x))
    return F.coalesce(
        _first(text, low, COMPANY_PHRASES, plausible_company),
        _first(text, low, SIGNATURES, lambda c: plausible_company(F.regexp_replace(c, r" (?:University|Campus|Graduate|Student)\z", ""))),
        F.when(kind["ats"], F.coalesce(own_name, weak)).otherwise(F.coalesce(weak, own_name)),
        let(url, lambda x: F.when(good(x), x)),
        let(direct, lambda x: F.when(good(x), x)),
        tenant,
        F.lit(lx.UNKNOWN),
    )


def without_ids(c: Column) -> Column:
    """Words with three digits or more become spaces; texts without such words are not looked through."""
    return let(c, lambda x: F.when(x.rlike(DIGITS), F.regexp_replace(x, ID_WORDS, " ")).otherwise(x))


def sanitize_role(c: Column) -> Column:
    """A title without ids, seasons, years and work modes, or null if it reads like prose or holds no title noun."""
    c = without_ids(c)
    c = F.regexp_replace(c, r"(?i)\b(?:summer|fall|autumn|winter|spring)?\s*20\d\d\b|\b(?:summer|fall|autumn|winter|spring)\b|\b(?:remote|hybrid|on-?site|full[- ]time|part[- ]time)\b|\(\s*\)", " ")
    c = _squeeze(F.regexp_replace(_squeeze(c), r"^[^A-Za-z0-9]+|[^A-Za-z0-9)+#]+\z", ""))
    c = F.regexp_replace(c, r"(?i)^(?:(?:at|as|of|in|on|to|by|for|with|from|the|a|an|your|our|this|that|and|or)\b\s*|re:\s*)+", "")

    def judged(x: Column) -> Column:
        bad = ~x.rlike(TITLE_NOUN) | x.rlike(ROLE_PROSE) | x.rlike(r"[.!?]\s+[A-Z]") | (F.size(F.split(x, " ")) > 9) | x.rlike(r"(?i)^(?:intern|internship|co-?op|interns|(?:hiring )?managers?|recruiters?)\z") | (F.length(x) < 3)
        return F.when(~bad, F.when(x == F.lower(x), F.initcap(x)).otherwise(x))

    return let(F.substring(_squeeze(c), 1, 70), judged)


def strip_leading_company(role: Column, company: Column) -> Column:
    """Without the company's words in front, if a title remains."""
    words, own = F.split(role, " "), F.split(company, " ")
    same = F.lower(F.array_join(F.slice(words, F.lit(1), F.size(own)), " ")) == F.lower(company)
    rest = F.array_join(F.slice(words, F.size(own) + 1, F.size(words)), " ")
    return F.when(same & rest.rlike(TITLE_NOUN) & (F.size(F.split(rest, " ")) > 1), rest).otherwise(role)


def role_is_just_company(role_key: Column, company_key: Column) -> Column:
    r, c = F.filter(F.split(role_key, " "), lambda t: t != ""), F.split(company_key, " ")
    return (F.size(r) > 0) & (F.size(r) <= 2) & (F.size(F.array_except(r, c)) == 0)


def role_text(subject: Column, body: Column) -> Column:
    """Where a title is looked for: the subject and the body's start, without ids."""
    return without_ids(F.concat_ws("\n", subject, F.substring(body, 1, 2000)))


def extract_role(text: Column, low: str) -> Column:
    """Pattern by pattern, the first plausible title of a ``role_text`` over all start positions (a bad match is scanned again one character on)."""
    return _first(text, low, ROLE_PHRASES, sanitize_role, ahead=True)

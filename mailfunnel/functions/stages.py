"""Stage detection (C1-C4, C18): own patterns for each family of wording. Column to Column, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import any_of, hit

CUT = r"(?<=[.!?\n])\s+|,\s+(?=(?i:but|however|although|though)\b)|;\s*"
HEDGE = r"(?i)\b(?:if|unless|until|without|in case|may be|might be|whether|tips|guide|should you be|we will (?:notify|let you know)|you(?:'ll| will) (?:hear|be notified)|will (?:only )?be (?:notified|contacted|informed))\b"
INSTRUCTION = r"(?i)\b(?:check|view|track|visit|log ?in|sign in)\b.*\b(?:status|portal|dashboard|account|page|here)\b|\bhelp (?:page|center)\b"

def _near(first: str, then: str, gap: int) -> str:
    """A pattern: the first words, then within a few characters of the same sentence the others."""
    return rf"\b(?:{first})\b[^.!?]{{0,{gap}}}\b(?:{then})\b"


PATTERNS: dict[str, list[str]] = {
    "rejected": [
        r"\bregret\b.*\b(?:inform|tell|let you know|advise)", r"\bnot\b[^.]{0,40}\b(?:mov(?:e|ing)|go(?:ing)?|proceed(?:ing)?|continu(?:e|ing))\b[^.]{0,20}\b(?:forward|ahead|with your)", r"\b(?:decided|chosen|elected|opted)\b[^.]{0,40}\b(?:other|another|different)\b[^.]{0,20}\b(?:candidate|applicant|direction)",
        r"\b(?:pursue|proceed with|move forward with|moving forward with|selected)\b[^.]{0,20}\b(?:other|another)\b[^.]{0,15}\b(?:candidate|applicant)", r"\b(?:not|weren't|wasn't|were not) (?:been )?(?:selected|successful|shortlisted|chosen)\b", r"\bunsuccessful\b", r"\bno longer (?:under consideration|being considered|considering)", r"\b(?:will not|won't|not able to|unable to) (?:be )?consider", r"\bwill not be (?:considered|selected|advanc|mov)",
        r"\b(?:positions?|roles?|openings?|requisition)\b[^.]{0,30}\b(?:has been|have been|have now been|was|were|are|is now|is)\b[^.]{0,10}\b(?:filled|closed|cancell?ed|on hold)", r"\b(?:not|isn't|aren't|wasn't) (?:quite )?(?:the|a) (?:right|good|best|strong) (?:fit|match)\b", r"\b(?:candidates|applicants)\b[^.]{0,40}\b(?:more closely|better|closer)\b[^.]{0,20}\b(?:match|align|fit|meet)", r"\bdo(?:es)? not (?:meet|match)\b[^.]{0,30}\b(?:requirement|qualification|criteria)",
        r"\bunable to (?:offer|move|proceed|advance)\b[^.]{0,12}\byou\b", r"\bdifferent direction\b", r"\bwon't be (?:moving|proceeding|able to offer you)", r"\bdeclin(?:e|ed) to (?:move|proceed)\b", r"\bmore (?:competitive|qualified) (?:candidates|applicants)",
    ],
    "offer": [
        _near("(?:pleased|delighted|excited|thrilled|happy|proud|glad) to", "offer|extend", 12), _near("extend(?:ed|ing|s)?|mak(?:e|ing)", "an? (?:[a-z]+ )?offer|(?:the|this|our|your) offer|offers?", 12), _near("offers?", "employment|letters?|package|terms|details", 6),
        _near("formal|official|written|verbal|conditional|job|employment", "offer", 2), _near("congratulations|congrats", "offer", 60), _near("sign|countersign|accept", "(?:the|this|our|your) (?:[a-z]+ )?offer|offer letter", 15),
    ],
    "interview": [
        r"\binvit(?:e|ed|ing|ation)\b[^.]{0,40}\b(?:interview|screen)", r"\binterview\b[^.]{0,20}\b(?:invitation|invite|confirmation|confirmed|scheduled)", r"\b(?:schedul(?:e|ed|ing)|book(?:ed)?|arranged?|set up)\b[^.]{0,40}\binterview", r"\binterview (?:availability|slot|time)", r"\b(?:schedule|book|set up)\b[^.]{0,30}\bcall\b[^.]{0,60}\b(?:recruit|hiring|role|position|team)", r"\b(?:phone|technical|on-?site|video|virtual|final|panel|recorded|one-way) (?:interview|screen)",
        r"\b(?:calendly|goodtime|savvycal)\b", r"\b(?:share|send|provide|let us know)\b[^.]{0,30}\byour availability\b", r"\bwhat times? work", r"\bare you (?:free|available)\b[^.]{0,40}\b(?:call|chat|talk|meet|discuss)", r"\bnext (?:round|stage)\b[^.]{0,40}\b(?:interview|process)?", r"\b(?:love|like) to (?:talk|chat|speak|connect)\b[^.]{0,60}\b(?:role|background|position|experience)", r"\bspeak with (?:our|a|the) (?:recruiter|hiring manager|team)", r"\binterview with (?:us|our|the)\b",
    ],
    "oa": [r"\bonline assessment\b", r"\b(?:coding|technical|skills?|programming|cognitive) (?:assessment|test)\b", r"\btake-?home\b", r"\bcoding challenge\b", r"\bhiring test\b", r"\b(?:pre-employment|aptitude|personality) (?:test|assessment)", r"\b(?:hackerrank|codesignal|codility|hackerearth|testgorilla|pymetrics)\b", r"\bcomplete\b[^.]{0,40}\bassessment", r"\binvit(?:e|ed|ation)\b[^.]{0,30}\b(?:test|assessment|challenge)\b", r"\bassessment (?:invitation|link|is ready)"],
    "applied": [
        _near("thanks?|thank you|grateful", "appl(?:y|ying|ication)|submi(?:t|tting|ssion)|interest in|your interest", 25), _near("application|resume|cv|submission", "received|submitted|reached us|arrived", 30), _near("received|got|have|reading|reviewing|review", "your (?:application|resume|cv|submission)", 12),
        _near("application|submission", "confirmation|receipt", 4), _near("your application", "to|for|with|at|has", 1), _near("successfully", "applied|submitted|received", 12), _near("appreciate|value", "your (?:interest|application)", 6),
        r"\b(?:is|are|now|currently|remains?)(?: (?:now|currently|still|actively|also|at present))? (?:under (?:review|consideration)|being (?:considered|reviewed|looked at))\b",
    ],
}
SORRY = [r"\bunfortunately\b", r"\b(?:after|following) careful (?:review|consideration)"]
_FLAGS = "(?is)"


def _clauses(text: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[^\s.!?])[ \t]*\r?\n(?=[a-z0-9(])", " ")
    return F.split(flat, CUT, -1)


def unhedged_clauses(text: Column) -> Column:
    """The clauses of a text that are not hypothetical."""
    return F.filter(_clauses(text), lambda c: ~c.rlike(HEDGE))


def unhedged_text(clauses: Column) -> Column:
    """Those clauses as text."""
    return F.array_join(clauses, " ")


def decisive_text(clauses: Column) -> Column:
    """The same without instructional clauses."""
    return F.array_join(F.filter(clauses, lambda c: ~c.rlike(INSTRUCTION)), " ")


def count_hits(text: Column, patterns: list[str], low: str | None = None) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + hit(text, _FLAGS + p, low).cast("int")
    return total


def any_hit(text: Column, *families: str, low: str | None = None) -> Column:
    """Whether any pattern is hit; ``low``: the column of the text in lower case, where there is one."""
    found = [p for f in families for p in PATTERNS[f]]
    return text.rlike(_FLAGS + "|".join(f"(?:{p})" for p in found)) if low is None else any_of(text, [_FLAGS + p for p in found], low)


def stage_hits(full: Column, decisive: Column, unhedged: Column, lows: tuple[str, str, str]) -> Column:
    """Distinct patterns hit per stage, and apologies; ``lows``: the columns of the three texts in lower case."""
    of = {"rejected": (decisive, lows[1]), "offer": (decisive, lows[1]), "interview": (unhedged, lows[2]), "oa": (unhedged, lows[2]), "applied": (full, lows[0])}
    hits = [count_hits(text, PATTERNS[k], low).alias(k) for k, (text, low) in of.items()]
    return F.struct(*hits, any_of(full, [_FLAGS + p for p in SORRY], lows[0]).cast("int").alias("sorry"))


def detect_stage(hits: Column) -> Column:
    """struct(stage, confidence), or null without any hit. Rejected wins, then offer; else most hits, ties to the more advanced. An apology adds one to a rejection that is there already."""
    best = F.greatest(hits["interview"], hits["oa"], hits["applied"])
    stage = F.when(hits["rejected"] > 0, "rejected").when(hits["offer"] > 0, "offer").when(best == 0, None).when(hits["interview"] == best, "interview").when(hits["oa"] == best, "oa").otherwise("applied")
    n = F.when(hits["rejected"] > 0, hits["rejected"] + hits["sorry"]).when(hits["offer"] > 0, hits["offer"]).otherwise(best)
    return F.when(stage.isNotNull(), F.struct(stage.alias("stage"), F.least(F.lit(0.55) + n * 0.15, F.lit(0.95)).alias("confidence")))


def guard_stage(stage: Column, text: Column, low: str | None = None) -> Column:
    """A stage that the text does not support is lowered to one that it does; ``low``: the column of the text in lower case, where there is one."""
    interview, oa = any_hit(text, "interview", low=low), any_hit(text, "oa", low=low)
    reject = any_hit(text, "rejected", low=low) | any_of(text, [_FLAGS + p for p in SORRY], low)
    return (
        F.when((stage == "interview") & ~interview, F.when(oa, "oa").otherwise("applied"))
        .when((stage == "offer") & ~any_hit(text, "offer", low=low), "applied")
        .when((stage == "oa") & ~oa, F.when(interview, "interview").otherwise("applied"))
        .when((stage == "rejected") & ~reject, "applied")
        .otherwise(stage)
    )


#: Words and signs of a text as far as ids need them: words with inner hyphens, opening brackets, dashes that stand alone.
ID_TOKENS = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*|\(|(?<=\s)[-\u2013\u2014](?=\s)"
#: A word with three digits or more, with its label: what a title must not hold.
ID_WORDS = r"(?:(?i:\b(?:(?:job|requisition|reference) )?(?:id|number|no|ref|requisition)\b)[\s:.#]*)?(?<![\w-])(?=(?:[A-Za-z-]*\d){3})[A-Za-z\d]+(?:-[A-Za-z\d]+)*(?![\w-])"
TAGS, LABELS, NUMBERED = ("req", "jr", "r"), ("req", "jr", "requisition", "ref", "reference"), ("id", "number", "no", "code")
POSTS = ("job", "position", "role", "posting", "vacancy", "opening", "application", "requisition", "req", "reference")


def _judged(tokens: Column, t: Column, i: Column) -> Column:
    """struct(kind, place, value) of a token that is an id, the surest kind first; null otherwise."""
    beside = lambda n: F.lower(F.coalesce(F.get(tokens, i + n), F.lit("")))
    letters, digits = F.lower(F.regexp_replace(t, "[^A-Za-z]", "")), F.regexp_replace(t, "[^0-9]", "")
    parts, n = F.split(t, "-"), F.length(digits)
    leads = t.startswith(F.regexp_replace(t, "[^A-Za-z].*", "")) & ~F.regexp_replace(t, "^[A-Za-z]+", "").rlike("[A-Za-z]")
    tagged = (n >= 5) & ((letters.isin(*TAGS) & leads) | ((letters == "br") & t.endswith("BR")) | ((letters == "") & (beside(1) == "br")))
    coded = (F.size(parts) == 3) & (n >= 2) & (parts[0] == F.upper(parts[0])) & ~F.concat(parts[0], parts[1]).rlike("[^A-Z]") & (F.get(parts, F.lit(2)) == digits)
    labelled = (n >= 4) & (F.length(letters) <= 1) & leads & (beside(-1).isin(*LABELS) | (beside(-1).isin(*NUMBERED) & (beside(-2).isin(*POSTS) | (beside(-2) == "("))))
    dashed = beside(1).isin("-", "\u2013", "\u2014") & F.coalesce(F.get(tokens, i + 2), F.lit("")).rlike("^[A-Z]")
    announced = (letters == "") & ~t.contains("-") & (n >= 5) & (((beside(-1) == "of") & beside(-2).isin(*POSTS)) | ((beside(-1).isin(*POSTS) | (beside(-1) == "to")) & dashed))
    kind = F.when(tagged, 1).when(coded, 2).when(labelled, 3).when(announced, 4)
    value = F.when(kind == 1, digits).otherwise(F.upper(F.replace(t, F.lit("-"), F.lit(""))))
    return F.when(kind.isNotNull() & (F.length(value) >= 4) & (F.length(value) <= 16) & ~value.rlike(r"^20\d\d$"), F.struct(kind.alias("kind"), i.alias("place"), value.alias("value")))


def extract_req_id(text: Column) -> Column:
    """The requisition id of a text, or null. Words with digits are judged one by one with their neighbours.

    Surest first: a company system's own tag on the number; a code of two groups of capitals and a number; a number after a label; a bare
    number that the text announces. Years are none.
    """
    each = lambda tokens: F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike("[0-9]{2}"), _judged(tokens, t, i))), lambda x: x.isNotNull()))["value"]
    found = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(ID_TOKENS), F.lit(0))), each), F.lit(0))
    return F.when(text.rlike("[0-9]{2}"), found)

"""Word lists and stage ranks. Results depend on them."""

# fmt: off
STAGES = ["applied", "oa", "interview", "offer", "accepted", "declined", "rejected"]
PROGRESSION = {"applied": 1, "oa": 2, "interview": 3, "rejected": 4, "offer": 5, "declined": 6, "accepted": 7}
BOARD = ["applied", "oa", "interview", "offer", "rejected"]
UNKNOWN = "Unknown Company"

ATS_DOMAINS = ["greenhouse.io", "greenhouse-mail.io", "lever.co", "hire.lever.co", "myworkday.com", "myworkdayjobs.com", "workday.com", "ashbyhq.com", "icims.com", "smartrecruiters.com", "jobvite.com", "taleo.net", "successfactors.com", "workable.com", "breezy.hr", "bamboohr.com", "rippling.com", "oraclecloud.com", "myworkdaysite.com", "eightfold.ai", "paradox.ai", "hirevue.com", "ripplingats.com", "brassring.com", "kenexa.com", "adp.com", "avature.net", "pinpoint.email", "dayforcehcm.com", "ultipro.com", "phenom.com"]
VENDOR_DOMAINS = ["codesignal.com", "hackerrank.com", "hackerrankforwork.com", "hackerearth.com", "codility.com", "coderpad.io", "karat.com", "hirevue.com", "codesubmit.io", "qualified.io", "testgorilla.com", "sovaassessment.com", "sovaonline.com", "shl.com", "criteriacorp.com", "pymetrics.com", "plum.io", "modernhire.com", "harver.com", "testdome.com"]
VENDOR_NAMES = ["codesignal", "hackerrank", "hackerearth", "codility", "coderpad", "karat", "hirevue", "codesubmit", "qualified", "testgorilla", "sova", "sovaassessment", "shl", "pymetrics", "plum", "modernhire", "harver"]
BOARD_DOMAINS = ["linkedin.com", "wayup.com", "ziprecruiter.com", "indeed.com", "joinhandshake.com", "glassdoor.com", "monster.com", "dice.com", "wellfound.com", "builtin.com", "otta.com", "untapped.io", "ripplematch.com", "simplify.jobs", "jobright.ai", "lensa.com"]
FREEMAIL_DOMAINS = ["gmail.com", "googlemail.com", "yahoo.com", "outlook.com", "hotmail.com", "live.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com"]
NOISE_DOMAINS = ["nytimes.com", "cnn.com", "quora.com", "substack.com", "medium.com", "dailytexan.com", "washingtonpost.com", "bloomberg.com", "techcrunch.com", "morningbrew.com", "theinformation.com", "reddit.com", "facebookmail.com", "twitter.com", "x.com", "youtube.com", "spotify.com", "leetcode.com", "news", "newsletter", "digest", "marketing"]

COMPANY_SUFFIXES = ["inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "the", "technologies", "technology", "tech", "labs", "group", "holdings", "global", "international", "systems", "solutions", "financial", "investments", "investment", "capital", "partners", "enterprises", "industries"]
CARD_SUFFIXES = ["inc", "llc", "ltd", "corp", "corporation", "co", "company", "the", "technologies", "technology", "labs", "group", "holdings", "global", "international", "systems", "solutions", "financial", "investments", "investment", "capital", "partners"]
ROLE_STOPWORDS = ["intern", "internship", "interns", "coop", "co", "op", "summer", "fall", "spring", "winter", "the", "a", "an", "position", "role", "opportunity", "opening", "program", "team", "early", "career", "careers", "new", "grad", "graduate", "student", "full", "time", "part", "i", "ii", "iii", "iv", "of", "for", "and", "at", "assessment", "assessments", "skills", "online", "oa", "test", "testing", "challenge", "coding", "code", "phone", "screen", "screening", "technical", "interview", "video", "virtual", "application", "apply", "req", "requisition", "id", "job", "summer2025", "summer2026", "us", "usa", "remote", "hybrid", "onsite"]
ROLE_SYNONYMS = {"engineering": "engineer", "development": "developer", "dev": "developer", "swe": "engineer", "sde": "engineer", "ml": "machinelearning", "ai": "artificialintelligence", "ux": "design", "ui": "design"}

CANDIDATE_PHRASES = ["thank you for applying", "thanks for applying", "thank you for your application", "thank you for your interest in", "application received", "received your application", "your application to", "your application for", "your application has been", "application was submitted", "online assessment", "coding assessment", "coding challenge", "take-home", "hackerrank", "codesignal", "schedule a", "phone screen", "technical interview", "interview invitation", "invite you to interview", "interview confirmation", "video interview", "move forward with your application", "not to move forward", "we regret to inform", "not been selected", "other applicants", "position has been filled", "position has been closed", "pleased to offer", "offer of employment"]
CANDIDATE_SENDERS = ["greenhouse.io", "lever.co", "myworkday.com", "myworkdayjobs.com", "ashbyhq.com", "icims.com", "smartrecruiters.com", "jobvite.com", "workable.com", "bamboohr.com", "hirevue.com"]
EXCLUDED_SENDERS = ["nytimes.com", "cnn.com", "quora.com", "substack.com", "medium.com"]
EXCLUDED_LABELS = ["SENT", "CHAT", "CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL", "SPAM"]
# fmt: on

#: White space as the web counts it; Java's \s knows only the ASCII part.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

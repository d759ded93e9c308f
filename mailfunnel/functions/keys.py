"""Identity keys, similarity and small display functions (C9-C17). Column to Column, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " ")


def norm_company(c: Column) -> Column:
    """Lower case, letters and digits only, without corporate suffix words; null gives ''."""
    return _squeezed(F.regexp_replace(_plain(c), rf"\b(?:{'|'.join(lx.COMPANY_SUFFIXES)})\b", " "))


def card_company_key(c: Column) -> Column:
    """The dashboard's own key: a shorter suffix list."""
    return _squeezed(F.regexp_replace(_plain(c), rf"\b(?:{'|'.join(lx.CARD_SUFFIXES)})\b", " "))


def norm_role(c: Column) -> Column:
    """Sorted distinct title words without filler, levels and numbers; null gives ''."""
    same = F.create_map(*[F.lit(x) for kv in lx.ROLE_SYNONYMS.items() for x in kv])
    words = F.transform(F.split(_plain(c), r"\s+"), lambda t: F.coalesce(same[t], t))
    stop = F.array(*[F.lit(w) for w in lx.ROLE_STOPWORDS])
    kept = F.filter(words, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t) & ~t.rlike("[0-9]"))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def dedup_key(company: Column, role: Column, req: Column) -> Column:
    return F.concat_ws("::", norm_company(company), norm_role(role), F.coalesce(req, F.lit("")))


def tokens(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda t: t != "")


def company_similar(a: Column, b: Column) -> Column:
    """Equal keys, or the shorter token list lies in the longer; '' matches nothing but ''."""
    ta, tb = tokens(a), tokens(b)
    small, big = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb), F.when(F.size(ta) <= F.size(tb), tb).otherwise(ta)
    return (a == b) | ((F.size(ta) > 0) & (F.size(tb) > 0) & (F.size(F.array_except(small, big)) == 0))


def role_similar(a: Column, b: Column) -> Column:
    """Equal keys, or one within the other, or Jaccard of at least 0.6; '' matches nothing but ''."""
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both, least = F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb))
    union = F.size(ta) + F.size(tb) - both
    return (a == b) | ((least > 0) & ((both == least) | (both / union >= 0.6)))


def looks_same_company(a: Column, b: Column) -> Column:
    """Two cards' companies: equal card keys, or one contains the other."""
    ka, kb = card_company_key(a), card_company_key(b)
    return (ka != "") & (kb != "") & (ka.contains(kb) | kb.contains(ka))


def board_column(stage: Column) -> Column:
    return F.when(stage.isin("accepted", "declined"), "offer").otherwise(stage)


def rank_of(stage: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in lx.PROGRESSION.items() for x in kv])[stage]


def time_ago(ts: Column, as_of: Column) -> Column:
    """never / just now / 5m ago / 3h ago / 12d ago, and the date from 30 days on."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(ts.isNull(), "never").when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).when(s < 30 * 86400, part(86400, "d")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def domain_of(email: Column) -> Column:
    return F.lower(F.coalesce(F.get(F.split(email, "@"), F.lit(1)), F.lit("")))


def sender_class(domain: Column) -> Column:
    """struct(ats, vendor, board, noise, freemail): the first four by substring, freemail by equality or as a subdomain."""
    any_of = lambda names: domain.rlike("|".join(n.replace(".", r"\.") for n in names))
    free = F.lit(False)
    for d in lx.FREEMAIL_DOMAINS:
        free = free | (domain == d) | domain.endswith(f".{d}")
    return F.struct(any_of(lx.ATS_DOMAINS).alias("ats"), any_of(lx.VENDOR_DOMAINS).alias("vendor"), any_of(lx.BOARD_DOMAINS).alias("board"), any_of(lx.NOISE_DOMAINS).alias("noise"), free.alias("freemail"))

"""URL filter: rules first, then trust and distrust spread over the host graph (operator 4). DataFrame functions only.

Personalised PageRank spreads trust from allowed seeds along host edges, and distrust from blocked seeds along reversed
edges (who links to a blocked host is distrusted). Both are whole numbers of 10^-12 of the seeds' mass, rounded
down at each step, so sums do not depend on the order of rows. A host without a rule is blocked if its distrust exceeds its
trust by the given ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASS = 10**12
#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0), F.lit(""))
    return F.translate(raw, UPPER, LOWER), path


def _matched(pages: DataFrame, rules, most_inline: int = 200) -> DataFrame:
    """``pages(page_id, host, path, n)`` with ``rule`` and ``action`` of the longest rule that fits (of equals, the first)."""
    ranked = sorted(dict.fromkeys(rules), key=lambda r: -len(r[1] + r[2]))
    if len(ranked) <= most_inline:
        fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = action = F.lit(None).cast("string")
        for a, h, p in reversed(ranked):
            rule, action = F.when(fits(h, p), F.lit(h + p)).otherwise(rule), F.when(fits(h, p), F.lit(a)).otherwise(action)
        return pages.withColumn("rule", rule).withColumn("action", action)
    table = pages.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(ranked)], "i int, a string, rh string, rp string")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    pairs = pages.select("host", "path").distinct().withColumn("rh", F.explode(tails)).join(table, "rh").where(F.expr("startswith(path, rp)"))
    best = pairs.groupBy("host", "path").agg(F.min(F.struct("i", F.concat("rh", "rp").alias("rule"), F.col("a").alias("action"))).alias("b")).select("host", "path", "b.rule", "b.action")
    return pages.join(best, ["host", "path"], "left")


def page_links(pages: DataFrame, host: str, html_col: str = "html") -> DataFrame:
    """Host edges of absolute links in ``pages(host, html)``: ``(src, dst)`` distinct, without self links."""
    urls = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)"), F.lit(1)))
    found = pages.where(F.col(html_col).contains("://")).select(F.col(host).alias("src"), urls.alias("u"))
    return found.select("src", host_and_path(F.col("u"))[0].alias("dst")).where("dst <> '' and src <> '' and src <> dst").distinct()


def site_links(hosts: DataFrame) -> DataFrame:
    """Edges between a host and the host one label shorter, in both directions: a site's hosts vouch for each other."""
    up = F.substring("host", F.instr("host", ".") + 1, 1 << 20)
    pairs = hosts.where("instr(host, '.') > 0").select(F.col("host").alias("src"), up.alias("dst")).where("dst <> '' and instr(dst, '.') > 0")
    deeper = pairs.select(F.col("dst").alias("src"), F.expr("substring(dst, instr(dst, '.') + 1)").alias("dst")).where("instr(dst, '.') > 0")
    pairs = pairs.union(deeper)
    return pairs.union(pairs.select(F.col("dst"), F.col("src"))).distinct()


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: int = 85) -> DataFrame:
    """``edges(src, dst)`` distinct and ``seeds(host, trusted, blocked)`` (longs) -> ``(host, trust, distrust)``.

    One table holds both walks: kind 't' along edges, kind 'd' against them. Ranks are joined to edges on the source and summed by
    target with map-side partial sums; every few rounds are written to the shared folder.
    """
    both = edges.select(F.lit("t").alias("kind"), "src", "dst").union(edges.select(F.lit("d").alias("kind"), F.col("dst"), F.col("src")))
    out = both.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    steps = staged(both.join(out, ["kind", "src"]), "edges")
    start = staged(
        seeds.select(F.lit("t").alias("kind"), "host", F.col("trusted").alias("seed")).union(seeds.select(F.lit("d").alias("kind"), "host", F.col("blocked").alias("seed"))).where("seed > 0"),
        "seeds",
    )
    rank = start.select("kind", "host", F.col("seed").alias("rank"))
    teleport = start.select("kind", "host", F.expr(f"seed * {100 - damping} div 100").alias("part"))
    for i in range(rounds):
        moved = steps.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.expr(f"rank * {damping} div (100 * degree)").alias("part"))
        rank = moved.union(teleport).groupBy("kind", "host").agg(F.sum("part").alias("rank")).where("rank > 0")
        if i % 3 == 2:
            rank = staged(rank, "ranks")
    score = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0))
    return rank.groupBy("host").agg(score("t").alias("trust"), score("d").alias("distrust"))


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", rounds: int = 10, ratio: int = 1, most_broadcast: int = 200_000) -> DataFrame:
    """One row per page: id, ``host, path, rule, verdict``, and the host's ``trust`` and ``distrust``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins and decides. Without a
    rule a page is blocked if its host's distrust is above ``ratio`` times its trust. Seeds: a host's share of the
    pages that rules allow (trust) and block (distrust). Null urls and urls without ``://`` have empty host and
    path, fit no rule and are allowed. Ids may be null or repeated; repeated rows are pages like any other. An empty
    table gives an empty result. Other columns are not read. Hosts' scores are broadcast up to ``most_broadcast`` hosts.
    """
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    base = staged(_matched(base, rules), "pages")
    per_host = staged(base.groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("a"), F.count_if(F.col("action") == "block").alias("b"), F.count_if(F.col("action").isNull()).alias("open")).where("host <> ''"), "hosts")
    sums = per_host.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    share = [MASS // max(1, int(s)) for s in sums]
    seeds = per_host.select("host", (F.col("a") * share[0]).alias("trusted"), (F.col("b") * share[1]).alias("blocked"))
    edges = site_links(per_host.select("host"))
    if html_col:
        edges = edges.union(page_links(pages.select(host.alias("host"), F.col(html_col)), "host", html_col)).distinct()
    scores = propagated(edges, seeds, rounds)
    open_hosts = staged(per_host.join(scores, "host").select("host", "trust", "distrust"), "scores")
    if open_hosts.count() <= most_broadcast:  # so that pages of one busy host need not meet in a task
        open_hosts = F.broadcast(open_hosts)
    out = base.join(open_hosts, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0)), "distrust": F.coalesce("distrust", F.lit(0))})
    verdict = F.coalesce("action", F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow"))
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")

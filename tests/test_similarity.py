"""Similarity joins against all pairs of small users, and what heavy words cost."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mailfunnel.operators import similarity

T0 = datetime(2026, 1, 1)


def alike(a, b):
    ta, tb = a.split(), b.split()
    small, big = (ta, tb) if len(ta) <= len(tb) else (tb, ta)
    return a == b or bool(small) and bool(big) and set(small) <= set(big)


def variants(spark, rows):
    return {(r.user_id, r.company_key): r.bucket for r in similarity.company_variants(spark.createDataFrame(rows, "user_id long, company_key string, first_at timestamp")).collect()}


def test_variants_as_all_pairs(spark):
    rng, words, rows = random.Random(3), ["acme", "foods", "bank", "north", "x", "y", "z", "q"], {}
    for u in range(6):
        for i in range(25):
            k = " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 2, 3, 4, 7, 9])))
            rows.setdefault((u, k), T0 + timedelta(hours=rng.randint(0, 9)))
    got, want = variants(spark, [(u, k, at) for (u, k), at in rows.items()]), {}
    for (u, k), at in rows.items():
        earlier = [(x, o) for (v, o), x in rows.items() if v == u and o != k and alike(o, k) and (x, o) < (at, k)]
        want[u, k] = min(earlier)[1] if earlier else k
    assert got == want


def test_a_word_in_half_of_the_keys_costs_its_rows(spark):
    """No join may bring the keys of a heavy word together: rows out of every node stay within a small factor of the input."""
    n = 3000
    rows = [(1, f"bank w{i}" if i % 2 else f"w{i} v{i}", T0 + timedelta(seconds=i)) for i in range(n)] + [(1, "bank", T0)]
    assert sum(b == "bank" for (_, k), b in variants(spark, rows).items() if k != "bank") == n // 2
    df = similarity.company_variants(spark.createDataFrame(rows, "user_id long, company_key string, first_at timestamp"))
    df.collect()
    made, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if hasattr(node, "executedPlan") and node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        rows_out = node.metrics().get("numOutputRows")
        made += [rows_out.get().value()] if rows_out.isDefined() else []
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    assert made and max(made) < 30 * n


def test_duplicates_as_all_pairs(spark):
    rng, parts = random.Random(5), ["a", "ab", "b", "acme", "foods", "x1", "cab", "acmefoods", "é"]
    rows = [(u, f"{u}-{i}", " ".join(rng.choices(parts, k=rng.choice([1, 1, 2])))) for u in range(5) for i in range(30)] + [(9, "e", None), (9, "f", "...")]
    df = spark.createDataFrame(rows, "user_id long, id string, company string")
    got = {(r.user_id, r.id, r.other_id) for r in similarity.duplicate_candidates(df).collect()}
    key = {r.id: r.k for r in df.select("id", similarity.keys.card_company_key(F.col("company")).alias("k")).collect()}
    want = {(u, i, j) for u, i, _ in rows for v, j, _ in rows if u == v and i != j and key[i] and key[j] and (key[i] in key[j] or key[j] in key[i])}
    assert got == want and len(similarity.duplicate_candidates(df).collect()) == len(want)
    cards, pairs = similarity.duplicate_keys(df)
    assert cards.count() == sum(bool(k) for k in key.values()) and pairs.count() == pairs.distinct().count()
    plan = similarity.duplicate_keys(df)[1]._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all(" g#" in line or "(g#" in line for line in joins), "no join on the user alone"

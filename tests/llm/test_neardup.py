import random

import numpy as np
import pytest
from mailfunnel.llm import neardup, simhash


def alike(a, b):
    """Whether two token lists have a Jaccard similarity of 0.8 over five-word shingles."""
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a, b))
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def grouped(rows):
    words = [(t or "").lower().split() for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and alike(words[i], words[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def made():
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(300)]
    common = [rng.choice(vocab) for _ in range(60)]
    rows = [(None, "a b c d"), (None, "quite other words stand here"), (3, None), (4, ""), (5, "  "), (6, "One two"), (6, "one TWO"), (6, "three four"), (7, "\u00e9 \u00dcn\u00ef x y z"), (8, "x " * 3000)]
    for i in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 250))] + common * (i % 2)
        for k in range(6):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((100 + i * 6 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [1_000_000, 400])
def test_one_of_each_component_as_brute_force(spark, block):
    rows = made()
    got = sorted(str(r.doc_id) for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as k", "2 as h"), block=block).collect())
    root = grouped(rows)
    want = sorted(str(min((rows[i][0] for i in range(len(rows)) if root[i] == r), key=lambda d: (d is None, d or 0))) for r in set(root))
    assert got == want and len(want) < len(rows) - 60


def test_the_pipelines_stage_drops_near_copies_and_no_others(spark):
    import corpus_pipeline

    base = ["word%d" % i for i in range(100)]
    near = [w if i not in (20, 70) else "new" for i, w in enumerate(base)]  # 86 of 106 shingles
    far = [w if i not in (20, 50, 80) else "new" for i, w in enumerate(base)]  # 81 of 111
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (None, "a null id"), (None, "another null id here too"), (9, "one id and two"), (9, "texts that are not alike")]
    kept = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert alike(base, near) and not alike(base, far) and sorted(r.text for r in kept) == sorted(t for d, t in rows if d != 2)


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(2000):
        x = rng.integers(0, 2**63, 100, dtype=np.uint64)
        y = np.concatenate([x[:90], rng.integers(0, 2**63, 9, dtype=np.uint64)])  # 90 of 109
        x = x[: len(x)]
        met += bool((neardup.bands(x) == neardup.bands(y)).any())
    assert met >= 1990


def similar_pair(rng, small, large, common):
    """Two sets of hashes and whether a trie's walk, within both budgets, brings them together."""
    h = np.unique(rng.integers(0, 2**63, small + large - common, dtype=np.uint64))
    x, y = h[:small], h[small - common :]
    own = list(neardup._with_few([x])), list(neardup._with_few([y]))
    for a in neardup.prints_of(own[0][0]):
        for b in neardup.prints_of(own[1][0]):
            wrong = np.bitwise_count(a ^ b)
            near = (wrong <= neardup.WORD_ERRORS) & (wrong + np.roll(wrong, -1) <= neardup.ERRORS)
            for shift, bits in simhash._blocks(neardup.TURNS - 1):
                if (near & (simhash._rotated(a ^ b, shift) >> np.uint64(64 - bits) == 0)).any():
                    return True
    return False


@pytest.mark.parametrize("small, large, common", [(4, 5, 4), (5, 6, 5), (8, 10, 8), (9, 9, 8), (45, 45, 40), (90, 90, 80), (400, 500, 400)])
def test_walks_meet_at_the_threshold(small, large, common):
    rng = np.random.default_rng(common)
    assert sum(similar_pair(rng, small, large, common) for _ in range(400)) >= 399


def test_candidates_come_from_the_tries_walk(spark, monkeypatch):
    base = ["word%d" % i for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:50] + ["new"] + base[51:]))]
    docs, calls = spark.createDataFrame(rows, "doc_id long, text string"), []
    walked = neardup.walked
    monkeypatch.setattr(neardup, "walked", lambda *a: calls.append(a[0].columns) or walked(*a))
    assert [r.doc_id for r in neardup.keep_one(docs).collect()] == [1] and calls == [["r", "key", "other", "side", "v", "w", "k"]]


def test_subtries_dealt_out_as_children(spark):
    rows = made()
    docs = spark.createDataFrame(rows[10:], "doc_id long, text string")
    whole, dealt = (sorted(r.doc_id for r in neardup.keep_one(docs, most=most).collect()) for most in (20_000, 6))
    assert whole == dealt


def test_empty_table(spark):
    assert neardup.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def pythons(plan):
    """The most Python nodes in one stage of a physical plan, and those in the stage of its top."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return pythons(plan.inputPlan())
    below = [pythons(plan.children().apply(i)) for i in range(plan.children().size())]
    own = sum(top for _, top in below) + ("Arrow" in name or "Python" in name or "Pandas" in name)
    return max([own, *(most for most, _ in below)]), 0 if "Exchange" in name else own


def test_no_task_holds_two_python_workers(spark, monkeypatch):
    plans, staged = [], neardup.staged
    seen = lambda df: plans.append(pythons(df._jdf.queryExecution().executedPlan())[0])
    monkeypatch.setattr(neardup, "staged", lambda df, name: seen(df) or staged(df, name))
    components = neardup.components
    monkeypatch.setattr(neardup, "components", lambda links: seen(links) or components(links))
    seen(neardup.keep_one(spark.createDataFrame(made(), "doc_id long, text string")))
    assert len(plans) == 7 and max(plans) == 1


def test_sets_are_of_the_class_asked_for(spark):
    texts = ["a b c d e f", "A b c d e F", "another text of six words here", "not asked for"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    x = {r.text: r.x for r in docs.selectExpr("text", "xxhash64(text) as x").collect()}
    k = {t: int(np.array([neardup._class(t.encode())], np.uint64).view(np.int64)[0]) for t in texts}
    # the last row gives a class the hash of a text that is not of the class, as if two hashes were equal
    heads = spark.createDataFrame([(k[texts[0]], x[texts[1]]), (k[texts[2]], x[texts[2]]), (k[texts[2]], x[texts[0]])], "k long, x long")
    got = {r.k: bytes(r.s) for r in neardup._sets(docs, "text", heads).collect()}
    assert got == {k[t]: neardup.shingles(t.encode()).tobytes() for t in (texts[0], texts[2])}

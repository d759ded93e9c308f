import random

import numpy as np
import pytest
import xxhash
from mailfunnel.llm import simhash


def brute(rows, words=4, errors=4):
    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        sh = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= errors:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            best[r] = min(best.get(r, d), d)
    return sorted((str(d), f"{f:016x}", best.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def made(n=120):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(50)]
    rows = [(None, "a b c d"), (3, None), (4, ""), (5, "  "), (6, "One two"), (6, "one TWO"), (7, "é Ünï x y z"), (8, "x " * 3000)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 300))] for _ in range(n // 4)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((100 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("most", [20_000, 3])
def test_components_as_brute_force(spark, most):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as key")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, most=most).collect())
    assert got == brute(rows)


def test_walk_finds_every_pair():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 20, dtype=np.uint64)
    v = np.unique(np.concatenate([centre, *[centre ^ np.uint64(1 << int(rng.integers(0, 64))) ^ np.uint64(1 << int(rng.integers(0, 64))) for _ in range(30)]]))
    got = {(int(a), int(b)) for x, y in simhash._walk(v, (0, len(v)), (0, len(v)), 0, 4, leaf=2) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if bin(int(v[i] ^ v[j])).count("1") <= 4}
    assert got == want


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "y"), (2, "A b c d e", "z"), (3, "other words in here now", "q"), (9, None, "n")], "doc_id long, text string, fingerprint string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 9]


def test_keep_one_keeps_unlike_texts_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (None, "other words in here now"), (None, "A b c d e"), (5, "one text under this id"), (5, "quite another text under it"), (6, "QUITE another text under it"), (7, None), (7, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "5", "7", "None", "None"]
    assert {(r.text or "").lower() for r in kept if r.doc_id != 7} == {"a b c d e", "other words in here now", "one text under this id", "quite another text under it"}

import random

import numpy as np
from mailfunnel.llm import decontam


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(prev[j] + (x != y), prev[j + 1] + 1, now[-1] + 1))
        prev = now
    return prev[-1]


def test_edit_distance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, (50, 9)), rng.integers(0, 4, (50, 9))
    assert decontam.edit_distance(a, b).tolist() == [distance(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_recall_against_brute_force_and_no_false_match(spark):
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(800)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([12, 20, 40])))) for i in range(40)]
    docs = [(1000, None), (1002, ""), (1001, items[0][1]), (1001, items[0][1])]
    for d in range(150):
        words = items[d % 40][1].split()
        for _ in range(rng.randint(0, int(0.3 * len(words)))):
            p, kind = rng.randrange(len(words)), rng.randint(0, 2)
            if kind == 0:
                words[p] = rng.choice(vocab)
            elif kind == 1:
                words.insert(p, rng.choice(vocab))
            elif len(words) > 8:
                del words[p]
        around = lambda: [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        docs.append((d, ", ".join([*around(), *words, *around()]).upper()))
    want = {}
    for d, t in docs:
        w = decontam.tokens(t or "")
        for i, x in items:
            y = x.split()
            n = len(y)
            best = min((distance(w[s : s + n], y) for s in range(len(w) - n + 1) if len(set(w[s : s + n]) & set(y)) > n // 3), default=n)
            if best <= int(0.2 * n):
                want[d, i] = best
    bench = spark.createDataFrame([*items, (77, None), (78, "one two"), (79, "")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'t' as t")
    for block in (20_000, 15):
        got = decontam.matches(df, bench, block=block).collect()
        assert len([r for r in got if r.doc_id == 1001]) == 2
        found = {(r.doc_id, r.item_id): r.distance for r in got}
        assert not set(found) - set(want)
        assert len(found) >= 0.95 * len(want)
        text = dict(docs)
        r = next(r for r in got if r.doc_id not in (1001,) and r.distance == 0)
        assert decontam.tokens(text[r.doc_id][r.start_char : r.end_char]) == dict(items)[r.item_id].split()
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    assert decontam.matches(df, bench.limit(0)).count() == 0 and decontam.matches(df.limit(0), bench).count() == 0


def nearest(text, item):
    """Edit distance of ``item`` to the closest run of ``text`` of any length."""
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(prev[j] + (x != y), prev[j + 1] + 1, now[-1] + 1))
        prev = now
    return min(prev)


def shortened(rng, items, vocab):
    """Items with words left out, put in or changed, alone in a text or in the middle of one."""
    docs = []
    for d in range(240):
        words = items[d % len(items)][1].split()
        for _ in range(rng.randint(0, len(words) // 4)):
            p, kind = rng.randrange(len(words)), d % 3
            if kind == 0:
                del words[p]
            elif kind == 1:
                words.insert(p, rng.choice(vocab))
            else:
                words[p] = rng.choice(vocab)
        around = [rng.choice(vocab) for _ in range(rng.randint(1, 40))] if d % 2 else []
        docs.append((d, " ".join([*around, *words, *around])))
    return docs


def test_any_run_against_brute_force():
    rng = random.Random(6)
    vocab = ["w%d" % i for i in range(800)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([12, 20, 38, 40])))) for i in range(40)] + [(50, "short one"), (51, "odd")]
    docs = [*shortened(rng, items[:40], vocab), (300, "a short one here"), (301, "short two one"), (302, "odd"), (303, ""), (304, "short one")]
    words = [decontam.tokens(t) for _, t in docs]
    want = {(t, i): n for t, w in enumerate(words) for i, x in items for y in [x.split()] if len(set(w) & set(y)) > len(y) // 3 or len(y) < 5 for n in [nearest(w, y)] if n <= int(0.2 * len(y))}
    whole = decontam.Items(items, 0.2, 1, wide=True)
    got = whole.search([np.array([whole.vocab.get(x, 0) for x in w], np.int64) for w in words])
    found = {(t, i): n for t, i, _, _, n in got}
    assert not set(found) - set(want) and all(n >= want[k] for k, n in found.items())
    assert len(found) >= 0.98 * len(want)
    text = dict(items)
    assert all(0 <= s and s + n <= len(words[t]) and distance(words[t][s : s + n], text[i].split()) == d for t, i, s, n, d in got)
    assert {(240, 50), (242, 51), (244, 50)} <= set(found) and (241, 50) not in found


def test_queries_find_an_item_with_words_left_out(spark, tmp_path):
    import corpus_pipeline
    from mailfunnel.llm import queries

    item = ["word%d" % i for i in range(38)]
    docs = [(1, " ".join(item[1:])), (2, " ".join(["before", *item[:10], *item[14:], "after", *["more"] * 9])), (3, " ".join(item[:28])), (None, "two words")]
    for name, rows, kind in (("documents", docs, "doc_id long, text string"), ("benchmark", [(7, " ".join(item)), (8, "two words")], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.op2_benchmark_leaks(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.item_id, r.distance, r.n_words) for r in got) == [("1", 7, 1, 37), ("2", 7, 4, 34), ("None", 8, 0, 2)]
    kept = corpus_pipeline.without_benchmark(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [3]


def test_recall_of_the_hashing_alone():
    """Planted windows that the choice of walks has not seen: without the run of untouched words, at least 0.98 of each length meet their item."""
    rng = np.random.default_rng(99)
    for length in (5, 8, 12, 20, 38, 60, 150):
        ids = rng.permutation(np.arange(1, 60 * length + 1)).reshape(60, length)
        errors = length // 5
        walks = decontam.walks_for(ids, errors)
        own = ids[np.arange(300) % 60]
        met = (decontam.signatures(decontam.planted(own, errors, rng), walks) == decontam.signatures(own, walks)).any(axis=1)
        assert walks < decontam.WALKS and met.mean() >= 0.98, (length, walks, met.mean())


def test_planted_windows_have_the_edits():
    rng = np.random.default_rng(3)
    ids = np.arange(1, 41).reshape(2, 20)
    for row, was in zip(decontam.planted(ids[[0, 1] * 20], 4, rng).tolist(), ids[[0, 1] * 20].tolist()):
        assert 0 < nearest(row, was) <= 8 and len(row) == 20  # words put in push as many off the end


def test_windows_meet_by_runs_where_no_walks_are_enough():
    """A target that no number of walks reaches: nothing is lost then, and nothing false comes in."""
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 20, 41])))) for i in range(30)]
    docs = [*shortened(rng, items, vocab), (300, "")]
    words = [decontam.tokens(t) for _, t in docs]
    want = {(t, i): n for t, w in enumerate(words) for i, x in items for y in [x.split()] for n in [nearest(w, y)] if n <= int(0.2 * len(y))}
    exact = decontam.Items(items, 0.2, 1, wide=True, recall=2.0)
    assert set(exact.runs) == set(exact.tables) and decontam.walks_for(exact.tables[12][1], 2, recall=2.0) == 0
    got = {(t, i): n for t, i, _, _, n in exact.search([np.array([exact.vocab.get(x, 0) for x in w], np.int64) for w in words])}
    assert set(got) == set(want) and all(n >= want[k] for k, n in got.items())


def test_ids_of_any_type_and_long_items(spark):
    long = " ".join(f"v{i % 997}x{i}" for i in range(300))
    bench = spark.createDataFrame([("a-1", "one two three four five"), ("b-2", long), (None, "six seven eight nine ten"), ("a-1", "one two three four five")], "name string, text string")
    docs = spark.createDataFrame([("d", "ONE two three four five"), ("e", "x " * 200 + long.replace("v5x5 ", "") + " y" * 200), (None, "six seven eight nine eleven"), ("f", None)], "key string, text string")
    got = decontam.matches(docs, bench, id_col="key", item_col="name", wide=True)
    assert sorted((str(r.key), str(r.name), r.distance) for r in got.select("key", got["name"].alias("name"), "distance").collect()) == [("None", "None", 1), ("d", "a-1", 0), ("e", "b-2", 1)]

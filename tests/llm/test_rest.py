import hashlib
import random
import zlib

import numpy as np
import pytest

from mailfunnel.llm import mixing, sharding, topk, toxicity, urlfilter


def test_top_k_as_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(rng.choice([4, 5]))]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 330)] + [(400, None), (None, [1.0]), (420, [float("nan")]), (440, [1.0, None]), (460, []), (480, [float("inf")])]
    df = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as own", "3 as score")
    import math

    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    once, ok = ok, [*ok, ok[0]]  # the repeated row is a candidate twice and asked once
    want = []
    for q, a in once:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for block in (4096, 64):
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, block=block).collect()]
        assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    """Ranked by the exact score; one that fits no long is an error where it is returned."""
    rows = [(0, [2.0**26, 1.0]), (1, [2.0**22, -(2.0**22)]), (2, [1.0, 2.0]), (3, [2.0**23 + 1, 0.0]), (20, [-(2.0**20), 1.5]), (40, [2.0**21] * 2), (41, [2.0**21] * 2), (60, [2.0**27 + 3, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    fits = df.where("vec_id not in (0, 60)")
    kept = {i: v for i, v in whole.items() if i not in (0, 60)}
    want = [(q, r + 1, i, -s) for q in (20, 40) for r, (s, i) in enumerate(sorted((-sum(x * y for x, y in zip(kept[q], b)), i) for i, b in kept.items() if i != q)[:3])]
    assert sorted(tuple(r) for r in topk.top_k(fits, k=3).collect()) == sorted(want)
    # 0 and 60: their product is over 2^63, so the best row of both is no long; no other row may take its place
    with pytest.raises(Exception, match="fits no long"):
        topk.top_k(df, k=1).collect()
    far = spark.createDataFrame([(0, [2.0**34]), (1, [2.0**23]), (2, [2.0**22]), (3, [2.0**27]), (4, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="query 0 and row 4 fits no long"):
        topk.top_k(far, k=1).collect()
    low = spark.createDataFrame([(0, [-(2.0**34)]), (1, [1.0]), (2, [2.0]), (3, [1e300])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(low, k=2).collect()] == [(1, -(2**46)), (2, -(2**47))]


def test_blocks_of_rings():
    assert topk._joined({(0, 0): 3, (0, 1): 4, (0, 2): 5, (0, 3): 25, (0, 4): 1, (1, 0): 1}, 10) == {(0, 0): "0,1", (0, 1): "0,1", (0, 2): "1,1", (0, 3): "2,3", (0, 4): "5,1", (1, 0): "0,1"}


def test_top_k_in_rings(spark):
    """Small blocks: cells are cut into rings, and most pairs of blocks never meet."""
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 3, (6, 8))
    data = [(i, (centre[i % 6] * (1 + (i % 50) / 10) + rng.normal(0, 0.05, 8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, k=5, block=128).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    m = np.floor(np.array([v for _, v in data]) * 64).astype(np.int64)
    for q in range(0, 3000, 20):
        s = m @ m[q]
        s[q] = -(2**62)
        best = np.lexsort((np.arange(3000), -s))[:5]
        assert sorted(got[q]) == [(i + 1, int(j), int(s[j])) for i, j in enumerate(best)]


def test_shards(spark, tmp_path):
    rows = [(None, None), (1, ""), (1, "a"), (1, "a")] + [(i, "é" * (i % 37)) for i in range(2, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as vslot")
    got = sharding.sharded(df, shards=5, slots=256, map_path=str(tmp_path / "map")).collect()
    load, count = [0] * 5, [0] * 5
    for r in got:
        load[r.shard] += r.size
        count[r.shard] += 1
    assert len(got) == len(rows) and max(load) < 1.05 * sum(load) / 5
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    first = sharding.load_map(spark, str(tmp_path / "map"))
    sizes = [(slot, n) for _, slot, _, n in first]
    grown = sharding.rebalanced(first, sizes, 6)
    old = {slot: shard for _, slot, shard, _ in first}
    assert {v for v, *_ in grown} == {2} and all(shard in (old[slot], 5) for _, slot, shard, _ in grown)
    assert sum(old[slot] != shard for _, slot, shard, _ in grown) < 0.3 * len(grown)
    assert sharding.sharded(df.limit(0)).count() == 0


def test_shards_of_equal_rows(spark):
    """Two thirds of the rows are alike: the law of near-equal bytes holds all the same."""
    same = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'' as text")
    rest = spark.range(2000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    got = sharding.sharded(same.union(rest), shards=8).groupBy("shard").agg(sharding.F.sum("size").alias("b"), sharding.F.count("*").alias("n"), sharding.F.count_distinct("slot").alias("d"), sharding.F.max("slot").alias("m")).collect()
    assert sum(r.n for r in got) == 22_000 and all(r.n == r.d == r.m + 1 for r in got)
    mean = sum(r.b for r in got) / 8
    assert max(r.b for r in got) < 1.03 * mean and min(r.b for r in got) > 0.97 * mean
    numbers = sharding.numbered(same.union(rest), run=7).groupBy("doc_id", "text").agg(sharding.F.count("*").alias("n"), sharding.F.count_distinct("number").alias("d"), sharding.F.max("number").alias("m")).collect()
    assert len(numbers) == 2001 and all(r.n == r.d == r.m + 1 for r in numbers) and max(r.n for r in numbers) == 20_000


def test_mixed_with_many_equal_rows(spark):
    """Rows repeated exactly share their positions at a cost in proportion; rows that differ in another column only keep theirs."""
    same = [(7, "a b c", "s", 1)] * 4000
    near = [(8, "a b", "s", i) for i in range(5)] + [(None, "n n", None, 1), (None, "n n", None, 2), (9, "", "s", 1)]
    df = spark.createDataFrame([*same, *near], "doc_id long, text string, source string, k int")
    found, stream = mixing.placed(df).collect(), mixing.mixed(df)
    assert stream.columns == df.columns
    got, want = {}, {}
    for r in stream.collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    for r in found:
        if r.copies:
            want[r.doc_id, r["__source"]] = want.get((r.doc_id, r["__source"]), 0) + r.copies
    assert got == want and sum(want.values()) > 4000
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, mixing.mixed(df.repartition(5)).collect()))


def test_mix_targets_and_copies(spark):
    rows = [(i, "w " * (i % 9), "a" if i % 3 else "b") for i in range(300)] + [(7, "x y", None), (7, "x y", None), (None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as taken")
    got = mixing.placed(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        x = by.setdefault(r["__source"], [0, r.target, 0])
        x[0] += r.taken
        x[2] = max(x[2], r.size)
    assert abs(sum(x[1] for x in by.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert all(abs(taken - target) <= largest for taken, target, largest in by.values())
    stream = mixing.mixed(df)
    assert stream.columns == df.columns and stream.count() == sum(r.copies for r in got)
    assert mixing.placed(df.limit(0)).count() == 0


def test_url_edges(spark):
    urls = ["http://A.com", "HTTP://x.example.com/en/a?b#c", "https://www.example.com/en/", "http://b.net/es/1", "http://b.net/x", "b.net/es/", None, "://", "http://q.org/?u=http://z.com/"]
    df = spark.createDataFrame([(i, u, "<a href='http://b.net/es/1'>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(df).collect()}
    assert got[0] == ("a.com", "", None, got[0][3]) and got[1][:3] == ("x.example.com", "/en/a", "example.com/en/") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3][3] == "block" and got[5][:2] == got[6][:2] == got[7][:2] == ("", "") and got[8][:2] == ("q.org", "/")
    assert all(v in ("allow", "block") for *_, v in got.values())
    many = [("block", f"h{i}.org", "/") for i in range(300)] + list(urlfilter.RULES)
    assert {r.page_id: r.rule for r in urlfilter.judged(df, rules=many).collect()} == {k: v[2] for k, v in got.items()}


def test_crf_finds_spans(monkeypatch):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "house", "river", "stone", "cloud"])
    rows = []
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 5 == 0:
            words[10:12] = ["vile", rng.choice(["vermin", "verminous"])]
        rows.append((" ".join(words), int(i % 5 == 0)))
    model = toxicity.fit(rows)
    texts = [*(t for t, _ in rows), "", None]
    whole = {i: m for at, marg in toxicity._marginals(model, texts) for i, m in zip(at, marg)}
    monkeypatch.setattr(toxicity, "STEP_CHARS", 1000)
    parts = list(toxicity._marginals(model, texts))
    assert len(parts) > 10 and sorted(i for at, _ in parts for i in at) == list(range(len(texts)))
    assert all(np.allclose(whole[i], m) for at, marg in parts for i, m in zip(at, marg))
    score = model.score([whole[i] for i in range(len(texts))])
    assert all((s >= 0.5) == bool(y) for s, (_, y) in zip(score, rows)) and max(score[-2:]) < 0.5
    a, b = toxicity._spans(texts[0], whole[0])[0]
    assert "vile" in texts[0][a:b]


def test_crf_over_tables(spark):
    texts = [(i, ("river vile vermin " if i % 4 == 0 else "river stone ") * (1 + i % 3)) for i in range(60)] + [(None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as score", "2 as t", "3 as toxic")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    got = toxicity.judged(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        bad = r.doc_id is not None and r.doc_id % 4 == 0
        assert r.predicted == bad and (r.n_spans > 0) == bad and (r.first_start in (6, 11) if bad else (r.first_start, r.first_end) == (-1, -1))
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert toxicity.judged(docs.limit(0), model).count() == 0 == toxicity.clean(docs.limit(0), model).count()


def test_training_positions_as_brute_force(spark):
    rows = [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(300)] + [(None, "x y", None), (None, "z y x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.size): r for r in mixing.ordered(df).collect()}
    for rank, source in enumerate(["a", "b", "c", None]):
        tilt, at = mixing.TILTS[rank % 3], 0
        key = lambda d, t: hashlib.md5((hashlib.md5(t.encode()).hexdigest() if d is None else str(d)).encode()).hexdigest()
        own = sorted((key(d, t), len(t.split()), d) for d, t, s in rows if s == source)
        size = sum(n for _, n, _ in own)
        for _, n, d in own:
            r = got[d, n]
            due = []
            for p in range(2):
                if n and size * p + at + n / 2 < r.target:
                    u, low, high = (size * p + at + n / 2) / max(r.target, 1), 0.0, 1.0
                    for _ in range(60):  # the demand is a growing function of time: bisection
                        t = (low + high) / 2
                        low, high = (t, high) if (1 + tilt) * t - tilt * t * t < u else (low, t)
                    due.append(low)
            at += n
            assert r.copies == len(due) and r.taken == n * len(due)
            if due:
                assert abs(r.first_position - due[0] * 1e6) < 2 and abs(r.last_position - due[-1] * 1e6) < 2
            else:
                assert r.first_position is None and r.last_position is None
    found = [r.first_position for r in mixing.ordered(df).collect() if r.first_position is not None]
    assert found == sorted(found)


def test_mixed_keeps_clashing_columns(spark):
    names = ["__h", "__m", "__t", "__id", "__source", "row", "i", "s", "h", "m", "at", "a.b"]
    df = spark.createDataFrame([(1, "x y", "a", *range(12)), (2, None, None, *range(12))], ["doc_id", "text", "source", *names])
    assert mixing.mixed(df).columns == df.columns and {r.doc_id for r in mixing.mixed(df).collect()} == {1}


def test_map_is_stored_and_edited(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(2000)], "doc_id long, text string")
    got = sharding.sharded(df, shards=4, slots=128, map_path=str(tmp_path / "map"), grow_to=5).collect()
    one, two = (sharding.load_map(spark, str(tmp_path / "map"), v) for v in (1, 2))
    assert len(one) == len(two) == 128 and {s for _, _, s, _ in two} == set(range(5))
    first, second = {s: x for _, s, x, _ in one}, {s: x for _, s, x, _ in two}
    assert all(r.shard == first[r.vslot] and r.next_shard == second[r.vslot] for r in got)
    assert 0 < sum(r.shard != r.next_shard for r in got) < 0.4 * len(got)


def test_spans_of_the_text_as_it_is_and_any_ids(spark):
    model = toxicity.fit([(f"word {i} of vile kind", 1) for i in range(40)] + [(f"word {i} of good kind", 0) for i in range(120)])
    text = "İİİİ vile, then good and fine words and more of them, vile"
    rows = [("a", text), (None, None), ("9007199254740993", "")]
    got = {r.doc_id: r for r in toxicity.judged(spark.createDataFrame(rows, "doc_id string, text string"), model).collect()}
    assert [text[s.start : s.end] for s in got["a"].spans] == ["vile", "vile"] and got[None].n_spans == 0
    longs = toxicity.judged(spark.createDataFrame([(9007199254740993, "x"), (None, "x")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.held_out for r in longs} == {9007199254740993: zlib.crc32(b"9007199254740993") % 5 == 0, None: zlib.crc32(b"None") % 5 == 0}


def test_shards_as_brute_force(spark, tmp_path):
    """The whole assignment again in plain Python: slots, their bytes, the map, the places."""
    rng = random.Random(12)
    rows = [(None, None), (None, "x"), (3, ""), (4, None), (5, "é" * 9000), *[(7, "same")] * 3, (7, "other")] + [(100 + i, "ab " * rng.randint(0, 90)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as vslot", "2 as shard", "'n' as size").repartition(4)
    got = sharding.sharded(df, shards=6, slots=64, map_path=str(tmp_path / "map")).collect()

    def record(doc, text):
        data = (text or "").encode()
        size = len(data) + 8
        crc = zlib.crc32(data)
        seen[doc, size, crc] = n = seen.get((doc, size, crc), -1) + 1  # equal records hash by their number too
        name = hashlib.md5(f"{f'~{crc}' if doc is None else doc}|{size}{f'|{n}' if n else ''}".encode()).hexdigest()
        return doc, size, crc, int(name[:8], 16) % 64

    seen = {}
    records = [record(*r) for r in rows]
    slots = {s: sum(r[1] for r in records if r[3] == s) for s in range(64)}
    load, shard_of = [0] * 6, {}
    for s in sorted(slots, key=lambda s: (-slots[s], s)):
        shard_of[s] = load.index(min(load))
        load[shard_of[s]] += slots[s]
    want = []
    for shard in range(6):
        own = sorted((r for r in records if shard_of[r[3]] == shard), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2]))
        want += [(str(r[0]), r[1], r[2], "bytes", shard, i, r[3]) for i, r in enumerate(own)]
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.law, r.shard, r.slot, r.vslot) for r in got) == sorted(want)

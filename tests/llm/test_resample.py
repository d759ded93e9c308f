import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from mailfunnel.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, target, percent=25):
    def feats(t):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return words, [zlib.crc32(f.encode()) % 10000 for f in words + [" ".join(p) for p in zip(words, words[1:])]]

    s, t = Counter(b for _, x in docs for b in feats(x)[1]), Counter(b for x in target for b in feats(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for d, x in docs:
        words, f = feats(x)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "Straße", "é", "日本", "x1", "B2b", "'s", "-", "naïve", "long" * 50, "of"]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 19, 20, 21, 60]))) for _ in range(n)]


def test_crcs_of_all_lengths():
    rng = random.Random(2)
    feats = [bytes(rng.choices(range(256), k=k)) for k in [0, 1, 1, 2, 3, 63, 64, 65, 66, 127, 128, 129, 1000, 1025, 20_000, 33_000] * 3]
    sizes = np.array([len(f) for f in feats])
    flat, begin = np.frombuffer(b"".join(feats), np.uint8), np.cumsum(sizes) - sizes
    assert resample.crc32s(flat, begin, sizes).tolist() == [zlib.crc32(f) for f in feats]
    assert resample.crc32s(flat, begin[:0], sizes[:0]).tolist() == []


def test_as_brute_force(spark):
    rows = list(enumerate(texts(300))) + [(1, texts(1)[0]), (None, None), (None, "null id " * 30), (900, ""), (901, "A" * 30_000 + " b " * 40), (902, "\x85\xa0 ÀÉ " * 20), (903, "tie " * 25), (903, "tie " * 25)]
    target = ["The long é of Straße", None, "", "日本 x1 x1 naïve " * 40]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as rank", "2 as _words")
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resampled(df, goal).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in got) == brute(rows, target)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 1 + sum(r.rank is not None for r in got)))
    assert sorted(str(tuple(r)[:5]) for r in resample.resampled(df, goal.limit(0), percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute(rows, [], 50)
    assert resample.resampled(df.limit(0), goal).count() == 0


def test_runs_do_not_matter():
    rows = [(i, t.encode()) for i, t in enumerate(texts(80, 3))]
    whole = resample.features([t for _, t in rows])
    assert np.bincount(whole[2], minlength=resample.BUCKETS).tolist() == sum(np.bincount(resample.features([t])[2], minlength=resample.BUCKETS) for _, t in rows).tolist()
    assert len(whole[1]) == sum(max(0, 2 * n - 1) for n in whole[0])

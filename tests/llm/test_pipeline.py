import hashlib
import math
import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from mailfunnel.llm import decontam, toxicity
from test_decontam import distance
from test_simhash import brute
from tokenizers import Tokenizer


def made():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(12))) for i in range(5)]
    docs, labels = [(None, "a text without id", "x"), (1000, None, "x"), (1001, "", None), (1002, "One! word", "y")], []
    for i in range(260):
        words = [rng.choice(vocab) for _ in range(rng.randint(25, 40))]
        if i % 5 == 0:
            words[10:12] = ["vile", rng.choice(["vermin", "verminous"])]
        elif i % 13 == 1:
            words[5:17] = items[i % 5][1].split()
            words[8] = "changed" if i % 2 else words[8]
        docs.append((i, " ".join(words).title() if i % 3 else " ".join(words) + ".", [*"abc", None][i % 4 if i % 8 else 0]))
        if i % 13 < 12:
            labels.append((i, int(i % 5 == 0)))
    copies = [(2000 + i, t if i % 2 else (t or "").upper(), s) for i, (_, t, s) in enumerate(rng.sample(docs[4:], 30))]
    return docs + copies, labels, items


def toxic_score(model, text):
    """Forward-backward of one text, a token at a time."""
    odds = [math.exp(max(-30, min(30, model.emission(w)))) for w in toxicity.TOKEN.findall((text or "").lower())]
    t, start, n = np.exp(model.trans), np.exp(model.start), len(odds)
    ahead, behind = np.zeros((n, 2)), np.ones((n, 2))
    for k in range(n):
        ahead[k] = (start if k == 0 else ahead[k - 1] @ t) * [1, odds[k]]
        ahead[k] /= ahead[k].sum()
    for k in range(n - 2, -1, -1):
        behind[k] = t @ (behind[k + 1] * [1, odds[k + 1]])
        behind[k] /= behind[k].sum()
    p = [(a * b / (a * b).sum())[1] for a, b in zip(ahead, behind)]
    z = np.array([1, max(p, default=0), math.log1p(sum(p))]) @ model.layer
    return 1 / (1 + math.exp(-z))


def holds(text, items):
    words = decontam.tokens(text or "")
    windows = lambda n: (words[s : s + n] for s in range(len(words) - n + 1))
    return any(len(set(w) & set(y)) > 4 and distance(w, y) <= int(0.2 * len(y)) for _, x in items for y in [x.split()] for w in windows(len(y)))


def mix(docs):
    """Each document as often as its source's target takes it."""
    size = lambda t: len((t or "").encode().split())
    by = defaultdict(list)
    for d in docs:
        by[d[2]].append(d)
    total = {s: sum(size(t) for _, t, _ in rows) for s, rows in by.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, set(by)
    while open_:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        target |= {s: 2 * total[s] if s in full else level * weight[s] for s in full or open_}
        open_ -= full or open_
    out = []
    for s, rows in by.items():
        before = 0
        for d in sorted(rows, key=lambda d: (hashlib.md5(str("" if d[0] is None else d[0]).encode()).hexdigest(), size(d[1]))):
            n = size(d[1])
            out += [d] * sum(n > 0 and total[s] * p + before + n / 2 < target[s] for p in range(2))
            before += n
    return out


def test_pipeline_as_brute_force(spark, tmp_path):
    rows, labels, items = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "length(text) as n_chars", "7 as size")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    tables = {"labels": (labels, "doc_id long, toxic int"), "benchmark": ([*items, (9, None), (10, "")], "item_id long, text string")}
    for name, (data, kind) in tables.items():
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.trained(docs, spark.createDataFrame(*tables["labels"]))
    kept = [d for d in rows if toxic_score(model, d[1]) < 0.5]
    toxic = {d[0] for d in rows if "vile" in (d[1] or "").lower()}
    assert toxic and {d[0] for d in rows} - {d[0] for d in kept} == toxic
    heads = {i for i, _, c in brute([(d, t) for d, t, _ in kept]) if i == str(c)}
    kept = [d for d in kept if str(d[0]) in heads]
    clean = [d for d in kept if not holds(d[1], items)]
    assert len(rows) - len(toxic) > len(kept) > len(clean)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for d, text, _ in sorted(mix(clean), key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, kind in {"documents": "doc_id long, text string, source string", "labels": "doc_id long, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from mailfunnel.llm import phrases, sql


def brute(rows, most=3, least=10, top=2000, inside=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if " " in p and a >= least}
        rows = []
        for p, a in cand.items():
            w = p.split(" ")
            score, k = min((1000000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w)))
            longer = [b for q, b in cand.items() if len(q.split(" ")) > len(w) and any(q.split(" ")[i : i + len(w)] == w for i in range(len(q.split(" "))))]
            if not any(100 * b >= inside * a for b in longer):
                rows.append((-score, -a, p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(seed, n=250):
    rng = random.Random(seed)
    words = ["New", "York", "city", "of", "the", "x\x0bq", "É", "a b", "ÉÉ", "no", "no", "\x1c"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\r\n", ":"]
    return [(rng.choice(["en", "en", "en", "de", None, ""]), "".join(w + rng.choice(ends) for w in rng.choices(words, weights=[9, 9, 3, 5, 5, 1, 1, 1, 1, 4, 4, 1], k=rng.choice([0, 1, 2, 9, 40])))) for _ in range(n)]


def spread(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").selectExpr("*", "1 as phrase", "2 as rank", "'x' as words")


@pytest.mark.parametrize("share, seed", [(0.25, 1), (0.02, 2), (1.0, 3)])
def test_as_brute_force(spark, share, seed):
    rows = [*texts(seed), ("en", None), (None, None), ("fr", ""), ("en", "no " * 5000), ("und", "und und"), ("und", "a b c. " * 12), *[("en", "same old text here")] * 15]
    got = phrases.collocations(spread(spark, rows), share=share)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_border_failures_lead_to_further_passes(spark):
    """A sample of nearly nothing proposes nearly nothing: words fail first, then their pairs, then the triples are counted."""
    rows, passes = [("en", f"alpha beta gamma{i % 3} delta") for i in range(90)], []
    docs = spark.createDataFrame(rows, "lang string, text string").select("lang", phrases.F.col("text").cast("binary").alias("text"))
    found = phrases.frequent(docs, 4, 10, share=0.0, passes=passes)
    got = {(r.phrase, r.f) for r in found.where("words > 0").collect()}
    assert passes[0] > 0 and passes[1] > 0 and passes[-1] == 0 and len(passes) == 4
    assert ("alpha beta gamma1 delta", 30) in got and ("beta", 90) in got and len(got) == 1 + 1 + 3 + 1 + 1 + 3 + 3 + 3 + 3 + 3
    assert found.where("words > 0").count() == len(got), "no phrase is counted twice"


def test_flushes_and_parameters(spark, monkeypatch):
    rows = texts(7, 120)
    monkeypatch.setattr(phrases, "GATHER", 50)
    monkeypatch.setattr(phrases, "RUN", 200)
    batch = phrases.pa.RecordBatch.from_arrays([phrases.pa.array([lang or "und" for lang, _ in rows]), phrases.pa.array([(t or "").encode() for _, t in rows])], names=["lang", "text"])
    assert len(list(phrases._gathered(iter([batch])))) > 5
    for most, least, top, inside in [(2, 3, 5, 50), (4, 5, 2000, 100)]:
        got = phrases.collocations(spread(spark, rows), most, least, top, inside)
        assert sorted(map(tuple, got.collect())) == brute(rows, most, least, top, inside)


def test_hashes_of_words_do_not_depend_on_their_place():
    rng = random.Random(9)
    words = [bytes(rng.choices(range(97, 123), k=k)) for k in [1, 2, 3, 3, 9, 254, 255, 256, 300, 5000] * 2] + ["É".encode(), b"a", b"a"]
    whole = phrases.hashed("x", [b" ".join(words), b"a"])
    alone = [phrases.hashed("x", [w])[0][0] for w in [*words, b"a"]]
    assert whole[0].tolist() == alone and len(set(alone)) == len({*words})
    assert whole[1].tolist() == [True] * (len(words) - 1) + [False, False]
    assert phrases.hashed("y", [b"a"])[0][0] != alone[-1] and not len(phrases.hashed("x", [b"", b" . "])[0])


def test_empty(spark):
    assert phrases.collocations(spread(spark, [("en", "a b")]).limit(0)).count() == 0
    assert phrases.collocations(spread(spark, [("en", "a b"), ("en", "")])).count() == 0


def test_large_products(spark):
    big = 3 * 10**14
    found = spark.createDataFrame([("x", "", 0, 10**15), ("x", "a", 1, big), ("x", "b", 1, big), ("x", "a b", 2, big - 1)], phrases.COUNTED)
    (r,) = phrases.scored(found, 3, 50).collect()
    assert r.score == 1000000 * (big - 1) ** 2 // big**2 and r.n == 10**15


def test_sql(spark, tmp_path):
    rows = texts(11, 400)
    spread(spark, rows).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(sql.PHRASES).fetchall()) == brute(rows)

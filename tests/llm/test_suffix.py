import hashlib
import random
from collections import Counter

import pytest
from mailfunnel.llm import suffix


def brute(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(90) for _ in range(4)]
    rows = [(None, None), (1, ""), (2, "short"), (3, "a" * 500), (4, "ab" * 150), (5, text(30)), (5, text(60)), (7, shared[0]), (8, shared[0]), (9, shared[0])]
    rows += [(10, "x" * 201 + text(20)), (11, "q" + "x" * 200), (12, text(40))] * 2
    for i in range(60):
        parts = [text(rng.randint(0, 60)) for _ in range(3)]
        s = rng.choice(shared)
        a = rng.randint(0, len(s) // 2)
        parts[1] = s[a : a + rng.randint(150, 420)]
        rows.append((100 + i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("most", [20_000, 2])
def test_as_brute_force(spark, most):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as k", "'x' as h", "1 as copies").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_bytes(df, most=most).collect())
    assert got == brute(rows, 200)


def test_empty_table(spark):
    assert suffix.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_difference_cover():
    v, line = suffix.difference_cover()
    assert (v, len(line)) == (133, 12)
    assert sorted((i - j) % v for i in line for j in line if i != j) == list(range(1, v))


@pytest.mark.parametrize(("stretch", "rounds"), [(700, 3), (5000, 1)])
def test_stretches_and_rounds(spark, stretch, rounds):
    """Short stretches: texts longer than one, ties within and between them, strings over their edges."""
    rows = made() + [(500, "x" * 199 + "".join(chr(97 + i * i % 23 % 7) for i in range(4000))), (501, "b" * 1500 + "é" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix.repeated_bytes(df, stretch=stretch, rounds=rounds, keep_text=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute(rows, 200)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_a_text_in_a_third_of_all_rows(spark):
    rows = [(i, "one common text " * 20 if i % 3 == 0 else f"{i} " + "again " * 60 + str(i)) for i in range(600)]
    found = suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute(rows, 200)


def test_ties_go_back_by_parts_of_many_chunks(spark, monkeypatch):
    """Not a row for each chunk and bucket: all chunks hold the same passage and its neighbours."""
    rng, rows, real = random.Random(6), [], suffix._bitmaps
    shared = " ".join(str(rng.random()) for _ in range(60))
    texts = [(i, f"{i} {shared} {i * i}") for i in range(160)]
    monkeypatch.setattr(suffix, "_bitmaps", lambda places: rows.append(places.count()) or real(places))
    found = suffix.repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), stretch=1500, rounds=2).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute(texts, 200)
    assert len(rows) == 3 and max(rows) <= 8 * 160 / 10  # 8 buckets, 160 chunks


def test_unfit_length(spark):
    with pytest.raises(ValueError):
        suffix.repeated_bytes(spark.createDataFrame([], "doc_id long, text string"), length=100)

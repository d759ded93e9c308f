import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from mailfunnel.llm import bytebpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
WANT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "  \t ", "Hello, World! it's 12 o'clock", "a\n b \n\n  c\t d  \n", "<|endoftext|> x<|endoftext|>", "日本語 テキスト 👍🏽 ﷽", "Größe ΑΣ é ́x", "wort " * 3000, "x" * 5001, "ab" * 3000 + " " * 999 + "\n", "banana " * 9 + "  　x \x1c y \u0085", "Hello, World! it's 12 o'clock", "e" * 7 + " " + "é" * 7]


@pytest.fixture(scope="module")
def own():
    return bytebpe.Codec(PATH, public_tokenizers.PATTERN, most=50)


def same(own, text):
    (ids,) = own.encode([text])
    assert ids.tolist() == WANT.encode_ordinary(text), repr(text)
    data = own.decode(ids)
    assert data == text.encode()
    assert "".join(own.pieces(ids, data)) == text
    starts, ends = own.offsets(ids, data)
    at = 0
    for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist()):
        token = WANT.decode_single_token_bytes(i)
        first, last = len(data[: at + 1].decode("utf-8", "ignore")), len(data[: at + len(token)].decode("utf-8", "ignore"))
        whole = data[:at].decode("utf-8", "ignore")
        assert a == len(whole) and token in text[a:b].encode() and b in (last, last + 1) and first >= a
        at += len(token)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("abcdeE '.,12\n\t\r 　\x1c\u0085é日👍ßs-") + ["the", " and", "ana", "'ll", "    ", "\n\n", "000"]), max_size=40).map("".join))
def test_as_ranks(own, text):
    same(own, text)


def test_repeats(own):
    rng = random.Random(5)
    for _ in range(300):
        same(own, "".join(rng.choices(["a", "aa", "b", "ab", " ", "  ", "-", "=", "\n", "0"], k=rng.randint(1, 60))))
    same(own, "q" * 100_000)


def test_all_texts(own):
    for text in TEXTS:
        same(own, text or "")


def test_other_pattern_and_unmatched_text():
    other = bytebpe.Codec(PATH, r"\p{L}+|\s")
    want = tiktoken.Encoding("other", pat_str=r"\p{L}+|\s", mergeable_ranks=RANKS, special_tokens={})
    for text in ("ab 12 cd.", "12", "", "a  b"):
        assert other.encode([text])[0].tolist() == want.encode_ordinary(text)


def test_split_character(own):
    ids = own.encode(["👍"])[0]
    assert len(ids) > 1 and own.pieces(ids, own.decode(ids)) == [""] * (len(ids) - 1) + ["👍"]
    assert own.decode(ids[:1]).decode("utf-8", "replace") == "�" and own.pieces(ids[:1], own.decode(ids[:1])) == ["�"]
    assert [x.tolist() for x in own.offsets(ids, "👍".encode())] == [[0] * len(ids), [1] * len(ids)]


def test_library_alone_may_differ(own):
    """Why repeated runs go by rank: the library takes another cut of the same token first."""
    assert bytebpe.may_differ(b"banana") and not bytebpe.may_differ(b"abcd") and bytebpe.may_differ(b"aaaa") and not bytebpe.may_differ(b"aaa")
    even = [w for w in (bytes(random.Random(i).choices(b"abcdefgh ", k=9)) for i in range(3000)) if not bytebpe.may_differ(w)]
    for w, e in zip(even, own.library.encode_batch_fast([w.decode() for w in even], add_special_tokens=False)):
        assert e.ids == WANT.encode_ordinary(w.decode())


def test_frames(spark):
    rows = [(None if i == 3 else i % 9, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as n_tokens", "2 as starts")
    want = []
    for d, t in rows:
        ids = np.array(WANT.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((str(d), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bytebpe.round_trip(df, PATH)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    tokens = bytebpe.encoded(df, PATH)
    back = bytebpe.decoded(tokens, PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t in rows)
    assert all("".join(r.pieces) == r.text and bytes(r.data) == r.text.encode() for r in back)
    for r in tokens.collect():
        assert len(r.ids) == len(r.starts) == len(r.ends)
    named = bytebpe.round_trip(spark.createDataFrame([("a", b"\xffx")], "key string, body binary"), PATH, id_col="key", text_col="body").first()
    assert named.key == "a" and named.decoded_sha256 == hashlib.sha256("�x".encode()).hexdigest()
    assert bytebpe.round_trip(df.limit(0), PATH).count() == 0 == bytebpe.decoded(tokens.limit(0), PATH).count()

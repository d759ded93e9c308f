import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from mailfunnel.llm import tokenfiles
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  \t", "Hello, World! it's 12 o'clock", "a b c \x0b\x0c d", "Größe ΑΣ ΑΣ. é ́x", "<|endoftext|> x<|startoftext|>y < |endoftext|>", "wort " * 5000, "\x1cfoo\x1dbar\u0085baz", "日本語 テキスト 👍🏽", "Hello, World! it's 12 o'clock"]


def test_ids_are_those_of_whole_texts():
    t, e = Tokenizer.from_file(PATH), tokenfiles.Encoder(PATH, 2, most=10)
    for text in TEXTS:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(e([(text or "").encode()])[0], "<u4").tolist() == want


def test_ids_of_random_pieces():
    t, e = Tokenizer.from_file(PATH), tokenfiles.Encoder(PATH, None, most=50)
    assert e.known.cuts
    rng = random.Random(3)
    parts = [*"abchst'.,!<>|_-09AHIS", "'s", "'LL", "don't", "\u0331", "\u0307", "é", "É", "ß", "Σ", "ς", "…", "—", "日", "\u00a0", "\x00", "👍", "<|endoftext|>", "²", "word", "xqzt", "\u2028"]
    for _ in range(3000):
        text = " ".join("".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(rng.randint(1, 4)))
        assert np.frombuffer(e([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(spark):
    rows = [(None if i == 3 else i % 9, x) for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as h", "2 as start")
    manifest = tokenfiles.written(df, PATH, file_bytes=40)
    got = sorted(tokenfiles.read_back(manifest).collect(), key=lambda r: r.start)
    t, at = Tokenizer.from_file(PATH), 0
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    want = sorted((str(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ((d, [*t.encode(x or "").ids, 2]) for d, x in rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens
    some = {r.doc_id: list(r.ids) for r in tokenfiles.fetched(manifest, spark.createDataFrame([(5,), (7,), (99,)], "doc_id long")).collect()}
    assert some == {d: [*t.encode(x or "").ids, 2] for d, x in rows if d in (5, 7)}


def test_broken_frame_is_noticed():
    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    w = tokenfiles.Writer(out)
    for i in range(3):
        w.add(i, np.arange(50 + i, dtype="<u4").tobytes())
    w.close()
    data = bytearray(out.getvalue())
    read = lambda d: tokenfiles.Reader(pa.BufferReader(bytes(d)))
    assert np.frombuffer(read(data).read(1), "<u4").tolist() == list(range(51))
    data[int(read(data).starts[1]) + 20] ^= 1
    read(data).read(0)
    with pytest.raises(Exception):
        read(data).read(1)


def test_empty_table(spark):
    assert tokenfiles.read_back(tokenfiles.written(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0


def test_letters_are_turned_into_bytes_once(monkeypatch):
    from tokenizers import pre_tokenizers

    asked = []

    class Counted:
        def __init__(self, **kinds):
            self.own = real(**kinds)

        def pre_tokenize_str(self, text):
            asked.append(text)
            return self.own.pre_tokenize_str(text)

    real = pre_tokenizers.ByteLevel
    monkeypatch.setattr(pre_tokenizers, "ByteLevel", Counted)
    t, e = Tokenizer.from_file(PATH), tokenfiles.Encoder(PATH, None)
    rng, before = random.Random(4), len(asked)
    letters = [chr(i) for i in range(97, 0x250) if chr(i).isalpha()]
    for _ in range(2000):
        text = "".join(rng.choices(letters if rng.random() < 0.5 else letters[:26], k=rng.randint(1, 9)))
        assert np.frombuffer(e([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert len(asked) == before

"""Byte-level BPE encoding and decoding over Arrow batches (operator 11).

A rank file (a token's bytes in base64 and its rank on each line) becomes a model of the tokenizers library: bytes are
spelt by the usual 256 printable characters, and each token gets all its cuts into two tokens as merges, in order of rank.
Ids are those that merging by ranks alone gives. The two ways can differ only where a piece holds a token of three bytes
or more twice, for only then do two cuts of one token compete: pieces without a repeated run of three bytes go to the
tokenizers library, the few others to a merge by ranks.

Texts: null counts as empty, invalid UTF-8 as U+FFFD, of any length; special tokens' strings are ordinary text. Rows keep
their number: repeated ids or texts give repeated rows, null ids stay null, an empty table gives an empty result. Only
the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import kept, steps, text_bytes, tidied

#: A space that stands in the midst or at the end of white space: no place to cut.
INSIDE = re.compile(r"\s (?:\s|\Z)")
CUT = re.compile(r"(?<!\s)(?= )|(?= \S)")
_L, _P = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", r"[!-/:-@\[-`{-~]"
#: A word with the punctuation after it, and perhaps a line's first word with its own: the public pattern always ends a match between these.
WORDS = re.compile(rf"( ?{_L}+)({_P}*)(?:(\n)({_L}+)({_P}*))?")
#: Bytes of text that a task encodes at a time.
RUN = 2 << 20


def byte_chars() -> list[str]:
    """The character that spells each byte: a visible Latin-1 one itself, any other byte the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no token for the bytes {missing[:5]}")
    return ranks


def may_differ(cell: bytes) -> bool:
    """Whether a run of three bytes repeats."""
    return len(cell) > 3 and len(set(zip(cell, cell[1:], cell[2:]))) < len(cell) - 2


class Codec:
    """Texts to ids and back. ``most``: distinct cells that are remembered.

    With the public pattern a match never runs past a space before a word, so a text is cut there into cells that can be
    encoded one by one and remembered; with any other pattern a text is one cell.
    """

    def __init__(self, path: str, pattern: str, most: int = 500_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks, spelt = read_ranks(path), byte_chars()
        spell = {token: "".join(spelt[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(spell[a], spell[b]) for a, b in sorted(cuts, key=lambda c: (ranks[c[0]], ranks[c[1]]))]
        vocab = {spell[token]: rank for token, rank in ranks.items()}
        self.library = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        # only what the pattern matches is text, each match by itself
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.by_rank = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cuts, self.most = pattern == public_tokenizers.PATTERN, most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

        self.spelt = dict(enumerate(spelt))
        byte_of = {c: b for b, c in enumerate(spelt)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for word, i in vocab.items():
            tokens[i] = bytes(map(byte_of.__getitem__, word))
        self.tokens = pa.array(tokens, pa.binary())
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))

    def cells(self, text: str) -> list[str]:
        if not self.cuts:
            return [text] if text else []
        if INSIDE.search(text):
            return CUT.split(text)
        head, *rest = text.split(" ")
        return [head, *[f" {c}" for c in rest]]

    def _learn(self, cells: set[str]) -> None:
        """All cells are known after this. Two generations are kept, so that frequent cells stay."""
        if len(self.known) > self.most // 2:
            self.known, self.older = {}, self.known
        new, cut = set(), {}
        for c in cells.difference(self.known):
            if (ids := self.older.get(c)) is not None:
                self.known[c] = ids
            elif self.cuts and (m := WORDS.fullmatch(c)) and len(parts := [g for g in m.groups() if g]) > 1:
                cut[c] = parts
                new.update(parts)
            else:
                new.add(c)
        new.difference_update(self.known)
        odd = [c for c in new if may_differ(c.encode())]
        even = new.difference(odd)
        words = [c for c in even if self.cuts and (m := WORDS.fullmatch(c)) and not m[2] and not m[3]]  # one match of the pattern each: no need to look for it
        for c in words:
            self.known[c] = array("I", [t.id for t in self.library.model.tokenize(c.encode().decode("latin-1").translate(self.spelt))]).tobytes()
        even = list(even.difference(words))
        for c, found in zip(even, self.library.encode_batch_fast(even, add_special_tokens=False)):
            self.known[c] = array("I", found.ids).tobytes()
        for c in odd:
            self.known[c] = array("I", self.by_rank.encode_ordinary(c)).tobytes()
        for c, parts in cut.items():
            self.known[c] = b"".join(map(self.known.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        cut = [self.cells(t) for t in texts]
        self._learn(set(itertools.chain.from_iterable(cut)))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, cells)), "<u4") for cells in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, one after the other. An id that the vocabulary lacks is an error."""
        out = self.tokens.take(pa.array(ids, pa.uint32()))
        return out.buffers()[2].to_pybytes()[: int(self.lengths[ids].sum())] if len(ids) else b""

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last for each token; tokens that split a character all span the whole of it."""
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        opened = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        return opened[np.minimum(begins + 1, ends)] - 1, opened[ends]

    def pieces(self, ids: np.ndarray, data: bytes) -> list[str]:
        """The text that each token brings to its end: a character split over tokens comes with the last of them. Bytes that make no character: each token by itself."""
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return [t.decode("utf-8", "replace") for t in self.tokens.take(pa.array(ids, pa.uint32())).to_pylist()]
        last = np.ones(len(data), bool)  # the last byte of its character
        last[:-1] = (np.frombuffer(data, np.uint8)[1:] & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(last)])[np.concatenate([[0], np.cumsum(self.lengths[ids])])]
        return [text[a:b] for a, b in itertools.pairwise(at.tolist())]


def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker, so that what it remembers serves later tasks too."""
    return kept(("bytebpe", path, pattern), lambda: Codec(path, pattern))


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _typed(df: DataFrame, col: str) -> str:
    return f"`{col}` {df.schema[col].dataType.simpleString()}"


def encoded(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, starts, ends``: token ids with their characters' offsets (from 0, end exclusive)."""
    pattern = pattern or public_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for part in _runs(batches):
            texts = [t.decode("utf-8", "replace") for t in part.column(1).to_pylist()]
            ids = of.encode(texts)
            spans = [of.offsets(i, t.encode()) for i, t in zip(ids, texts)]
            lists = [ids, [s for s, _ in spans], [e for _, e in spans]]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x.astype(np.int32) for x in col], pa.list_(pa.int32())) for col in lists]], names=[id_col, "ids", "starts", "ends"])

    return docs.select(id_col, text_bytes(text_col)).mapInArrow(tidied(run), f"{_typed(docs, id_col)}, ids array<int>, starts array<int>, ends array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, data, text, pieces``: bytes and text of token ids, and the text that each token completes. Null ids count as none; bytes that make no character are U+FFFD in ``text``."""
    pattern = pattern or public_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for b in batches:
            ids = [np.array(x or [], np.uint32) for x in b.column(1).to_pylist()]
            data = [of.decode(i) for i in ids]
            text = [d.decode("utf-8", "replace") for d in data]
            bits = [of.pieces(i, d) for i, d in zip(ids, data)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), pa.array(text, pa.string()), pa.array(bits, pa.list_(pa.string()))], names=[id_col, "data", "text", "pieces"])

    return tokens.select(id_col, ids_col).mapInArrow(tidied(run), f"{_typed(tokens, id_col)}, data binary, text string, pieces array<string>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose second column holds at most RUN bytes, one row at least."""
    for b in batches:
        sizes = pc.binary_length(b.column(1)).to_pylist()
        for low, high in steps(sizes, RUN):
            yield b.slice(low, high - low)


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256, n_bytes``: every text encoded, its ids decoded; digests of the ids (little-endian unsigned 32-bit) and of the decoded bytes."""
    pattern = pattern or public_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for part in _runs(batches):
            rows = []
            for ids in of.encode([t.decode("utf-8", "replace") for t in part.column(1).to_pylist()]):
                back = of.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))]], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return docs.select(id_col, text_bytes(text_col)).mapInArrow(tidied(run), f"{_typed(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")

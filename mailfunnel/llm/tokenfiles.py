"""Token ids in seekable zstandard files (operator 3).

Layout of a file: one independent zstandard frame per document (its ids as little-endian unsigned 32-bit integers, with
the frame's own checksum), then a skippable frame with the documents' ids, then a skippable frame with the seek table:
for each document compressed size, decompressed size and the low 32 bits of the XXH64 of its ids. A reader takes the two
tables from the end of the file and decompresses only the frames it wants.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, new_path, partitions, staged, text_bytes, tidied

# Fixed values of the public seekable zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = 0x184D2A50
# Fixed values of the public tokenizer: its normalizer and its rule for cutting texts; and ASCII punctuation but for "<".
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PUNCTUATION = b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
MANIFEST = "file string, part int, seq int, n_docs long, n_tokens long, first_id long, last_id long"


def _latin(text: bytes | str) -> bool:
    """Only Latin letters, and at least one."""
    return text.isalpha() and max(text) < (128 if isinstance(text, bytes) else "\u0250")


class Pieces(dict):
    """Ids of pieces between white space, as bytes, remembered in two generations of up to ``most`` / 2, so that frequent ones
    stay. A missing piece is cut where the tokenizer is known to cut it (letters from the punctuation after them), and what is left goes to the library."""

    def __init__(self, tokenizer, most: int):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer, self.most, bytewise = tokenizer, most, ByteLevel(add_prefix_space=False, use_regex=False)
        made = json.loads(tokenizer.to_str())
        marked = all("<" in t["content"] for t in made["added_tokens"])
        # rules of the public tokenizer that the cuts rest on; with any other each piece goes to the library whole
        self.cuts = marked and made["normalizer"] == NORMALIZER and (made["pre_tokenizer"] or {}).get("pretokenizers") == [SPLIT, BYTES]
        # what the library makes of each Latin letter's bytes, asked once; ASCII letters stay as they are
        self.letters = {i: bytewise.pre_tokenize_str(chr(i))[0][0] for i in range(128, 0x250) if chr(i).isalpha()}

    def __missing__(self, piece: bytes) -> bytes:
        if (ids := self.older.get(piece)) is None:
            if self.cuts and piece.isalpha() and piece.islower():  # bytes: ASCII only
                ids = self._merged(piece.decode())
            elif not self.cuts or b"<" in piece:
                ids = self._encoded(piece)
            elif piece.isascii() and piece.lower() != piece:
                ids = self[piece.lower()]
            elif (head := piece.rstrip(PUNCTUATION)) != piece and _latin(head[-1:] if head[-1:].isascii() else head.decode("utf-8", "replace")[-1:]):
                ids = self[head] + self[piece[len(head) :]]
            elif _latin(text := piece.decode("utf-8", "replace")) and text.lower() == text and unicodedata.is_normalized("NFC", text):
                ids = self._merged(text.translate(self.letters))
            else:
                ids = self._encoded(piece)
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _merged(self, text: str) -> bytes:
        got = self.tokenizer.model.tokenize(text)
        return struct.pack(f"<{len(got)}I", *[t.id for t in got])

    def _encoded(self, piece: bytes) -> bytes:
        ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Whole texts to ids. White space always separates tokens of such a vocabulary, so each distinct piece between
    white space is encoded once and remembered; ids are those of the whole text."""

    def __init__(self, path: str, end: int | None, most: int = 500_000):
        from tokenizers import Tokenizer

        self.known = Pieces(Tokenizer.from_file(path), most)
        self.end = b"" if end is None else np.array([end], "<u4").tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        get, cuts = self.known.__getitem__, self.known.cuts
        # lower-cased first where that is the same: fewer distinct pieces
        return [b"".join(map(get, (t.lower() if cuts and t.isascii() and b"<" not in t else t).split())) + self.end for t in texts]


def encoder(path: str, end: int | None) -> Encoder:
    """One for each Python worker, so that what it remembers serves later tasks too."""
    return kept((path, end), lambda: Encoder(path, end))


class Writer:
    """Writes one file of documents in the order given."""

    def __init__(self, stream, level: int = 3):
        self.out, self.entries, self.ids = stream, [], []
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.bytes += len(frame)

    def close(self) -> None:
        index = zlib.compress(json.dumps(self.ids).encode())
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Reads the tables at the end of a file, then single documents on demand; every read is checked."""

    def __init__(self, stream):
        self.file, size = stream, stream.size()
        n, flags, magic = struct.unpack("<IBI", stream.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        table = stream.read_at(12 * n, size - 9 - 12 * n)
        self.sizes, self.lengths, self.sums = np.frombuffer(table, "<u4").reshape(-1, 3).T.astype(np.int64) if n else np.zeros((3, 0), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        low, high = int(self.starts[-1]), size - 9 - 12 * n - 8
        magic, length = struct.unpack("<II", stream.read_at(8, low))
        if magic != INDEX or low + 8 + length != high:
            raise ValueError("no index of documents")
        self.ids = json.loads(zlib.decompress(stream.read_at(length, low + 8)))
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def read(self, i: int) -> bytes:
        """The ids of the i-th document, decompressing its frame only."""
        ids = self.unpacker.decompress(self.file.read_at(int(self.sizes[i]), int(self.starts[i])), max_output_size=int(self.lengths[i]))
        if len(ids) != self.lengths[i] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"checksum of document {i}")
        return ids


def written(docs: DataFrame, tokenizer: str, end: int | None = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 128 << 20, level: int = 3) -> DataFrame:
    """Writes the files in ascending id order and returns the manifest: ``file, part, seq, n_docs, n_tokens, first_id, last_id``.

    Documents are range-partitioned by id (ties by text hash, so a repeated id does not fill one task), encoded where
    they land and written in order; a file ends beyond ``file_bytes``. A task writes under a name of its
    own attempt, so a repeated attempt never damages a file that the manifest lists. Null ids come first; null texts
    are empty and hold the end id alone.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = base.repartitionByRange(partitions(spark), F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "t").select("id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode, (fs, root) = encoder(tokenizer, end), pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done, out, tokens, name = [], None, 0, ""

        def close():
            out.close()
            known = [i for i in out.ids if i is not None]
            done.append((f"{folder}/{name}", task.partitionId(), len(done), len(out.ids), tokens, min(known, default=None), max(known, default=None)))

        for b in batches:
            for low in range(0, b.num_rows, 500):
                ids, texts = (b.column(c).slice(low, 500).to_pylist() for c in (0, 1))
                for i, data in zip(ids, encode(texts)):
                    if out is None:
                        name = f"{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}.zst"
                        out, tokens = Writer(fs.open_output_stream(f"{root}/{name}", compression=None), level), 0
                    out.add(i, data)
                    tokens += len(data) // 4
                    if out.bytes >= file_bytes:
                        close()
                        out = None
        if out is not None:
            close()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return staged(dealt.mapInArrow(tidied(run), MANIFEST), "manifest")


def read_back(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document in the manifest's files; start counts the ids of all documents before it."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("file", "base")
    spread = files.repartition(max(1, min(10_000, manifest.count())), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as stream:
                    got, rows = Reader(stream), []
                    for i in range(len(got)):
                        data = got.read(i)
                        rows.append((got.ids[i], at, len(data) // 4, zlib.crc32(data)))
                        at += len(data) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def fetched(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, ids``: the documents of ``wanted(id)`` only. Files are found by their id range, and of each only the wanted frames are read."""
    low, high, n = manifest.agg(F.coalesce(F.min("first_id"), F.lit(0)), F.coalesce(F.max("last_id"), F.lit(0)), F.count("*")).first()
    width = (high - low) // max(1, n) + 1  # ids fall into as many bins as there are files; ranges follow each other, so they touch at most twice as many
    in_bin = lambda c: F.expr(f"({c} - {low}) div {width}")
    files = manifest.where("first_id is not null").select("file", "first_id", "last_id", F.explode(F.sequence(in_bin("first_id"), in_bin("last_id"))).alias("bin"))
    need = wanted.select(F.col(id_col).cast("long").alias("w")).where(F.col("w").between(low, high)).distinct().withColumn("bin", in_bin("w"))
    by_file = files.join(need, "bin").where("w between first_id and last_id").groupBy("file").agg(F.collect_list("w").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, (fs, path) = set(ids), pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as stream:
                    got = Reader(stream)
                    rows = [(d, np.frombuffer(got.read(i), "<u4").astype(np.int64)) for i, d in enumerate(got.ids) if d in ids]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))], names=[id_col, "ids"])

    return by_file.mapInArrow(run, f"{id_col} long, ids array<long>")

"""Importance resampling towards a target distribution (operator 13).

Words and pairs of words are hashed into buckets by CRC-32. How much more often a bucket occurs in the target than in the
documents is its gain; a document's weight is the mean gain of its features. Documents are drawn without replacement by
weight plus Gumbel noise from their ids, so reruns agree.

CRCs of distinct features are computed in matrices: features of equal length (long ones: of lengths within a factor of two)
are the rows of a uint8 matrix, all CRCs advance a column at a time, and the buckets are scattered back to the features'
occurrences.

Texts: null counts as empty, of any length, read whole. A document without features weighs 0. Rows keep their number:
repeated rows are drawn each for itself and rank next to each other. A null id is hashed as ``None`` and comes after all
other ids of equal score. Without target texts all gains follow from the documents alone; an empty table gives an empty
result. Only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged, steps, text_bytes, tidied

BUCKETS = 10_000
#: Bytes of text that a task takes at a time, and length up to which features of one length alone form a matrix.
RUN, EVEN = 2 << 20, 64
#: Every byte that is no part of a word, as a space; upper case as lower case.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte: eight divisions by the reversed polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _crc_table()


def crc32s(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``flat``, in matrices of slices of one length, or of a band of lengths that shrinks as its rows end."""
    out = np.zeros(len(begin), np.uint32)
    band = np.where(size <= EVEN, size, EVEN + np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    order = np.lexsort((-size, band))
    for group in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
        width = int(size[group[0]]) if len(group) else 0
        if not width:
            continue
        for low in range(0, len(group), most := max(1, (16 << 20) // width)):
            rows = group[low : low + most]
            wide = np.arange(width)[:, None]
            columns = flat[begin[rows] + np.minimum(wide, size[rows] - 1)]  # a row of this array is a column of bytes
            ends = np.searchsorted(-size[rows], -np.arange(width), "left")  # rows longer than j come first
            crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
            for j, n in enumerate(ends.tolist()):
                live = crc[:n]
                np.bitwise_xor(TABLE.take(live.astype(np.uint8) ^ columns[j, :n]), live >> np.uint32(8), out=live)
            out[rows] = ~crc
    return out


class _Ids(dict):
    """Words numbered in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; the text of each feature, and its bucket. Distinct features are hashed once, from where they first stand."""
    words = [t.translate(FOLD).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    all_words = list(itertools.chain.from_iterable(words))
    flat, size = np.frombuffer(b" ".join(all_words), np.uint8), np.fromiter(map(len, all_words), np.int64, len(all_words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    ids = np.fromiter(map(_Ids().__getitem__, all_words), np.int64, len(all_words))
    once = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    once[ids[::-1]] = np.arange(len(ids))[::-1]
    owner = np.repeat(np.arange(len(texts)), counts)
    next_too = np.flatnonzero(owner[1:] == owner[:-1])
    _, first, back = np.unique(ids[next_too] * len(once) + ids[next_too + 1], return_index=True, return_inverse=True)
    first = next_too[first]
    crc = crc32s(flat, np.concatenate([begin[once], begin[first]]), np.concatenate([size[once], end[first + 1] - begin[first]]))
    bucket = (crc % BUCKETS).astype(np.int64)
    return counts, np.concatenate([owner, owner[next_too]]), np.concatenate([bucket[ids], bucket[len(once) + back]])


def _runs(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low, high in steps(pc.binary_length(b.column(col)).to_pylist(), RUN):
            yield b.slice(low, high - low)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket: a fixed number of counts, summed per task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in _runs(batches, 0):
            total += np.bincount(features(part.column(0).to_pylist())[2], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = docs.select(text_bytes(text_col)).mapInArrow(tidied(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    all_s, all_t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return [math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source.tolist(), target.tolist())]


def noise(doc_id, seed: int) -> int:
    """Gumbel noise of an id in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: list[int], seed: int, id_col: str, text_col: str) -> DataFrame:
    """``id, _words, n_features, weight, score`` of every document."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, 1):
            words, owner, bucket = features(part.column(1).to_pylist())
            n = np.bincount(owner, minlength=len(words))
            total = np.zeros(len(words), np.int64)
            np.add.at(total, owner, table[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = weight + np.fromiter((noise(d, seed) for d in part.column(0).to_pylist()), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (words, n, weight, score))], names=[id_col, "_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_bytes(text_col)).mapInArrow(tidied(run), f"`{id_col}` {kind}, _words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` from 1 over all of them: dealt out by range and sorted, so no task sees more than its range; offsets are a row a range."""
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # partition above bit 33, place in it below
    placed = staged(dealt.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), "_part").withColumn("rank", F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_features, weight, score, rank``: every document; ``rank`` 1, 2, 3... for the drawn ones, null for the others.

    ``percent`` of the documents with ``least_words`` or more are drawn: the highest scores, ties to smaller ids.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    rows = staged(weighed(docs, gain, seed, id_col, text_col), "weighed")
    enough = F.col("_words") >= least_words
    drawn = percent * rows.where(enough).count() // 100
    placed = ranked(rows.where(enough), [F.desc("score"), F.asc_nulls_last(id_col)])
    out = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))).drop("_words")

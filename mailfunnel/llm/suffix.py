"""Removal of repeated byte strings: difference-cover sample, then one bucket of suffixes at a time (operator 10).

Positions whose remainder modulo v lies in a difference cover are sampled: for any two positions there is one offset
below v at which both are sampled. With ``gram = length - v + 1``, two equal strings of ``length`` bytes therefore hold
an equal sampled gram at the same offset. Texts are packed into chunks of about a megabyte, and

1. the cover's grams are ranked bucket by bucket; a suffix with no repeated gram at any of its cover positions ties
   with no other suffix over ``length`` bytes and is out;
2. the suffixes that are left are sorted one bucket at a time, ``rounds`` rounds after each other, so that a round
   moves and holds only its share of them; a suffix is known by the name of its first ``length`` bytes;
3. suffixes that tie with a neighbour cover the bytes to remove.

Grams and suffixes that a stretch of text repeats within itself are told apart there, and one of them goes on: so a
bucket holds a string at most once a stretch, however often it stands in the corpus. Work inside a chunk goes by
stretches of bounded size, also in one very long text. Suffixes are named by 96 bits of hashes and
their bucket: results are exact but for collisions. Grams have 32 bits and their bucket: two that share a name by chance
only let suffixes into step 2 that tie with none there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, partitions, staged, text_bytes

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SALTS = 8
_HELD = 1_000_000
_PART = 16


@lru_cache(1)
def difference_cover(q: int = 11) -> tuple[int, tuple[int, ...]]:
    """A perfect difference set of q + 1 residues modulo v = q * q + q + 1, for a prime q: (v, residues).

    Points of the projective plane over q elements are the powers of a cube root ``x`` of ``a x x + b x + c``; those
    on one line make the set (Singer).
    """
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        point, line = (1, 0, 0), []
        for i in range(v):
            if not point[2]:
                line.append(i)
            low, mid, top = point
            point = (top * c % q, (low + top * b) % q, (mid + top * a) % q)
        if len({(i - j) % v for i in line for j in line}) == v and len(line) == q + 1:
            return v, tuple(line)
    raise ValueError(f"no difference set for {q}")


@lru_cache(4)
def _powers(size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i up to size."""
    out = []
    for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        p = np.full(size + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _names(data: np.ndarray, at: np.ndarray, width: int, which: int, stretch: int) -> np.ndarray:
    """Names of the strings of ``width`` bytes at the places ``at`` of a stretch."""
    up, down = _powers(stretch + 1024, which)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix64((total[at + width] - total[at]) * down[at])


def _inside(at: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Those places from which ``width`` bytes lie in one text."""
    return at[at + width <= ends[np.searchsorted(ends, at, side="right")]]


def _ties(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by name; which of that order equal their predecessor; which equal any neighbour."""
    order = np.argsort(one, kind="stable")
    one, two = one[order], two[order]
    again = np.zeros(len(one), bool)
    again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1]).all(axis=1)
    tied = again.copy()
    tied[:-1] |= again[1:]
    return order, again, tied


def _dealt(stretches: Iterator[tuple], buckets: int) -> Iterator[tuple]:
    """Stretches (c, at, one, two) -> rows (bucket, cs, counts, at, one, two): ties within a stretch, without names, and one
    string of each name by bucket. Rows hold what many stretches have for a bucket, so their number does not grow with
    chunks times buckets. The bucket holds the upper half of ``one``, the row the lower.
    """
    held, size = [], 0

    def rows() -> Iterator[tuple]:
        c = np.repeat([x[0] for x in held], [len(x[1]) for x in held])
        at, one, two = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        bucket = ((one >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        bucket, c, at, one, two = bucket[order], c[order], at[order], one[order].astype(np.uint32), two[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = c[low:high]
            turn = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [high - low]])
            yield int(bucket[low]), own[turn[:-1]].tobytes(), np.diff(turn).astype(np.int32).tobytes(), at[low:high].tobytes(), one[low:high].tobytes(), two[low:high].tobytes()

    for c, at, one, two in stretches:
        order, again, tied = _ties(one, two)
        if tied.any():
            own = np.sort(at[order[tied]])
            yield c % buckets, np.int64(c).tobytes(), np.int32(len(own)).tobytes(), own.tobytes(), b"", b""
        order = order[~again]
        if len(order):
            held.append((c, at[order], one[order], two[order]))
            size += len(order)
        if size > _HELD:
            yield from rows()
            held, size = [], 0
    if held:
        yield from rows()


def _batches(rows: Iterator[tuple], fields: list, most: int = 5000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``most`` rows and about 8 MB."""
    names, kinds = zip(*fields)

    def batch(got):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names=list(names))

    got, size = [], 0
    for row in rows:
        got.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(got) >= most or size > 8_000_000:
            yield batch(got)
            got, size = [], 0
    if got:
        yield batch(got)


def _chunked(texts: DataFrame, most: int, stretch: int) -> DataFrame:
    """``(k, t)`` -> chunks ``(c, ks, ends, data)`` of at most ``most`` whole texts and ``stretch`` bytes (a longer text is one alone)."""
    fields = [("c", pa.int64()), ("ks", pa.binary()), ("ends", pa.binary()), ("data", pa.binary())]

    def rows(batches):
        number, ks, own, size = TaskContext.get().partitionId() << 32, [], [], 0

        def chunk():
            return number, np.array(ks, np.int64).tobytes(), np.cumsum([len(t) for t in own]).astype(np.int64).tobytes(), b"".join(own)

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if own and (size + len(t) > stretch or len(own) >= most):
                    yield chunk()
                    number, ks, own, size = number + 1, [], [], 0
                ks.append(k)
                own.append(t)
                size += len(t)
        if own:
            yield chunk()

    return texts.mapInArrow(lambda batches: _batches(rows(batches), fields), "c long, ks binary, ends binary, data binary")


_DEALT = [("bucket", pa.int32()), *((name, pa.binary()) for name in ("cs", "counts", "at", "one", "two"))]
_DEALT_SQL = "bucket int, cs binary, counts binary, at binary, one binary, two binary"


def _cover_grams(chunks: DataFrame, length: int, gram: int, buckets: int, stretch: int) -> DataFrame:
    """The names of the grams at cover positions, dealt into buckets."""
    v, line = difference_cover()

    def rows(batches):
        for b in batches:
            for c, ends, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                ends, data = np.frombuffer(ends, np.int64), np.frombuffer(data, np.uint8)
                for low in range(0, len(data), stretch):
                    high = min(len(data), low + stretch)
                    base = np.arange(low - low % v, high, v)
                    at = (base[:, None] + np.array(line)).ravel()
                    at = _inside(at[(at >= low) & (at < high)], ends, gram)
                    one = _names(data[low : high + length], at - low, gram, 0, stretch)
                    yield c, at.astype(np.int32), one, np.zeros((len(one), 0), np.uint64)

    return chunks.select("c", "ends", "data").mapInArrow(lambda batches: _batches(_dealt(rows(batches), buckets), _DEALT), _DEALT_SQL)


def _suffixes(marked: DataFrame, length: int, gram: int, buckets: int, rounds: int, this: int, stretch: int) -> DataFrame:
    """The names of this round's share of the suffixes that hold a repeated cover gram, dealt into buckets."""
    left = length - gram

    def rows(batches):
        for b in batches:
            for c, ends, data, marks in zip(*(b.column(i).to_pylist() for i in range(4))):
                ends, data, marks = np.frombuffer(ends, np.int64), np.frombuffer(data, np.uint8), np.frombuffer(marks, np.int32)
                for low in range(0, len(data), stretch):
                    high = min(len(data), low + stretch)
                    near = marks[np.searchsorted(marks, low) : np.searchsorted(marks, high + left)]
                    turn = np.bincount(np.maximum(near - left, low) - low, minlength=high - low + 1)[: high - low + 1]
                    turn -= np.bincount(np.minimum(near + 1, high) - low, minlength=high - low + 1)
                    at = _inside(np.flatnonzero(np.cumsum(turn[:-1])) + low, ends, length)
                    one = _names(data[low : high + length], at - low, length, 0, stretch)
                    own = one % np.uint64(rounds) == np.uint64(this)
                    at, one = at[own], one[own]
                    two = _names(data[low : high + length], at - low, length, 1, stretch)
                    yield c, at.astype(np.int32), one, two[:, None]

    return marked.select("c", "ends", "data", "marks").mapInArrow(lambda batches: _batches(_dealt(rows(batches), buckets), _DEALT), _DEALT_SQL)


_TIED = [("part", pa.int32()), ("cs", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())]


def _by_part(found: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[tuple]:
    """Places (c, at) -> rows (part, cs, counts, at): what a task's buckets have for all the chunks of a part, about ``_PART``,
    so that there are not as many rows as chunks times buckets."""
    held, size = [], 0

    def rows() -> Iterator[tuple]:
        c, at = (np.concatenate([x[i] for x in held]) for i in range(2))
        part = (mix64(c.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((c, part))
        part, c, at = part[order], c[order], at[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = c[low:high]
            turn = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [high - low]])
            yield int(part[low]), own[turn[:-1]].tobytes(), np.diff(turn).astype(np.int32).tobytes(), at[low:high].tobytes()

    for c, at in found:
        held.append((c, at))
        size += len(c)
        if size > _HELD:
            yield from rows()
            held, size = [], 0
    if size:
        yield from rows()


def _repeated(dealt: DataFrame, parts: int) -> DataFrame:
    """Dealt names -> ``(part, cs, counts, at)``: the places of names that stand at two places or more, by part of the chunks. One bucket is sorted at a time."""

    def bucket(own: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        cs, counts, at, one, two = (np.frombuffer(b"".join(r[i] for r in own), kind) for i, kind in enumerate((np.int64, np.int32, np.int32, np.uint32, np.uint64), 1))
        c, two = np.repeat(cs, counts), two.reshape(len(at), -1)
        if two.shape[1]:  # equal upper halves: sort by all that is left
            two, one = one[:, None], two[:, 0]
        order, _, tied = _ties(one, two)
        hit = order[tied]
        return c[hit], at[hit]

    def found(batches):
        own = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if not row[4]:
                    at = np.frombuffer(row[3], np.int32)
                    yield np.full(len(at), np.frombuffer(row[1], np.int64)[0]), at
                    continue
                if own and own[0][0] != row[0]:
                    yield bucket(own)
                    own = []
                own.append(row)
        if own:
            yield bucket(own)

    sorted_ = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(lambda batches: _batches(_by_part(found(batches), parts), _TIED), "part int, cs binary, counts binary, at binary")


def _bitmaps(places: DataFrame) -> DataFrame:
    """``(part, cs, counts, at)`` -> ``(c, bits)``: one row a chunk, a compressed bitmap of its places. One part is held at a time."""

    def part(own: list[tuple]) -> Iterator[tuple]:
        cs, counts, at = (np.frombuffer(b"".join(r[i] for r in own), kind) for i, kind in enumerate((np.int64, np.int32, np.int32), 1))
        order = np.argsort(cs, kind="stable")
        starts = np.cumsum(counts) - counts
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cs[order])) + 1, [len(cs)]])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            runs = [at[starts[i] : starts[i] + counts[i]] for i in order[low:high].tolist()]
            on = np.zeros(max(int(x.max()) for x in runs) + 1, bool)
            for x in runs:
                on[x] = True
            yield int(cs[order[low]]), zlib.compress(np.packbits(on).tobytes(), 1)

    def rows(batches):
        own = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if own and own[0][0] != row[0]:
                    yield from part(own)
                    own = []
                own.append(row)
        if own:
            yield from part(own)

    sorted_ = places.repartition("part").sortWithinPartitions("part")
    return sorted_.mapInArrow(lambda batches: _batches(rows(batches), [("c", pa.int64()), ("bits", pa.binary())]), "c long, bits binary")


def _places(bits: list[bytes]) -> np.ndarray:
    """Places set in any of the bitmaps, ascending."""
    maps = [np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)) for x in bits]
    on = np.zeros(max(map(len, maps), default=0), np.uint8)
    for m in maps:
        on[: len(m)] |= m
    return np.flatnonzero(on)


def _marked(chunks: DataFrame, bits: DataFrame) -> DataFrame:
    """Chunks cut down to the texts that hold repeated cover grams, with ``marks``, the places of these grams."""
    fields = [("c", pa.int64()), ("ks", pa.binary()), ("ends", pa.binary()), ("data", pa.binary()), ("marks", pa.binary())]

    def rows(batches):
        for b in batches:
            for c, ks, ends, data, found in zip(*(b.column(i).to_pylist() for i in range(5))):
                ks, ends, at = np.frombuffer(ks, np.int64), np.frombuffer(ends, np.int64), _places([found])
                starts = np.concatenate([[0], ends[:-1]])
                text = np.searchsorted(ends, at, side="right")
                used = np.unique(text)
                now = np.cumsum((ends - starts)[used])
                moved = np.zeros(len(ends), np.int64)
                moved[used] = np.concatenate([[0], now[:-1]]) - starts[used]
                yield c, ks[used].tobytes(), now.tobytes(), b"".join(data[starts[i] : ends[i]] for i in used.tolist()), (at + moved[text]).astype(np.int32).tobytes()

    return chunks.join(bits, "c").mapInArrow(lambda batches: _batches(rows(batches), fields), "c long, ks binary, ends binary, data binary, marks binary")


def _cut(marked: DataFrame, bits: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """One row for each text that loses bytes: k, n_removed, n_spans, kept_sha256, kept."""
    fields = [("k", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]

    def rows(batches):
        for b in batches:
            for ks, ends, data, found in zip(*(b.column(i).to_pylist() for i in range(4))):
                ks, ends, at = np.frombuffer(ks, np.int64), np.frombuffer(ends, np.int64), _places(found)
                text = np.searchsorted(ends, at, side="right")
                first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > length) | (np.diff(text) > 0)]))
                last = np.concatenate([first[1:], [len(at)]]) - 1
                low, high, text = at[first], at[last] + length, text[first]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]])
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    t = int(text[i])
                    outer = [0 if t == 0 else int(ends[t - 1]), *np.stack([low[i:j], high[i:j]], 1).ravel().tolist(), int(ends[t])]
                    rest = b"".join(data[a:e] for a, e in zip(outer[::2], outer[1::2]))
                    yield int(ks[t]), int((high[i:j] - low[i:j]).sum()), j - i, hashlib.sha256(rest).hexdigest(), rest if keep_text else None

    every = bits.groupBy("c").agg(F.collect_list("bits").alias("bits"))
    joined = marked.select("c", "ks", "ends", "data").join(every, "c").drop("c")
    return joined.mapInArrow(lambda batches: _batches(rows(batches), fields), "k long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, most: int = 20_000, keep_text: bool = False, rounds: int = 8, stretch: int = 1 << 20) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``, the bytes, if asked).

    A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too, in this text or another.
    Null and empty texts have no bytes and lose none. Texts shorter than ``length`` are never touched. Repeated rows
    are copies of each other: they lose all their bytes. Ids may be null or repeated; other columns are not read. An
    empty table gives an empty result. ``rounds``: suffixes are sorted in so many rounds, each with its own share of
    them. A chunk holds at most ``most`` texts and ``stretch`` bytes; a longer text is worked on by stretches of that
    size. None of the three changes a result. ``length`` must be from 149 to 931 (the cover's modulus is 133).
    """
    gram = length - difference_cover()[0] + 1
    if not 16 < gram < 800:
        raise ValueError(f"a length of {length} bytes does not go with the cover's modulus")
    buckets = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t")).withColumn("sha", F.sha2("t", 256))
    base = base.withColumn("k", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    meta = base.select("id", "k", "salt", "sha", F.octet_length("t").cast("long").alias("n"))
    long_ = meta.where(F.col("n") >= length)
    texts = base.where(F.octet_length("t") >= length).groupBy("k").agg(F.any_value("t").alias("t"))
    chunks = staged(_chunked(texts, most, stretch), "chunks")
    parts = max(1, -(-chunks.count() // _PART))
    grams = staged(_bitmaps(_repeated(_cover_grams(chunks, length, gram, buckets, stretch), parts)), "grams")
    marked = staged(_marked(chunks, grams), "marked")
    dropped(chunks)
    dropped(grams)
    found = [staged(_bitmaps(_repeated(_suffixes(marked, length, gram, buckets, rounds, i, stretch), parts)), "tied") for i in range(rounds)]
    bits = found[0]
    for more in found[1:]:
        bits = bits.union(more)
    done = staged(_cut(marked, bits, length, keep_text), "cut")
    for over in (marked, *found):
        dropped(over)
    copies = long_.groupBy("k").agg(F.count("*").alias("copies"), F.min("salt").alias("one"))
    known = copies.join(done, "k", "left").withColumn("salt", F.explode(F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.col("one").cast("int"))))).withColumn("salt", F.col("salt").cast("long"))
    copy = F.col("copies") > 1
    out = long_.join(known.drop("one"), ["k", "salt"])
    cols = [
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    zero = F.lit(0).cast("long")
    short = [F.col("id").alias(id_col), F.col("n").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256")]
    brief = meta.where(F.col("n") < length)
    if keep_text:
        out = out.join(texts.withColumnRenamed("t", "whole"), "k")
        cols.append(F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", "whole")).alias("kept"))
        brief = base.select("id", "sha", "t", F.octet_length("t").cast("long").alias("n")).where(F.col("n") < length)
        short.append(F.col("t").alias("kept"))
    return out.select(*cols).unionByName(brief.select(*short))

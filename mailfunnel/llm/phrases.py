"""Phrase collocations by sampling and exact counting (operator 12), after Toivonen.

A sample of the documents proposes phrases at a lowered threshold. A full pass then counts all words, and each longer phrase
whose two phrases of one word less are proposed: the proposals and their negative border, the phrases that could be
frequent only if the sample was wrong. Where a phrase outside the proposals proves frequent, it joins them and a further
pass counts just what that newly allows, until no such phrase is left. So the sample decides the amount of work, never
the result.

These passes count 64-bit hashes, whose counts are never below their phrases'. A last pass counts, word by word and
exactly, the phrases of those hashes that reached the threshold. Tasks know proposals and reached hashes as a bitmap for each
phrase length, whose size is bounded (2^28 bits, 32 MB): a collision has some more phrases counted, exactly, and none
left out.

Texts: null counts as empty, invalid UTF-8 as U+FFFD, of any length, read whole. A null language is ``und``. Repeated rows
count as often as they stand there; a phrase never crosses a piece or a document. An empty table, or one without a phrase
frequent enough, gives an empty result. Only the two named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, staged, steps, tidied

#: Lower case for A-Z, the ends of pieces as a byte that UTF-8 never holds, tabs as spaces.
END = b"\xff"
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0xFF if b in b".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 9 else b for b in range(256))
#: Words that a task gathers before it hands on their counts, and bytes of text that it takes at a time.
GATHER, RUN = 1_500_000, 2 << 20
COUNTED = "lang string, phrase string, words int, f long"
#: The lowest bits of a phrase's hash hold its number of words.
LENGTHS = np.uint64(15)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Words numbered in order of appearance; the end of a piece has number 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _turned(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(1)) | (x >> np.uint64(63))


def word_hashes(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, lang: str) -> np.ndarray:
    """A 64-bit hash of each slice of ``flat``: all words advance by a byte at a time, the longest first; words of over 255 bytes one by one."""
    seed, short = np.uint64(xxhash.xxh64_intdigest(lang.encode())), size <= 255
    order = np.argsort(255 - np.minimum(size, 255).astype(np.uint8), kind="stable")
    order = order[short[order]]
    at, h = begin[order], np.full(len(order), seed, np.uint64)
    longer = np.searchsorted(-size[order], -np.arange(int(size[order[0]]) if len(order) else 0), "left")
    for j, n in enumerate(longer.tolist()):
        h[:n] = h[:n] * _FACTOR + flat[at[:n] + j] + np.uint64(1)
    out = np.empty(len(begin), np.uint64)
    out[order] = h
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh64_intdigest(flat[begin[i] : begin[i] + size[i]].tobytes(), int(seed))
    return mix64(out)


class Bitmap:
    """A set of hashes of which a task can be sure that a hash is not in it."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def joined(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.bits, self.data | other.data)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language each, at most RUN bytes of a batch at a time, one text at least."""
    for b in batches:
        for low, high in steps(pc.binary_length(b.column(1)).to_pylist(), RUN):
            by_lang = defaultdict(list)
            for lang, text in zip(b.column(0).slice(low, high - low).to_pylist(), b.column(1).slice(low, high - low).to_pylist()):
                by_lang[lang].append(text)
            yield from by_lang.items()


def hashed(lang: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts in order, and whether the next word follows it in the same piece."""
    flat = np.frombuffer(END.join(texts).translate(FOLD) + END, np.uint8)
    inside = (flat != 0x20) & (flat != 0xFF)
    turn = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = turn[::2], turn[1::2]
    piece = np.cumsum(flat == 0xFF)[begin]
    follows = np.zeros(len(begin), bool)
    follows[:-1] = piece[1:] == piece[:-1]
    return word_hashes(flat, begin, end - begin, lang), follows


def tallied(h: np.ndarray, follows: np.ndarray, most: int, now: dict[int, Bitmap] | None, before: dict[int, Bitmap] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of each phrase whose sub-phrases are all in ``now`` (None: all are) and that ``before`` (None: no phrase) did not have counted."""
    first, allowed, again = h, np.ones(len(h), bool), np.full(len(h), before is not None)
    for words in range(1, most + 1):
        yield np.unique((h[allowed & ~again] & ~LENGTHS) | np.uint64(words), return_counts=True)
        if words == most or len(h) < 2:
            return
        hit = allowed if now is None else allowed & now[words].has(h)
        old = again if before is None else again & before[words].has(h)
        if words == 1:
            hit, old, right, after = hit & follows, old & follows, hit, old
        else:
            right, after = hit, old
        allowed, again = hit[:-1] & right[1:], old[:-1] & after[1:]
        h = _turned(h[:-1]) ^ first[words:]


def hash_counts(docs: DataFrame, most: int, now=None, before=None) -> DataFrame:
    """``h, f``: how often each hash of a phrase that ``now`` allows and ``before`` did not stands in ``docs(lang, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = now and now.value, before and before.value
        held, total = [], 0

        def let_go():
            for h, n in tallied(np.concatenate([h for h, _ in held]), np.concatenate([f for _, f in held]), most, new, old):
                for low in range(0, len(h), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(h[low : low + (1 << 18)].view(np.int64)), pa.array(n[low : low + (1 << 18)].astype(np.int64))], names=["h", "f"])

        for lang, texts in _slices(batches):
            held.append(hashed(lang, texts))
            total += len(held[-1][0])
            if total >= GATHER:
                yield from let_go()
                held, total = [], 0
        if held:
            yield from let_go()

    return docs.mapInArrow(tidied(run), "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """The words of the texts of a language as numbers, and the words; up to about GATHER of them at a time."""
    held, vocab, total = defaultdict(list), defaultdict(_Ids), 0

    def let_go():
        for lang, parts in held.items():
            yield lang, np.concatenate(parts), list(vocab[lang])

    for lang, texts in _slices(batches):
        words = (END.join(texts) + END).translate(FOLD).replace(END, b" \xff ").split()
        held[lang].append(np.fromiter(map(vocab[lang].__getitem__, words), np.int64, len(words)))
        total += len(words)
        if total >= GATHER:
            yield from let_go()
            held, vocab, total = defaultdict(list), defaultdict(_Ids), 0
    yield from let_go()


def counted(lang: str, ids: np.ndarray, names: list[bytes], most: int, reached: dict[int, Bitmap]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """``words, phrases, counts`` of one language's words in order (0: end of a piece), of phrases whose hash is in ``reached``. Phrases are told apart by their words' numbers."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    first = word_hashes(np.frombuffer(b"".join(names), np.uint8), np.cumsum(size) - size, size, lang)[ids]
    h, valid = first, ids > 0
    for words in range(1, most + 1):
        at = np.flatnonzero(valid & reached[words].has(h))
        key = ids[at]
        for i in range(1, words):
            key = np.unique(key, return_inverse=True)[1] * len(names) + ids[at + i] if i > 1 else key * len(names) + ids[at + i]
        _, where, n = np.unique(key, return_index=True, return_counts=True)
        where = at[where]
        yield words, [b" ".join([names[i] for i in own]) for own in np.stack([ids[where + i] for i in range(words)], 1).tolist()], n
        if len(h) < 2:
            return
        valid, h = valid[:-1] & (ids[words:] > 0), _turned(h[:-1]) ^ first[words:]


def counts(docs: DataFrame, most: int, reached) -> DataFrame:
    """COUNTED: how often each phrase whose hash is in ``reached`` stands in ``docs(lang, text)``; with ``words`` 0 and phrase '' the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, names in _gathered(batches):
            for words, phrases, n in [(0, [b""], np.array([np.count_nonzero(ids)])), *counted(lang, ids, names, most, reached.value)]:
                for low in range(0, len(phrases), 200_000):
                    part = phrases[low : low + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(part), np.int32))), pa.array(part, pa.binary()).cast(pa.string()), pa.array(np.full(len(part), words, np.int32)), pa.array(n[low : low + 200_000].astype(np.int64))], names=["lang", "phrase", "words", "f"])

    return docs.mapInArrow(tidied(run), COUNTED).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def of_length(hashes: DataFrame, words: int) -> DataFrame:
    return hashes.where(F.col("h").bitwiseAND(int(LENGTHS)) == words)


def bits_for(n: int, each: int) -> int:
    """So many bits for each of ``n`` hashes, within bounds, as a power of two."""
    return min(28, max(18, math.ceil(math.log2(each * max(1, n)))))


def bitmap(hashes: DataFrame, bits: int) -> Bitmap:
    """The ``hashes(h)`` as bits, set on the executors; the driver gets the 2^bits bits."""
    at = F.shiftrightunsigned("h", 64 - bits) + 1
    rows = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    data = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r.m), np.uint8)
        low = (r.b - 1) * len(part)
        data[low : low + len(part)] |= part[: len(data) - low]
    return Bitmap(bits, data)


def frequent(docs: DataFrame, most: int, least: int, share: float = 0.25, passes: list | None = None) -> DataFrame:
    """COUNTED for every phrase of 1 to ``most`` (15 at most) words with f >= ``least``, and the number of words of each language (``words`` 0, phrase '').

    ``share``: the part of the documents, picked by a hash of language and text, that proposes phrases; it changes the
    work, not the result. ``passes`` takes the number of border failures after each full pass.
    """
    spark, lengths = docs.sparkSession, range(1, most)

    def number(hashes: DataFrame) -> dict[int, int]:
        found = {r.k: r.n for r in hashes.groupBy(F.col("h").bitwiseAND(int(LENGTHS)).alias("k")).agg(F.count("*").alias("n")).collect()}
        return {k: found.get(k, 0) for k in range(1, most + 1)}

    part = docs.where(F.pmod(F.xxhash64("lang", "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    proposed = staged(hash_counts(part, most - 1).where(F.col("f") >= max(1, math.floor(share * least * 0.8))).select("h"), "proposed")
    sizes = number(proposed)
    now = {k: bitmap(of_length(proposed, k), bits_for(sizes[k], 16)) for k in lengths}
    held, last, reached = spark.sparkContext.broadcast(now), None, None
    while True:
        more = staged(hash_counts(docs, most, held, last).where(F.col("f") >= int(least)).select("h"), "reached")
        reached = more if reached is None else reached.unionByName(more)
        # what a task finds in a bitmap need not have been proposed, but it is allowed all the same
        failed = staged(missed(more, held, most), "failed")
        n = number(failed)
        if passes is not None:
            passes.append(sum(n.values()))
        if not any(n.values()):
            break
        now = {k: now[k].joined(bitmap(of_length(failed, k), now[k].bits)) if n[k] else now[k] for k in lengths}
        held, last = spark.sparkContext.broadcast(now), held
    sizes = number(reached)
    final = spark.sparkContext.broadcast({k: bitmap(of_length(reached, k), bits_for(sizes[k], 64)) for k in range(1, most + 1)})
    return staged(counts(docs, most, final).where(f"words = 0 OR f >= {int(least)}"), "counted")


def missed(hashes: DataFrame, held, most: int) -> DataFrame:
    """Those of the hashes of fewer than ``most`` words that the bitmaps do not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            words, out = h & LENGTHS, np.zeros(len(h), bool)
            for k in range(1, most):
                out |= (words == k) & ~held.value[k].has(h)
            yield b.filter(pa.array(out))

    return hashes.mapInArrow(run, "h long")


def scored(found: DataFrame, most: int, inside_percent: int, salts: int = 16) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of every candidate that no longer one takes in. All arithmetic is exact: decimals of 38 digits.

    Parts of a candidate meet their counts once; a frequent word is part of many candidates, so single words are dealt
    out over ``salts`` tasks.
    """
    cand = found.where("words >= 2")
    w, size = F.split("phrase", " "), F.col("words")
    piece = lambda low, n: F.array_join(F.slice(w, low, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), piece(F.lit(1), k).alias("part"), (k == 1).alias("one")), F.struct(k.alias("k"), F.lit(1).alias("side"), piece(k + 1, size - k).alias("part"), (k == size - 1).alias("one"))))
    each = cand.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.flatten(cuts)))
    each = each.withColumn("salt", F.when(F.col("one"), F.pmod(F.xxhash64("phrase"), F.lit(salts))).otherwise(0).cast("int")).drop("one")
    known = found.where(f"words between 1 and {most - 1}").select("lang", F.col("phrase").alias("part"), F.col("f").alias("g"), F.explode(F.sequence(F.lit(0), F.when(F.col("words") == 1, salts - 1).otherwise(0))).alias("salt"))
    met = each.join(known, ["lang", "part", "salt"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("g"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("g"))).alias("r"))
    both = both.withColumn("score", F.expr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").cast("long"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: piece(i, n))))
    inside = cand.where("words >= 3").select("lang", F.col("f").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).drop("longer")
    return left.join(found.where("words = 0").select("lang", F.col("f").alias("n")), "lang")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50, share: float = 0.25, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``most`` words that stand there ``least`` times or more.

    n: words of the language; a, l, r: how often the phrase and the two parts of its weakest cut stand there; score:
    floor(1000000 * a * a / (l * r)). Ordered by score and a, both descending, then by the phrase's bytes.
    """
    text = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary")
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    rows = staged(scored(frequent(docs, most, least, share), most, inside_percent), "collocations")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best of each share first, then the best of those: no task gets a whole language
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Near-duplicates by SimHash in a binary-trie self-join, then word-shingle Jaccard similarity: the pipeline's near-dedup stage.

Texts of equal tokens are one class. A class has a SimHash fingerprint of ``PRINTS`` words of 64 bits over its distinct shingles.
At a Jaccard similarity of 0.8 about 15 % of the bits differ: too many for one trie with an error-free block, whose blocks
would be of four bits. So each word has its own trie in each of ``TURNS`` rotations, and it is enough that one of
these blocks is free of errors (a pair at the threshold has none with a probability of about 0.00002). In a
subtrie the walk of operator 8 finds the pairs within ``WORD_ERRORS`` bits of the word and ``ERRORS`` bits of it and the next one;
classes it connects there are a bucket, and in a bucket every pair not yet linked is checked exactly on whole shingle
sets. Only a spanning set of links leaves a task; large subtries and large buckets are dealt out as pairs of parts.

Fingerprints of very small sets are coarse: sets of at most ``FEW`` shingles, whose pairs at 0.8 or more differ by one
shingle left out, stand in the tries without each of their shingles too, where they equal the other set's fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mix64, staged, steps, text_bytes, tidied
from .components import components
from .simhash import _blocks, _joined, _rotated, _walk, node_pairs, one_per_root, walked

WORDS = 5
PRINTS, TURNS, WORD_ERRORS, ERRORS, FEW = 10, 6, 22, 32, 6
BLOCK = 1_000_000
STEP_BYTES = 2_000_000
_FACTORS = np.random.default_rng(23).integers(0, 2**63, PRINTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def _parts(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a task holds a bounded number of bytes of a column at once."""
    for b in batches:
        for low, high in steps(pc.binary_length(b.column(col)).to_pylist(), STEP_BYTES):
            yield b.slice(low, high - low)


def _class(text: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's runs of ``words`` tokens, sorted; of a shorter text the whole."""
    tokens = text.lower().split()  # bytes: A-Z only, white space \x20 \x09-\x0D
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    stops = ends[words - 1 :] or [len(joined) + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], stops)], np.uint64))


def prints_of(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash fingerprints of sets of hashes (none empty): a row of ``PRINTS`` words each."""
    size = np.array([len(x) for x in sets])
    hashes = np.concatenate(sets)
    # bits are counted in bytes, so at most 255 hashes at a time
    runs = -(-size // 255)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    starts = np.repeat(np.cumsum(size) - size, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    out = np.zeros((len(sets), PRINTS), np.uint64)
    for m in range(PRINTS):
        mixed = mix64(hashes * _FACTORS[m])
        for s in range(8):
            lanes = np.add.reduceat((mixed >> np.uint64(s)) & _LANES, starts)
            count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
            out[:, m] |= (2 * count > size[:, None]).astype(np.uint8).view(np.uint64)[:, 0] << np.uint64(s)
    return out


def bands(hashes: np.ndarray) -> np.ndarray:
    """The nodes under which a set of hashes stands, one in each trie: where two sets share one, they are walked together."""
    words = prints_of([hashes])[0]
    return np.concatenate([_rotated(words, shift) >> np.uint64(64 - bits) for shift, bits in _blocks(TURNS - 1)])


def _with_few(sets: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Each set, followed by itself without each of its shingles if it has few."""
    for x in sets:
        yield [x] * bool(len(x)) + [np.delete(x, i) for i in range(len(x)) if 1 < len(x) <= FEW]


def _printed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, x, k, n, words)``: each row's text hash, class, number of shingles and fingerprints (none for a text without tokens)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None, lambda: None)
        for b in _parts(batches, 1):
            texts = b.column(1).to_pylist()
            sets = [shingles(t) for t in texts]
            k = np.array([_class(t) for t in texts], np.uint64).view(np.int64)
            forms = list(_with_few(sets))
            flat = [x for own in forms for x in own]
            words = (prints_of(flat) if flat else np.zeros(0, np.uint64)).view(np.int64).ravel()
            ends = np.cumsum([0, *(len(own) * PRINTS for own in forms)])
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(k), pa.array([len(s) for s in sets], pa.int64()), words], names=["id", "x", "k", "n", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"), F.xxhash64(text_col).alias("x")).mapInArrow(run, f"id {kind}, x long, k long, n long, words array<long>")


def _tries(each: DataFrame) -> DataFrame:
    """``(k, words)`` -> the tries' values ``(r, key, other, side, v, w, k)``: a rotated word v, and the word w after it."""
    by_word = each.select("k", "words", F.posexplode("words").alias("at", "v"))
    after = f"element_at(words, cast(at - at % {PRINTS} + (at + 1) % {PRINTS} + 1 as int))"
    turned = by_word.select("k", F.expr(f"cast(at % {PRINTS} as int)").alias("m"), "v", F.expr(after).alias("w"), F.explode(F.expr(f"sequence(0, {TURNS - 1})")).alias("turn"))
    shift, bits = (f"element_at(array({', '.join(str(x[i]) for x in _blocks(TURNS - 1))}), turn + 1)" for i in range(2))
    turned = turned.withColumn("s", F.expr(shift)).select("k", "w", "turn", F.expr(f"m * {TURNS} + turn").alias("r"), F.expr("shiftleft(v, s) | shiftrightunsigned(v, (64 - s) % 64)").alias("v"))
    node = F.expr(f"shiftrightunsigned(v, 64 - {bits})")
    return turned.select("r", node.alias("key"), node.alias("other"), F.lit(0).alias("side"), "v", "w", "k")


def _met(nodes: DataFrame) -> DataFrame:
    """``(h, k)``: the classes that the walk connects inside each node pair, by bucket."""
    blocks = _blocks(TURNS - 1) * PRINTS

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        h, ks = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for r, first, second, (v, w, k) in node_pairs(pa.Table.from_batches(got)):
            root, w = np.arange(len(v)), w.view(np.uint64)

            def near(v=v, w=w, root=root, ends=(first, second, blocks[r][1])):
                for x, y in _walk(v, *ends, WORD_ERRORS, leaf=512, root=root):
                    ok = np.bitwise_count(v[x] ^ v[y]) + np.bitwise_count(w[x] ^ w[y]) <= ERRORS
                    yield x[ok], y[ok]

            _joined(root, near())
            hit = np.flatnonzero(np.bincount(root, minlength=len(v))[root] > 1)
            if len(hit):
                h.append(mix64(mix64(v[root[hit]] + np.uint64(r)) ^ w[root[hit]]))
                ks.append(k[hit])
        h, ks = np.concatenate(h).view(np.int64), np.concatenate(ks)
        order = np.lexsort((ks, h))
        h, ks = h[order], ks[order]
        new = np.append(True, (np.diff(h) != 0) | (np.diff(ks) != 0))[: len(h)]  # a class meets its own other forms
        yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(ks[new])], names=["h", "k"])

    return nodes.repartition("r", "key", "other").mapInArrow(run, "h long, k long")


def linked(keys: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest that spans the pairs of ``sets`` with Jaccard similarity 0.8: (key, root's key) for each that has a link."""
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    held, root = np.zeros(len(values), bool), np.arange(len(sets))
    for i in range(len(sets) - 1):
        rest = slice(i + 1, len(sets))
        open_ = (root[rest] != root[i]) & (5 * np.minimum(size[rest], size[i]) >= 4 * np.maximum(size[rest], size[i]))
        if not open_.any():
            continue
        own = codes[starts[i] : starts[i + 1]]
        held[own] = True
        common = np.add.reduceat(held[codes[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)
        held[own] = False
        near = np.flatnonzero(open_ & (9 * common >= 4 * (size[rest] + size[i]))) + i + 1
        if len(near):
            met = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, met)] = met[0]
    far = root != np.arange(len(sets))
    return keys[far], keys[root[far]]


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members(h, i, j, k)`` and their shingle sets -> ``(a, b)`` links inside each bucket or pair of blocks."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, own = None, [], []

        def found() -> pa.RecordBatch:
            a, b = linked(np.array(keys, np.int64), own) if len(keys) > 1 else (np.empty(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in _parts(batches, 4):
            for *group, k, s in zip(*(b.column(c).to_pylist() for c in ("h", "i", "j", "k", "s"))):
                if group != at:
                    yield found()
                    at, keys, own = group, [], []
                keys.append(k)
                own.append(np.frombuffer(s, np.uint64))
        yield found()

    dealt = members.join(sets, "k").select("h", "i", "j", "k", "s").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, text_col: str, heads: DataFrame) -> DataFrame:
    """``(k, s)``: the shingle set of each class of ``heads(k, x)``, of its texts with hash x.

    Texts are found by built-in functions, so that a task holds one Python worker: workers once started stay, and with
    them the memory of all later stages.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # equal texts that stand together are cut up once
        for b in _parts(batches, 1):
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != last and _class(t) == k % 2**64:  # a text of another class may have the hash too
                    rows.append((k, shingles(t).tobytes()))
                    last = k
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["k", "s"])

    texts = docs.select(text_bytes(text_col).alias("t"), F.xxhash64(text_col).alias("x"))
    return texts.join(heads, "x").select("k", "t").mapInArrow(run, "k long, s binary").groupBy("k").agg(F.first("s").alias("s"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most: int = 20_000) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one of each component of texts linked by a Jaccard similarity of 0.8.

    Similarity is that of the sets of ``WORDS``-word shingles (a shorter text is one shingle). Null and empty texts
    are alike. The row with the smallest id stays, a null id last; of a repeated id the first by text hash. Ids name
    nothing else, so unlike texts with null or repeated ids all stay. All columns are kept as they are; an empty
    table gives an empty result. ``block``: buckets of more shingles are dealt out as pairs of blocks.
    ``most``: subtries of more fingerprints are dealt out as pairs of child nodes.
    """
    prints = staged(_printed(docs, id_col, text_col), "prints")
    each = staged(prints.groupBy("k").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.min("x").alias("x")), "classes")
    met = staged(walked(_tries(each.select("k", "words")), _blocks(TURNS - 1) * PRINTS, WORD_ERRORS, most, _met), "met")
    dealt = staged(met.join(each.select("k", "n"), "k").select("k", "n", "h"), "buckets")
    buckets = dealt.groupBy("h").agg(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(k))").alias("x"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("n").alias("n")).where("c > 1")
    # subtries that bring the same classes together give one bucket
    buckets = buckets.groupBy("c", "x", "lo", "hi").agg(F.min("h").alias("h"), F.first("n").alias("n"))
    members = dealt.select("h", "k").join(buckets.select("h", F.ceil(F.col("n") / block).cast("int").alias("parts")), "h")
    own = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    members = staged(members.select("h", "k", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "k"), "members")
    links = _links(members, _sets(docs, text_col, each.select("k", "x").join(members.select("k"), "k", "left_semi")))
    rooted = prints.select("id", "x", "k").join(components(links), F.col("k") == F.col("node"), "left").select("id", "k", "x", F.coalesce("root", "k").alias("root"))
    return one_per_root(docs, rooted, id_col, text_col)

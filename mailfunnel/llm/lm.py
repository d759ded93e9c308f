"""Hierarchical Pitman-Yor language model scores (operator 6).

Restaurants: every word that occurs is a context of its own (so is the beginning of a text); contexts whose words end
alike share a parent restaurant, one for each of ``CLASSES`` classes of endings; these share the unigram restaurant,
whose base is uniform over the V known words and one unknown word. So what is gathered grows with the corpus.

Seating is sampled by Gibbs sweeps over Chinese restaurants: a dish's customers are taken out and seated again one after the
other, given the tables of all other dishes (beyond 64 customers in steps of a 32nd of those seated). Draws are hashes of restaurant, dish, customer and
sweep, so results do not depend on how the input is split. All tokens of a context meet in one bucket, where its
dishes are seated; contexts with very many tokens are spread over the buckets of their class by the next word. Tables of
a bucket's contexts are the customers of the class restaurants: they meet by word, are seated there and in the unigram
restaurant, and what each bucket asked for goes back to it. The last round averages predictive probabilities over
sweeps and scores every token with them.

Tokens travel packed: one row for each chunk of texts and bucket.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, dropped, mix64, partitions, staged, steps, text_bytes, tidied

BEGIN, END = 0, 1  # codes; END's class is never asked for
CLASSES = 16
CHUNK_TOKENS, CHUNK_DOCS, STEP_BYTES = 900_000, 32_000, 2_000_000
BUCKET_TOKENS, SLICE_WORDS = 600_000, 300_000
THETA = (2.0, 2.0, 1.0)  # of contexts, classes, unigrams
SEED = np.uint64(0x5EED)


class Coder:
    """Words to 64-bit codes: a 58-bit hash with the class of the word's ending in the low bits."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w) // CLASSES * CLASSES + xxhash.xxh32_intdigest(w[-3:]) % CLASSES
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def tokenized(texts: list[bytes], code: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts -> codes of all tokens (each text's words and one end), of their contexts, and the number of tokens of each text."""
    words = [t.lower().split() for t in texts]  # bytes: A-Z only, white space \x20 \x09-\x0D
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes) - 1
    own = np.full(int(sizes.sum()), END, np.uint64)
    inner = np.ones(len(own), bool)
    inner[ends] = False
    own[inner] = code([w for ws in words for w in ws])
    context = np.concatenate([[np.uint64(BEGIN)], own[:-1]])
    context[ends[:-1] + 1] = BEGIN
    return own, context, sizes


def _parts(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low, high in steps(pc.binary_length(b.column(col)).to_pylist(), STEP_BYTES):
            yield b.slice(low, high - low)


def word_counts(texts: DataFrame) -> DataFrame:
    """``texts(t)`` -> ``(code, n)``: how often each token occurs."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder()
        for b in _parts(batches, 0):
            codes, n = np.unique(tokenized(b.column(0).to_pylist(), code)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Layout:
    """Where a token's context is handled: bucket ``class << 20 | part``; hot contexts are spread by the next word.

    A matter of sizes only, so it is made from a sample: no count of the model comes from it.
    """

    parts: np.ndarray  # buckets of each class
    hot: np.ndarray  # sorted codes of contexts with very many tokens
    often: np.ndarray  # sorted codes that travel as two bytes
    slices: int  # of the words' side

    def bucket(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        kind = (context % np.uint64(CLASSES)).astype(np.int64)
        by = np.where(np.isin(context, self.hot), word, context) if len(self.hot) else context
        return kind << 20 | ((mix64(by) >> np.uint64(20)) % self.parts[kind].astype(np.uint64)).astype(np.int64)

    def short(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes as three arrays: which are frequent, these as numbers, the others as they are."""
        at = np.minimum(np.searchsorted(self.often, codes), max(0, len(self.often) - 1))
        hit = self.often[at] == codes if len(self.often) else np.zeros(len(codes), bool)
        return np.packbits(hit), at[hit].astype(np.uint16), codes[~hit]

    def whole(self, bits: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out, hit = np.empty(len(at) + len(rest), np.uint64), np.unpackbits(bits, count=len(at) + len(rest)).astype(bool)
        out[hit], out[~hit] = self.often[at], rest
        return out


def sized(texts: DataFrame, bucket_tokens: int, sample: int = 20_000) -> Layout:
    """A layout from about ``sample`` texts, those with certain hashes."""
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    some = texts.where(F.pmod(F.xxhash64("id", "t"), F.lit(max(1, n // sample))) == 0).select("t")
    counts = staged(word_counts(some), "counts")
    seen, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    times = max(1.0, (size + n) / max(1, some.agg(F.coalesce(F.sum(F.octet_length("t") + 1), F.lit(0))).first()[0]))
    # the beginning is a context as often as texts end; it takes the end's place
    used = counts.withColumn("code", F.when(F.col("code") == END, F.lit(BEGIN)).otherwise(F.col("code")))
    weights = np.zeros(CLASSES)
    for r in used.groupBy(F.pmod("code", F.lit(CLASSES)).alias("k")).agg(F.sum("n").alias("n")).collect():
        weights[r.k] = r.n * times
    codes = lambda df: np.array(sorted(r.code % 2**64 for r in df.select("code").collect()), np.uint64)
    hot = codes(used.where(F.col("n") * times > bucket_tokens * 5 // 12))  # at most 2.4 * tokens / bucket_tokens
    often = codes(counts.orderBy(F.desc("n"), "code").limit(1 << 16))
    parts = np.maximum(1, np.ceil(weights / bucket_tokens)).astype(np.int64)
    return Layout(parts, hot, often, max(16, int(distinct * times**0.8 * 3 // SLICE_WORDS)))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, whole numbers as narrow as they fit (64-bit unsigned are codes and stay)."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        if a.dtype.kind in "ui" and a.dtype != np.uint64:
            top = int(a.max(initial=0))
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64) if int(a.min(initial=0)) >= 0 else a.astype(np.int64)
        parts += [struct.pack("<4sQ", a.dtype.str.encode(), len(a)), a.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(data), [], 4
    for _ in range(struct.unpack_from("<I", raw)[0]):
        kind, n = struct.unpack_from("<4sQ", raw, at)
        out.append(np.frombuffer(raw, kind.rstrip(b"\0").decode(), n, at + 12))
        at += 12 + out[-1].nbytes
    return out


def packed_piece(layout: Layout, context: np.ndarray, word: np.ndarray, doc: np.ndarray) -> bytes:
    """Tokens of one chunk and bucket, sorted by context, word and document."""
    new_c = np.concatenate([[True], context[1:] != context[:-1]])
    new_w = new_c | np.concatenate([[True], word[1:] != word[:-1]])
    at = np.flatnonzero(new_w | np.concatenate([[True], doc[1:] != doc[:-1]]))
    times = np.diff(np.concatenate([at, [len(doc)]]))
    words, index = np.unique(word[new_w], return_inverse=True)
    return packed(*layout.short(context[new_c]), *layout.short(words), index, new_c[at].astype(np.uint8) | new_w[at].astype(np.uint8) << 1, doc[at], times)


def read_piece(layout: Layout, data: bytes) -> tuple[np.ndarray, ...]:
    """Context, word, document and count of each entry."""
    x = unpacked(data)
    index, flags, doc, times = x[6:]
    return layout.whole(*x[:3])[np.cumsum(flags & 1) - 1], layout.whole(*x[3:6])[index[np.cumsum(flags >> 1) - 1]], doc.astype(np.uint16), times.astype(np.uint32)


def pieces(texts: DataFrame, layout: Layout) -> DataFrame:
    """``texts(id, train, t)`` -> ``(chunk, bucket, payload)``: tokens by chunk and bucket; the list of a chunk's documents has bucket ``-1 - chunk``."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, chunk = Coder(), TaskContext.get().partitionId() << 32
        offset = np.concatenate([[0], np.cumsum(layout.parts)])
        held: list[tuple] = []

        def rows(buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(payloads), pa.int64()), pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary())], names=["chunk", "bucket", "payload"])

        def flush() -> Iterator[pa.RecordBatch]:
            ids, known, train, sizes, word, context = (np.concatenate(c) for c in zip(*held))
            held.clear()
            yield rows([-1 - chunk], [packed(ids, known.astype(np.uint8), train.astype(np.uint8), sizes)])
            doc = np.repeat((np.arange(len(sizes)) | train.astype(np.int64) << 15).astype(np.uint16), sizes)
            bucket = layout.bucket(context, word)
            values, at = np.unique(word, return_inverse=True)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            before = np.concatenate([[0], at[:-1] + 1])  # a context is the word before, or (0) the beginning
            before[first] = 0
            n = len(values) + 1
            order = np.argsort(((offset[bucket >> 20] + (bucket & 0xFFFFF)) * n + before) * n + at, kind="stable")  # documents stay in order
            bucket, context, word, doc = bucket[order], context[order], word[order], doc[order]
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
            for low in range(0, len(edges) - 1, 32):
                cuts = list(zip(edges, edges[1:]))[low : low + 32]
                yield rows([int(bucket[a]) for a, _ in cuts], [packed_piece(layout, context[a:b], word[a:b], doc[a:b]) for a, b in cuts])

        for b in _parts(batches, 2):
            for low in range(0, b.num_rows, CHUNK_DOCS):
                part = b.slice(low, CHUNK_DOCS)
                if held and (sum(len(h[4]) for h in held) > CHUNK_TOKENS or sum(len(h[0]) for h in held) + part.num_rows > CHUNK_DOCS):
                    yield from flush()
                    chunk += 1
                word, context, sizes = tokenized(part.column(2).to_pylist(), code)
                ids = part.column(0)
                held.append((pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), sizes, word, context))
        if held:
            yield from flush()

    return texts.mapInArrow(run, "chunk long, bucket long, payload binary")


def draw(key: np.ndarray, step: int, sweep: int) -> np.ndarray:
    """Uniform numbers that depend on nothing but a dish, its customer and the sweep."""
    return (mix64(key + SEED * np.uint64(2 * step + 1) + mix64(np.array([sweep + 1], np.uint64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seated(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, theta: float, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of dishes after seating their ``customers`` again, given the tables of the ``others`` in their restaurants.

    The next customer opens a table with odds (theta + d * tables in the restaurant) * parent's probability, and sits down at
    one of the dish with odds (customers - d * the dish's tables). One at a time up to 64, then in steps of i // 32 whose tables are drawn at once.
    """
    tables = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    i = 1
    while len(live):
        step = max(1, i // 32) if i >= 64 else 1
        n = np.minimum(step, customers[live] - i)
        mine = tables[live]
        opens = (theta + discount * (others[live] + mine)) * parent[live]
        p = opens / (opens + np.maximum(i + (step - 1) / 2 - discount * mine, 1e-9))
        tables[live] = mine + np.floor(n * p + draw(key[live], i, sweep)).astype(np.int64)
        i += step
        live = live[customers[live] > i]
    return tables


@dataclass
class Totals:
    """What rounds exchange: sums over all buckets; a number for each class and hot context, no more."""

    n: float = 0.0
    v: float = 0.0
    ones: list[float] = field(default_factory=lambda: [0.0] * 3)
    twos: list[float] = field(default_factory=lambda: [0.0] * 3)
    c: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    t: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    root_c: float = 0.0
    root_t: float = 0.0
    hot: dict[int, tuple[float, float]] = field(default_factory=dict)

    def discount(self, level: int) -> float:
        """n1 / (n1 + 2 n2) of the level's customers, the usual estimate."""
        return min(0.95, max(0.05, self.ones[level] / max(1.0, self.ones[level] + 2 * self.twos[level])))

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        d = self.discount(2)
        return (customers - d * tables + (THETA[2] + d * self.root_t) / (self.v + 1)) / (THETA[2] + self.root_c)

    def of_class(self, kind: np.ndarray | int, customers: np.ndarray, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        d = self.discount(1)
        return (customers - d * tables + (THETA[1] + d * self.t[kind]) * root) / (THETA[1] + self.c[kind])


class Bucket:
    """One bucket's entries as arrays, and its restaurants: (context, word) pairs with their training customers."""

    def __init__(self, number: int, data: bytes):
        self.number, self.kind = number, number >> 20
        x = unpacked(data)
        self.chunks, sizes, self.contexts, self.words, per_context, pw, customers, per_pair, self.doc, self.times = x
        self.doc = self.doc.astype(np.int64)
        self.edges = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        self.pair = np.repeat(np.arange(len(pw)), per_pair)  # of each entry
        self.seat = np.cumsum(customers > 0) - 1  # the place of a pair among those with customers
        self.hit = customers > 0
        self.all_u, self.all_w = np.repeat(np.arange(len(self.contexts)), per_context), pw.astype(np.int64)
        self.pu, self.pw, self.customers = self.all_u[self.hit], self.all_w[self.hit], customers[self.hit].astype(np.int64)
        self.names = mix64(self.contexts[self.pu] * np.uint64(31) + self.words[self.pw])
        self.c = np.bincount(self.pu, self.customers, len(self.contexts))

    @staticmethod
    def packed(layout: Layout, chunks: list[int], payloads: list[bytes]) -> bytes:
        """The pieces of a bucket, brought into order once. Entries by pair; ``doc`` counts the chunks' documents through."""
        parts = [read_piece(layout, p) for p in payloads]
        context, word, doc, times = (np.concatenate(c) for c in zip(*parts))
        chunk = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        del parts
        contexts, u = np.unique(context, return_inverse=True)
        words, w = np.unique(word, return_inverse=True)
        del context, word
        key = u * len(words) + w
        order = np.argsort(key, kind="stable")
        key, doc, times, chunk = key[order], doc[order], times[order], chunk[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pairs = key[at]
        customers = np.add.reduceat(np.where(doc >> 15 == 1, times, 0).astype(np.int64), at)
        size = np.array([1 << 15] * len(chunks), np.int64)
        return packed(np.array(chunks, np.int64), size, contexts, words, np.bincount(pairs // len(words), minlength=len(contexts)), pairs % len(words), customers, np.diff(np.concatenate([at, [len(key)]])), chunk << 15 | (doc & 0x7FFF), times)

    def sweeps(self, totals: Totals, parent: np.ndarray, first: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tables of each pair, and of each context with its customers, after each of ``n`` sweeps."""
        tables, c = np.ones(len(self.customers), np.int64), self.c.copy()
        hot = [(i, *totals.hot[u]) for i, u in enumerate(self.contexts.tolist()) if u in totals.hot]
        d = totals.discount(0)
        for sweep in range(first, first + n):
            t = np.bincount(self.pu, tables, len(self.contexts))
            for i, all_c, all_t in hot:
                c[i], t[i] = all_c, all_t
            tables = seated(self.customers, parent[self.pw], t[self.pu] - tables, THETA[0], d, self.names, sweep)
            t = np.bincount(self.pu, tables, len(self.contexts))
            for i, _, all_t in hot:
                t[i] = all_t
            yield tables, t, c


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by ``key`` -> each key with its rows."""
    at, rows = None, []
    for b in batches:
        for i in range(b.num_rows):  # few and large: packed payloads
            (r,) = b.slice(i, 1).to_pylist()
            if r[key] != at and rows:
                yield at, rows
                rows = []
            at = r[key]
            rows.append(r)
    if rows:
        yield at, rows


def prepared(rows: DataFrame, layout: Layout) -> DataFrame:
    """``pieces`` -> ``(bucket, payload)``: one row for each bucket and each list of documents."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in _runs(batches, "bucket"):
            data = own[0]["payload"] if bucket < 0 else Bucket.packed(layout, [r["chunk"] for r in own], [r["payload"] for r in own])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([data], pa.binary())], names=["bucket", "payload"])

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, "bucket long, payload binary")


def _slices(words: np.ndarray, n: int) -> np.ndarray:
    """The slice of the words' side that each word belongs to."""
    return ((mix64(words + np.uint64(77)) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[tuple[Bucket, list[np.ndarray] | None]]:
    """Rows of buckets -> each bucket with what the words' side answered, in the order of its words."""
    for _, (row,) in _runs(batches, "bucket"):
        own, answers = Bucket(row["bucket"], row["payload"]), [unpacked(r["payload"]) for r in row["answers"] or ()]
        del row
        if answers:
            order = np.argsort(_slices(own.words, slices), kind="stable")
            found = [np.empty(len(order)) for _ in range(5)]
            for out, x in zip(found, zip(*answers)):
                out[order] = np.concatenate(x)
        yield own, found if answers else None


def _met(tokens: DataFrame, seats: DataFrame | None) -> DataFrame:
    """Tokens and the answers of the words' side, by bucket. Tokens stay where they are: their table is bucketed."""
    if seats is None:
        return tokens.select("bucket", "payload", F.lit(None).cast("array<struct<slice: bigint, payload: binary>>").alias("answers"))
    answers = seats.where("kind = 'w'").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("slice", "payload"))).alias("answers"))
    return tokens.join(answers.hint("shuffle_merge"), "bucket", "left").select("bucket", "payload", "answers")


def _parent(totals: Totals, bucket: Bucket, seats: list[np.ndarray]) -> np.ndarray:
    """The class restaurant's probability of each of the bucket's words."""
    return totals.of_class(bucket.kind, seats[0], seats[1], totals.root(seats[2], seats[3]))


ASKED = "kind string, bucket long, slice long, code long, served long, n long, payload binary"


def served(tokens: DataFrame, seats: DataFrame | None, totals: Totals, slices: int, first: int, n: int) -> DataFrame:
    """Seats the contexts of every bucket -> rows of ``ASKED``.

    'w': a bucket's words of one slice, with the tables that serve each there and its training count, packed; 'h': a hot
    context's tables and customers; 's': numbers of pairs with one (0) and two customers (1).
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, answers in _buckets(batches, slices):
            tables = np.ones(len(own.customers), np.int64)
            if answers is not None:
                for tables, _, _ in own.sweeps(totals, _parent(totals, own, answers), first, n):
                    pass
            by_word = [np.bincount(own.pw, x, len(own.words)).astype(np.uint32) for x in (tables, own.customers)]
            slice_ = _slices(own.words, slices)
            order = np.argsort(slice_, kind="stable")
            cuts = np.searchsorted(slice_[order], np.arange(slices + 1))
            rows = [("w", own.number, i, None, None, None, packed(own.words[part], *(x[part] for x in by_word))) for i in range(slices) for part in [order[cuts[i] : cuts[i + 1]]] if len(part)]
            t = np.bincount(own.pu, tables, len(own.contexts))
            rows += [("h", own.number, None, int(own.contexts[i].view(np.int64)), int(t[i]), int(own.c[i]), None) for i in np.flatnonzero(np.isin(own.contexts, np.array(list(totals.hot), np.uint64)))]
            rows += [("s", own.number, None, i, int(np.count_nonzero(own.customers == i + 1)), 0, None) for i in range(2)]
            yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array(x, pa.string() if i == 0 else pa.binary() if i == 6 else pa.int64()) for i, (c, x) in enumerate(zip(ASKED.split(", "), zip(*rows)))})

    return _met(tokens, seats).mapInArrow(run, ASKED)


def upper_seats(code: np.ndarray, kind: np.ndarray, customers: np.ndarray, totals: Totals, first: int, burn: int, samples: int) -> tuple[np.ndarray, ...]:
    """Class and unigram restaurants of whole words: rows sorted by word -> customers and mean tables in class and root, by row."""
    words, word = np.unique(code, return_inverse=True)
    dish, at = np.unique(word * CLASSES + kind, return_inverse=True)
    cust = np.bincount(at, customers, len(dish)).astype(np.int64)
    word, kind = dish // CLASSES, dish % CLASSES
    tables, root_t = (cust > 0).astype(np.int64), None
    sums = [np.zeros(len(cust)), np.zeros(len(words)), np.zeros(len(words))]
    if not totals.root_c:  # the first round: one table for each dish
        root_c = np.bincount(word, tables, len(words))
        return tuple(x[at] for x in (cust, tables, root_c[word], (root_c > 0)[word]))
    name = mix64(words[word].view(np.uint64) * np.uint64(31) + kind.astype(np.uint64) + np.uint64(7))
    top = mix64(words.view(np.uint64) + np.uint64(11))
    root_c = np.bincount(word, tables, len(words)).astype(np.int64)
    root_t = (root_c > 0).astype(np.int64)
    base = np.full(len(words), 1 / (totals.v + 1))
    for s in range(burn + samples):
        parent = totals.root(root_c, root_t)[word]
        tables = seated(cust, parent, totals.t[kind] - tables, THETA[1], totals.discount(1), name, first + s)
        root_c = np.bincount(word, tables, len(words)).astype(np.int64)
        root_t = seated(root_c, base, totals.root_t - root_t, THETA[2], totals.discount(2), top, first + s)
        if s >= burn:
            for total, x in zip(sums, (tables, root_c, root_t)):
                total += x
    t, rc, rt = (x / samples for x in sums)
    return tuple(x[at] for x in (cust, t, rc[word], rt[word]))


SEATS = "kind string, bucket long, slice long, payload binary, a double, b double, c double, d double, e double, f double"


def answered(asked: DataFrame, totals: Totals, first: int, burn: int, samples: int) -> DataFrame:
    """Words of all buckets meet -> rows of ``SEATS``: what each bucket asked for, packed in the same order, and sums by class and over all words ('s')."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES + 1, 6))
        for number, rows in _runs(batches, "slice"):
            asks = [unpacked(r["payload"]) for r in rows]
            sizes = [len(x[0]) for x in asks]
            code, served_, n = (np.concatenate(x) for x in zip(*asks))
            code = code.view(np.int64)
            kind = np.repeat([r["bucket"] >> 20 for r in rows], sizes)
            cust, tab, root_c, root_t = upper_seats(code, kind, served_, totals, first, burn, samples)
            words, word = np.unique(code, return_inverse=True)
            count = np.bincount(word, n, len(words))[word]
            new = np.unique(word * CLASSES + kind, return_index=True)[1]  # a row for each dish, then for each word
            np.add.at(sums[:CLASSES, :4], kind[new], np.stack([cust[new], tab[new], cust[new] == 1, cust[new] == 2], axis=1))
            one = np.unique(word, return_index=True)[1]
            sums[CLASSES, :4] += root_c[one].sum(), root_t[one].sum(), ((root_c[one] > 0) & (root_c[one] < 1.5)).sum(), ((root_c[one] >= 1.5) & (root_c[one] < 2.5)).sum()
            sums[CLASSES, 4:] += count[one].sum(), (count[one] > 0).sum()
            ends = np.cumsum(sizes)
            kinds = (np.int64, np.float32, np.float32, np.float32, np.int64)
            out = [packed(*(x[e - m : e].astype(k) for x, k in zip((cust, tab, root_c, root_t, count), kinds))) for e, m in zip(ends, sizes)]
            none = pa.nulls(len(out), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.repeat("w", len(out)), pa.array([r["bucket"] for r in rows]), pa.array([number] * len(out)), pa.array(out, pa.binary()), *[none] * 6], names=names)
        m = CLASSES + 1
        yield pa.RecordBatch.from_arrays([pa.repeat("s", m), pa.array(np.arange(m)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), *(pa.array(sums[:, i]) for i in range(6))], names=names)

    names = [c.split()[0] for c in SEATS.split(", ")]
    rows = asked.where("kind = 'w'").select("bucket", "slice", "payload").repartition("slice").sortWithinPartitions("slice", "bucket")
    return rows.mapInArrow(run, SEATS)


def _summed(asked: DataFrame, seats: DataFrame) -> Totals:
    """The totals after a round: at most a row for each class and hot context on the driver."""
    out = Totals()
    for r in asked.where("kind <> 'w'").groupBy("kind", "code").agg(F.sum("served").alias("x"), F.sum("n").alias("y")).collect():
        if r.kind == "h":
            out.hot[r.code % 2**64] = (float(r.y), float(r.x))
        else:
            (out.twos if r.code else out.ones)[0] = float(r.x)
    for r in seats.where("kind = 's'").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in "abcdef"]).collect():
        if r.bucket < CLASSES:
            out.c[r.bucket], out.t[r.bucket] = r.a, r.b
            out.ones[1] += r.c
            out.twos[1] += r.d
        else:
            out.root_c, out.root_t, out.ones[2], out.twos[2], out.n, out.v = r.a, r.b, r.c, r.d, r.e, r.f
    return out


def _scores(tokens: DataFrame, seats: DataFrame, totals: Totals, slices: int, n: float, first: int, burn: int, samples: int) -> DataFrame:
    """``(chunk, payload)``: of each chunk and bucket the documents with their sums of log10 probability, base and known tokens."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, answers in _buckets(batches, slices):
            parent = _parent(totals, own, answers)
            p, d = np.zeros(len(own.all_w)), totals.discount(0)  # of each pair
            for i, (tables, t, c) in enumerate(own.sweeps(totals, parent, first, burn + samples)):
                if i >= burn:  # predictive probabilities are averaged, not seats
                    p += ((THETA[0] + d * t) / (THETA[0] + c))[own.all_u] * parent[own.all_w]
                    p[own.hit] += (own.customers - d * tables) / (THETA[0] + c[own.pu])
            count = answers[4]
            base = np.log10((count + 0.5) / (n + 0.5 * (totals.v + 1)))
            by_pair = (np.log10(p / samples), base[own.all_w], (count > 0)[own.all_w])
            docs, inverse = np.unique(own.doc, return_inverse=True)
            sums = [np.bincount(inverse, x[own.pair] * own.times, len(docs)) for x in by_pair]
            cuts = np.searchsorted(docs, own.edges)
            out = [packed(docs[a:b] & 0x7FFF, sums[0][a:b].astype(np.float32), sums[1][a:b], sums[2][a:b].astype(np.int64)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(own.chunks.astype(np.int64)), pa.array(out, pa.binary())], names=["chunk", "payload"])

    return _met(tokens, seats).mapInArrow(run, "chunk long, payload binary")


def _by_document(sums: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, train, n_tokens, n_known, base, score)`` of every document: a chunk's sums meet its list of documents."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "chunk"):
            ids, known, train, sizes = unpacked(rows[0]["payload"])
            total = np.zeros((3, len(ids)))
            for r in rows[1:]:
                doc, *sums = unpacked(r["payload"])
                for row, x in zip(total, sums):
                    row[doc] += x
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64), mask=known == 0), pa.array(train == 1), pa.array(sizes.astype(np.int64)), pa.array(np.rint(total[2]).astype(np.int64)), pa.array(total[1]), pa.array(total[0])], names=["id", "train", "n_tokens", "n_known", "base", "score"])

    rows = docs.select("chunk", F.lit(True).alias("listed"), "payload").union(sums.select("chunk", F.lit(False), "payload"))
    return rows.repartition("chunk").sortWithinPartitions("chunk", F.desc("listed")).mapInArrow(run, "id long, train boolean, n_tokens long, n_known long, base double, score double")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, burn: int = 1, samples: int = 3, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per input row: id, ``held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Learns from texts outside the held-out fold. Tokens: lower-cased (A-Z) runs of bytes other than space and \\x09-\\x0D,
    then one end. base_score: log10 of add-half unigram probabilities; score: log10 of the model's probability.
    Null and empty texts are one end token. Ids are whole numbers (others count as null); null ids are in the fold of the
    text 'None'; repeated rows are texts like any other. Other columns are not read. An empty table gives an empty
    result. If no text is in the training folds, every word is unknown. Scores do not depend on the partitioning
    (but for the order of floating-point sums). ``bucket_tokens``: about how many tokens a task holds at once.
    """
    of = F.when(F.col(id_col).isNull(), F.lit("None")).otherwise(F.col(id_col).cast("string"))
    texts = docs.select(F.col(id_col).try_cast("long").alias("id"), (F.crc32(of.cast("binary")) % folds != held_out).alias("train"), text_bytes(text_col).alias("t"))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")  # rows are large
    layout = sized(texts, bucket_tokens)
    rows = bucketed(prepared(pieces(texts, layout), layout), "tokens", "bucket")
    tokens, lists = rows.where("bucket >= 0"), rows.where("bucket < 0")
    totals, seats = Totals(hot={int(u): (0.0, 0.0) for u in layout.hot}), None
    for r in range(2):  # minimal seats, then a sampled round given their probabilities
        asked = staged(served(tokens, seats, totals, layout.slices, 0, 2), "asked")
        old, seats = seats, staged(answered(asked, totals, 0, burn * r, samples), "seats")
        totals = _summed(asked, seats)
        for gone in (asked, old):
            if gone is not None:
                dropped(gone)
    n = totals.n
    sums = _scores(tokens, seats, totals, layout.slices, n, 2, burn, samples)
    out = _by_document(sums, lists.select((-1 - F.col("bucket")).alias("chunk"), "payload"))
    return out.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )

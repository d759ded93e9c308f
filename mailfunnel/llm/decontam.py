"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 2).

Texts and items become sequences of lower-case words. For every item length, each window of that many words is a
candidate if a run of an item's words stands about where the item has it and enough of its words occur in the benchmark at
all (necessary conditions for the edit distance, so nothing is lost). The CGK random walk turns a window into a string of three times its length in which few edits mean few
differing positions; each of several walks is sampled at a few positions several times, and a window meets the items of
its length that agree in all positions of one sample. The number of walks follows from a target recall: for each item length,
the fewest for which that share of planted windows (items of the block with as many edits as are allowed) meets its item. Pairs that meet are verified by exact word edit distance: of the window, or
(``wide``) of the closest run of any length about the window, texts then being padded so that shortened items fill windows too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mix64, original, steps, tidied

WORD = re.compile(r"[^\W_]+")
WALKS, SAMPLES, BITS = 64, 6, 2  # WALKS: the most that are ever taken
RECALL, PLANTED = 0.999, 1000
STEP_CHARS = 2_000_000
HELD_WORDS = 4_000_000  # words of windows, or of pairs of windows and items, that are compared at once


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _walked(x: np.ndarray, walk: int, positions: np.ndarray) -> np.ndarray:
    """CGK embedding of rows of word ids, at the given (sorted, distinct) positions. Past the end it yields -1."""
    n, width = x.shape
    padded = np.concatenate([x, np.full((n, 1), -1, x.dtype)], axis=1)
    bit = mix64(padded.astype(np.uint64) + np.uint64(0x9E37 * (walk + 1)))
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, len(positions)), np.int64)
    want = {int(p): i for i, p in enumerate(positions)}
    for j in range(int(positions[-1]) + 1):
        if j in want:
            out[:, want[j]] = padded[rows, at]
        at = np.minimum(at + ((bit[rows, at] >> np.uint64(j % 61)) & np.uint64(1)).astype(np.int64), width)
    return out


def signatures(x: np.ndarray, walks: int, samples: int = SAMPLES, bits: int = BITS, first: int = 0) -> np.ndarray:
    """A row of ``walks * samples`` keys for each row of word ids: the same rules for windows and items of one length."""
    keys = []
    for w in range(first, first + walks):
        rng = np.random.default_rng((x.shape[1], w))
        drawn = [np.sort(rng.choice(2 * x.shape[1], min(bits, 2 * x.shape[1]), replace=False)) for _ in range(samples)]
        positions = np.unique(np.concatenate(drawn))
        got = _walked(x, w, positions)
        for s, p in enumerate(drawn):
            key = np.full(len(x), np.uint64(w * samples + s + 1))
            for c in np.searchsorted(positions, p):
                key = mix64(key * np.uint64(31) + got[:, c].astype(np.uint64))
            keys.append(key)
    return np.stack(keys, axis=1)


def planted(ids: np.ndarray, errors: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of word ids with ``errors`` word edits each: words changed, left out or put in alike; foreign words (0) fill a row that got shorter, and one that got longer is cut, as windows of the item's length are."""
    out = np.zeros_like(ids)
    for r, row in enumerate(ids.tolist()):
        for _ in range(errors):
            at, kind = int(rng.integers(len(row))) if row else 0, int(rng.integers(3))
            row[at : at + (kind < 2)] = [0] * (kind != 1)
        out[r, : len(row)] = row[: ids.shape[1]]
    return out


def walks_for(ids: np.ndarray, errors: int, recall: float = RECALL, rows: int = PLANTED) -> int:
    """The fewest walks with which at least ``recall`` of ``rows`` planted windows (fewer, 50 at least, for items of over 1,000 words) share a key with their item; 0 if no number up to WALKS is enough."""
    rows = max(50, min(rows, 1000 * rows // max(1, ids.shape[1])))
    rng = np.random.default_rng(ids.shape[1])
    own = ids[np.arange(rows) % len(ids)]
    window, met = planted(own, errors, rng), np.zeros(rows, bool)
    for w in range(WALKS):
        met |= (signatures(window, 1, first=w) == signatures(own, 1, first=w)).any(axis=1)
        if met.mean() >= recall:
            return w + 1
    return 0


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distance of each row of ``a`` to the same row of ``b`` (equal widths)."""
    n, width = a.shape
    steps = np.arange(width + 1)
    prev = np.broadcast_to(steps, (n, width + 1)).astype(np.int32)
    for i in range(width):
        now = np.empty_like(prev)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (b != a[:, i : i + 1]))
        prev = np.minimum.accumulate(now - steps, axis=1) + steps
        prev = prev.astype(np.int32)
    return prev[:, -1]


def closest(text: np.ndarray, item: np.ndarray, free: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The smallest word edit distance of each row of ``item`` to a run of the same row of ``text``, and where the first such run ends.

    Runs start anywhere, or (not ``free``) at the row's first word.
    """
    n, width = text.shape
    steps = np.arange(width + 1, dtype=np.int32)
    prev = np.broadcast_to(0 * steps if free else steps, (n, width + 1))
    for i in range(item.shape[1]):
        now = np.empty((n, width + 1), np.int32)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (text != item[:, i : i + 1]))
        prev = np.minimum.accumulate(now - steps, axis=1) + steps
    end = prev.argmin(axis=1)
    return prev[np.arange(n), end], end


def _gram(ids) -> np.ndarray:
    """A hash of runs of word ids, given as one array for each place in the run."""
    h = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        h = mix64(h * np.uint64(31) + np.asarray(x).astype(np.uint64))
    return h


class Items:
    """Benchmark items by length, with their tables of sampled positions. Small: items of one block only."""

    def __init__(self, rows: list[tuple[int, str]], share: float, min_words: int, wide: bool = False, recall: float = RECALL):
        self.share, self.wide, self.vocab, by = share, wide, {}, {}
        for item, text in rows:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in tokens(text or "")]
            if len(ids) >= min_words:
                by.setdefault(len(ids), []).append((item, ids))
        self.gap = 2 * int(share * max(by, default=0)) if wide else 0
        self.tables, self.runs = {}, {}
        for length, own in sorted(by.items()):
            ids = np.array([x for _, x in own], np.int64)
            walks = walks_for(ids, int(share * length), recall)
            keys = signatures(ids, walks) if walks else np.empty((len(ids), 0), np.uint64)
            order = np.argsort(keys, axis=0, kind="stable")
            self.tables[length] = ([i for i, _ in own], ids, np.take_along_axis(keys, order, 0), order)
            if not walks:  # no number of walks is enough: windows of this length meet items by an untouched run, which is exact
                self.runs[length] = self._run_index(ids, length // (int(share * length) + 1))
        # with k edits one of k + 1 equal parts of an item is untouched: a window must hold a run of that many of its words
        grams: dict[int, list[np.ndarray]] = {}
        for length, (_, ids, _, _) in self.tables.items():
            q = length // (int(share * length) + 1)
            for at in range(length - q + 1):
                h = _gram(ids[:, at : at + q].T)
                grams.setdefault(q, []).append(np.stack([h.view(np.int64), np.full(len(h), length), np.full(len(h), at)], axis=1))
        self.grams = {}
        for q, parts in grams.items():
            rows = np.unique(np.concatenate(parts), axis=0)
            self.grams[q] = (rows[:, 0], rows[:, 1], rows[:, 2])

    @staticmethod
    def _run_index(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Hashes of the items' runs of ``q`` words in order, with item and place of each."""
        h = np.stack([_gram(ids[:, at : at + q].T) for at in range(ids.shape[1] - q + 1)], axis=1)
        order = np.argsort(h.ravel(), kind="stable")
        item, at = np.divmod(order, h.shape[1])
        return h.ravel()[order], item, at, q

    def _by_run(self, flat: np.ndarray, starts: np.ndarray, length: int, errors: int) -> np.ndarray:
        """Pairs (window, item), as window * items + item, that share a run about the same place."""
        hashes, item, at, q = self.runs[length]
        met = []
        for shift in range(-errors, length + errors - q + 1):
            where = np.maximum(starts + shift, 0)
            where = np.minimum(where, len(flat) - q)
            h = _gram([flat[where + i] for i in range(q)])
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            times = high - low
            row = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            w = np.repeat(np.arange(len(starts)), times)
            near = np.abs(at[row] - shift) <= errors
            met.append(np.unique(w[near] * len(self.tables[length][0]) + item[row[near]]))
        return np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)

    def search(self, words: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """Texts as word ids -> (text index, item, start word, words, distance): the best window of each text and item."""
        gap = np.zeros(self.gap, np.int64)
        flat = np.concatenate([*(x for w in words for x in (gap, w)), gap, np.zeros(1, np.int64)])
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes + self.gap)
        begin = ends - sizes
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        near = self._near(flat, known)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for length, (items, ids, keys, order) in self.tables.items():
            if len(flat) <= length or length not in near:
                continue
            errors = int(self.share * length)
            starts = np.unique(near[length][:, None] + np.arange(-errors, errors + 1))
            starts = starts[(starts >= 0) & (starts < len(flat) - length)]
            starts = starts[known[starts + length] - known[starts] >= length - errors]
            text = np.searchsorted(ends, starts, side="right")
            text = np.minimum(text, len(words) - 1)
            past = errors if self.wide else 0
            inside = (starts >= begin[text] - past) & (starts + length <= ends[text] + past)
            starts, text = starts[inside], text[inside]
            most = max(1, min(20_000, HELD_WORDS // length))
            for low in range(0, len(starts), most):
                self._meet(flat, starts[low : low + most], text[low : low + most], begin, ends, length, errors, items, ids, keys, order, best)
        return [(t, i, s - int(begin[t]), n, d) for (t, i), (d, s, n) in best.items()]

    def _near(self, flat: np.ndarray, known: np.ndarray) -> dict[int, np.ndarray]:
        """By item length, where windows would start if a run of an item's words stood in its place."""
        found: dict[int, list[np.ndarray]] = {}
        for q, (hashes, lengths, offsets) in self.grams.items():
            at = np.flatnonzero(known[q:] - known[:-q] == q)
            h = _gram([flat[at + i] for i in range(q)]).view(np.int64)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(high > low)
            times = (high - low)[hit]
            row = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start, size = np.repeat(at[hit], times) - offsets[row], lengths[row]
            for n in np.unique(size):
                found.setdefault(int(n), []).append(start[size == n])
        return {n: np.unique(np.concatenate(x)) for n, x in found.items()}

    def _meet(self, flat, starts, text, begin, ends, length, errors, items, ids, keys, order, best) -> None:
        windows = flat[starts[:, None] + np.arange(length)]
        met = [self._by_run(flat, starts, length, errors)] if length in self.runs else []
        for c, own in enumerate(signatures(windows, keys.shape[1] // SAMPLES).T if keys.shape[1] else ()):
            low, high = np.searchsorted(keys[:, c], own, "left"), np.searchsorted(keys[:, c], own, "right")
            w = np.repeat(np.arange(len(own)), high - low)
            met.append(w * len(items) + order[np.concatenate([np.arange(a, b) for a, b in zip(low[high > low], high[high > low])] or [np.empty(0, np.int64)]), c])
        pairs = np.unique(np.concatenate(met))
        most = max(1, min(20_000, HELD_WORDS // length))
        for lo in range(0, len(pairs), most):
            w, i = np.divmod(pairs[lo : lo + most], len(items))
            if self.wide:
                w, i, far, start, size = self._runs(flat, starts, begin[text], ends[text], errors, w, i, ids)
            else:
                far, start, size = edit_distance(windows[w], ids[i]), starts[w], np.full(len(w), length)
            for k in np.flatnonzero(far <= errors):
                key, value = (int(text[w[k]]), items[i[k]]), (int(far[k]), int(start[k]), int(size[k]))
                if key not in best or value < best[key]:
                    best[key] = value


    @staticmethod
    def _runs(flat, starts, begin, ends, errors, w, i, ids) -> tuple[np.ndarray, ...]:
        """Those of the pairs (window ``w``, item ``i``) whose item has a close run about the window: w, i, distance, start and length of the run."""
        at = np.arange(ids.shape[1] + 2 * errors)
        around = flat[np.minimum(starts[w][:, None] - errors + at, len(flat) - 1)]  # past its ends a text has 2 * errors words of padding at least
        far, end = closest(around, ids[i])
        ok = far <= errors
        w, i, far, end, around = w[ok], i[ok], far[ok], end[ok], around[ok]
        back = end[:, None] - 1 - at
        _, size = closest(np.where(back >= 0, np.take_along_axis(around, np.maximum(back, 0), 1), -1), ids[i][:, ::-1], free=False)
        stop = starts[w] - errors + end
        start, stop = np.maximum(stop - size, begin[w]), np.minimum(stop, ends[w])
        return w, i, far, start, stop - start


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = 0.2, min_words: int = 5, block: int = 20_000, wide: bool = False) -> DataFrame:
    """``id, item_id, distance, n_words, start_char, end_char``: the closest window of each text and item that it holds.

    A text holds an item of L words if a window of L of its words is within floor(``share`` * L) word edits (0.8 similarity by
    default); with ``wide``, if a run of any number of its words is, and ``n_words`` is the length of the closest run. Items of fewer than ``min_words`` words never match, nor do null or empty ones. Repeated rows give a
    row each; ids may be null; other columns are not read. An empty table on either side gives an empty
    result. The benchmark goes to the tasks in blocks of about ``block`` items, so what is sent has a bound; a larger
    benchmark takes more passes over ``docs``.
    """
    some = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    n = some.count()
    blocks = max(1, -(-n // block))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    base = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    out = None
    for b in range(blocks):
        rows = some.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        items = Items([(r.i, r.t) for r in rows], share, min_words, wide)
        found = base.mapInArrow(_searcher(items, item_col, to_arrow_type(item_kind)), f"`{id_col}` {kind}, `{item_col}` {item_kind.simpleString()}, distance int, n_words int, start_char long, end_char long")
        out = found if out is None else out.union(found)
    return out


def _searcher(items: Items, item_col: str, item_kind: pa.DataType):
    kinds = (item_kind, pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items.vocab.get
        for b in batches:
            for low, high in steps(pc.utf8_length(b.column(1)).to_pylist(), STEP_CHARS):
                part = b.slice(low, high - low)
                texts = part.column(1).to_pylist()
                ids = [np.array([get(w, 0) for w in tokens(t)], np.int64) for t in texts]
                found = sorted(items.search(ids), key=lambda f: (f[0], str(f[1]), f[2:])) if ids else []
                spans: dict[int, list[tuple[int, int]]] = {}
                rows = []
                for t, item, start, n, far in found:
                    if t not in spans:
                        back = original(texts[t], low_text := texts[t].lower())
                        spans[t] = [back(*m.span()) for m in WORD.finditer(low_text)]
                    rows.append((item, far, n, spans[t][start][0], spans[t][start + n - 1][1]))
                if rows:
                    own = part.column(0).take(pa.array([f[0] for f in found]))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[part.schema.names[0], item_col, "distance", "n_words", "start_char", "end_char"])

    return run


def leaked(items: Items):
    """A column function: text -> whether it holds any item."""

    @tidied
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            hit = np.zeros(len(texts), bool)
            for low, high in steps(texts.str.len().tolist(), STEP_CHARS):
                ids = [np.array([items.vocab.get(w, 0) for w in tokens(t)], np.int64) for t in texts.iloc[low:high]]
                hit[[low + f[0] for f in items.search(ids)]] = True
            yield pd.Series(hit)

    @F.pandas_udf("boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return hits(batches)

    return of


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = 0.2, min_words: int = 5, block: int = 20_000, wide: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    some = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    blocks = max(1, -(-some.count() // block))
    out = docs
    for b in range(blocks):
        rows = some.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        out = out.where(~leaked(Items([(r.i, r.t) for r in rows], share, min_words, wide))(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return out

"""Toxicity by a linear-chain conditional random field (operator 5).

Training: a bounded sample of labelled documents. Token labels come from the documents' labels: a token counts as toxic if
its document does and one of its features (word, word starts) is significantly tied to toxic documents. A CRF with
two states (clean, toxic) is fitted to these by gradient ascent on the exact likelihood (forward-backward).
Scoring: forward-backward marginals of every token of every whole text; the document's score is a logistic function of
what the marginals say together; tokens above one half form the offending spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, original, steps, tidied

TOKEN = re.compile(r"[^\W_]+")
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_TOKENS = 1000, 3000, 2_000_000
STEP_CHARS = 2_000_000


def features(word: str) -> list[str]:
    """The features of a token: the word itself and its starts of 3 to 6 letters."""
    return [f"w={word}", *(f"{n}={word[:n]}" for n in range(3, 7) if len(word) > n)]


class _Emissions(dict):
    """Emissions by word, each worked out once; what is remembered is bounded."""

    def __init__(self, model: Crf, most: int = 300_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.model.emission(word)
        return value


@dataclass
class Crf:
    """Emission weights of the toxic state by feature (clean is 0), a transition matrix, start weights, and the document layer."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    layer: np.ndarray = field(default_factory=lambda: np.array([-3.0, 6.0, 0.0]))
    cache: _Emissions | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": None}

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def emissions(self, words: Iterable[list[str]]) -> list[np.ndarray]:
        """Emission of every token; of an iterator only one text's words are held at a time."""
        if self.cache is None:
            self.cache = _Emissions(self)
        get = self.cache.__getitem__
        return [np.fromiter(map(get, w), np.float64, len(w)) for w in words]

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of every token: forward-backward in probability space over all texts at once, one step a position."""
        order = np.argsort([-len(e) for e in emissions], kind="stable")
        sizes = np.array([len(emissions[i]) for i in order])
        width = int(sizes[0]) if len(sizes) else 0
        if not width:
            return [np.zeros(0) for _ in emissions]
        # the texts still alive at position t are the first alive[t] in order of length
        alive = np.searchsorted(-sizes, -np.arange(width), side="left")
        offset = np.concatenate([[0], np.cumsum(alive)])
        odds = np.empty(offset[-1])
        where = [offset[: s] + rank for rank, s in enumerate(sizes)]
        for rank, i in enumerate(order):
            odds[where[rank]] = emissions[i]
        odds = np.exp(np.clip(odds, -30, 30))
        t = np.exp(self.trans)
        s0, s1 = np.exp(self.start)
        ahead, behind = np.empty(len(odds)), np.empty(len(odds))  # P(toxic) so far, and from here on
        a = slice(0, alive[0])
        x1 = s1 * odds[a]
        ahead[a] = x1 / (x1 + s0)
        for k in range(1, width):
            p = ahead[offset[k - 1] : offset[k - 1] + alive[k]]
            x1 = (p * t[1, 1] + (1 - p) * t[0, 1]) * odds[offset[k] : offset[k + 1]]
            ahead[offset[k] : offset[k + 1]] = x1 / (x1 + p * t[1, 0] + (1 - p) * t[0, 0])
        behind[offset[width - 1] :] = 0.5
        for k in range(width - 2, -1, -1):
            now, m = slice(offset[k], offset[k + 1]), alive[k + 1]
            nxt = behind[offset[k + 1] : offset[k + 1] + m]
            x1 = nxt * odds[offset[k + 1] : offset[k + 1] + m]
            b1, b0 = x1 * t[1, 1] + (1 - nxt) * t[1, 0], x1 * t[0, 1] + (1 - nxt) * t[0, 0]
            behind[now] = 0.5
            behind[offset[k] : offset[k] + m] = b1 / (b1 + b0)
        both = ahead * behind / (ahead * behind + (1 - ahead) * (1 - behind))
        out: list[np.ndarray] = [np.zeros(0)] * len(emissions)
        for rank, i in enumerate(order):
            out[i] = both[where[rank]]
        return out

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(_layer_input(marginals) @ self.layer)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _layer_input(marginals: list[np.ndarray]) -> np.ndarray:
    rows = [(1.0, m.max() if len(m) else 0.0, math.log1p(m.sum())) for m in marginals]
    return np.array(rows).reshape(-1, 3)


def _tied(docs: list[tuple[list[str], int]], weakest: float = 1e-4) -> set[str]:
    """Features tied to toxic documents beyond chance (the base rate to the power of the count), chosen so that each adds to the others.

    The feature that explains most toxic documents not yet explained comes first; it ends when a feature's gain could be
    chance. So the rare words of a toxic document with many copies are not taken for toxic themselves.
    """
    inside: dict[str, set[int]] = {}
    for i, (words, label) in enumerate(docs):
        if label:
            for f in {f for w in set(words) for f in features(w)}:
                inside.setdefault(f, set()).add(i)
    base = max(1e-3, sum(label for _, label in docs) / max(1, len(docs)))
    least = math.ceil(math.log(weakest) / math.log(base))
    inside = {f: d for f, d in inside.items() if len(d) >= least}
    outside = Counter()
    for words, label in docs:
        if not label:
            outside.update(inside.keys() & {f for w in set(words) for f in features(w)})
    inside = {f: d for f, d in inside.items() if outside[f] <= 0.02 * len(d)}
    chosen: set[str] = set()
    gain = max(2, least // 2)
    while inside:
        f = max(inside, key=lambda x: (len(inside[x]), -len(x), x))
        if len(inside[f]) < gain:
            break
        gone = inside.pop(f)
        chosen.add(f)
        inside = {g: d - gone for g, d in inside.items() if len(d - gone) >= gain}
    return chosen


def fit(labelled: list[tuple[str, int]], rounds: int = 40, rate: float = 1.0) -> Crf:
    """A CRF from ``(text, label)`` pairs. Without toxic or without clean ones it scores all texts low or high alike."""
    docs = [(TOKEN.findall((t or "").lower()), int(y)) for t, y in labelled]
    model = Crf()
    share = (sum(y for _, y in docs) + 0.5) / (len(docs) + 1)
    if not docs or share in (0, 1) or len({y for _, y in docs}) < 2:
        model.layer = np.array([math.log(share / (1 - share)) if docs else -3.0, 0.0, 0.0])
        return model
    tied = _tied(docs)
    names: dict[str, int] = {f: i for i, f in enumerate(sorted(tied))}
    words: dict[str, int] = {}
    for ws, _ in docs:
        for w in ws:
            words.setdefault(w, len(words))
    hot = [[names[f] for f in features(w) if f in names] for w in words]
    owner, feat = np.repeat(np.arange(len(hot)), [len(h) for h in hot]), np.array([f for h in hot for f in h], np.int64)
    is_tied = np.array([bool(h) for h in hot])
    ids = [np.array([words[w] for w in ws], np.int64) for ws, _ in docs]
    gold = [is_tied[x] & bool(y) for x, (_, y) in zip(ids, docs)]
    weights = np.zeros(len(names))
    pairs = np.zeros((2, 2))
    for g in gold:
        np.add.at(pairs, (g[:-1].astype(int), g[1:].astype(int)), 1)
    model.trans = np.log((pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True))
    n_hot = sum(int(g.sum()) for g in gold)
    model.bias = 0.0
    by_word_gold = np.zeros(len(hot))
    for x, g in zip(ids, gold):
        np.add.at(by_word_gold, x, g)
    square = np.zeros(len(weights) + 1)
    for _ in range(rounds if n_hot else 0):
        emission = model.bias + np.bincount(owner, weights[feat], len(hot)) if len(feat) else np.full(len(hot), model.bias)
        marg = model.marginals([emission[x] for x in ids])
        expected = np.zeros(len(hot))
        for x, m in zip(ids, marg):
            np.add.at(expected, x, m)
        gap = by_word_gold - expected
        grad = np.concatenate([np.bincount(feat, gap[owner], len(weights)) - 0.05 * weights, [gap.sum()]])
        square += grad * grad
        step = rate * grad / (np.sqrt(square) + 1e-8)
        weights, model.bias = weights + step[:-1], model.bias + float(step[-1])
    model.weights = {f: float(weights[i]) for f, i in names.items() if weights[i]}
    marg = model.marginals(model.emissions([ws for ws, _ in docs]))
    x, y = _layer_input(marg), np.array([v for _, v in docs], float)
    layer = np.zeros(3)
    for _ in range(50):  # Newton's method, with a small ridge
        p = _sigmoid(x @ layer)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        layer += np.linalg.solve(h, x.T @ (y - p) - 0.1 * layer)
    model.layer = layer
    return model


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN, most_chars: int = 6 * SAMPLE_TOKENS) -> Crf:
    """A model of a bounded sample of the labelled rows outside the held-out fold.

    At most ``most_toxic`` and ``most_clean`` documents and ``most_chars`` characters are used, those with the smallest
    hashes; an id with several labels counts as toxic if any says so; rows without id or label teach nothing.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % folds != held_out).withColumn("h", F.xxhash64("id"))
    chosen = known.where("y = 1").orderBy("h", "id").limit(most_toxic).union(known.where("y = 0").orderBy("h", "id").limit(most_clean))
    chosen = F.broadcast(chosen.select("id", "y", "h"))  # at most most_toxic + most_clean rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(chosen, "id")
    # as many of them, in hash order, as the character budget allows; at most twice as many rows (repeated ids)
    rows = rows.orderBy("h", "t").limit(2 * (most_toxic + most_clean))
    sample, size = [], 0
    for r in rows.toLocalIterator():
        if size + len(r.t or "") <= most_chars:
            sample.append((r.t or "", r.y))
            size += len(r.t or "")
    return fit(sample)


def score_column(model: Crf):
    """A column function: text -> score."""

    @tidied
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept(None, lambda: None)
        for texts in batches:
            score = np.zeros(len(texts))
            for at, marg in _marginals(model, texts):
                score[at] = model.score(marg)
            yield pd.Series(score)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return scores(batches)

    return of


def _marginals(model: Crf, texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """``(indexes, marginals)`` of texts of like length together, a bounded number of characters at a time."""
    whole = [t or "" for t in texts]
    order = sorted(range(len(whole)), key=lambda i: len(whole[i]))
    for low, high in steps([len(whole[i]) for i in order], STEP_CHARS):
        at = order[low:high]
        yield at, model.marginals(model.emissions(TOKEN.findall(whole[i].lower()) for i in at))


def judged(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per input row: id, ``held_out, score, predicted, n_spans, first_start, first_end`` and ``spans``, all offending ones.

    Spans are ``(start, end)`` in characters of the text as it is; without any, the first is (-1, -1). Null and empty texts
    get the score of a text without any evidence. Repeated rows get a row each; ids may be of any type and null
    (held_out is then by the text 'None'). Other columns are not read. An empty table gives an empty result.
    """
    of = F.coalesce(F.col(id_col).cast("string"), F.lit("None"))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None, lambda: None)
        for b in batches:
            score, texts = np.zeros(b.num_rows), [t or "" for t in b.column(2).to_pylist()]
            spans: list[list[tuple[int, int]]] = [[]] * len(texts)
            for at, marg in _marginals(model, texts):
                score[at] = model.score(marg)
                for i, m in zip(at, marg):
                    spans[i] = _spans(texts[i], m)
            first = np.array([s[0] if s else (-1, -1) for s in spans], np.int64).reshape(-1, 2)
            cols = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(s) for s in spans], pa.int32()), pa.array(first[:, 0]), pa.array(first[:, 1]), pa.array([[{"start": a, "end": e} for a, e in s] for s in spans], span)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "held_out", "score", "predicted", "n_spans", "first_start", "first_end", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), (F.crc32(of.cast("binary")) % folds == held_out).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, n_spans int, first_start long, first_end long, spans array<struct<start: bigint, end: bigint>>").withColumnRenamed("id", id_col)


def _spans(text: str, marginals: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of runs of tokens more likely toxic than not."""
    if not len(marginals) or marginals.max() <= 0.5:
        return []
    out: list[tuple[int, int]] = []
    inside, low = False, text.lower()
    back = original(text, low)
    for m, p in zip(TOKEN.finditer(low), marginals):
        if p > 0.5:
            start, end = back(*m.span())
            out.append((out.pop()[0], end) if inside else (start, end))
        inside = p > 0.5
    return out


def clean(docs: DataFrame, model: Crf, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns.

    Null and empty texts are judged as texts without evidence; repeated rows are judged alike; an empty table stays empty.
    """
    return docs.where(score_column(model)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < threshold)

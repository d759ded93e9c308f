"""Exact top-k inner-product search by pivot-table elimination (operator 1).

The pivot table: distances of every vector to a few fixed vectors and to the origin. For a query q and rows x the
largest gap between their distances to a pivot bounds |q - x| from below, and with the norms this bounds the inner
product from above: q.x <= (|q|^2 + |x|^2 - gap^2) / 2. Three tiers use it, the coarser first:

1. a floor for each query: its k-th score among a sample of fixed size;
2. blocks of queries and rows around the same pivots: a pair of blocks whose bound is below the lowest floor never meets;
3. in a pair of blocks, leaves of a few hundred rows: every query takes the leaf with its highest bound next and stops
   when that bound is below its k-th score, which makes the result exact. Leaves are evaluated as matrix products.

Each pair of blocks yields at most k rows a query, and these are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LEAF, SAMPLE, RINGS = 256, 4096, 16
LONG = 2**63 - 1
_HUGE = float(np.finfo(np.float64).max)


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles, filled up with zeros."""
    out, sizes = np.zeros((len(col), width)), col.value_lengths().to_numpy(zero_copy_only=False)
    values = col.flatten().to_numpy(zero_copy_only=False)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(col)), sizes), np.arange(len(values)) - starts] = values
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to the pivots and, last, to the origin. Exact up to the root while squares stay below 2^53."""
    own = (x * x).sum(1)
    square = own[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0, np.concatenate([square, own[:, None]], axis=1)))


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of scored pairs the k best of each query: higher scores first, then smaller ids."""
    order = np.lexsort((ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
    keep = place < k
    return query[keep], row[keep], score[keep]


def search(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, x: np.ndarray, xid: np.ndarray, pivots: np.ndarray, k: int, most: int = 2_000_000) -> tuple[np.ndarray, ...]:
    """(query, row, score) of each query's k best rows among ``x``, but for rows below its floor. Scores are whole and below 2^53."""
    qd, xd = distances(q, pivots), distances(x, pivots)
    near = xd.argmin(1)
    order = np.lexsort((xd[np.arange(len(x)), near], near))
    x, xid, xd = x[order], xid[order], xd[order]
    starts = np.arange(0, len(x), LEAF)
    low, high = np.minimum.reduceat(xd, starts, axis=0), np.maximum.reduceat(xd, starts, axis=0)
    gap = np.zeros((len(q), len(starts)))
    for p in range(qd.shape[1]):
        own = qd[:, p : p + 1]
        np.maximum(gap, np.maximum(own - high[:, p], low[:, p] - own), out=gap)
    norms = (q * q).sum(1)[:, None] + np.square(high[:, -1])
    upper = (norms - gap * gap) / 2 + 1e-9 * norms + 1e-6  # the last two for rounding
    turn = np.argsort(-upper, axis=1, kind="stable")
    top, kth = np.full((len(q), k), -np.inf), floor.astype(np.float64)
    found: list[tuple[np.ndarray, ...]] = []
    alive, held = np.arange(len(q)), 0
    for r in range(len(starts)):
        leaf = turn[alive, r]
        go = upper[alive, leaf] >= kth[alive]  # later bounds are no higher: the rest stop here
        alive, leaf = alive[go], leaf[go]
        if not len(alive):
            break
        by = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by])) + 1
        for group in np.split(by, cuts):
            a, own = starts[leaf[group[0]]], alive[group]
            score = np.rint(q[own] @ x[a : a + LEAF].T)
            score[xid[a : a + LEAF][None] == qid[own][:, None]] = -np.inf
            i, j = np.nonzero((score >= kth[own][:, None]) & (score > -np.inf))
            if not len(i):
                continue
            found.append((own[i], a + j, score[i, j]))
            held += len(i)
            better = np.unique(i)
            rows = own[better]
            top[rows] = -np.partition(-np.concatenate([top[rows], score[better]], axis=1), k - 1, axis=1)[:, :k]
            kth[rows] = np.maximum(kth[rows], top[rows].min(1))
        if held > most:  # many ties
            found = [_best(*(np.concatenate(c) for c in zip(*found)), xid, k)]
            held = len(found[0][0])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    query, row, score = _best(*(np.concatenate(c) for c in zip(*found)), xid, k)
    return query, order[row], score.astype(np.int64)


def search_wide(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, score, beyond) for components of any size, without bounds: whole numbers as wide as needed, ranked as they are.

    A score that fits no long comes as the nearest one, with ``beyond`` 1 or -1 (else 0).
    """
    big = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1]) > LONG
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) if big else m.astype(np.int64)
    qs, xs = whole(q), whole(x)
    out = []
    for i in range(len(q)):
        score = xs @ qs[i]
        at = np.flatnonzero(xid != qid[i])
        if big:
            at = np.array(sorted(at.tolist(), key=lambda j: (-score[j], xid[j]))[:k], np.int64)
            beyond = np.array([(score[j] > LONG) - (score[j] < -LONG - 1) for j in at], np.int64)
            score = np.array([min(LONG, max(-LONG - 1, score[j])) for j in at], np.int64)
        else:
            at = at[np.lexsort((xid[at], np.invert(score[at])))[:k]]
            score, beyond = score[at], np.zeros(len(at), np.int64)
        out.append((np.full(len(at), i), at, score, beyond))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 4


def _joined(rows: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], str]:
    """(cell, ring) -> ``first block, number of blocks``: neighbouring rings of a cell share a block of at most ``most`` rows, a larger ring has several."""
    out, used, load = {}, {}, {}
    for c, r in sorted(rows):
        n = rows[c, r]
        if load.get(c) is None or load[c] + n > most:
            out[c, r] = f"{used.get(c, 0)},{max(1, -(-n // most))}"
            used[c] = used.get(c, 0) + max(1, -(-n // most))
            load[c] = n if n <= most else most
        else:
            out[c, r] = f"{used[c] - 1},1"
            load[c] += n
    return out


def _sampled(rows: DataFrame, n: int) -> list:
    """``n`` rows with the smallest hashes: a sample of fixed size that does not depend on the partitioning."""
    return rows.where("not wide").orderBy("own", "id").limit(n).select("id", "x").collect()


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, query_step: int = 20, pivots: int = 24, near: int = 8, block: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``query_step`` its k best other rows.

    Components become floor(scale * x) in double; the score is their exact inner product, and rows are ranked by it. A score
    among a query's ``k`` that fits no long is an error.
    Ties go to the smaller id. Rows take no part if the id is null or no whole number, or the vector is null or holds a
    null or non-finite component. Shorter vectors count as filled up with zeros. Rows repeated exactly are candidates
    as often as they stand there, and are asked once; an id with several vectors has one ranking for each. Rows with
    the query's id are never its candidates. With fewer than k other rows all are returned; an empty table gives an
    empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    fine = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).try_cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("raw")).where("id is not null")
    width, peak = rows.agg(F.coalesce(F.max(F.size("raw")), F.lit(0)), F.max(F.coalesce(F.array_max(F.transform("raw", F.abs)), F.lit(0.0)))).first()
    rows = rows.groupBy("id", "raw").agg(F.count("*").alias("n"))
    limit = 2.0 ** ((53 - max(1, width).bit_length()) // 2)  # products of components up to it add up below 2^53
    top = min(limit, np.ceil((peak or 0.0) * abs(scale)) + 1)
    kind = next(t for t in (np.int8, np.int16, np.int32) if top <= np.iinfo(t).max)

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(matrix(b.column(1), width) * scale), -_HUGE, _HUGE)
            wide = np.abs(x).max(axis=1, initial=0) > limit
            data = [(r if w else r.astype(kind)).tobytes() for r, w in zip(x, wide)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), b.column(2), b.column(3), pa.array(wide)], names=["id", "x", "n", "own", "wide"])

    base = staged(rows.select("id", "raw", "n", F.xxhash64("id", "raw").alias("own")).mapInArrow(floored, "id long, x binary, n long, own long, wide boolean"), "vectors")
    mat = lambda c: np.frombuffer(b"".join(c), kind).reshape(len(c), width).astype(np.float64) if width and len(c) else np.zeros((len(c), max(1, width)))
    some = _sampled(base, SAMPLE)
    sample, sample_ids = mat([bytes(r.x) for r in some]), np.array([r.id for r in some], np.int64)
    table = np.unique(sample[:pivots], axis=0)
    centres = table[:near]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = b.column(4).to_numpy(zero_copy_only=False)
            cell, floor, d = np.full(b.num_rows, len(centres) + 1), np.full(b.num_rows, -np.inf), np.zeros((b.num_rows, len(table) + 1))
            at, ids = np.flatnonzero(~wide), b.column(0).to_numpy()
            if len(at):
                x = mat(b.column(1).take(pa.array(at)).to_pylist())
                d[at] = distances(x, table)
                cell[at] = d[at][:, : len(centres)].argmin(1)
                ask = np.flatnonzero(ids[at] % query_step == 0)
                for low in range(0, len(ask), 500):
                    part = ask[low : low + 500]
                    score = np.rint(x[part] @ sample.T)
                    score[sample_ids[None] == ids[at][part][:, None]] = -np.inf
                    if len(sample) >= k:
                        floor[at[part]] = np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]
            dist = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(cell.astype(np.int32)), pa.array(floor), dist], names=["id", "x", "n", "own", "wide", "cell", "floor", "d"])

    base = staged(base.mapInArrow(placed, "id long, x binary, n long, own long, wide boolean, cell int, floor double, d array<double>"), "pivots")
    asked = F.col("id") % query_step == 0
    # a cell is cut into rings of distance to its own pivot, by quantiles of the sample, so that the bounds of its blocks differ
    inner, rings = distances(sample, table)[:, : len(centres)], {}
    for c in range(len(centres)):
        own = inner[inner.argmin(1) == c, c]
        rings[c] = sorted({float(v) for v in np.quantile(own, np.arange(1, RINGS) / RINGS)}) if len(own) else []
    edges = F.create_map(*[x for c, r in rings.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in r]).cast("array<double>"))] or [F.lit(0), F.array().cast("array<double>")])
    far = F.element_at("d", F.col("cell") + 1)  # cells after the last pivot hold the wide rows, which have no distances
    ring = F.coalesce(F.size(F.filter(edges[F.col("cell")], lambda e: e <= far)), F.lit(0)) if len(centres) else F.lit(0)
    base = base.withColumn("ring", ring)
    parts = {(r.cell, r.ring): (r.n, r.q) for r in base.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).collect()}  # RINGS rows a pivot
    runs = [_joined({p: n for p, (n, _) in parts.items()}, block), _joined({p: q for p, (_, q) in parts.items()}, max(1, block // 8))]

    def number(i: int):
        """Which block of its cell a row belongs to: several rings that are small together, or a share of one by hash."""
        known = F.create_map(*[F.lit(v) for (c, r), own in runs[i].items() for v in (c * RINGS + r, own)] or [F.lit(0), F.lit("0,1")])
        first_n = F.split(known[F.col("cell") * RINGS + F.col("ring")], ",")
        return first_n[0].cast("int") + F.pmod("own", first_n[1].cast("long")).cast("int")

    data = base.withColumn("xb", F.struct("cell", number(0).alias("part")))
    asks = base.where(asked).withColumn("qb", F.struct("cell", number(1).alias("part")))
    cells = sorted({c for c, _ in parts})
    ends = lambda of: [F.array(*[of(F.col("d")[i]) for i in range(len(table) + 1)])]
    x_blocks = data.groupBy("xb", "wide").agg(ends(F.min)[0].alias("low"), ends(F.max)[0].alias("high"))
    q_blocks = asks.groupBy("qb", F.col("wide").alias("q_wide")).agg(ends(F.min)[0].alias("q_low"), ends(F.max)[0].alias("q_high"), F.min("floor").alias("floor"))
    # which pairs of blocks may hold a result: every block of queries against every block of rows, by summaries of fixed size
    x_blocks = x_blocks.withColumn("c", F.explode(F.array(*[F.lit(c) for c in cells] or [F.lit(0)])))
    met = x_blocks.join(q_blocks.withColumn("c", F.col("qb.cell")), "c")
    gap = F.greatest(F.lit(0.0), F.lit(0.0), *[F.greatest(F.col("q_low")[i] - F.col("high")[i], F.col("low")[i] - F.col("q_high")[i]) for i in range(len(table) + 1)])
    norms = F.pow(F.col("q_high")[len(table)], 2) + F.pow(F.col("high")[len(table)], 2)
    pairs = staged(met.where(F.col("wide") | F.col("q_wide") | (((norms - gap * gap) / 2 + norms * 1e-9 + 1e-6) >= F.col("floor"))).select("xb", "qb"), "pairs")
    anew = lambda df, names: df.select(*[F.col(c).alias(c) for c in names])
    left = anew(asks.join(pairs, "qb"), ["id", "own", "x", "wide", "floor", "qb", "xb"])
    right = anew(data.join(pairs, "xb"), ["id", "n", "x", "wide", "qb", "xb"])

    def cell(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        got = []
        for qw in (False, True):
            for xw in (False, True):
                a, b = q[q.wide == qw], x[x.wide == xw]
                if len(a) and len(b):
                    read = lambda f, w: np.frombuffer(b"".join(f.x), np.float64).reshape(len(f), width) if w else mat(list(f.x))
                    qs, xs, qid, xid = read(a, qw), read(b, xw), a.id.to_numpy(), b.id.to_numpy()
                    i, j, s, *beyond = search_wide(qs, qid, xs, xid, k) if qw or xw else search(qs, qid, a.floor.to_numpy(), xs, xid, table, k)
                    got.append(pd.DataFrame({"query_id": qid[i], "own": a.own.to_numpy()[i], "vec_id": xid[j], "n": b.n.to_numpy()[j], "score": s, "beyond": beyond[0] if beyond else np.zeros(len(i), np.int64)}))
        return pd.concat(got) if got else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "own", "vec_id", "n", "score", "beyond")})

    found = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInPandas(cell, "query_id long, own long, vec_id long, n long, score long, beyond long")
    found = found.withColumn("n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id", "own").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    told = F.concat(F.lit("the score of query "), F.col("query_id").cast("string"), F.lit(" and row "), F.col("vec_id").cast("string"), F.lit(" fits no long"))
    return best.select("query_id", "rank", "vec_id", F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(told).cast("long")).alias("score"))

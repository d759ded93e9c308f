"""SimHash near-duplicates by a binary-trie self-join (operator 8).

Fingerprints are computed from whole texts. Two fingerprints within ``errors`` bits agree entirely in one of
``errors + 1`` bit blocks, so the trie is built once for each rotation that puts that block first; under such a first
block (the root of a subtrie) node pairs are walked together, differing bits are added up, and a pair is left as
soon as its sum exceeds the budget. A subtrie is one task's work; subtries with many fingerprints are dealt out as
pairs of their own children. Only a spanning set of links leaves a task, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_bytes
from .components import components

_ONE = np.uint64(1)


def _fingerprint(text: bytes, words: int) -> int:
    tokens = text.lower().split()  # bytes: A-Z only, white space \x20 \x09-\x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for low in range(0, n, 65536):  # bounds the memory of one very long text
        high = min(n, low + 65536)
        starts = [0, *ends[: high - 1]][low:] if low == 0 else ends[low - 1 : high - 1]
        stops = ends[low + words - 1 : high + words - 1] or [len(joined) + 1]
        h = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, fp)``: each row's 64-bit fingerprint as a signed long. Null and empty texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([_fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def fingerprint_column(words: int = 4):
    """A column function: UTF-8 bytes -> fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([_fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return of


def _blocks(errors: int) -> list[tuple[int, int]]:
    """(shift, bits) of the first block of each rotation."""
    edges = [round(64 * i / (errors + 1)) for i in range(errors + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rotated(x: np.ndarray, shift: int) -> np.ndarray:
    return x if shift == 0 else (x << np.uint64(shift)) | (x >> np.uint64(64 - shift))


def _walk(values: np.ndarray, low: tuple[int, int], high: tuple[int, int], depth: int, errors: int, leaf: int = 48, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted rotated ``values`` within ``errors`` bits, from node pair (low, high) that share ``depth`` bits of path.

    ``root``: node pairs whose values all have one root by now are left out.
    """
    stack = [(*low, *high, depth, 0)]
    while stack:
        a, b, c, d, bit, wrong = stack.pop()
        same = (a, b) == (c, d)
        if a == b or c == d or (same and b - a < 2):
            continue
        if root is not None and (root[a:b] == root[a]).all() and (root[c:d] == root[a]).all():
            continue
        if (b - a) * (d - c) <= leaf * leaf or bit == 64:
            for i in range(a, b, max(leaf, 512)):  # equal values can be many
                x, y = np.nonzero(np.bitwise_count(values[i : min(b, i + max(leaf, 512)), None] ^ values[None, c:d]) <= errors)
                x, y = x + i, y + c
                if same:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    yield x, y
            continue
        mask = _ONE << np.uint64(63 - bit)
        cut = lambda p, q: p + int(np.searchsorted((values[p:q] & mask) != 0, True))
        m = cut(a, b)
        n = m if same else cut(c, d)
        stack.append((a, m, c, n, bit + 1, wrong))
        stack.append((m, b, n, d, bit + 1, wrong))
        if wrong < errors:  # the budget still allows this bit to differ
            stack.append((a, m, n, d, bit + 1, wrong + 1))
            if not same:
                stack.append((m, b, c, n, bit + 1, wrong + 1))


def _joined(root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
    """Joins in ``root``, in place, what the pairs link."""
    for x, y in pairs:
        while True:
            rx, ry = root[x], root[y]
            differ = rx != ry
            if not differ.any():
                break
            np.minimum.at(root, np.maximum(rx, ry)[differ], np.minimum(rx, ry)[differ])
            while not np.array_equal(jumped := root[root], root):
                root[:] = jumped


def _links(values: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A forest that spans the linked values: (value, root) for each that has a link."""
    root = np.arange(len(values))
    _joined(root, pairs)
    far = root != np.arange(len(values))
    return values[far], values[root[far]]


def trie_links(prints: DataFrame, errors: int = 4, most: int = 20_000) -> DataFrame:
    """Distinct fingerprints ``prints(fp)`` -> ``(a, b)`` long: links that connect just what Hamming distance ``errors`` connects.

    ``most``: subtries with more fingerprints are dealt out as pairs of child nodes (again and again, one more byte
    deep each time), so that no task holds an unbounded group.
    """
    blocks = _blocks(errors)
    arms = [
        prints.select(F.lit(r).alias("r"), F.expr(f"shiftrightunsigned({rot}, {64 - bits})").alias("node"), F.expr(rot).alias("v"))
        for r, (shift, bits) in enumerate(blocks)
        for rot in [f"((fp << {shift}) | shiftrightunsigned(fp, {64 - shift}))" if shift else "fp"]
    ]
    nodes = arms[0]
    for arm in arms[1:]:
        nodes = nodes.union(arm)
    nodes = nodes.select("r", F.col("node").alias("key"), F.col("node").alias("other"), F.lit(0).alias("side"), "v")
    return walked(nodes, blocks, errors, most, lambda own: _local_links(own, blocks, errors))


def walked(nodes: DataFrame, blocks: list[tuple[int, int]], errors: int, most: int, local: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``local`` finds in the node pairs of ``nodes(r, key, other, side, v, ...)``; those of more than ``most`` values are dealt out as pairs of children first."""
    found: list[DataFrame] = []
    for depth in range(8):
        big = staged(nodes.groupBy("r", "key", "other").agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n"), "big")
        deepest = max(bits for _, bits in blocks) + 8 * (depth + 1) > 64
        if deepest or big.isEmpty():
            found.append(local(nodes))
            break
        found.append(local(nodes.join(big, ["r", "key", "other"], "left_anti")))
        nodes = staged(_children(nodes.join(big, ["r", "key", "other"], "left_semi"), blocks, errors, depth), "children")
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def _children(nodes: DataFrame, blocks: list[tuple[int, int]], errors: int, depth: int) -> DataFrame:
    """Node pairs one byte deeper: every value goes to the pairs of its own child with all non-empty children in budget."""
    first = "element_at(array(" + ", ".join(str(b) for _, b in blocks) + "), r + 1)"
    byte = nodes.withColumn("c", F.expr(f"cast(shiftrightunsigned(v, cast(64 - {first} - {8 * (depth + 1)} as int)) & 255 as int)"))
    kids = byte.select("r", "key", "other", "side", "c").distinct()
    mine, theirs = kids.alias("m"), kids.alias("t")
    same = (F.col("m.key") == F.col("m.other"))
    pairs = mine.join(theirs, (F.col("m.r") == F.col("t.r")) & (F.col("m.key") == F.col("t.key")) & (F.col("m.other") == F.col("t.other")) & F.when(same, F.col("m.c") <= F.col("t.c")).otherwise((F.col("m.side") == 0) & (F.col("t.side") == 1)) & (F.bit_count(F.col("m.c").bitwiseXOR(F.col("t.c"))) <= errors))
    pairs = pairs.select(F.col("m.r").alias("r"), F.col("m.key").alias("key"), F.col("m.other").alias("other"), F.col("m.side").alias("s1"), F.col("m.c").alias("c1"), F.col("t.side").alias("s2"), F.col("t.c").alias("c2"))
    ends = pairs.select("*", F.explode(F.when((F.col("s1") == F.col("s2")) & (F.col("c1") == F.col("c2")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("new"))
    ends = ends.withColumn("side", F.when(F.col("new") == 0, F.col("s1")).otherwise(F.col("s2"))).withColumn("c", F.when(F.col("new") == 0, F.col("c1")).otherwise(F.col("c2")))
    joined = byte.join(ends, ["r", "key", "other", "side", "c"])
    same_now = (F.col("s1") == F.col("s2")) & (F.col("c1") == F.col("c2"))
    key = F.xxhash64("key", "other", "s1", "c1", "s2", "c2")
    return joined.select("r", key.alias("key"), F.when(same_now, key).otherwise(F.lit(-1) - key).alias("other"), F.when(same_now, F.lit(0)).otherwise(F.col("new")).alias("side"), *[c for c in nodes.columns if c not in ("r", "key", "other", "side")])


def node_pairs(got: pa.Table) -> Iterator[tuple[int, tuple[int, int], tuple[int, int], list[np.ndarray]]]:
    """The node pairs among rows ``(r, key, other, side, v, ...)``: r, both nodes' ranges of values, and the columns from v on, sorted by side and v."""
    r, key, other, side, v, *more = (got.column(c).to_numpy() for c in range(got.num_columns))
    v = v.view(np.uint64)
    order = np.lexsort((v, side, other, key, r))
    r, key, other, side, v, *more = (x[order] for x in (r, key, other, side, v, *more))
    edge = np.flatnonzero((np.diff(r) != 0) | (np.diff(key) != 0) | (np.diff(other) != 0)) + 1
    for p, q in zip([0, *edge], [*edge, len(v)]):
        if q - p < 2:
            continue
        cut = p + int(np.searchsorted(side[p:q], 1))
        first, second = ((0, q - p), (0, q - p)) if cut == q else ((0, cut - p), (cut - p, q - p))
        yield int(r[p]), first, second, [x[p:q] for x in (v, *more)]


def _local_links(nodes: DataFrame, blocks: list[tuple[int, int]], errors: int) -> DataFrame:
    """Links inside each node pair; many node pairs share a task, so that a group is never one tiny Python call."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        a, b = [], []
        for r, first, second, (own,) in node_pairs(pa.Table.from_batches(got)):
            shift, bits = blocks[r]
            # nodes of a split pair differ somewhere on their path: the walk restarts at the shared first block and prunes on
            x, y = _links(own, _walk(own, first, second, bits, errors))
            if shift:
                x, y = _rotated(x, 64 - shift), _rotated(y, 64 - shift)
            a.append(x)
            b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    dealt = nodes.select("r", "key", "other", "side", "v").repartition("r", "key", "other")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, errors: int = 4, most: int = 20_000) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and repeated ids are kept, one
    result row each. A null id keeps its row; it is never a component's id unless the component has no other. An
    empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    prints = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    each = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = components(trie_links(each.select("fp"), errors, most))
    part = linked.join(each, linked.node == each.fp).select("node", "root", "least")
    best = part.groupBy("root").agg(F.min("least").alias("best"))
    moved = staged(part.join(best, "root").select(F.col("node").alias("fp"), "best"), "moved")
    # every fingerprint's own smallest id, or its component's; then one join on the fingerprint
    named = each.join(moved, "fp", "left").select("fp", F.coalesce("best", "least").alias("component_id"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_root(docs: DataFrame, rooted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of ``docs`` one for each root in ``rooted(id, x, root)``, where x is ``xxhash64`` of the text: the smallest by id (null last), then x.

    Components are told apart by root only, so null and repeated ids lose no component. All columns are kept.
    """
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x")).alias("m"))
    heads = best.select(F.col("m.id").alias("i"), F.col("m.x").alias("h")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("t"))
    hit = rows.join(heads, F.col("id").eqNullSafe(F.col("i")) & (F.col("x") == F.col("h")), "left_semi")
    order = Window.partitionBy("id", "x").orderBy(F.col("t").asc_nulls_last())
    return hit.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, errors: int = 4, most: int = 20_000) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id (null last) stays.

    Of several such rows (a repeated id) the first by text hash stays; all columns of ``docs`` are kept as they are.
    """
    texts = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("x"))
    prints = staged(texts.select(F.col(id_col).alias("id"), "x", fingerprint_column(words)(text_bytes(text_col)).alias("fp")), "fingerprints")
    linked = components(trie_links(staged(prints.select("fp").distinct(), "distinct"), errors, most))
    rooted = prints.join(linked, prints.fp == linked.node, "left").select("id", "x", F.coalesce("root", "fp").alias("root"))
    return one_per_root(docs, rooted, id_col, text_col)

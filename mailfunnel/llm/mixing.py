"""Mixing sources to target weights along a time-varying curriculum (operator 9). DataFrame functions only.

Targets: each source's share of the wanted words by weight, stopped at ``most`` times its size, the excess shared by the
others. Time: a source's weight runs linearly from ``1 + tilt`` to ``1 - tilt`` times its mean over training time 0..1,
so its cumulative demand is a quadratic in time. A document taken at cumulative word u of its source is due where that
demand reaches u: the inverse of the quadratic. Documents are then range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (5, 2, 1)
TILTS = (0.6, 0.0, -0.6)
BUCKETS = 4096


def words(text_col: str) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; null: 0."""
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes(source, source_size)``, one row a source -> with weight, tilt and target (double).

    The level L at which sum(min(most * size, L * weight)) is the wanted total is found by a window over the sources
    in order of most * size / weight: those before the first that stays below L are stopped.
    """
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("r", F.lit(len(values))) + 1).cast("int")) if i else None
    ranked = ranked.withColumn("weight", pick(weights, 1)).withColumn("tilt", pick(tilts, 1))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), "r")
    upto, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("capped", F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0))).withColumn("rest", F.sum("weight").over(after))
    ranked = ranked.withColumn("level", (F.lit(share * total) - F.col("capped")) / F.col("rest"))
    first = F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct(F.col("capped"), "level"))).over(Window.partitionBy())
    ranked = ranked.withColumn("found", first["level"])
    return ranked.select("source", "source_size", "weight", "tilt", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("found") * F.col("weight"), (most * F.col("source_size")).cast("double"))).alias("target"))


def _time(u: Column, tilt: Column) -> Column:
    """The time at which a share u of the source's demand is met: (1 + tilt) t - tilt t^2 = u."""
    bent = (1 + tilt - F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * u))) / (2 * tilt)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.abs(tilt) < 1e-9, u).otherwise(bent)))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False, **options) -> DataFrame:
    """One row per document: id, ``size, source_size, target, taken, copies, positions`` (and for ``mixed``, with ``whole``, a key of the whole row).

    Positions are training times, 0 to 1. Within a source, documents stand in the order of an md5 of the id (a null id: of the text; ties: size, then text hash); passes over the source repeat until
    the target is met, and a document is taken in a pass if its middle word lies before the target: whole documents,
    0 to ``most`` times. Prefix sums go by 4096 hash buckets a source, so no task holds a source. Null texts have
    size 0 and are taken 0 words; a null source is a source of its own, the last. Repeated rows are
    documents like any other. An empty table gives an empty result. Reruns agree.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.md5(text)).cast("binary"))  # null ids stand by their texts
    base = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__s"), words(text_col).alias("__n"), key.alias("__key"), F.xxhash64(text_col).alias("__t"), (row_key(docs, id_col, text_col, source_col) if whole else F.lit("")).alias("__k"))
    sized = base.withColumn("__b", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int"))
    sized = staged(sized, "sizes")
    buckets = staged(sized.groupBy("__s", "__b").agg(F.sum("__n").alias("__sum")), "buckets")
    goal = targets(buckets.groupBy(F.col("__s").alias("source")).agg(F.sum("__sum").alias("source_size")), **options)
    by = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.withColumn("__base", F.coalesce(F.sum("__sum").over(by), F.lit(0))).drop("__sum")
    bases = bases.join(goal, bases["__s"].eqNullSafe(goal["source"])).drop("source")
    inner = Window.partitionBy("__s", "__b").orderBy("__key", "__n", "__t", "__k").rowsBetween(Window.unboundedPreceding, -1)
    at = sized.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    at = at.alias("a").join(bases.alias("b"), F.expr("a.__s <=> b.__s and a.__b = b.__b")).select("a.*", "b.__base", "b.source_size", "b.weight", "b.tilt", "b.target")
    most = options.get("most", 2)
    middle = lambda p: (F.col("source_size") * p + F.col("__base") + F.col("__in")) + F.col("__n") / 2.0
    due = [F.when((F.col("__n") > 0) & (middle(p) < F.col("target")), _time(middle(p) / F.greatest(F.col("target"), F.lit(1.0)), F.col("tilt"))) for p in range(most)]
    at = at.withColumn("positions", F.filter(F.array(*due), lambda x: x.isNotNull()))
    return at.select(F.col("__id").alias(id_col), F.col("__n").alias("size"), "source_size", "target", (F.size("positions") * F.col("__n")).cast("long").alias("taken"), F.size("positions").alias("copies"), "positions", F.col("__s").alias("__source"), "__k")


def ordered(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document as in ``placed``, with its first and last training position in millionths (null if it is not taken), range-sorted by the first."""
    found = placed(docs, id_col, **options)
    at = lambda i: F.floor(F.get("positions", i) * 1_000_000).cast("long")
    found = found.withColumns({"first_position": at(F.lit(0)), "last_position": at(F.size("positions") - 1)})
    out = found.select(id_col, "size", "source_size", "target", "taken", "copies", "first_position", "last_position")
    return out.repartitionByRange(F.col("first_position").asc_nulls_last(), id_col).sortWithinPartitions(F.col("first_position").asc_nulls_last(), id_col)


def row_key(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    """One string for a row: id and source as they are, the text and all columns as hashes. Never null."""
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000"))
    others = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.concat_ws("\u0001", told(id_col), told(source_col), F.xxhash64(text_col).cast("string"), F.xxhash64(*others).cast("string"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The training stream: rows of ``docs``, each as often as it is taken, range-sorted by training position.

    Null and empty texts are never taken; a null source is a source of its own; other columns are kept whatever their
    names; texts may be of any length. Rows repeated exactly are alike, so one of them stands for all at all their positions. An
    empty table stays empty. Reruns agree.
    """
    found = placed(docs, id_col, text_col, source_col, whole=True, **options).where("copies > 0").select("__k", F.explode("positions").alias("at"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(docs, id_col, text_col, source_col).alias("k"))
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.lit(0)))).where("n = 1")
    out = one.join(found, F.col("k") == F.col("__k")).select("row", "k", "at")
    return out.repartitionByRange("at", "k").sortWithinPartitions("at", "k").select("row.*")

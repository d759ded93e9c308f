"""Similarity joins of companies, roles and cards (J4-J7). Always on shared tokens or keys, never all pairs of a user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys


#: Words of a key up to which all its sets of words are written out (at most 63), and tasks over which single words are dealt.
WORDS, SALTS = 6, 8


def _subsets(tokens: Column) -> Column:
    """All non-empty subsets of sorted tokens, each as a string."""
    return F.transform(F.sequence(F.lit(1), F.lit(2**WORDS - 1)), lambda m: F.array_join(F.filter(tokens, lambda _, i: F.getbit(m.cast("long"), i) == 1), " "))


def company_variants(seen: DataFrame) -> DataFrame:
    """``seen(user_id, company_key, first_at)``, one row a key -> with ``bucket``: itself if no earlier key is similar, else the earliest similar one.

    Similar keys lie within each other word by word, so they meet on sets of words: a key with the earliest key that holds all
    its words, and with the earliest key for each subset of its own. Each set keeps one key, so a word in half of a user's
    keys costs no more than its rows. Keys of over WORDS words, or that repeat one, meet the others on their rarest word.
    """
    own = seen.select("user_id", "company_key", "first_at", F.array_sort(F.array_distinct(keys.tokens(F.col("company_key")))).alias("t"), F.size(keys.tokens(F.col("company_key"))).alias("n"), F.struct("first_at", "company_key").alias("me"))
    even = own.where((F.size("t") == F.col("n")) & F.col("n").between(1, WORDS))
    salt = F.when(~F.col("s").contains(" "), F.pmod(F.xxhash64("company_key"), F.lit(SALTS))).otherwise(0).cast("int")
    each = even.select("user_id", "company_key", "me", F.explode(F.array_distinct(F.filter(_subsets(F.col("t")), lambda x: x != ""))).alias("s")).withColumn("salt", salt)
    around = each.groupBy("user_id", "s").agg(F.min("me").alias("o"))
    whole = even.select("user_id", F.array_join("t", " ").alias("s"), "company_key", "me", "n")
    exact = whole.groupBy("user_id", "s").agg(F.min("me").alias("o"), F.max("n").alias("n")).select("user_id", "s", "o", F.explode(F.sequence(F.lit(0), F.when(F.col("n") == 1, SALTS - 1).otherwise(0))).alias("salt"))
    found = whole.join(around, ["user_id", "s"]).select("user_id", "company_key", "o")
    found = found.union(each.join(exact, ["user_id", "s", "salt"]).groupBy("user_id", "company_key").agg(F.min("o").alias("o")))
    found = found.union(_odd_variants(own))
    first = found.join(own.select("user_id", "company_key", "me"), ["user_id", "company_key"]).where(F.col("o") < F.col("me")).groupBy("user_id", "company_key").agg(F.min("o").alias("o"))
    return seen.join(first, ["user_id", "company_key"], "left").select("user_id", "company_key", "first_at", F.coalesce(F.col("o.company_key"), F.col("company_key")).alias("bucket"))


def _odd_variants(own: DataFrame) -> DataFrame:
    """``user_id, company_key, o``: the keys that sets of words don't serve, and what they meet: on the rarest word of the user, then verified."""
    odd = F.col("n").isNotNull() & ((F.size("t") != F.col("n")) | (F.col("n") > WORDS))
    marked = own.select("user_id", "company_key", "me", "t", odd.alias("odd"))
    users = marked.where("odd").select("user_id").distinct()
    each = marked.join(users, "user_id", "left_semi").select("user_id", "company_key", "me", "odd", F.explode("t").alias("token"))
    often = each.groupBy("user_id", "token").agg(F.count("*").alias("often"))
    rare = Window.partitionBy("user_id", "company_key").orderBy("often", "token")
    anchor = each.join(often, ["user_id", "token"]).withColumn("i", F.row_number().over(rare)).where("i = 1")
    a = anchor.select("user_id", "token", F.col("company_key").alias("a"), F.col("me").alias("a_me"), F.col("odd").alias("a_odd"))
    b = each.select("user_id", "token", F.col("company_key").alias("b"), F.col("me").alias("b_me"), F.col("odd").alias("b_odd"))
    pairs = a.join(b, ["user_id", "token"]).where((F.col("a_odd") | F.col("b_odd")) & (F.col("a") != F.col("b"))).select("user_id", F.least("a_me", "b_me").alias("o"), F.greatest("a_me", "b_me").alias("later"))
    return pairs.where(keys.company_similar(F.col("o.company_key"), F.col("later.company_key"))).select("user_id", F.col("later.company_key").alias("company_key"), "o")


def role_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of one user and company with similar roles and compatible requisitions: ``a(user_id, company_key, role_key, req, id)``, ``b`` alike."""
    left = a.select("user_id", "company_key", *[F.col(c).alias(f"a_{c}") for c in ("id", "role_key", "req")])
    right = b.select("user_id", "company_key", *[F.col(c).alias(f"b_{c}") for c in ("id", "role_key", "req")])
    fits = F.col("a_req").isNull() | F.col("b_req").isNull() | (F.col("a_req") == F.col("b_req"))
    return left.join(right, ["user_id", "company_key"]).where(keys.role_similar(F.col("a_role_key"), F.col("b_role_key")) & fits)


GRAM = 3


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n))))


def duplicate_keys(apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``user_id, id, k``: each card's company key; ``user_id, k, o``: pairs of a user's different keys of which one lies in the other, both ways).

    A key within another shares all its runs of GRAM characters with it: each key meets the user's others on its rarest
    run, then containment is verified. Keys shorter than a run meet, whole, the runs of their own length.
    """
    cards = apps.select("user_id", "id", keys.card_company_key(F.col("company")).alias("k")).where("k <> ''")
    names = cards.select("user_id", "k").distinct()
    each = names.where(F.length("k") >= GRAM).select("user_id", "k", F.explode(_grams(F.col("k"), GRAM)).alias("g"))
    often = each.groupBy("user_id", "g").agg(F.count("*").alias("often"))
    rarest = each.join(often, ["user_id", "g"]).groupBy("user_id", "k").agg(F.min(F.struct("often", "g")).alias("m")).select("user_id", F.col("k").alias("o"), F.col("m.g").alias("g"))
    inner = rarest.join(each, ["user_id", "g"])
    short = names.where(F.length("k") < GRAM)
    for n in range(1, GRAM):
        some = short.where(F.length("k") == n).select("user_id", F.col("k").alias("g"), F.col("k").alias("o"))
        users = some.select("user_id").distinct()
        runs = names.join(users, "user_id", "left_semi").where(F.length("k") >= n).select("user_id", "k", F.explode(_grams(F.col("k"), n)).alias("g"))
        inner = inner.unionByName(some.join(runs, ["user_id", "g"]).select(*inner.columns))
    inner = inner.where((F.col("k") != F.col("o")) & F.col("k").contains(F.col("o"))).select("user_id", "k", "o")
    return cards, inner.union(inner.select("user_id", "o", "k"))


def duplicate_candidates(apps: DataFrame) -> DataFrame:
    """Pairs of a user's cards whose companies look the same: ``user_id, id, other_id``. ``duplicate_keys`` has the same by keys, before the cards of a key are paired."""
    cards, pairs = duplicate_keys(apps)
    alike = pairs.union(cards.select("user_id", "k", F.col("k").alias("o")).distinct())
    other = cards.select("user_id", F.col("id").alias("other_id"), F.col("k").alias("o"))
    return cards.join(alike, ["user_id", "k"]).join(other, ["user_id", "o"]).where("id <> other_id").select("user_id", "id", "other_id")


def attach_roleless(events: DataFrame) -> DataFrame:
    """Mails without role and requisition take the company's card of the mail before: ``card`` null -> the last one known."""
    before = Window.partitionBy("user_id", "company_key").orderBy("email_at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("card", F.coalesce("card", F.last("card", ignorenulls=True).over(before)))

"""Joins on skewed keys and connected components, both without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

#: A key with more than one in so many rows of the larger side is hot; fewer keys than this can be.
HOT_SHARE = 200
#: Rows that a key may have at any size of the larger side.
LEAST = 1000


def unique_join(left: DataFrame, right: DataFrame, key: str, weights: DataFrame, hint: str | None = None, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key; weights: (key, n), the rows that left has of each key.

    A hot key's rows are dealt out over as many parts as the limit for one key fits into them, and its row of `right` is
    there once a part.  Only the hot keys and their parts are broadcast, fewer than HOT_SHARE pairs of key and number;
    the parts of all hot keys are fewer than twice HOT_SHARE, so that many rows of `right` are copied, whatever their
    size.  No task gets more than the limit of one key's rows.  Null keys meet nothing and stay where they are.
    """
    if how == "left":
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
        met = unique_join(left.where(F.col(key).isNotNull()), right, key, weights, hint, "outer side")
        return met.unionAll(left.where(F.col(key).isNull()).select("*", *none))
    how = "left" if how == "outer side" else how
    total, most = weights.agg(F.sum("n"), F.max("n")).first()
    limit = max(LEAST, (total or 0) // HOT_SHARE)
    names = [c for c in right.columns if c != key]
    if (most or 0) <= limit:
        return left.join(right.hint(hint) if hint else right, key, how).select(*left.columns, *names)
    hot_key, parts, salt = fresh(left.join(right, key), "hot_key", "parts", "salt")
    hot = weights.where(F.col("n") > limit).select(F.col(key).alias(hot_key), F.ceil(F.col("n") / limit).cast("int").alias(parts))
    others = [c for c in left.columns if c != key]
    own = F.abs(F.xxhash64(*[F.col(f"`{c}`") for c in others]) % F.col(parts)).cast("int") if others else F.lit(0)
    spread = left.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left").withColumn(salt, F.coalesce(own, F.lit(0))).drop(hot_key, parts)
    copies = right.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(hot_key, parts)
    return spread.join(copies.hint(hint) if hint else copies, [key, salt], how).select(*left.columns, *names)


def counted(df: DataFrame, key: str) -> DataFrame:
    """The rows of each key, as weights."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


#: Bits of a sieve for each key, and of the largest one: 8 MB.  Beyond that many keys more rows pass that need not.
SIEVE_BITS, SIEVE_MOST = 32, 1 << 26
#: Bits in one of Spark's bitmaps.
BITMAP = 1 << 15


def sieved(left: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of left whose key is among keys (one column, `key`), and some others: those that share a hash with one.

    A bitmap of the keys' hashes, no larger than SIEVE_MOST bits whatever the keys, is broadcast, so that wide rows are
    left out before they are moved.  An exact join has to follow.  Null keys don't pass.
    """
    bits = min(SIEVE_MOST, max(BITMAP, 1 << (SIEVE_BITS * keys.count()).bit_length()))
    bucket, place, bitmap = fresh(left, "bucket", "place", "bitmap")
    hashed = F.pmod(F.xxhash64(key), F.lit(bits))
    of_keys = keys.where(F.col(key).isNotNull()).select((hashed / BITMAP).cast("int").alias(bucket), (hashed % BITMAP).alias(place))
    maps = of_keys.groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(bitmap))
    spread = left.where(F.col(key).isNotNull()).withColumn(bucket, (hashed / BITMAP).cast("int")).withColumn(place, (hashed % BITMAP).cast("int"))
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, {place} div 8 + 1, 1)")), 16, 10).cast("int")
    passed = spread.join(F.broadcast(maps), bucket).where(F.getbit(byte, F.col(place) % 8) == 1)
    return passed.select(*left.columns)


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (node, component), component being the smallest node reachable; nodes without edges are absent.

    Each round hangs every node below its smallest neighbour, flattens the trees by pointer doubling and contracts the
    edges to the roots.  Edges shrink by half a round at least.  All steps are minima that combine before they shuffle
    and joins in which a node or a root that stands in many rows is dealt out.
    """
    left = staged(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    label: DataFrame | None = None
    while not left.isEmpty():
        both = left.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(left.select(F.col("v").alias("node"), F.col("u").alias("other")))
        parent = staged(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")), "parents")
        while True:
            above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = unique_join(parent, above, "parent", counted(parent, "parent"))
            jumped = staged(jumped.select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
            parent = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        of_u, of_v = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu")), parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        ends = unique_join(unique_join(left, of_u, "u", counted(left, "u")), of_v, "v", counted(left, "v"))
        left = staged(ends.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        if label is None:
            label = parent
        else:
            step = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            label = staged(unique_join(label, step, "parent", counted(label, "parent"), how="left").select("node", F.coalesce("next", "parent").alias("parent")), "labels")
    if label is None:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    return label.select("node", F.col("parent").alias("component"))

"""A shuffle by seed that sorts nothing: rows have numbers, a keyed permutation gives each number its place, and rows go to the partition that holds it.

The permutation is a Feistel network over pairs (left below a, right below b) with a·b just over the number of rows: rounds add a digest of one half to the other, modulo its size, which can be undone, so that it is one
to one. What falls beyond the number of rows walks on through the network until it doesn't. All of this is arithmetic on one row's number: no digest is sorted, no row meets another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import let

ROUNDS, WALKS, BUCKETS = 6, 32, 1024
#: A prime below 2^31 and a factor: products of two numbers below it fit into 64 bits.
PRIME, FACTOR = 2_147_483_647, 1_103_515_245


def halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def digest(half: Column, seed: int, turn: Column) -> Column:
    """A number below PRIME: a square of a linear mix, so that rounds aren't linear."""
    x = (half % PRIME * FACTOR + F.lit(seed * 12_345 % PRIME).cast("long") + turn * 2_654_435) % PRIME
    return (x * x + x) % PRIME


def network(x: Column, a: int, b: int, seed: int) -> Column:
    """All rounds once: x is left * b + right, and they change in turn."""
    whole = lambda c: c.cast("long")
    pair = lambda left, right: F.struct(left.alias("left"), right.alias("right"))

    def turned(p: Column, turn: Column) -> Column:
        left, right = p["left"], p["right"]
        return F.when(turn % 2 == 0, pair((left + digest(right, seed, turn)) % whole(F.lit(a)), right)).otherwise(pair(left, (right + digest(left, seed, turn)) % whole(F.lit(b))))

    first = pair(F.call_function("div", x, whole(F.lit(b))), x % whole(F.lit(b)))
    return F.aggregate(F.sequence(whole(F.lit(0)), whole(F.lit(ROUNDS - 1))), first, turned, lambda p: p["left"] * b + p["right"])


def place(number: Column, n: int, seed: int) -> Column:
    """The place, from 0 to n - 1, of each number of that range, for n up to 2^52; every place once."""
    a, b = halves(n)
    # Places beyond n are fewer than a, one in sqrt(n) or less: after WALKS more turns none is left unless chance is beyond belief, and for small n there aren't as many.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), network(number.cast("long"), a, b, seed), lambda x, _: F.when(x < n, x).otherwise(network(x, a, b, seed)))
    return F.when(number.between(0, n - 1), let(walked, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a number walked too far")).cast("long"))))


def numbers(rows: DataFrame, keys: list[str], name: str = "number", buckets: int = BUCKETS) -> DataFrame:
    """Adds 0, 1, ... in an order that depends on the keys' values alone: by buckets of their hash, and by key within a bucket. Keys should tell rows apart."""
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("__bucket").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__size"))  # a row for each bucket
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys))
    return dealt.withColumn("__inside", inside).join(offsets, "__bucket").withColumn(name, F.col("__before") + F.col("__inside") - 1).drop("__bucket", "__inside", "__before")


def shuffled(rows: DataFrame, keys: list[str], seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Rows in an order that the seed gives, always the same for the same keys: partition k holds the k-th share of the places, in order. A file of each is a share of the shuffle."""
    n = rows.count()
    if not n:
        return rows
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = numbers(rows, keys, "__number").withColumn("__place", place(F.col("__number"), n, seed)).drop("__number")
    share = F.floor(F.col("__place") * F.lit(parts) / F.lit(n)).cast("int")
    return placed.repartitionById(parts, share).sortWithinPartitions("__place").drop("__place")

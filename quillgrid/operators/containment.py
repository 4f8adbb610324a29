"""Which names stand in which texts, and which paths end with which, without pairs of all.

Names and texts of a scope meet in a task, in blocks: a scope with over BLOCK of either is cut by a hash of the string, and every block of names meets every block of
texts. There, texts have an inverted index of those substrings of GRAM characters that names have, too. A name that a text contains has all its grams there, so it is looked up by its rarest
one alone, and what that finds is checked. Shorter names are grams themselves. What is shuffled is each string once (of large scopes, once for each block that it meets), not its grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.session import checkpointed, ship

GRAM = 4
#: Names, and texts, of a scope that meet at once; rows of a batch of what is found.
BLOCK, ROWS = 4096, 10_000


def grams(text: str, n: int) -> set[str]:
    return {text[k : k + n] for k in range(len(text) - n + 1)} if n else {""}


def pairs_contained(names: set[str], texts: set[str], gram: int = GRAM) -> Iterator[tuple[str, str]]:
    """Names with texts that hold them."""
    own = {name: grams(name, min(len(name), gram)) for name in names}
    index: dict[str, list[str]] = {g: [] for some in own.values() for g in some}
    lengths = {min(len(name), gram) for name in names}
    for text in texts:
        for n in lengths:
            for g in grams(text, n):
                if g in index:
                    index[g].append(text)
    for name, some in own.items():
        for text in min((index[g] for g in some), key=len):
            if name in text:
                yield name, text


def pairs_ending(names: set[str], texts: set[str]) -> Iterator[tuple[str, str]]:
    """Names with texts that end with them."""
    lengths = {len(name) for name in names}
    for text in texts:
        for n in lengths:
            if n <= len(text) and (name := text[len(text) - n :]) in names:
                yield name, text


def met(names: DataFrame, texts: DataFrame, scope: str, find: Callable[[set[str], set[str]], Iterable[tuple[str, str]]], block: int = BLOCK) -> DataFrame:
    """scope, name and text of the pairs that find gives of the names (scope, name) and texts (scope, text) of each scope. Nulls match nothing."""
    ship(names.sparkSession)
    both = names.select(scope, F.lit(0).alias("side"), F.col("name").alias("value")).unionByName(texts.select(scope, F.lit(1).alias("side"), F.col("text").alias("value")))
    both = both.filter(F.col(scope).isNotNull() & F.col("value").isNotNull())
    blocks = lambda side: F.greatest(F.ceil(F.count_if(F.col("side") == side) / block), F.lit(1)).cast("int")
    large = checkpointed(both.groupBy(scope).agg(blocks(0).alias("rows"), blocks(1).alias("columns")).filter("rows > 1 OR columns > 1"))
    n = large.count()
    if n:
        both = both.join(F.broadcast(large) if n <= 100_000 else large, scope, "left")
    some = lambda c: F.coalesce(c, F.lit(1)) if n else F.lit(1)
    mine = lambda c: F.pmod(F.xxhash64("value"), some(c)).cast("int")
    all_of = lambda c: F.sequence(F.lit(0), some(c) - 1)
    if n:
        both = both.withColumn("i", F.explode(F.when(F.col("side") == 0, F.array(mine("rows"))).otherwise(all_of("rows")))).withColumn("j", F.explode(F.when(F.col("side") == 1, F.array(mine("columns"))).otherwise(all_of("columns"))))
    else:
        both = both.withColumns({"i": F.lit(0), "j": F.lit(0)})

    def run(batches):
        last, held, found = None, (set(), set()), []

        def told():
            made = [pa.array([x[k] for x in found], t) for k, t in enumerate((kind, pa.string(), pa.string()))]
            found.clear()
            return pa.RecordBatch.from_arrays(made, [scope, "name", "text"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at, i, j, side, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (at, i, j) != last:
                    if held[0] and held[1]:
                        found.extend((last[0], *pair) for pair in find(*held))
                        if len(found) >= ROWS:
                            yield told()
                    last, held = (at, i, j), (set(), set())
                held[side].add(value)
        if held[0] and held[1]:
            found.extend((last[0], *pair) for pair in find(*held))
        if found:
            yield told()

    # Dealt by a digest: by the scope itself, Spark takes a union of two sides that are dealt by it for dealt already, and leaves them apart.
    dealt = both.repartition(F.xxhash64(scope, "i", "j")).select(scope, "i", "j", "side", "value").sortWithinPartitions(scope, "i", "j")
    return dealt.mapInArrow(run, f"{scope} {names.schema[scope].dataType.simpleString()}, name string, text string")


def contained(names: DataFrame, texts: DataFrame, scope: str, block: int = BLOCK) -> DataFrame:
    """scope, name and text of every name (scope, name) that stands in a text (scope, text) of its scope."""
    return met(names, texts, scope, pairs_contained, block)


def ends_with(names: DataFrame, texts: DataFrame, scope: str, block: int = BLOCK) -> DataFrame:
    """scope, name and text of every name (scope, name) that a text (scope, text) of its scope ends with."""
    return met(names, texts, scope, pairs_ending, block)

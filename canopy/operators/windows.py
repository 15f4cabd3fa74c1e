"""First rows, top rows, ranks and samples of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.functions.draws import hash_order
from canopy.sources.io import staged


def _named(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def first_n(df: DataFrame, keys: list[str], order, n: int = 1) -> DataFrame:
    """The first n rows of each group in a stated order. Null keys form no group."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*_named(order)))
    return df.dropna(subset=keys).withColumn("__row", row).filter(F.col("__row") <= n).drop("__row")


def tallest(df: DataFrame, individual: str = "individual", height: str = "height", seq: str = "seq") -> DataFrame:
    """The record with the greatest height of each individual that has one."""
    return first_n(df.dropna(subset=[height]), [individual], [F.col(height).desc(), F.col(seq)])


def latest_without_height(df: DataFrame, individual: str = "individual", height: str = "height", event: str = "eventID", seq: str = "seq") -> DataFrame:
    """The latest record of individuals that never had a height."""
    known = df.dropna(subset=[height]).select(individual).distinct()
    never = df.filter(F.col(height).isNull()).join(known, individual, "left_anti")
    return first_n(never, [individual], [F.col(event).desc(), F.col(seq)])


def one_per_individual(df: DataFrame, **names) -> DataFrame:
    """W3 and W4 together."""
    return tallest(df, **{k: v for k, v in names.items() if k != "event"}).unionByName(latest_without_height(df, **names))


def shuffled_first_n(df: DataFrame, keys: list[str], row_key: str, n: int, seed=0) -> DataFrame:
    """N rows of each group in a seeded random order."""
    return first_n(df, keys, [hash_order(seed, row_key), row_key], n)


def n_individuals(df: DataFrame, keys: list[str], individual: str, n: int | Column, *, order: str = "id", seed=0) -> DataFrame:
    """All rows of n individuals of each class: the first by id, or a seeded random choice (``order`` "hash").

    ``n`` may be a column (a cap worked out from the data).
    """
    by = [individual] if order == "id" else [hash_order(seed, individual), individual]
    some = df.select(*keys, individual, *([n.alias("__cap")] if isinstance(n, Column) else [])).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_named(by)))
    cap = F.col("__cap") if isinstance(n, Column) else F.lit(n)
    chosen = some.withColumn("__row", rank).filter(F.col("__row") <= cap).select(*keys, individual)
    return df.join(chosen, [*keys, individual], "left_semi")


def sample_or_skip(df: DataFrame, keys: list[str], row_key: str, n: int, seed=0) -> DataFrame:
    """N random rows of each group; groups with fewer are left out. Groups are counted by an aggregation; only their first rows meet."""
    enough = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__all")).filter(F.col("__all") >= n).select(*keys)
    return shuffled_first_n(df.join(enough, keys, "left_semi"), keys, row_key, n, seed)


def _in_parts(df: DataFrame, order) -> DataFrame:
    """``df`` cut into ranges of an order, numbered by ``__part``; written, so that the ranges stay as they are."""
    return staged(df.repartitionByRange(*_named(order)).withColumn("__part", F.spark_partition_id()), "ranges")


def _before(parts: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """For each part the sums of all earlier parts; as many rows as there are parts."""
    sums = parts.groupBy("__part").agg(*[c.alias(n) for n, c in amounts.items()])
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("__part", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in amounts])


def number_rows(df: DataFrame, order, name: str = "number", keys: list[str] | None = None) -> DataFrame:
    """A number from 0 in a stated order, within each key, or over the whole table.

    Over a whole table the order is cut into ranges; only the ranges' row counts meet.
    """
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*_named(order))) - 1)
    parts = _in_parts(df, order)
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*_named(order))) - 1
    starts = _before(parts, {"__start": F.count("*")})
    numbered = parts.withColumn("__own", own).join(F.broadcast(starts), "__part")
    return numbered.withColumn(name, F.col("__own") + F.col("__start")).select(*df.columns, name)


def last_k(values: str | Column, k: int) -> Column:
    """The k greatest distinct values of an array, ascending."""
    a = F.array_sort(F.array_distinct(F.col(values) if isinstance(values, str) else values))
    return F.slice(a, F.greatest(F.size(a) - k, F.lit(0)) + 1, k)


def running_hits(df: DataFrame, score: str, hit: str, keys: list[str] | None = None) -> DataFrame:
    """One row per distinct score from the top: hits and rows so far, within each key or over the whole table.

    Rows are aggregated by score first, so running sums go over distinct scores only; over
    a whole table these are cut into ranges, whose sums alone meet.
    """
    keys = keys or []
    each = df.groupBy(*keys, score).agg(F.sum(F.col(hit).cast("long")).alias("__h"), F.count("*").alias("__n"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.col(score).desc())
        return each.select(*keys, score, F.sum("__h").over(w).alias("hits"), F.sum("__n").over(w).alias("rows"))
    parts = _in_parts(each, [F.col(score).desc()])
    w = Window.partitionBy("__part").orderBy(F.col(score).desc())
    starts = _before(parts, {"__h0": F.sum("__h"), "__n0": F.sum("__n")})
    own = parts.select(score, "__part", F.sum("__h").over(w).alias("__hw"), F.sum("__n").over(w).alias("__nw")).join(F.broadcast(starts), "__part")
    return own.select(score, (F.col("__hw") + F.col("__h0")).alias("hits"), (F.col("__nw") + F.col("__n0")).alias("rows"))


def shuffled_keys(df: DataFrame, key: str, seed=0, keys: list[str] | None = None) -> DataFrame:
    """Distinct keys with their place in a seeded random order."""
    return number_rows(df.select(*(keys or []), key).distinct(), [hash_order(seed, *(keys or []), key), key], "place", keys)

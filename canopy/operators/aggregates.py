"""Counts, quantiles, floors, audits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.sources.io import staged


def counts(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Rows per key; null keys don't count. One aggregation is both the per-tile and the total count."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name))


def p99_from(value: str | Column, least: float = 0.5, share: float = 0.99) -> Column:
    """A3: aggregate: the exact, interpolated quantile of values of at least ``least``; NaN is left out, none gives null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.percentile(F.when((v >= least) & ~F.isnan(v.cast("double")), v), share)


#: Values of a group that may meet in one buffer, and the bins that larger groups are counted in.
WHOLE, BINS = 65_536, 4_096


def exact_quantiles(df: DataFrame, key: str, value: str, share: float = 0.99, *, whole: int = WHOLE, bins: int = BINS, name: str = "quantile", weight: str | None = None) -> DataFrame:
    """A3: each group's exact, interpolated quantile in bounded memory; nulls are left out, groups without a value too.

    Groups of up to ``whole`` values are ordered at once. For larger ones the two values around the quantile are
    looked for by rank: values are counted in bins between the least and the greatest, the bin that holds the
    rank is counted again, until it has one value or fits in a buffer (two passes, unless values crowd). Bins are
    counted before the shuffle, so a group may hold any share of the rows. ``df`` is read once a pass and should be a table.
    ``weight``: a row stands for so many (a whole number above 0) equal ones.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(key).alias("__key"), v.alias("__v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("__w")).filter("__v is not null")
    whole_group = F.percentile("__v", share, F.col("__w")).alias(name) if weight else F.percentile("__v", share).alias(name)
    sizes = staged(rows.groupBy("__key").agg(F.count("*").alias("rows"), F.sum("__w").alias("n"), F.min("__v").alias("a"), F.max("__v").alias("b")), "group-sizes")
    large = sizes.filter(F.col("rows") > whole)
    if large.isEmpty():
        return rows.groupBy("__key").agg(whole_group).withColumnRenamed("__key", key)
    small = rows.join(large.select("__key"), "__key", "left_anti").groupBy("__key").agg(whole_group)
    place = F.lit(float(share)) * (F.col("n") - 1)
    ranks = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))
    wanted = staged(large.select("__key", ranks.alias("rank"), "a", "b", F.lit(0).cast("long").alias("below")), "ranks")
    found = []
    ends = [float("-inf"), float("inf")]
    while True:
        within = rows.join(wanted, "__key").filter(F.col("__v").between(F.col("a"), F.col("b")))
        finite = lambda c: F.least(F.greatest(c, F.lit(-1.7e308)), F.lit(1.7e308)) / 2
        spot = F.floor(F.try_divide(finite(F.col("__v")) - finite(F.col("a")), finite(F.col("b")) - finite(F.col("a"))) * bins)
        spot = F.when(F.col("__v") == ends[1], bins).when(F.col("__v") == ends[0], -1).otherwise(F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)))
        held = within.groupBy("__key", "rank", "below", spot.alias("bin")).agg(F.count("*").alias("rows"), F.sum("__w").alias("n"), F.min("__v").alias("a"), F.max("__v").alias("b"))
        before = F.sum("n").over(Window.partitionBy("__key", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        hit = held.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0))).filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        hit = staged(hit.select("__key", "rank", "a", "b", "below", "n", "rows"), "bins")
        found.append(hit.filter("a = b").select("__key", "rank", F.col("a").alias("value")))
        fits = hit.filter((F.col("a") < F.col("b")) & (F.col("rows") <= whole)).drop("n", "rows")
        kept = rows.join(fits, "__key").filter(F.col("__v").between(F.col("a"), F.col("b")))
        upto = F.col("below") + F.sum("__w").over(Window.partitionBy("__key", "rank").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
        found.append(kept.withColumn("__upto", upto).filter(F.col("__upto") > F.col("rank")).groupBy("__key", "rank").agg(F.min("__v").alias("value")))
        wanted = hit.filter((F.col("a") < F.col("b")) & (F.col("rows") > whole)).select("__key", "rank", "a", "b", "below")
        if wanted.isEmpty():
            break
    ends_of = reduce(DataFrame.unionByName, found).join(large.select("__key", "n"), "__key").groupBy("__key", "n").agg(F.min(F.struct("rank", "value")).alias("lo"), F.max(F.struct("rank", "value")).alias("hi"))
    part = place - F.floor(place)
    big = ends_of.select("__key", F.when(F.col("lo.rank") == F.col("hi.rank"), F.col("lo.value")).otherwise((1 - part) * F.col("lo.value") + part * F.col("hi.value")).alias(name))
    return small.unionByName(big).withColumnRenamed("__key", key)


def extent(df: DataFrame, x: str = "x", y: str = "y", keys: list[str] | None = None) -> DataFrame:
    """A5: bounds of a layer, or of each group of it."""
    return df.groupBy(*(keys or [])).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def enough_rows(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Rows of keys with strictly more than so many rows."""
    keep = counts(df, key, name="__n").filter(F.col("__n") > more_than).select(key)
    return of_keys(df, keep, key)


def of_keys(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows of the keys in ``keep``, which is written first: the planner then knows its size, and rows of few keys need not meet in as few tasks."""
    return df.join(staged(keep, "keys"), key, "left_semi")


def individuals_of(df: DataFrame, key: str, individual: str, name: str) -> DataFrame:
    """Distinct individuals of each key; null keys go.

    Pairs are sent by both columns to a fixed number of tasks, which isn't lowered by size: distinct pairs take far more memory than they take to send.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = df.select(key, individual).dropna(subset=[key]).repartition(n, key, individual).distinct()
    return pairs.groupBy(key).agg(F.count(individual).alias(name))


def enough_individuals(df: DataFrame, key: str, individual: str, at_least: int) -> DataFrame:
    """Rows of keys with at least so many individuals."""
    keep = individuals_of(df, key, individual, "__n").filter(F.col("__n") >= at_least).select(key)
    return of_keys(df, keep, key)


def species_floor(df: DataFrame, taxon: str, individual: str, least: int, share: float = 0.05) -> DataFrame:
    """Per taxon the greater of a share of its individuals and ``least``."""
    n = individuals_of(df, taxon, individual, "individuals")
    return n.withColumn("floor", F.greatest(share * F.col("individuals"), F.lit(float(least))))


#: Labels that the bitmap of an observed stage has room for.
MOST_LABELS = 32_768


def audited(df: DataFrame, name: str, label: str, individual: str | None = None) -> tuple[DataFrame, Observation]:
    """The same rows; once an action has run, the observation has their number, the exact number of ``label``s and about how many individuals.

    ``label`` is a dense number from 0 under MOST_LABELS (see split.encode_labels); others fail the job. Null has no place.
    """
    seen = Observation(name)
    code = F.col(label).cast("long")
    place = F.when(code.between(0, MOST_LABELS - 1), code).when(code.isNotNull(), F.raise_error(F.concat(F.lit(f"{label} is not from 0 to {MOST_LABELS - 1}: "), code.cast("string"))).cast("long"))
    metrics = [F.count(F.lit(1)).alias("rows"), F.bitmap_count(F.bitmap_construct_agg(place)).alias("taxa")]
    if individual:
        metrics.append(F.approx_count_distinct(individual).alias("individuals"))
    return df.observe(seen, *metrics), seen


def audit_of(spark: SparkSession, seen: dict[str, Observation]) -> DataFrame:
    """The observations of stages whose action has run, as a table: step, stage, rows, taxa."""
    rows = [(i, name, int(o.get["rows"]), int(o.get["taxa"])) for i, (name, o) in enumerate(seen.items())]
    return spark.createDataFrame(rows, "step int, stage string, rows long, taxa long")


def stage_audit(stages: dict[str, DataFrame], taxon: str, individual: str) -> DataFrame:
    """Exact rows, individuals and taxa of each stage, in order."""
    each = [d.agg(F.count("*").alias("rows"), F.countDistinct(individual).alias("individuals"), F.countDistinct(taxon).alias("taxa")).select(F.lit(i).alias("step"), F.lit(n).alias("stage"), "*") for i, (n, d) in enumerate(stages.items())]
    return reduce(DataFrame.unionByName, each)


def pivot_levels(df: DataFrame, individual: str, level: str, levels, values: list[str]) -> DataFrame:
    """A10: one row per individual, columns {value}_level_{level}."""
    wide = df.groupBy(individual).pivot(level, list(levels)).agg(*[F.first(v).alias(v) for v in values])
    names = {f"{k}_{v}": f"{v}_level_{k}" for k in levels for v in values} if len(values) > 1 else {str(k): f"{values[0]}_level_{k}" for k in levels}
    return wide.select(individual, *[F.col(f"`{a}`").alias(b) for a, b in names.items()])


def mean_scores(df: DataFrame, individual: str, scores: str) -> DataFrame:
    """Mean score of each class over an individual's rows; rows that are all zero are skipped."""
    used = df.filter(F.exists(scores, lambda v: v != 0))
    each = used.select(individual, F.posexplode(scores).alias("class", "v")).groupBy(individual, "class").agg(F.avg("v").alias("v"))
    rows = each.groupBy(individual).agg(F.array_sort(F.collect_list(F.struct("class", "v"))).alias("s"))
    return rows.select(individual, F.transform("s", lambda p: p["v"]).alias(scores))


def fingerprint(df: DataFrame, portable: bool = False) -> DataFrame:
    """One row that changes with any value of the table, whatever the order of rows; and their number.

    ``portable``: from MD5 of the values as text, which other engines can repeat (slower; nulls are left out).
    """
    if portable:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]).cast("binary")), 1, 15), 16, 10).cast("long")
    else:
        h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(2**31 - 1))), F.lit(0)).alias("sum"))


def class_weights(df: DataFrame, label: str, floor: float = 0.0) -> DataFrame:
    """1 / n over the largest of these, but at least ``floor`` (10, as once configured, makes all weights 10)."""
    n = counts(df, label, name="n")
    w = (1 / F.col("n")) / F.max(1 / F.col("n")).over(Window.partitionBy())  # as many rows as classes
    return n.withColumn("weight", F.greatest(w, F.lit(float(floor))))


def year_coverage(catalog: DataFrame, *, key: str = "geo_index", product: str = "product", year: str = "tile_year", products: int = 3, after: int = 2017, last: int = 3) -> DataFrame:
    """Places with ``last`` years that all products have; the latest such years."""
    common = catalog.filter(F.col(year) > after).groupBy(key, year).agg(F.countDistinct(product).alias("n")).filter(F.col("n") == products)
    recent = F.row_number().over(Window.partitionBy(key).orderBy(F.col(year).desc()))
    few = common.withColumn("r", recent).filter(F.col("r") <= last)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(year)).alias("years")).filter(F.size("years") == last)


def complete_sets(df: DataFrame, key: str, at_least: int = 3) -> DataFrame:
    """Sets of files with at least so many members."""
    few = counts(df, key, name="__n").filter(F.col("__n") < at_least).select(key)
    return df.dropna(subset=[key]).join(few, key, "left_anti")


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def shared_taxa(train: DataFrame, test: DataFrame, taxon: str) -> tuple[DataFrame, DataFrame]:
    """Train cut to the taxa of test, then test to those of the reduced train."""
    train = of_keys(train, test.select(taxon).distinct(), taxon)
    return train, of_keys(test, train.select(taxon).distinct(), taxon)


def never_sampled(df: DataFrame, train: DataFrame, test: DataFrame, individual: str, taxon: str) -> DataFrame:
    """Individuals in neither split whose taxa are in neither split."""
    used = train.select(individual, taxon).union(test.select(individual, taxon))
    return df.join(used.select(individual).distinct(), individual, "left_anti").join(used.select(taxon).distinct(), taxon, "left_anti")


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """U4: distinct combinations."""
    return df.select(*columns).dropDuplicates()


def distinct_labels(*tables: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column of several tables."""
    return reduce(DataFrame.union, [t.select(column) for t in tables]).dropna().distinct()

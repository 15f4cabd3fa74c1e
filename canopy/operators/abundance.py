"""Landscape abundance and permutation draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.arrays import cumulative
from canopy.functions.draws import hash_uniform
from canopy.functions.geometry import Box
from canopy.operators.aggregates import counts
from canopy.operators.clean import one_year
from canopy.operators.spatial import clip_boxes, clip_points
from canopy.operators.windows import first_n


def abundance(predictions: DataFrame, ring: Column, *, keys: list[str], individual: str = "individual", taxon: str = "ensembleTaxonID", order: list[str], box: Box | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Individuals of each taxon inside a ring, for each of ``keys`` (a model): one row per individual, first in order."""
    one = first_n(predictions, [*keys, individual], order)
    inside = clip_boxes(one, ring, box) if box else clip_points(one, ring, x, y)
    return counts(inside, *keys, taxon)


def prediction_layer(predictions: DataFrame, ring: Column, *, individual: str = "individual", order: list[str], box: Box = Box()) -> DataFrame:
    """One row per individual, clipped."""
    return clip_boxes(first_n(predictions, [individual], order), ring, box)


def keep_draw(u: Column, score: Column) -> Column:
    """Keep with the score as probability; no score keeps."""
    return score.isNull() | F.isnan(score) | (u < score)


def category(u: Column, cumulated: Column) -> Column:
    """The first place whose cumulated probability is above u; the last if rounding leaves none."""
    at = F.size(F.filter(cumulated, lambda c: c <= u))
    return F.least(at, F.size(cumulated) - 1)


def permute(predictions: DataFrame, confusion: DataFrame, *, iterations: int = 100, labels: list[str], key: str = "row_id", taxon: str = "ensembleTaxonID", score: str = "ens_score", year: int | None = None, seed=0) -> DataFrame:
    """Every row in every iteration with its drawn taxon.

    ``confusion``: (taxon, p) with p over ``labels``. A row keeps its taxon by X3, else draws
    from its taxon's row; DEAD stays DEAD, and a taxon without a row stays as it is.
    """
    if year is not None:
        predictions = one_year(predictions, year)
    rows = confusion.select(F.col("taxon").alias(taxon), cumulative("p").alias("__cum"))
    met = predictions.join(rows, taxon, "left").withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    kept = keep_draw(hash_uniform(f"{seed}:keep", "iteration", key), F.col(score))
    drawn = F.get(F.lit(labels), category(hash_uniform(f"{seed}:draw", "iteration", key), F.col("__cum")))
    final = F.when((F.col(taxon) == "DEAD") | kept | F.col("__cum").isNull(), F.col(taxon)).otherwise(drawn)
    return met.withColumn("sampled", final).drop("__cum")


def permuted_counts(predictions: DataFrame, confusion: DataFrame, **options) -> DataFrame:
    """Rows of each taxon in each iteration. Rows multiply by iterations before the shuffle, but are counted where they are made."""
    return counts(permute(predictions, confusion, **options), "iteration", "sampled", name="n")


def permutation_summary(counted: DataFrame, iterations: int, shares=(0.025, 0.5, 0.975)) -> DataFrame:
    """Mean, deviation and quantiles of each taxon over all iterations; absent counts are 0."""
    every = F.array_repeat(F.lit(0), iterations)
    lists = counted.groupBy("sampled").agg(F.collect_list("n").alias("s")).withColumn("s", F.slice(F.concat(F.col("s").cast("array<double>"), every.cast("array<double>")), 1, iterations))
    values = lists.select("sampled", F.explode("s").alias("v"))
    return values.groupBy("sampled").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), *[F.percentile("v", q).alias(f"p{str(q).replace('0.', '')}") for q in shares])

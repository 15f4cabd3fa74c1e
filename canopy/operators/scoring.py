"""Scoring, post-processing and per-level models."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.arrays import argmax, ranked, softmax
from canopy.functions.geometry import box_area, Box
from canopy.operators.aggregates import class_weights, pivot_levels
from canopy.operators.clean import mask_dead, tall_crowns
from canopy.operators.hierarchy import ROUTES, route
from canopy.operators.spatial import natural


class Scorer(Protocol):
    """K5: anything that turns a table with ``features`` into one with ``yhat`` (array of class scores)."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def train_level(df: DataFrame, *, features: str = "features", label: str = "label", site: str | None = None, weight_floor: float = 0.0, max_iter: int = 50, tol: float = 1e-6) -> PipelineModel:
    """A weighted multinomial classifier on array features; with ``site``, its one-hot code is a further input (K6)."""
    weights = class_weights(df, label, weight_floor).select(label, "weight")
    rows = df.join(weights, label).withColumn("__v", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    stages, inputs = [], ["__v"]
    if site:
        stages += [StringIndexer(inputCol=site, outputCol="__s", handleInvalid="keep"), OneHotEncoder(inputCol="__s", outputCol="__o", handleInvalid="keep")]
        inputs.append("__o")
    stages += [VectorAssembler(inputCols=inputs, outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=max_iter, tol=tol, predictionCol="__p", probabilityCol="__q", rawPredictionCol="__r")]
    return Pipeline(stages=stages).fit(rows)


def fitted_moments(df: DataFrame, model: PipelineModel, *, features: str = "features", label: str = "label", site: str | None = None, weight_floor: float = 0.0) -> DataFrame:
    """(class, input, fitted, observed): weighted means of each input, over the probabilities of a class and over its rows.

    Their difference is the gradient of the weighted log-loss, so both agree for each class and input where a fit is an optimum.
    Inputs are "1" (the intercept), f0, f1 and so on, and the sites.
    """
    weights = class_weights(df, label, weight_floor).select(label, "weight")
    scored = scorer_of(model, features)(df).join(weights, label)
    kind = "array<struct<input:string,v:double>>"
    numbers = F.transform(features, lambda v, i: F.struct(F.concat(F.lit("f"), i.cast("string")), v)).cast(kind)
    ones = [F.struct(c, F.lit(1.0)) for c in (F.lit("1"), *([F.col(site).cast("string")] if site else []))]
    inputs = F.concat(F.array(*ones).cast(kind), numbers)
    each = scored.select(F.col(label).alias("__label"), "weight", F.posexplode("yhat").alias("class", "p"), inputs.alias("x")).select("__label", "weight", "class", "p", F.explode("x").alias("x"))
    total = scored.agg(F.sum("weight").alias("__total"))  # one row
    sums = each.groupBy("class", "x.input").agg(F.sum(F.col("weight") * F.col("p") * F.col("x.v")).alias("f"), F.sum(F.when(F.col("__label") == F.col("class"), F.col("weight") * F.col("x.v")).otherwise(0.0)).alias("o"))
    return sums.crossJoin(F.broadcast(total)).select("class", "input", (F.col("f") / F.col("__total")).alias("fitted"), (F.col("o") / F.col("__total")).alias("observed"))


def scorer_of(model: PipelineModel, features: str = "features") -> Scorer:
    """A fitted model as a scorer; ``yhat`` are probabilities, ``raw`` the margins."""

    def score(df: DataFrame) -> DataFrame:
        rows = df.withColumn("__v", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
        out = model.transform(rows)
        return out.withColumn("yhat", vector_to_array("__q")).withColumn("raw", vector_to_array("__r")).select(*df.columns, "yhat", "raw")

    return score


def score_levels(df: DataFrame, scorers: dict[int, Scorer], individual: str = "individual") -> DataFrame:
    """M1: (individual, level, yhat) for all levels."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [s(df).select(individual, F.lit(k).alias("level"), "yhat") for k, s in scorers.items()])


def gather_levels(scores: DataFrame, labels: DataFrame, levels, *, individual: str = "individual") -> DataFrame:
    """M2: wide label, score and taxon per level. ``labels``: (level, label, taxon). (individual, level) must be unique: it is checked."""
    top = scores.select(individual, "level", argmax("yhat").alias("label"), F.array_max("yhat").alias("score"))
    unique = top.groupBy(individual, "level").agg(F.count("*").alias("n"), F.first("label").alias("label"), F.first("score").alias("score"))
    checked = unique.withColumn("label", F.when(F.col("n") == 1, F.col("label")).otherwise(F.raise_error(F.lit("several rows for one individual and level")).cast("int")))
    named = checked.join(labels.select("level", "label", "taxon"), ["level", "label"], "left")
    return pivot_levels(named, individual, "level", levels, ["label", "score", "taxon"])


def route_levels(wide: DataFrame, routes=ROUTES) -> DataFrame:
    """M3 on the result of M2."""
    return route(wide, routes)


def top_two(scores: str | Column, probabilities: bool = False) -> list[Column]:
    """Best and second class and their scores (softmax first unless these are probabilities)."""
    r = ranked(scores if probabilities else softmax(scores))
    at = lambda k: F.get(r, F.lit(k))
    return [at(0)["index"].alias("top1"), at(0)["score"].alias("score1"), at(1)["index"].alias("top2"), at(1)["score"].alias("score2")]


def flat_predictions(df: DataFrame, labels: DataFrame, scores: str = "yhat", truth: str | None = None) -> DataFrame:
    """M4: top-1/top-2 labels, scores and taxa, and the true taxon."""
    got = df.select("*", *top_two(scores))
    names = labels
    for k in ("top1", "top2", *([truth] if truth else [])):
        got = got.join(names.select(F.col("label").alias(k), F.col("taxon").alias(f"{k}_taxon")), k, "left")
    return got


def dead_scores(df: DataFrame, scores: str = "dead_yhat") -> DataFrame:
    """M5: dead_label and dead_score of two-class scores."""
    p = softmax(scores)
    return df.withColumns({"dead_label": argmax(p), "dead_score": F.array_max(p)})


def detected_crowns(boxes: DataFrame, tile: str = "tile", order=("xmin", "ymin"), min_score: float | None = None) -> DataFrame:
    """M7: detector boxes (pixels with left, top, resolution) as a crown table with ids {i}_{tile}."""
    from canopy.functions.geometry import pixel_to_world
    from canopy.operators.windows import number_rows

    x0, y1 = pixel_to_world("xmin", "ymin", "left", "top", F.col("resolution"))
    x1, y0 = pixel_to_world("xmax", "ymax", "left", "top", F.col("resolution"))
    world = boxes.withColumns({"__x0": x0, "__y0": y0, "__x1": x1, "__y1": y1}).drop("xmin", "ymin", "xmax", "ymax")
    world = world.withColumnsRenamed({"__x0": "xmin", "__y0": "ymin", "__x1": "xmax", "__y1": "ymax"})
    if min_score is not None:
        world = world.filter(F.col("score") >= min_score)
    numbered = number_rows(world, list(order), "number", [tile])
    none = F.lit(None).cast("string")
    return numbered.withColumns({"individual": F.format_string("%d_%s", "number", tile), "plotID": none, "siteID": none, "taxonID": none}).drop("number")


def find_crowns(boxes: DataFrame, heights: DataFrame, dead: DataFrame | None = None, key: str = "individual") -> DataFrame:
    """Detected boxes with canopy heights, tall ones only, with dead scores."""
    crowns = tall_crowns(natural(detected_crowns(boxes), heights))
    return natural(crowns, dead_scores(dead).select(key, "dead_label", "dead_score")) if dead is not None else crowns


def tile_predictions(wide: DataFrame, crowns: DataFrame, *, threshold: float = 0.95, filter_dead: bool = True, labels: DataFrame | None = None, box: Box = Box()) -> DataFrame:
    """M6: routed labels joined to crown rows (one per year), dead ones masked, with areas."""
    routed = route(wide)
    if labels is not None:
        routed = routed.join(labels.select(F.col("taxon").alias("ensembleTaxonID"), F.col("label").alias("ens_label")), "ensembleTaxonID", "left")
    elif "ens_label" not in routed.columns:
        routed = routed.withColumn("ens_label", F.lit(None).cast("int"))
    got = natural(routed, crowns)
    if filter_dead:
        got = mask_dead(got, threshold)
    return got.withColumn("crown_area", box_area(box))


def prediction_crops(cells: DataFrame, crowns: DataFrame, dead: DataFrame, *, on: list[str]) -> DataFrame:
    """Cells of all crowns of a tile, with their dead scores."""
    from canopy.operators.raster import crop_cells

    return natural(crop_cells(cells, crowns, on=on), dead)


def novel_confidence(scores: DataFrame, rows: DataFrame, yhat: str = "yhat") -> DataFrame:
    """M8: for taxa that weren't trained: best raw score, best softmax, joined to the source rows."""
    return natural(scores.withColumns({"top_score": F.array_max(yhat), "top_softmax": F.array_max(softmax(yhat)), "top_label": argmax(yhat)}), rows)

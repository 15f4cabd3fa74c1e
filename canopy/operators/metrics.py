"""Evaluation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.arrays import normalise_row, ranked
from canopy.operators.spatial import natural
from canopy.operators.windows import first_n, running_hits


def micro_accuracy(df: DataFrame, truth: str = "label", pred: str = "pred", keys: list[str] | None = None) -> DataFrame:
    """V1: share of hits."""
    return df.groupBy(*(keys or [])).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("micro"))


def class_table(df: DataFrame, truth: str = "label", pred: str = "pred", keys: list[str] | None = None, name: str = "taxon") -> DataFrame:
    """Per class accuracy (recall) and precision; null where a class has no truth or no prediction.

    Truth and prediction are counted from one pass: each row gives one entry as truth and one as prediction.
    """
    keys = keys or []
    hit = (F.col(truth) == F.col(pred)).cast("int")
    sides = F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    tall = df.select(*keys, hit.alias("hit"), sides.alias("s")).select(*keys, F.col("s.c").alias(name), F.col("s.t").alias("t"), F.col("s.p").alias("p"), "hit")
    sums = tall.dropna(subset=[name]).groupBy(*keys, name).agg(F.sum("t").alias("n_truth"), F.sum("p").alias("n_pred"), F.sum(F.col("hit") * F.col("t")).alias("hits"))
    return sums.select(*keys, name, "n_truth", "n_pred", F.try_divide("hits", "n_truth").alias("accuracy"), F.try_divide("hits", "n_pred").alias("precision"))


def macro_accuracy(df: DataFrame, truth: str = "label", pred: str = "pred", keys: list[str] | None = None) -> DataFrame:
    """V2: mean recall of the classes that occur as truth or prediction (no truth counts as 0)."""
    keys = keys or []
    return class_table(df, truth, pred, keys).groupBy(*keys).agg(F.avg(F.coalesce("accuracy", F.lit(0.0))).alias("macro"))


def site_scores(df: DataFrame, site: str, truth: str = "label", pred: str = "pred") -> DataFrame:
    """V6: micro and macro accuracy of each site."""
    return micro_accuracy(df, truth, pred, [site]).join(macro_accuracy(df, truth, pred, [site]), site)


def top_k_accuracy(df: DataFrame, scores: str, truth: str = "label", k: int = 4) -> DataFrame:
    """V3: share of rows whose true class is among the k best."""
    best = F.transform(F.slice(ranked(scores), 1, k), lambda p: p["index"])
    return df.agg(F.avg(F.array_contains(best, F.col(truth)).cast("double")).alias("top_k"))


def confusion(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """V7: (truth, prediction, n); see confusion_wide for the matrix."""
    return df.dropna(subset=[truth, pred]).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_wide(df: DataFrame, classes, truth: str = "label", pred: str = "pred") -> DataFrame:
    """V7: one row per true class, a column per predicted class."""
    return df.groupBy(F.col(truth).alias("truth")).pivot(pred, list(classes)).count().fillna(0)


def confusion_norm(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """V8: each count over its row's sum."""
    n = confusion(df, truth, pred)
    total = n.groupBy("truth").agg(F.sum("n").alias("all"))
    return n.join(total, "truth").select("truth", "pred", (F.col("n") / F.col("all")).alias("share"))


def normalised_matrix(rows: DataFrame, values: str = "matrix") -> DataFrame:
    """V8: the same for rows that are arrays."""
    return rows.withColumn(values, normalise_row(values))


def site_confusion(df: DataFrame, sites: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """V9: share of errors whose classes occur at a common site; 0 without errors. ``sites``: (taxon, array of sites)."""
    wrong = df.filter(F.col(truth) != F.col(pred))
    a = sites.select(F.col("taxon").alias(truth), F.col("sites").alias("__a"))
    b = sites.select(F.col("taxon").alias(pred), F.col("sites").alias("__b"))
    met = wrong.join(a, truth, "left").join(b, pred, "left")
    return met.agg(F.coalesce(F.avg(F.coalesce(F.arrays_overlap("__a", "__b"), F.lit(False)).cast("double")), F.lit(0.0)).alias("within"))


def genus_confusion(df: DataFrame, names: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """Share of errors within a genus (first word of the scientific name); 0 without errors. ``names``: (taxon, name)."""
    genus = F.get(F.split("name", r"\s+"), F.lit(0))
    wrong = df.filter(F.col(truth) != F.col(pred))
    a = names.select(F.col("taxon").alias(truth), genus.alias("__a"))
    b = names.select(F.col("taxon").alias(pred), genus.alias("__b"))
    met = wrong.join(a, truth, "left").join(b, pred, "left")
    return met.agg(F.coalesce(F.avg(F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)).cast("double")), F.lit(0.0)).alias("within"))


def pr_curve(df: DataFrame, score: str, hit: str) -> DataFrame:
    """Threshold, precision and recall at each distinct score."""
    total = df.agg(F.sum(F.col(hit).cast("long")).alias("t")).first()["t"]
    run = running_hits(df.filter(F.col(score).isNotNull()), score, hit)
    recall = F.col("hits") / F.lit(float(total)) if total else F.lit(None).cast("double")
    return run.select(F.col(score).alias("threshold"), (F.col("hits") / F.col("rows")).alias("precision"), recall.alias("recall"))


def truth_pairs(predictions: DataFrame, truth: DataFrame, individual: str, order: list[str]) -> DataFrame:
    """Each individual's first prediction beside its truth; individuals without either are left out."""
    return natural(first_n(predictions, [individual], order), truth)


def evaluation_frame(predictions: DataFrame, crowns: DataFrame, *tables: DataFrame) -> DataFrame:
    """Predictions joined to their crowns and these to dictionary tables (species, sites), each on the columns they share."""
    return reduce(natural, tables, natural(predictions, crowns))


def evaluation(df: DataFrame, site: str, truth: str = "label", pred: str = "pred") -> dict[str, DataFrame]:
    """All tables of an evaluation, of a frame with truth, prediction and site."""
    return {"micro": micro_accuracy(df, truth, pred), "macro": macro_accuracy(df, truth, pred), "classes": class_table(df, truth, pred), "sites": site_scores(df, site, truth, pred), "confusion": confusion(df, truth, pred)}

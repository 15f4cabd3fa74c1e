"""Plot-disjoint train/test splits searched in parallel, and label encoding."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.functions.draws import hash_order
from canopy.operators.aggregates import counts, distinct_labels, enough_individuals, enough_rows, shared_taxa
from canopy.operators.clean import without_fixed
from canopy.sources.io import staged


@dataclass(frozen=True)
class Names:
    plot: str = "plotID"
    taxon: str = "taxonID"
    individual: str = "individual"
    site: str = "siteID"
    box_id: str = "box_id"


def plot_counts(df: DataFrame, names: Names = Names()) -> DataFrame:
    """Individuals of each taxon in each plot: all that the search needs, small however many rows there are."""
    return df.dropna(subset=[names.plot, names.taxon]).groupBy(names.plot, names.taxon).agg(F.countDistinct(names.individual).alias("n"))


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    """One iteration: walk plots in order; one that holds a taxon still short goes to test.

    Only (plot, taxon, n) counts of one site and iteration come here.
    """
    frame = frame.sort_values(["place", "taxon"])
    have: dict[str, int] = {}
    chosen = []
    for plot, rows in frame.groupby("place", sort=True):
        if any(have.get(t, 0) <= f for t, f in zip(rows["taxon"], rows["floor"], strict=True)):
            chosen.append(rows["plot"].iloc[0])
            for t, n in zip(rows["taxon"], rows["n"], strict=True):
                have[t] = have.get(t, 0) + int(n)
    return pd.DataFrame({"iteration": frame["iteration"].iloc[0], "plot": pd.Series(chosen, dtype="object")})


def test_plots(df: DataFrame, home, iterations: int, *, min_test: int, names: Names = Names(), seed=0) -> DataFrame:
    """(iteration, plot) of the test plots of each iteration.

    With two plots or fewer the first is test. Otherwise plots of the home site are walked in
    a seeded random order; a taxon is done once its test count is strictly above the greater
    of 5 % of its individuals and ``min_test``. Iterations run side by side.
    """
    spark = df.sparkSession
    few = df.select(names.plot).dropna().distinct().orderBy(names.plot).limit(3).collect()
    if len(few) <= 2:
        rows = [(i, few[0][0]) for i in range(iterations)] if few else []
        return spark.createDataFrame(rows, f"iteration int, plot {df.schema[names.plot].dataType.simpleString()}")
    per = plot_counts(df.filter(F.col(names.site) == home), names)
    total = df.dropna(subset=[names.taxon]).groupBy(names.taxon).agg(F.countDistinct(names.individual).alias("all"))
    tall = per.join(total, names.taxon).select(F.col(names.plot).cast("string").alias("plot"), F.col(names.taxon).cast("string").alias("taxon"), "n", F.greatest(0.05 * F.col("all"), F.lit(float(min_test))).alias("floor"))
    tries = tall.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    order = Window.partitionBy("iteration").orderBy(hash_order(seed, "iteration", "plot"), "plot")
    placed = tries.withColumn("place", F.dense_rank().over(order))
    chosen = placed.groupBy("iteration").applyInPandas(_greedy, "iteration int, plot string")
    return chosen.withColumn("plot", F.col("plot").cast(df.schema[names.plot].dataType))


def apply_split(df: DataFrame, plots: DataFrame, *, min_train: int, min_test: int, names: Names = Names()) -> tuple[DataFrame, DataFrame]:
    """Train and test from test plots: no fallback boxes in test, enough individuals in each, taxa of both."""
    keys = staged(plots.select(F.col("plot").alias(names.plot)).distinct(), "keys")
    test, train = df.join(keys, names.plot, "left_semi"), df.join(keys, names.plot, "left_anti")
    if names.box_id in df.columns:
        test = without_fixed(test, names.box_id)
    train = enough_individuals(train, names.taxon, names.individual, min_train)
    test = enough_individuals(test, names.taxon, names.individual, min_test)
    return shared_taxa(train, test, names.taxon)


def split_scores(df: DataFrame, plots: DataFrame, iterations: int, *, min_train: int, min_test: int, names: Names = Names()) -> DataFrame:
    """For each iteration the test taxa and train rows that apply_split would leave, worked out from counts."""
    boxes = F.col(names.box_id).contains("fixed") if names.box_id in df.columns else F.lit(False)
    per = df.dropna(subset=[names.plot, names.taxon]).groupBy(names.plot, names.taxon).agg(
        F.count("*").alias("rows"), F.countDistinct(names.individual).alias("n"), F.countDistinct(F.when(~F.coalesce(boxes, F.lit(False)), F.col(names.individual))).alias("n_test")
    )
    every = per.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    sides = every.join(plots.select("iteration", F.col("plot").alias(names.plot), F.lit(True).alias("test")), ["iteration", names.plot], "left")
    by = sides.groupBy("iteration", names.taxon).agg(
        F.sum(F.when(F.col("test"), F.col("n_test")).otherwise(0)).alias("test_n"),
        F.sum(F.when(F.col("test").isNull(), F.col("n")).otherwise(0)).alias("train_n"),
        F.sum(F.when(F.col("test").isNull(), F.col("rows")).otherwise(0)).alias("train_rows"),
    )
    both = by.filter((F.col("test_n") >= max(1, min_test)) & (F.col("train_n") >= max(1, min_train)))
    return both.groupBy("iteration").agg(F.count("*").alias("test_taxa"), F.sum("train_rows").alias("train_rows"))


def best_split(df: DataFrame, home, *, iterations: int = 100, min_train: int = 10, min_test: int = 10, names: Names = Names(), seed=0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, test and the table of scores; most test taxa win, then most train rows, then the first.

    With two plots or fewer the first is test and the second is train, as they are.
    """
    usable = enough_rows(df, names.taxon, min_train + min_test)
    if len(few := usable.select(names.plot).dropna().distinct().limit(3).collect()) <= 2:
        first = min((r[0] for r in few), default=None)
        on = F.col(names.plot) == F.lit(first)
        scores = usable.filter(on).groupBy(F.lit(0).alias("iteration")).agg(F.countDistinct(names.taxon).alias("test_taxa")).withColumn("train_rows", F.lit(usable.filter(~on).count()).cast("long"))
        return usable.filter(~on), usable.filter(on), scores
    plots = staged(test_plots(usable, home, iterations, min_test=min_test, names=names, seed=seed), "test-plots")
    scores = split_scores(usable, plots, iterations, min_train=min_train, min_test=min_test, names=names)
    best = scores.orderBy(F.desc("test_taxa"), F.desc("train_rows"), "iteration").first()
    if best is None:
        raise ValueError("no split leaves a taxon with enough individuals in train and test")
    train, test = apply_split(usable, plots.filter(F.col("iteration") == best["iteration"]), min_train=min_train, min_test=min_test, names=names)
    return train, test, scores


def encode_labels(*tables: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Dense numbers from 0 in sorted order over all tables (as many rows as labels)."""
    labels = distinct_labels(*tables, column=column)
    return labels.withColumn(name, (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))


def class_inventory(df: DataFrame, taxon: str, individual: str) -> DataFrame:
    """Rows and individuals of each taxon."""
    return counts(df, taxon, name="rows").join(df.dropna(subset=[taxon]).groupBy(taxon).agg(F.countDistinct(individual).alias("individuals")), taxon)

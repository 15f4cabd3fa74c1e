"""Operators on places and extents give what the pairs give, and don't grow with pairs of copies."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import aggregates, raster, spatial, split
from canopy.plans import pipelines

COPIES = 20_000


def plain(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(1)
    some = [(i, i % 2, float(r.randrange(12)), float(r.randrange(12)), r.choice([None, 1.0, 2.0, 3.0]), r.choice([None, 1.0, 2.0])) for i in range(300)]
    return spark.createDataFrame([*some, (300, 0, None, 1.0, 9.0, 9.0)], "individual long, plot long, x double, y double, height double, CHM_height double")


@pytest.fixture(scope="module")
def boxes(spark):
    r = random.Random(2)
    some = [(f"b{i}", i % 2, x := float(r.randrange(12)), y := float(r.randrange(12)), x + r.randrange(4), y + r.randrange(4), i / 10) for i in range(120)]
    return spark.createDataFrame([*some, ("b7", 1, 3.0, 3.0, 9.0, 9.0, 0.7)], "box_id string, plot long, xmin double, ymin double, xmax double, ymax double, score double")


@pytest.fixture(scope="module")
def pairs(points, boxes):
    return spatial.points_in_boxes(points, boxes, on=["plot"])


def test_copies_in_boxes(points, boxes, pairs):
    got = spatial.copies_in_boxes(points, boxes, on=["plot"])
    assert sorted(got.columns) == sorted(pairs.columns)
    assert plain(got, *pairs.columns) == plain(pairs, *pairs.columns)
    assert plain(spatial.points_in_any(points, boxes, on=["plot"]), "individual") == plain(pairs.select("individual").distinct(), "individual")


def test_nearest_of_boxes(points, boxes, pairs):
    got = spatial.nearest_of_boxes(points, boxes, on=["plot"])
    assert plain(got, *pairs.columns) == plain(spatial.nearest_box(pairs), *pairs.columns)


def test_first_in_boxes(points, boxes, pairs):
    got = spatial.first_in_boxes(points, boxes, ["plot", "box_id"], ["individual"], on=["plot"])
    assert plain(got, "individual", "plot", "box_id") == plain(spatial.dedupe_boxes(pairs, ["plot", "box_id"], ["individual"]), "individual", "plot", "box_id")


@pytest.mark.parametrize("drop", [True, False])
def test_tallest_of_boxes(points, boxes, pairs, drop):
    for p in (points, points.withColumn("height", F.lit(None).cast("double"))):
        met = spatial.points_in_boxes(p, boxes, on=["plot"])
        want = spatial.tallest_in_box(met, drop_unmeasured=drop)
        got = spatial.tallest_of_boxes(p, boxes, drop_unmeasured=drop, on=["plot"])
        assert plain(got, *pairs.columns) == plain(want, *pairs.columns)


def test_zones_of_one_extent_and_keys_that_come_again(points, boxes, pairs):
    cells = points.withColumn("value", F.coalesce("height", F.lit(0.2)) + F.col("individual") / 1000)
    met = spatial.points_in_boxes(cells, boxes, on=["plot"]).filter("value >= 0.5")
    want = boxes.join(met.groupBy("box_id").agg(F.percentile("value", 0.99).alias("h")), "box_id", "left").select("box_id", "xmin", F.round("h", 9).alias("h"))
    got = raster.zonal_p99(cells, boxes, "box_id", on=["plot"]).select("box_id", "xmin", F.round("CHM_height", 9).alias("h"))
    assert plain(got, "box_id", "xmin", "h") == plain(want, "box_id", "xmin", "h")


@pytest.mark.parametrize("whole", [4, 1_000])
def test_weighted_quantiles(spark, whole):
    r = random.Random(3)
    rows = [(i % 3, float(r.randrange(40)), r.randrange(1, 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v double, w long")
    want = df.groupBy("k").agg(F.round(F.percentile("v", 0.9, F.col("w")), 9).alias("q"))
    got = aggregates.exact_quantiles(df, "k", "v", 0.9, whole=whole, bins=4, weight="w").select("k", F.round("quantile", 9).alias("q"))
    assert plain(got, "k", "q") == plain(want, "k", "q")


def test_spectra_without_crops(spark):
    r = random.Random(4)
    cells = spark.createDataFrame([(float(x := r.randrange(8)), float(y := r.randrange(8)), "0_0", 2018 + i % 2, [float(i), None if i % 5 == 0 else 2.0 * i]) for i in range(150)], "x double, y double, geo_index string, tile_year int, bands array<double>")
    crowns = spark.createDataFrame([(i % 30, float(r.randrange(10)), float(r.randrange(10))) for i in range(40)], "individual long, xmin double, ymin double").withColumns({"xmax": F.col("xmin") + 2, "ymax": F.col("ymin") + 1})
    catalog = cells.select("geo_index", "tile_year").distinct()
    cropped, _ = pipelines.generate_crops(crowns, cells, catalog)
    tall = lambda d: d.select("individual", F.explode("years").alias("year", "bands")).select("individual", "year", F.transform("bands", lambda v: F.round(v, 9)).alias("bands"))
    want, got = pipelines.yearly_features(cropped, bands=2), pipelines.yearly_spectra(crowns, cells, catalog, bands=2)
    assert plain(tall(got), "individual", "year", "bands") == plain(tall(want), "individual", "year", "bands")
    assert plain(pipelines.annotations(pipelines.cropped_crowns(crowns, cells, catalog)), "individual", "tile_year") == plain(pipelines.annotations(cropped), "individual", "tile_year")


def test_radius_plots_of_copies(spark):
    """400 million pairs of points within the radius."""
    p = spark.range(COPIES).select(F.col("id").alias("position"), (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = spatial.radius_plots(p).groupBy("plot").count().collect()
    assert [tuple(r) for r in got] == [(COPIES - 1, COPIES)]


def test_copies_of_one_place_and_extent(spark):
    """400 million pairs of a point and a box; a result of one row each."""
    p = spark.range(COPIES).select(F.col("id").alias("individual"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.col("id").cast("double").alias("height"), F.lit(1.0).alias("CHM_height"))
    b = spark.range(COPIES).select(F.format_string("b%05d", "id").alias("box_id"), F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(2.0).alias("xmax"), F.lit(2.0).alias("ymax"), F.lit(0.5).alias("score"))
    near = spatial.nearest_of_boxes(p, b).groupBy("box_id").count().collect()
    assert [tuple(r) for r in near] == [("b00000", COPIES)]
    firsts = spatial.first_in_boxes(p, b, ["box_id"], ["individual"]).groupBy("individual").count().collect()
    assert [tuple(r) for r in firsts] == [(0, COPIES)]
    top = spatial.tallest_of_boxes(p, b).groupBy("individual").count().collect()
    assert [tuple(r) for r in top] == [(COPIES - 1, COPIES)]
    crowns = pipelines.associate(p.withColumn("plotID", F.lit("a")), b.withColumn("plotID", F.lit("a"))).collect()
    assert [(r["individual"], r["box_id"]) for r in crowns] == [(COPIES - 1, "b00000")]


def test_rings_of_one_shape(spark):
    p = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 4).cast("double").alias("x"), F.lit(1.0).alias("y"))
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    rings = spark.range(10).select(F.col("id").alias("ring_id"), F.array(at(0.0, 0.0), at(2.0, 0.0), at(2.0, 2.0), at(0.0, 2.0)).alias("ring"))
    got = spatial.points_in_rings(p, rings)
    assert sorted(got.columns) == ["k", "ring", "ring_id", "x", "y"]
    assert plain(got, "k", "ring_id") == sorted(repr(r) for r in p.filter("x <= 2").crossJoin(rings).select("k", "ring_id").collect())


def test_individuals_are_spread_over_tasks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", None), (None, 1)], "k string, i int")
    got = aggregates.individuals_of(df, "k", "i", "n")
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("b", 0)}
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_rows_of_few_keys_are_not_brought_together(spark):
    """Rows of eight taxa and forty plots: none is sorted or sent by its key to be kept or dropped."""
    rows = spark.range(3_000_000).select("id", F.concat(F.lit("t"), F.col("id") % 8).alias("taxonID"), F.concat(F.lit("P"), F.col("id") % 40).alias("plotID"), (F.col("id") % 4_000).alias("individual"))
    plots = spark.createDataFrame([(0, f"P{k}") for k in range(16)], "iteration int, plot string")
    train, test = split.apply_split(rows, plots, min_train=2, min_test=1)
    found = [aggregates.enough_rows(rows, "taxonID", 10), aggregates.enough_individuals(rows, "taxonID", "individual", 2), train, test]
    assert [f.count() for f in found] == [3_000_000, 3_000_000, 1_800_000, 1_200_000]
    assert not any("SortMergeJoin" in f._jdf.queryExecution().executedPlan().toString() for f in found)


def written(df, tmp_path):
    """Rows and bytes of a result that is written."""
    df.write.parquet(str(tmp_path / "out"))
    return df.sparkSession.read.parquet(str(tmp_path / "out")).count(), sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))


def test_crops_of_one_place_are_not_held_at_once(spark):
    """36 million rows of 6,000 cells and 6,000 crowns, which a task hands on block by block."""
    cells = spark.range(6_000).select(F.lit("0_0").alias("geo_index"), F.lit(1.0).alias("cell_x"), F.lit(1.0).alias("cell_y"))
    crowns = spark.range(6_000).select(F.col("id").alias("individual"), F.lit("0_0").alias("geo_index"), *[F.lit(v).alias(n) for n, v in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 2.0), ("ymax", 2.0))])
    blocks = spatial._blocks(cells, ["geo_index", "cell_x", "cell_y"], "some").select(F.size("some").alias("n"))
    assert blocks.agg(F.sum("n"), F.max("n")).first() == (6_000, 256)
    raster.crop_cells(cells, crowns, on=["geo_index"], x="cell_x", y="cell_y").write.format("noop").mode("overwrite").save()


def test_crops_come_apart_in_many_tasks(spark):
    cells = spark.range(4_000).select(F.lit("0_0").alias("geo_index"), (F.col("id") % 400).cast("double").alias("cell_x"), F.lit(1.0).alias("cell_y"))
    crowns = spark.range(4_000).select(F.col("id").alias("individual"), F.lit("0_0").alias("geo_index"), (F.col("id") % 400).cast("double").alias("xmin"), F.lit(0.0).alias("ymin")).withColumns({"xmax": F.col("xmin") + 1, "ymax": F.col("ymin") + 1})
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = raster.crop_cells(cells, crowns, on=["geo_index"], x="cell_x", y="cell_y")
        per_task = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(r["count"] for r in per_task) == 4_000 * 10 + 3_990 * 10
    assert len(per_task) == 16 and max(r["count"] for r in per_task) < 3 * 79_900 // 16


def test_written_pairs_of_copies_are_small(spark, tmp_path):
    """40,000 points at one place, read in 64 parts, and two extents of 50 boxes."""
    p = spark.range(0, 40_000, 1, 64).select(F.col("id").alias("individual"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    b = spark.range(0, 100, 1, 64).select(F.col("id").alias("box"), F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), (F.col("id") % 2 + 2).cast("double").alias("xmax"), F.lit(2.0).alias("ymax"))
    rows, size = written(spatial.copies_in_boxes(p, b).select("individual", "box"), tmp_path)
    assert rows == 40_000 * 100 and size < 0.5 * rows


def test_written_pairs_of_rings_are_small(spark, tmp_path):
    """40,000 points at one place, read in 64 parts, and two shapes of 50 rings."""
    p = spark.range(0, 40_000, 1, 64).select(F.col("id").alias("k"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).alias("y"))
    east = F.col("id") % 2 + 2
    rings = spark.range(0, 100, 1, 64).select(F.col("id").alias("ring_id"), F.array(corner(F.lit(0), 0.0), corner(east, 0.0), corner(east, 2.0), corner(F.lit(0), 2.0)).alias("ring"))
    rows, size = written(spatial.points_in_rings(p, rings).select("k", "ring_id"), tmp_path)
    assert rows == 40_000 * 100 and size < 0.5 * rows

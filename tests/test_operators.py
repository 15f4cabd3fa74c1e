"""Known answers and rules of the operators."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.functions import arrays, geometry, projection, tiles
from canopy.functions.draws import hash_uniform
from canopy.operators import abundance, aggregates, clean, hierarchy, metrics, raster, scoring, spatial, split, windows
from canopy.plans import pipelines
from canopy.sources import io


def one(spark, column, **values):
    return spark.createDataFrame([Row(**(values or {"a": 1}))]).select(column.alias("v")).first()["v"]


def test_height_rules(spark):
    df = spark.createDataFrame([(11.0, 6.0), (20.0, 19.0), (5.0, 7.0), (0.5, 5.0), (10.0, None), (None, 10.0)], "CHM_height double, height double")
    kept = clean.height_rules(df).filter("keep").select("CHM_height", "height").collect()
    assert {tuple(r) for r in kept} == {(20.0, 19.0), (5.0, 7.0), (10.0, None)}
    assert clean.height_rules(df, least=None).filter("keep").count() == 6


def test_shaded(spark):
    df = spark.createDataFrame([("a", "Full shade"), ("a", None), ("b", "Full shade"), ("b", "Full sun"), ("c", None)], "individual string, canopyPosition string")
    assert {r[0] for r in clean.drop_shaded(df).collect()} == {"b", "c"}


def test_site_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (1, 0)], "label int, pred int")
    same = spark.createDataFrame([(0, [0]), (1, [0])], "taxon int, sites array<int>")
    apart = spark.createDataFrame([(0, [1]), (1, [0])], "taxon int, sites array<int>")
    assert metrics.site_confusion(df, same).first()[0] == 1
    assert metrics.site_confusion(df, apart).first()[0] == 0
    assert metrics.site_confusion(df.filter("label = pred"), same).first()[0] == 0


def test_genus_confusion(spark):
    names = spark.createDataFrame([(0, "Acer rubrum"), (1, "Quercus muehlenbergii"), (2, "Quercus laevis")], "taxon int, name string")
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (1, 2)], "label int, pred int")
    assert metrics.genus_confusion(df, names).first()[0] == 1
    assert metrics.genus_confusion(spark.createDataFrame([(1, 0)], "label int, pred int"), names).first()[0] == 0


def test_permutation_keeps_dead_and_total(spark):
    p = spark.createDataFrame([(0, "A", 0.9999, 2021), (1, "A", 0.05, 2021), (2, "B", 0.9999, 2021), (3, "DEAD", None, 2021), (4, "A", 0.5, 2020)], "row_id int, ensembleTaxonID string, ens_score double, tile_year int")
    confusion = spark.createDataFrame([("A", [0.85, 0.15]), ("B", [0.15, 0.85])], "taxon string, p array<double>")
    got = abundance.permuted_counts(p, confusion, iterations=30, labels=["A", "B"], year=2021)
    per = got.groupBy("iteration").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("sampled") == "DEAD", F.col("n"))).alias("d")).collect()
    assert len(per) == 30 and all(r["n"] == 4 and r["d"] == 1 for r in per)
    s = abundance.permutation_summary(got, 30).filter("sampled = 'DEAD'").first()
    assert s["mean"] == 1 and s["sd"] == 0


def test_year_mean_skips_zero_years(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("a", [0.0, 0.0])], "individual string, s array<double>")
    assert aggregates.mean_scores(df, "individual", "s").first()["s"] == [2.0, 4.0]


def test_p99(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (0.1,), (math.nan,)], "v double")
    assert df.agg(aggregates.p99_from("v")).first()[0] == pytest.approx(9.79)
    assert df.filter("v < 0.5").agg(aggregates.p99_from("v")).first()[0] is None


def test_association_rules(spark):
    stems = spark.createDataFrame([("P", "s1", 1.0, 1.0, 9.0, 8.0), ("P", "s2", 1.5, 1.0, 12.0, 8.0), ("P", "s3", 50.0, 50.0, 5.0, 4.0)], "plotID string, individual string, x double, y double, height double, CHM_height double")
    boxes = spark.createDataFrame([("P", "b1", 0.0, 0.0, 2.0, 2.0), ("P", "b2", 0.0, 0.0, 9.0, 9.0), ("P", "b3", 80.0, 80.0, 81.0, 81.0)], "plotID string, box_id string, xmin double, ymin double, xmax double, ymax double")
    got = {r["individual"]: r for r in pipelines.associate(stems, boxes).collect()}
    assert set(got) == {"s2", "s3"} and got["s2"]["box_id"] == "b1"
    assert got["s3"]["box_id"].startswith("fixed_box_") and got["s3"]["score"] is None
    moved = boxes.withColumns({c: F.col(c) + 1000 for c in ("xmin", "ymin", "xmax", "ymax")})
    assert all(r["box_id"].startswith("fixed_box") for r in pipelines.associate(stems, moved).collect())


def test_join_equals_cross_join(spark):
    pts = spark.range(300).select(F.col("id").alias("p"), (F.col("id") * 37 % 101 - 50).cast("double").alias("x"), (F.col("id") * 53 % 97 - 50).cast("double").alias("y"))
    box = spark.range(80).select(F.col("id").alias("b"), (F.col("id") * 29 % 90 - 50).cast("double").alias("xmin"), (F.col("id") * 31 % 90 - 50).cast("double").alias("ymin")).withColumns({"xmax": F.col("xmin") + F.col("b") % 13, "ymax": F.col("ymin") + F.col("b") % 7})
    plain = pts.crossJoin(box).filter("x between xmin and xmax and y between ymin and ymax").select("p", "b")
    for size in (None, 1.0, 7.5, 500.0):
        got = spatial.points_in_boxes(pts, box, size=size).select("p", "b")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_ring(spark):
    ring = geometry.literal_ring([(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)])
    pts = spark.createDataFrame([(1.0, 1.0, True), (5.0, 6.0, False), (5.0, 5.0, True), (0.0, 3.0, True), (11.0, 1.0, False)], "x double, y double, want boolean")
    assert all(r["want"] == r["got"] for r in pts.withColumn("got", geometry.point_in_ring("x", "y", ring)).collect())
    boxes = spark.createDataFrame([(-1.0, -1.0, 11.0, 11.0, True), (4.0, 7.0, 6.0, 8.0, False), (9.0, 9.0, 12.0, 12.0, True), (20.0, 20.0, 21.0, 21.0, False), (1.0, 1.0, 2.0, 2.0, True)], "xmin double, ymin double, xmax double, ymax double, want boolean")
    assert all(r["want"] == r["got"] for r in boxes.withColumn("got", geometry.box_meets_ring(geometry.Box(), ring)).collect())
    assert one(spark, geometry.ring_area(ring)) == 75.0


def test_projection(spark):
    lon, lat = projection.to_geographic(F.lit(500000.0), F.lit(4649776.22), F.lit(18))
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert r["lon"] == pytest.approx(-75.0, abs=1e-9) and r["lat"] == pytest.approx(42.0, abs=1e-6)
    df = spark.createDataFrame([(243000.0, 4330000.0), (760000.0, 4300000.0)], "e double, n double")
    x, y = projection.change_zone("e", "n", 18, 17)
    there = df.select("e", "n", x.alias("x"), y.alias("y"))
    bx, by = projection.change_zone("x", "y", 17, 18)
    for r in there.select("e", "n", bx.alias("bx"), by.alias("by")).collect():
        assert abs(r["e"] - r["bx"]) < 0.01 and abs(r["n"] - r["by"]) < 0.01


def test_names(spark):
    df = spark.createDataFrame([("/p/2019/FullSite/AB_D17_SITE_DP3_404000_3286000_image.tif",)], "path string")
    r = df.select(tiles.geo_index_from_name("path"), tiles.site_from_name("path"), tiles.domain_from_name("path"), tiles.year_from_path("path"), tiles.base_name("path")).first()
    assert tuple(r) == ("404000_3286000", "SITE", "D17", 2019, "AB_D17_SITE_DP3_404000_3286000_image")
    assert one(spark, tiles.geo_index(F.lit(404111.5), F.lit(3286500.0), F.lit(404113.0), F.lit(3286502.0))) == "404000_3286000"
    assert one(spark, tiles.year_from_name(F.lit("x_y.tif"))) is None


def test_arrays(spark):
    assert one(spark, F.size(arrays.drop_water(F.array_repeat(F.lit(1), 426)))) == 369
    assert one(spark, F.size(arrays.trim(F.array_repeat(F.lit(1), 369)))) == 349
    assert one(spark, arrays.min_max(F.array(F.lit(2.0), F.lit(2.0)))) == [0.0, 0.0]
    assert one(spark, arrays.min_max(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0)))) == [0.0, 1.0, 0.5]
    assert one(spark, arrays.resize(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))), 4))[0] == [1, 1, 2, 2]
    assert one(spark, arrays.argmax(F.array(F.lit(1), F.lit(5), F.lit(5)))) == 1
    assert one(spark, arrays.cumulative(F.array(F.lit(0.25), F.lit(0.75)))) == [0.25, 1.0]
    assert sum(one(spark, arrays.softmax(F.array(F.lit(1000.0), F.lit(1001.0))))) == pytest.approx(1)
    assert one(spark, arrays.one_hot(F.lit(1), 3)) == [0, 1, 0]


def test_split_rules(spark):
    rows = [(i, f"i{i % 120}", f"T{i % 120 % 6}", f"P{i % 120 % 25}", "S") for i in range(600)]
    df = spark.createDataFrame(rows, "row int, individual string, taxonID string, plotID string, siteID string")
    train, test, scores = split.best_split(df, "S", iterations=10, min_train=3, min_test=2, seed=1)
    a, b = train.toPandas(), test.toPandas()
    assert len(a) and len(b) and not set(a.individual) & set(b.individual) and not set(a.plotID) & set(b.plotID)
    assert set(a.taxonID) == set(b.taxonID) and (b.groupby("taxonID").individual.nunique() >= 2).all()
    best = scores.orderBy(F.desc("test_taxa"), F.desc("train_rows"), "iteration").first()
    assert best["test_taxa"] == b.taxonID.nunique()
    again = split.best_split(df, "S", iterations=10, min_train=3, min_test=2, seed=1)[1].toPandas()
    assert sorted(again.row) == sorted(b.row)


def test_hierarchy(spark):
    wide = spark.createDataFrame([("a", "PIPA2", "BROADLEAF", "OAK", "PICL", "QUNI"), ("b", "OTHER", "BROADLEAF", "OAK", "PICL", "QUNI"), ("c", "OTHER", "CONIFER", "OAK", "PICL", "QUNI"), ("d", "OTHER", "BROADLEAF", "ACRU", "PICL", "QUNI")], "individual string, " + ", ".join(f"taxon_level_{k} string" for k in range(5)))
    wide = wide.withColumns({f"score_level_{k}": F.lit(k / 10) for k in range(5)})
    got = {r["individual"]: (r["ensembleTaxonID"], r["ens_level"]) for r in hierarchy.route(wide).collect()}
    assert got == {"a": ("PIPA2", 0), "b": ("QUNI", 4), "c": ("PICL", 3), "d": ("ACRU", 2)}


def test_gather_wants_unique_rows(spark):
    labels = spark.createDataFrame([(0, 0, "A"), (0, 1, "B")], "level int, label int, taxon string")
    scores = spark.createDataFrame([("x", 0, [0.1, 0.9]), ("x", 0, [0.2, 0.8])], "individual string, level int, yhat array<double>")
    with pytest.raises(Exception, match="several rows"):
        scoring.gather_levels(scores, labels, [0]).collect()


def test_missing_dictionary_key_fails(spark):
    df = spark.createDataFrame([("A",), ("Z",)], "taxon string")
    table = spark.createDataFrame([("A", 0)], "taxon string, label int")
    with pytest.raises(Exception, match="Z"):
        spatial.look_up(df, table, "taxon", "label").collect()
    assert spatial.look_up(df, table, "taxon", "label", strict=False).count() == 2


def test_crops_for_every_year(spark):
    cells = spark.createDataFrame([("400000_3280000", y, r, c, 400000.5 + c, 3280000.5 + r, [1, 2]) for y in (2018, 2019) for r in range(6) for c in range(6)], "geo_index string, tile_year int, row int, col int, x double, y double, bands array<smallint>")
    crowns = spark.createDataFrame([("i1", 400001.0, 3280001.0, 400003.0, 3280003.0), ("i2", 400900.0, 3280900.0, 400901.0, 3280901.0)], "individual string, xmin double, ymin double, xmax double, ymax double")
    cropped, empty = pipelines.generate_crops(crowns, cells, cells)
    assert {(r["individual"], r["tile_year"]) for r in pipelines.annotations(cropped).collect()} == {("i1", 2018), ("i1", 2019)}
    assert [r["individual"] for r in empty.collect()] == ["i2"]
    crops = raster.crop_rows(cropped, ["individual", "tile_year"])
    assert all(len(r["crop"]) == 2 and len(r["crop"][0]) == 2 for r in crops.collect())
    assert all(len(r["p"]) == 11 for r in crops.select(raster.preprocess("crop").alias("p")).collect())
    yearly = pipelines.yearly_features(cropped.filter("tile_year = 2018 or individual = 'i1'"), bands=2).first()["years"]
    assert yearly == {2018: [1.0, 2.0], 2019: [1.0, 2.0]}


def test_sources(spark, tmp_path):
    (tmp_path / "OSBS_a.csv").write_text("id,v\n1,NaN\n2,3.5\n")
    (tmp_path / "HARV_b.csv").write_text("id,v\n3,1\n")
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id INT, v DOUBLE")
    got = io.read_csv(spark, str(tmp_path / "OSBS_a.csv"), schema)
    assert sorted((r["id"], r["v"]) for r in got.fillna(-1).collect()) == [(1, -1.0), (2, 3.5)]
    layers = io.read_layers(spark, str(tmp_path), "OSBS", schema=schema)
    assert {r["filename"] for r in layers.collect()} == {"OSBS_a"}
    assert io.file_catalog(spark, str(tmp_path), "*.csv").count() == 2
    (tmp_path / "m.json").write_text('{"labels": ["A", "B"], "matrix": [[3, 1], [0, 2]]}')
    assert {r["taxon"]: r["p"] for r in io.read_confusion_json(spark, str(tmp_path / "m.json")).collect()} == {"A": [0.75, 0.25], "B": [0.0, 1.0]}
    done = str(tmp_path / "done")
    assert io.unfinished(layers, done, ["id"]).count() == 2
    layers.limit(1).write.parquet(done)
    assert io.unfinished(layers, done, ["id"]).count() == 1
    calls = []
    for _ in range(2):
        assert io.snapshot(spark, str(tmp_path), "x", lambda: calls.append(1) or layers).count() == 2
    assert len(calls) == 1


def test_incremental_counts(spark, tmp_path):
    from canopy.streaming.incremental import arriving, running_counts

    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "taxon string"
    from pyspark.sql.types import StructType

    for batch in (["A", "A"], ["B", "A"]):
        spark.createDataFrame([(t,) for t in batch], schema).coalesce(1).write.mode("append").parquet(folder)
        running_counts(arriving(spark, folder, StructType.fromDDL(schema)), ["taxon"], out, check).awaitTermination()
    total = spark.read.parquet(out).groupBy("taxon").agg(F.sum("count").alias("n"))
    assert {r["taxon"]: r["n"] for r in total.collect()} == {"A": 3, "B": 1}


def test_training(spark):
    df = spark.createDataFrame([([float(i % 2), 1.0], i % 2, f"S{i % 3}") for i in range(60)], "features array<double>, label int, site string")
    score = scoring.scorer_of(scoring.train_level(df, site="site", max_iter=10))
    got = score(df).select((arrays.argmax("yhat") == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got == 1.0


def test_uniform(spark):
    df = spark.range(2000).select(hash_uniform(1, "id").alias("u"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert r[0] >= 0 and r[1] < 1 and abs(r[2] - 0.5) < 0.03


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("b", 3, None), ("b", 4, None), (None, 5, 1.0)], "individual string, seq int, height double").withColumn("eventID", F.concat(F.lit("e"), F.col("seq").cast("string")))
    assert sorted(r["seq"] for r in windows.one_per_individual(df).collect()) == [2, 4]
    assert one(spark, windows.last_k(F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(2)), 2)) == [2, 3]


def test_numbers_over_whole_tables(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("v"), "id")
    got = windows.number_rows(df, ["v", "id"]).collect()
    want = sorted((i * 37 % 101, i) for i in range(500))
    assert sorted((r["v"], r["id"], r["number"]) for r in got) == [(v, i, k) for k, (v, i) in enumerate(want)]
    assert windows.number_rows(df.limit(0), ["v"]).count() == 0
    hits = windows.running_hits(df.withColumn("hit", F.col("id") % 3 == 0), "v", "hit").collect()
    assert len(hits) == 101
    for r in hits:
        above = [i for v, i in want if v >= r["v"]]
        assert (r["rows"], r["hits"]) == (len(above), sum(i % 3 == 0 for i in above))


# ---- plans ---------------------------------------------------------------------------


def test_large_boxes_go_to_coarser_grids(spark):
    r = random.Random(1)
    boxes = [(i, x := r.uniform(-50, 1000), y := r.uniform(-50, 1000), x + r.uniform(0, 3), y + r.uniform(0, 3)) for i in range(300)]
    boxes += [(400, 0.0, 0.0, 1000.0, 1000.0), (401, 100.0, 100.0, 140.0, 900.0), (402, 5.0, 5.0, 5.0, 5.0), (403, 9.0, 9.0, 1.0, 1.0)]
    points = [(k, r.uniform(-60, 1060), r.uniform(-60, 1060)) for k in range(2000)] + [(5000, 5.0, 5.0), (5001, None, 3.0), (5002, 1000.0, 1000.0)]
    p, b = spark.createDataFrame(points, "k int, x double, y double"), spark.createDataFrame(boxes, "box int, xmin double, ymin double, xmax double, ymax double")
    want = {(k, i) for k, x, y in points if x is not None for i, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}
    got = [(g["k"], g["box"]) for g in spatial.points_in_boxes(p, b).collect()]
    assert len(got) == len(want) and set(got) == want
    assert spatial.cell_size(b)[1] > 1 and spatial.points_in_boxes(p, b.limit(0)).count() == 0 == spatial.points_in_boxes(p.limit(0), b).count()


def test_windows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(raster, "WINDOW_BLOCK", 5)
    r = random.Random(2)
    cells = {(t, row, col): r.randint(1, 99) for t in "ab" for row in range(-7, 12) for col in range(13) if r.random() < 0.8}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "tile string, row int, col int, value int")
    got = raster.neighbourhood(df, ["tile"], width=4, height=3)
    assert got.schema["window"].dataType.simpleString() == "array<int>" and got.schema["row"].dataType.simpleString() == "int"
    want = {(t, row, col): [cells.get((t, row + i, col + j), 0) for i in range(3) for j in range(4)] for t, row, col in cells}
    assert {(g["tile"], g["row"], g["col"]): g["window"] for g in got.collect()} == want


def test_two_plots_are_split_as_they_are(spark):
    rows = [(f"i{k}", "B" if k % 2 else "A", f"t{k % 3}", "S", "fixed_box_1" if k == 0 else "b") for k in range(12)]
    df = spark.createDataFrame(rows, "individual string, plotID string, taxonID string, siteID string, box_id string")
    train, test, scores = split.best_split(df, "S", iterations=3, min_train=1, min_test=1)
    assert {g["plotID"] for g in test.collect()} == {"A"} and {g["plotID"] for g in train.collect()} == {"B"} and test.count() == train.count() == 6
    assert scores.first()["test_taxa"] == 3


def test_shade_and_samples_keep_null_rules(spark):
    s = spark.createDataFrame([(None, "Full shade"), ("a", "Full shade"), ("a", "Full sun"), ("b", "Full shade"), ("b", None), ("c", None)], "individual string, canopyPosition string")
    assert sorted(str(g["individual"]) for g in clean.drop_shaded(s).collect()) == ["None", "a", "a", "c"]
    d = spark.createDataFrame([(k, "x" if k < 5 else "y" if k < 7 else None) for k in range(12)], "k int, g string")
    assert sorted(g["g"] for g in windows.sample_or_skip(d, ["g"], "k", 3).collect()) == ["x"] * 3


def test_truth_pairs_and_portable_fingerprint(spark):
    p = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "individual string, seq int, pred string")
    t = spark.createDataFrame([("a", "y"), ("c", "z")], "individual string, truth string")
    assert [(g["pred"], g["truth"]) for g in metrics.truth_pairs(p, t, "individual", ["seq"]).collect()] == [("y", "y")]
    a, b = aggregates.fingerprint(p, portable=True).first(), aggregates.fingerprint(p.orderBy("seq").repartition(3), portable=True).first()
    assert a == b != aggregates.fingerprint(p.withColumn("seq", p.seq + 1), portable=True).first()
    assert aggregates.fingerprint(p.limit(0), portable=True).first()["rows"] == 0


def test_csv_by_header(spark, tmp_path):
    schema = StructType.fromDDL("x int, y int, t string")
    (tmp_path / "a_OSBS.csv").write_text('y,x,t\n1,2,"a, b"\n')
    (tmp_path / "b_OSBS.csv").write_text("\ufefft,z,x\nq,9,3\n,8,\n")
    (tmp_path / "c_HARV.csv").write_text("x,y,t\n5,6,u\n")
    (tmp_path / "d_OSBS.csv").write_text("x,y,t\n")
    (tmp_path / "e_OSBS.csv").write_text("")
    got = {tuple(r) for r in io.read_layers(spark, str(tmp_path), "OSBS", schema=schema).collect()}
    assert got == {(2, 1, "a, b", "a_OSBS"), (3, None, "q", "b_OSBS"), (None, None, None, "b_OSBS")}
    assert [tuple(r) for r in io.read_csv(spark, f"{tmp_path}/a_OSBS.csv", schema).collect()] == [(2, 1, "a, b")]
    with pytest.raises(ValueError, match="no column"):
        io.read_csv(spark, [f"{tmp_path}/a_OSBS.csv", f"{tmp_path}/b_OSBS.csv"], schema)
    every = io.read_layers(spark, str(tmp_path))
    assert dict(every.dtypes) == {"y": "int", "x": "int", "t": "string", "z": "int", "filename": "string"} and every.count() == 4
    (tmp_path / "twice.csv").write_text("x,x\n1,2\n")
    with pytest.raises(ValueError, match="two columns"):
        io.read_csv(spark, f"{tmp_path}/twice.csv")
    assert io.read_layers(spark, str(tmp_path), "none", schema=schema).count() == 0


def test_sinks_keep_what_they_do_not_replace(spark, tmp_path):
    tile = lambda name, n: spark.range(n).select("id", F.lit(name).alias("geo_index"))
    path = f"{tmp_path}/layer"
    for name, n in (("A", 5), ("B", 3), ("A", 2)):
        io.write_layer(tile(name, n), path)
    assert {r[0]: r[1] for r in spark.read.parquet(path).groupBy("geo_index").count().collect()} == {"A": 2, "B": 3}
    crop = lambda ids, v: spark.createDataFrame([(i, 2019 + k % 2, v) for k, i in enumerate(ids)], "individual string, tile_year int, v int")
    path = f"{tmp_path}/crops"
    names = [f"i{k}" for k in range(300)]
    io.write_crops(crop(names, 1), path)
    io.write_crops(crop(["i4", "new"], 2), path)
    io.write_crops(crop(["i6", "late"], 3), path, replace=False)
    got = {r["name"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 302 == spark.read.parquet(path).count()
    assert (got["i4_2019"], got["new_2020"], got["i6_2019"], got["late_2020"], got["i5_2020"]) == (2, 2, 1, 3, 1)


def test_crops_without_a_year_are_kept(spark, tmp_path):
    kind = "individual string, tile_year string, v int"
    path = f"{tmp_path}/crops"
    io.write_crops(spark.createDataFrame([(f"i{k}", None, 1) for k in range(200)] + [("i1", "2019", 1)], kind), path)
    io.write_crops(spark.createDataFrame([("i7", None, 2, "x"), ("i1", "2019", 3, "y")], kind + ", more string"), path)
    got = {(r["name"], r["v"], r["more"]) for r in spark.read.option("mergeSchema", True).parquet(path).collect()}
    assert got == {(f"i{k}", 1, None) for k in range(200) if k != 7} | {("i7", 2, "x"), ("i1_2019", 3, "y")}


def test_named_file_is_replaced(spark, tmp_path):
    for n in (2, 3):
        io.write_named(spark.range(n), str(tmp_path), "one.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/one.csv").count() == 3


@pytest.mark.parametrize("share", [0.0, 0.5, 0.99, 1.0])
def test_exact_quantiles_in_bins(spark, share):
    r = random.Random(3)
    inf = float("inf")
    groups = {"few": [3.0], "pair": [1.0, 2.0], "same": [7.0] * 500, "many": [r.gauss(0, 1) for _ in range(3000)], "crowd": [1 + r.random() * 1e-12 for _ in range(900)] + [1e9], "ends": [inf] * 40 + [-inf] * 40 + [r.random() for _ in range(200)], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    got = {x["k"]: x["quantile"] for x in aggregates.exact_quantiles(df, "k", "v", share, whole=16, bins=8).collect()}
    assert set(got) == set(groups) - {"none"}
    want = {x["k"]: x["q"] for x in df.filter("v is not null").groupBy("k").agg(F.percentile("v", share).alias("q")).collect()}
    assert got == pytest.approx(want, nan_ok=True)


def test_points_in_rings_equal_all_pairs(spark):
    r = random.Random(9)
    rings = []
    for k in range(60):
        x, y, size = r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.5, 3, 40])
        turns = sorted(r.uniform(0, 6.283) for _ in range(r.randint(3, 9)))
        rings.append((k, k % 2, [(x + size * r.uniform(0.2, 1) * math.cos(t), y + size * r.uniform(0.2, 1) * math.sin(t)) for t in turns]))
    rings += [(100, 0, [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]), (101, 1, []), (102, 0, None)]
    rings = spark.createDataFrame(rings, "ring_id int, plot int, ring array<struct<x double, y double>>")
    points = spark.createDataFrame([(i, i % 2, float(r.randint(-50, 50)), float(r.randint(-50, 50))) for i in range(800)] + [(900, 0, None, 1.0)], "i int, plot int, x double, y double")
    for on in ([], ["plot"]):
        side = points if on else points.withColumnRenamed("plot", "other")
        got = {(x["i"], x["ring_id"]) for x in spatial.points_in_rings(side, rings, on=on).collect()}
        all_ = points.alias("p").crossJoin(rings.alias("r")).filter(geometry.point_in_ring(F.col("p.x"), F.col("p.y"), F.col("r.ring")))
        want = {(x["i"], x["ring_id"]) for x in (all_.filter("p.plot = r.plot") if on else all_).select("i", "ring_id").collect()}
        assert got == want and len(want) > 100
    cover = spatial.ring_cover(rings, size=0.25)
    assert cover.groupBy("ring_id").count().agg(F.max("count")).first()[0] <= 18 * 18 and cover.filter("not __edge").count() > 0


def test_windows_of_bands(spark, monkeypatch):
    monkeypatch.setattr(raster, "WINDOW_BLOCK", 4)
    monkeypatch.setattr(raster, "WINDOW_BYTES", 200)
    r = random.Random(2)
    cells = {(i, j): [r.random(), float(i), float(j)] for i in range(11) for j in range(9) if r.random() < 0.8}
    cells[5, 5] = None
    df = spark.createDataFrame([("t", i, j, v) for (i, j), v in cells.items()], "tile string, row int, col int, value array<double>")
    got = raster.neighbourhood(df, ["tile"], width=2, height=3).collect()
    assert len(got) == len(cells)
    for x in got:
        assert x["window"] == [cells.get((x["row"] + a, x["col"] + b)) or [0.0] * 3 for a in range(3) for b in range(2)]
    odd = spark.createDataFrame([("t", 0, 0, [1.0]), ("t", 0, 1, [1.0, 2.0])], df.schema)
    with pytest.raises(Exception, match="bands"):
        raster.neighbourhood(odd, ["tile"], width=2, height=2).collect()


def test_observed_stages_take_one_job(spark):
    rows = spark.createDataFrame([(k % 7 if k % 11 else None, k % 50) for k in range(1000)], "label int, who int")
    a, seen_a = aggregates.audited(rows, "a", "label", "who")
    b, seen_b = aggregates.audited(a.filter("who < 10 and label <> 3"), "b", "label")
    spark.sparkContext.setJobGroup("audit", "audit")
    b.write.format("noop").mode("overwrite").save()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("audit")) == 1
    spark.sparkContext.setJobGroup("rest", "rest")
    got = [tuple(r) for r in aggregates.audit_of(spark, {"a": seen_a, "b": seen_b}).collect()]
    assert got == [(0, "a", 1000, 7), (1, "b", b.count(), 6)] and seen_a.get["individuals"] == 50

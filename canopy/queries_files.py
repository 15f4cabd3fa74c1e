"""Driver queries, continued: sources and sinks. Every query writes what Spark derives from the tables to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.queries import _BOX_SQL, _boxes, _t, query
from canopy.sources import io


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 > 1 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    """Nulls, NaN (read as null) and text in CSV files with a header."""
    k = F.col("c_custkey")
    balance = F.when(k % 5 == 0, float("nan")).when(k % 5 != 1, F.col("c_acctbal"))
    path = io.new_folder(spark, "csv")
    io.write_csv(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", balance.alias("c_acctbal"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment")), path)
    return io.read_csv(spark, path, StructType.fromDDL("c_custkey long, c_name string, c_acctbal double, c_mktsegment string"))


@query(f"SELECT box, xmin, ymax, (box % 7)::INT AS tile FROM (SELECT {_BOX_SQL} FROM part)")
def layer_round_trip(spark, sf_dir):
    """Boxes by tile."""
    path = io.new_folder(spark, "layer")
    io.write_layer(_boxes(spark, sf_dir).withColumn("tile", (F.col("box") % 7).cast("int")), path, by="tile")
    return io.read_layer(spark, path, ["box", "xmin", "ymax", "tile"])


@query("SELECT s_suppkey, 'OSBS_' || s_suppkey % 3 AS layer FROM supplier WHERE s_suppkey % 3 <> 2")
def site_layers(spark, sf_dir):
    """S3: of a folder of layers those whose file name contains a site, tagged with it."""
    path = io.new_folder(spark, "layers")
    for k, site in enumerate(("OSBS_0", "OSBS_1", "HARV_2")):  # three small files
        io.write_named(_t(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 3 == k).select("s_suppkey"), path, f"{site}.csv")
    got = io.read_layers(spark, path, site="OSBS", schema=StructType.fromDDL("s_suppkey long"))
    return got.select("s_suppkey", F.col("filename").alias("layer"))


@query("SELECT DISTINCT (400000 + page_id%5*1000) || '_' || (3280000 + page_id%7*1000) AS geo_index, 2018 + page_id%2 AS tile_year FROM pages WHERE page_id % 3 <> 0")
def sensor_files(spark, sf_dir):
    """The files under a pool by what their paths say; excluded folders are left out."""
    i = F.col("page_id")
    place = F.concat((400_000 + i % 5 * 1000).cast("string"), F.lit("_"), (3_280_000 + i % 7 * 1000).cast("string"), F.lit("_image"))
    pages = _t(spark, sf_dir, "pages").select(place.alias("tile"), (2018 + i % 2).alias("year"), F.when(i % 3 == 0, "classified").otherwise("camera").alias("product"), i.alias("page_id"))
    path = io.new_folder(spark, "pool")
    for year in (2018, 2019):
        pages.filter(F.col("year") == year).drop("year").repartition("product", "tile").write.partitionBy("product", "tile").parquet(f"{path}/{year}")
    found = io.file_catalog(spark, path, "*.parquet")
    return found.select("geo_index", F.col("tile_year").cast("bigint").alias("tile_year")).distinct()


_MATRIX_SQL = "c AS (SELECT p_brand AS taxon, p_type AS other, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT DISTINCT p_brand AS taxon FROM part), o AS (SELECT DISTINCT p_type AS other FROM part), m AS (SELECT taxon, other, coalesce(n, 0) AS n FROM t CROSS JOIN o LEFT JOIN c USING (taxon, other))"


def _matrix(spark, sf_dir):
    """Brands by types: a small table of counts, as one row for each brand."""
    p = _t(spark, sf_dir, "part")
    types = sorted(r[0] for r in p.select("p_type").distinct().collect())  # a handful
    wide = p.groupBy("p_brand").pivot("p_type", types).count().fillna(0)
    return wide.select(F.col("p_brand").alias("predicted"), *types), types


@query(f"WITH {_MATRIX_SQL} SELECT taxon, row_number() OVER (PARTITION BY taxon ORDER BY other) - 1 AS place, round(n / sum(n) OVER (PARTITION BY taxon), 6) AS p FROM m")
def confusion_json(spark, sf_dir):
    """Matrix and labels of a JSON file, each row over its sum."""
    wide, types = _matrix(spark, sf_dir)
    rows = wide.agg(F.array_sort(F.collect_list(F.struct("predicted", F.array(*[F.col(f"`{c}`").cast("double") for c in types]).alias("p")))).alias("r"))
    path = io.new_folder(spark, "confusion")
    rows.select(F.transform("r", lambda x: x["predicted"]).alias("labels"), F.transform("r", lambda x: x["p"]).alias("matrix")).write.json(path)
    got = io.read_confusion_json(spark, path).select("taxon", F.posexplode("p").alias("place", "p"))
    return got.select("taxon", F.col("place").cast("bigint").alias("place"), F.round("p", 6).alias("p"))


@query(f"WITH {_MATRIX_SQL} SELECT taxon, other AS label, n::DOUBLE AS p FROM m")
def confusion_csv(spark, sf_dir):
    """A CSV with a column for each label."""
    path = io.new_folder(spark, "confusion")
    io.write_csv(_matrix(spark, sf_dir)[0], path)
    got, labels = io.read_confusion_csv(spark, path)
    return got.select("taxon", F.posexplode("p").alias("k", "p")).select("taxon", F.get(F.lit(labels), F.col("k")).alias("label"), "p")


@query("SELECT l_orderkey, l_linenumber, 'g' || l_suppkey % 6 AS geo_index, (2018 + l_partkey % 4)::INT AS tile_year FROM lineitem WHERE l_suppkey % 6 IN (1, 4) AND l_partkey % 4 IN (0, 3)")
def cell_scan(spark, sf_dir):
    """Cells by tile and year, read for two tiles and two years."""
    cells = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("g"), (F.col("l_suppkey") % 6).cast("string")).alias("geo_index"), (2018 + F.col("l_partkey") % 4).cast("int").alias("tile_year"))
    path = io.new_folder(spark, "cells")
    cells.repartition("geo_index", "tile_year").write.partitionBy("geo_index", "tile_year").parquet(path)
    return io.read_cells(spark, path, geo_index=["g1", "g4"], years=[2018, 2021])


@query("SELECT event_id, user_id || '_' || year AS name, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM (SELECT event_id, event_id AS user_id, 2018 + event_id % 3 AS year FROM events)")
def crop_sink(spark, sf_dir):
    """Crops by name; a second run adds only those that are missing."""
    i = F.col("event_id")
    crops = _t(spark, sf_dir, "events").select("event_id", i.alias("individual"), (2018 + i % 3).cast("int").alias("tile_year"))
    path = io.new_folder(spark, "crops")
    io.write_crops(crops.filter(i % 2 == 0).withColumn("run", F.lit("first")), path)
    io.write_crops(crops.withColumn("run", F.lit("second")), path, replace=False)
    return spark.read.parquet(path).select("event_id", "name", "run")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0)")
def unfinished_work(spark, sf_dir):
    """The part of a work list that isn't among the finished units."""
    path = io.new_folder(spark, "finished")
    _t(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("c_nationkey")).write.parquet(path)
    return io.unfinished(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), path, ["c_nationkey"])


@query("SELECT s_suppkey, s_acctbal * 2 AS v FROM supplier")
def snapshot_reuse(spark, sf_dir):
    """What was saved under a name is used, and not built again."""
    s, root = _t(spark, sf_dir, "supplier"), io.new_folder(spark, "snapshots")
    io.snapshot(spark, root, "a", lambda: s.select("s_suppkey", (F.col("s_acctbal") * 2).alias("v")))
    return io.snapshot(spark, root, "a", lambda: s.select("s_suppkey", F.lit(0.0).alias("v")))


@query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'train' ELSE 'test' END AS side FROM orders WHERE o_custkey % 3 <> 2 AND o_custkey IN (SELECT c_custkey FROM customer)")
def reapplied_split(spark, sf_dir):
    """New rows by the ids of a saved split."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    train, test = io.reapply_split(_t(spark, sf_dir, "orders"), io.staged(c.filter("o_custkey % 3 = 0"), "train"), io.staged(c.filter("o_custkey % 3 = 1"), "test"), "o_custkey")
    return train.select("o_orderkey", F.lit("train").alias("side")).union(test.select("o_orderkey", F.lit("test")))


@query(f"""
WITH b AS (SELECT {_BOX_SQL} FROM part)
SELECT box, xmin, ymax, (box % 7)::INT AS tile FROM b WHERE box % 7 > 1
UNION ALL SELECT box, xmin + 1, ymax, (box % 7)::INT FROM b WHERE box % 7 <= 1 AND box % 2 = 0
""")
def layer_rewrites(spark, sf_dir):
    """Tiles 0 to 2, then the others, then 0 and 1 again with fewer rows: these alone are replaced."""
    path, tile = io.new_folder(spark, "layer"), F.col("box") % 7
    boxes = _boxes(spark, sf_dir).withColumn("tile", tile.cast("int"))
    io.write_layer(boxes.filter(tile <= 2), path, by="tile")
    io.write_layer(boxes.filter(tile > 2), path, by="tile")
    io.write_layer(boxes.filter((tile <= 1) & (F.col("box") % 2 == 0)).withColumn("xmin", F.col("xmin") + 1), path, by="tile")
    return io.read_layer(spark, path, ["box", "xmin", "ymax", "tile"])


@query("""
SELECT event_id, event_id || '_' || (2018 + event_id % 3) AS name, CASE WHEN event_id % 5 = 0 THEN 'third' WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS run, CASE WHEN event_id % 5 = 0 THEN value END AS value
FROM events WHERE event_id % 5 = 0 OR event_id % 2 = 0 OR event_id % 3 = 0
""")
def crop_rewrites(spark, sf_dir):
    """Crops written in two runs, then some of them replaced and some added, with one more column; no other is lost."""
    i = F.col("event_id")
    crops = _t(spark, sf_dir, "events").select("event_id", i.alias("individual"), (2018 + i % 3).cast("int").alias("tile_year"), "value")
    path, run = io.new_folder(spark, "crops"), lambda name: F.lit(name).alias("run")
    io.write_crops(crops.filter(i % 2 == 0).select("event_id", "individual", "tile_year", run("first")), path)
    io.write_crops(crops.filter((i % 3 == 0) & (i % 2 != 0)).select("event_id", "individual", "tile_year", run("second")), path)
    io.write_crops(crops.filter(i % 5 == 0).select("*", run("third")), path)
    return spark.read.option("mergeSchema", True).parquet(path).select("event_id", "name", "run", "value")


@query("""
SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 <> 2 THEN s_acctbal END AS s_acctbal, CASE WHEN s_suppkey % 3 = 2 THEN s_nationkey * 10 END AS plot, 'OSBS_' || s_suppkey % 3 AS layer FROM supplier
""")
def unlike_layers(spark, sf_dir):
    """S3: layers with swapped and unlike columns meet by name; what one lacks is null."""
    s, path = _t(spark, sf_dir, "supplier"), io.new_folder(spark, "layers")
    part = lambda k: s.filter(F.col("s_suppkey") % 3 == k)
    io.write_named(part(0).select("s_suppkey", "s_name", "s_acctbal"), path, "OSBS_0.csv")
    io.write_named(part(1).select("s_acctbal", "s_name", F.col("s_nationkey").alias("other"), "s_suppkey"), path, "OSBS_1.csv")
    io.write_named(part(2).select((F.col("s_nationkey") * 10).alias("plot"), "s_suppkey", "s_name"), path, "OSBS_2.csv")
    got = io.read_layers(spark, path, schema=StructType.fromDDL("s_suppkey long, s_name string, s_acctbal double, plot long"))
    return got.select("s_suppkey", "s_name", "s_acctbal", "plot", F.col("filename").alias("layer"))


@query("SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS mark FROM part")
def csv_by_name(spark, sf_dir):
    """Two files of one table with their columns in another order, types inferred over both."""
    p, path = _t(spark, sf_dir, "part"), io.new_folder(spark, "csv")
    half = lambda k, mark: p.filter(F.col("p_partkey") % 2 == k).withColumn("mark", F.col(mark))
    io.write_named(half(0, "p_size").select("p_partkey", "p_size", "p_retailprice", "mark"), path, "a.csv")
    io.write_named(half(1, "p_brand").select("p_retailprice", "mark", "p_partkey", "p_size"), path, "b.csv")
    got = io.read_csv(spark, path)
    kinds = {k: v for k, v in got.dtypes if k != "mark"}
    if not set(kinds.values()) <= {"int", "bigint", "double"} or dict(got.dtypes)["mark"] != "string":
        raise ValueError(f"types were inferred as {got.dtypes}")
    return got.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast(p.schema["p_size"].dataType).alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"), "mark")

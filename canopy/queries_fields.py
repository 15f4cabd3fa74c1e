"""Driver queries, continued: filters, joins, counts, windows, and expressions on boxes, pixels and bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import arrays, geometry, projection, tiles
from canopy.functions.geometry import Box
from canopy.operators import aggregates, clean, metrics, raster, spatial, split, windows
from canopy.plans import pipelines
from canopy.queries import _BOX_SQL, _CATALOG_SQL, _boxes, _catalog, _spectra, _t, _xy, _xy_sql, query
from canopy.sources.io import staged

# ---- filters -------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 AND c_mktsegment = 'BUILDING' THEN 'MACHINERY' ELSE c_mktsegment END AS taxon FROM customer")
def site_codes(spark, sf_dir):
    """F12."""
    return _t(spark, sf_dir, "customer").select("c_custkey", clean.collapse_code("c_nationkey", "c_mktsegment", 3, "BUILDING", "MACHINERY").alias("taxon"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND contains(p_name, 'ring') THEN 'polygons' ELSE 'points' END AS side FROM part")
def routed_layers(spark, sf_dir):
    """both routes, null names among the points."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("filename"))
    polygons, points = clean.route_by_name(p, "filename", "ring")
    return polygons.select("p_partkey", F.lit("polygons").alias("side")).union(points.select("p_partkey", F.lit("points")))


def _triangles(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return b.select("box", (F.col("box") % 3).alias("tile"), F.array(at("xmin", "ymin"), at("xmax", "ymin"), at("xmin", "ymax")).alias("ring"))


@query(f"WITH b AS (SELECT {_BOX_SQL} FROM part) SELECT box, row_number() OVER (PARTITION BY box % 3 ORDER BY box) - 1 AS box_id, xmin, ymin, xmax, ymax FROM b")
def surveyed_boxes(spark, sf_dir):
    """envelopes of rings, numbered within their tile."""
    return spatial.surveyed_boxes(_triangles(spark, sf_dir), ["box"], keys=["tile"]).select("box", F.col("box_id").cast("bigint").alias("box_id"), "xmin", "ymin", "xmax", "ymax")


_MARKED_SQL = "SELECT event_id, 'I' || user_id || CASE WHEN event_id % 4 = 0 THEN '.graves' ELSE '' END AS individual, CASE event_id % 3 WHEN 1 THEN 'fixed_box_1' WHEN 2 THEN '7' END AS box_id FROM events"


def _marked(spark, sf_dir):
    i = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("I"), F.col("user_id").cast("string"), F.when(i % 4 == 0, ".graves").otherwise("")).alias("individual"), F.when(i % 3 == 1, "fixed_box_1").when(i % 3 == 2, "7").alias("box_id"))


@query(f"SELECT event_id, individual FROM ({_MARKED_SQL}) WHERE NOT contains(individual, 'graves')")
def without_graves(spark, sf_dir):
    """F15."""
    return clean.not_containing(_marked(spark, sf_dir), "individual", "graves").select("event_id", "individual")


@query(f"SELECT event_id, box_id FROM ({_MARKED_SQL}) WHERE box_id IS NULL OR NOT contains(box_id, 'fixed')")
def without_fixed_boxes(spark, sf_dir):
    """null box ids stay."""
    return clean.without_fixed(_marked(spark, sf_dir)).select("event_id", "box_id")


@query("SELECT p_partkey, p_size / 10.0::DOUBLE AS CHM_height FROM part WHERE p_size > 30")
def tall_crowns(spark, sf_dir):
    """F19."""
    return clean.tall_crowns(_t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("CHM_height")))


@query(f"WITH {_CATALOG_SQL} SELECT path, geo_index FROM cat WHERE contains(path, 'pool') AND tile_year = 2019 AND NOT contains(path, '402000') AND split_part(geo_index, '_', 1)::BIGINT BETWEEN 400001 AND 403999")
def chosen_tiles(spark, sf_dir):
    """F21."""
    return clean.choose_tiles(_catalog(spark, sf_dir), site="pool", year=2019, without="402000", x=(400_000, 404_000)).select("path", "geo_index")


@query("SELECT c_acctbal, c_custkey FROM customer")
def wanted_columns(spark, sf_dir):
    """a wanted column that isn't there is left out."""
    return clean.keep_columns(_t(spark, sf_dir, "customer"), ["c_acctbal", "c_phone", "c_custkey"])


# ---- joins, counts, windows ----------------------------------------------------------


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_brand FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey")
def one_key_join(spark, sf_dir):
    """J10."""
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return spatial.natural(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts).select("l_orderkey", "l_linenumber", "p_brand")


@query("WITH t AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT l_orderkey, l_linenumber, top FROM lineitem JOIN t USING (l_partkey, l_suppkey)")
def natural_join(spark, sf_dir):
    """On all shared columns."""
    rows = _t(spark, sf_dir, "lineitem")
    top = rows.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("top"))
    return spatial.natural(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), top).select("l_orderkey", "l_linenumber", "top")


@query("""
WITH p AS (SELECT user_id, event_type AS pred, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), t AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS truth FROM events WHERE user_id % 7 <> 0)
SELECT user_id, pred, truth FROM p JOIN t USING (user_id) WHERE r = 1
""")
def truth_pairs(spark, sf_dir):
    """One prediction per individual beside its truth."""
    e = _t(spark, sf_dir, "events")
    u = F.col("user_id")
    truth = e.filter(u % 7 != 0).select("user_id", F.when(u % 3 == 0, "click").when(u % 3 == 1, "view").otherwise("error").alias("truth")).distinct()
    return metrics.truth_pairs(e.select("user_id", "event_id", F.col("event_type").alias("pred")), truth, "user_id", ["event_id"]).select("user_id", "pred", "truth")


@query("SELECT event_type, count(*) AS count FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def key_counts(spark, sf_dir):
    """A1: null keys don't count."""
    e = _t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("event_type"))
    return aggregates.counts(e, "event_type")


@query("WITH s AS (SELECT page_id, page_id * page_id % 89 AS file_set FROM pages) SELECT page_id, file_set FROM s WHERE file_set IN (SELECT file_set FROM s GROUP BY 1 HAVING count(*) >= 3)")
def complete_sets(spark, sf_dir):
    """Sets of fewer than three files are out."""
    s = _t(spark, sf_dir, "pages").select("page_id", (F.col("page_id") * F.col("page_id") % 89).alias("file_set"))
    return aggregates.complete_sets(s, "file_set").select("page_id", "file_set")


@query(f"WITH b AS (SELECT {_BOX_SQL} FROM part) SELECT box, (xmax-xmin)*(ymax-ymin) AS box_area, (xmax-xmin)*(ymax-ymin)/2 AS ring_area FROM b")
def crown_areas(spark, sf_dir):
    """Of boxes and of rings (right-angled triangles)."""
    both = _boxes(spark, sf_dir).join(_triangles(spark, sf_dir).drop("tile"), "box")
    return both.select("box", geometry.box_area().alias("box_area"), geometry.ring_area("ring").alias("ring_area"))


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5")
def first_rows(spark, sf_dir):
    """W2."""
    e = _t(spark, sf_dir, "events")
    return windows.first_n(e, ["event_type"], [F.col("value").desc(), "event_id"], 5).select("event_id", "event_type")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS number FROM customer")
def row_numbers(spark, sf_dir):
    """Over the whole table."""
    return windows.number_rows(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", F.col("number").cast("bigint").alias("number"))


@query("""
SELECT count(*) AS rows, bit_xor(h) AS "xor", sum(h % 2147483647)::BIGINT AS "sum" FROM (SELECT ('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)), 1, 15))::BIGINT AS h FROM orders)
""")
def portable_fingerprint(spark, sf_dir):
    """A12, by a hash that other engines have."""
    return aggregates.fingerprint(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), portable=True)


# ---- names and nulls -----------------------------------------------------------------


@query("SELECT user_id, event_id, individual, regexp_matches(individual, '[A-Z]$') AS multi_bole, split_part(individual, '_', 1) AS prefix FROM (SELECT user_id, event_id, event_type || '_' || user_id || CASE WHEN user_id % 4 = 0 THEN 'B' WHEN user_id % 4 = 1 THEN 'b' ELSE '' END AS individual FROM events)")
def name_predicates(spark, sf_dir):
    """E7."""
    u = F.col("user_id")
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.lit("_"), u.cast("string"), F.when(u % 4 == 0, "B").when(u % 4 == 1, "b").otherwise("")).alias("individual"))
    return e.select("user_id", "event_id", "individual", tiles.is_multi_bole("individual").alias("multi_bole"), tiles.prefix_token("individual").alias("prefix"))


@query("SELECT event_id, event_id % 3 <> 2 AS missing, CASE WHEN event_id % 3 = 2 THEN value END AS value FROM events")
def missing_values(spark, sf_dir):
    """Null and NaN."""
    i = F.col("event_id")
    v = _t(spark, sf_dir, "events").select("event_id", F.when(i % 3 == 0, float("nan")).when(i % 3 == 2, F.col("value")).alias("value"))
    return v.select("event_id", tiles.is_missing("value").alias("missing"), tiles.nan_to_null("value").alias("value"))


@query("SELECT p_partkey, '{\"site\":\"S' || p_size % 4 || '\",\"bounds\":{\"xmin\":' || p_partkey % 50 || ',\"ymin\":' || p_partkey % 60 || ',\"xmax\":' || p_partkey % 50 + 11 || ',\"ymax\":' || p_partkey % 60 + 11 || '},\"epsg\":32617}' AS record FROM part")
def crop_records(spark, sf_dir):
    """E27."""
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select("p_partkey", tiles.crop_metadata(F.concat(F.lit("S"), (F.col("p_size") % 4).cast("string")), k % 50, k % 60, k % 50 + 11, k % 60 + 11, F.lit(32617)).alias("record"))


# ---- boxes and pixels ----------------------------------------------------------------


@query("SELECT p_partkey, 400000.0::DOUBLE + p_partkey % 400 * 0.1::DOUBLE AS x, 3280000.0::DOUBLE - p_size * 0.1::DOUBLE AS y FROM part")
def pixel_places(spark, sf_dir):
    """E10."""
    p = _t(spark, sf_dir, "part").withColumns({"left": F.lit(400_000.0), "top": F.lit(3_280_000.0)})
    x, y = geometry.pixel_to_world(F.col("p_partkey") % 400, "p_size", "left", "top", 0.1)
    return p.select("p_partkey", x.alias("x"), y.alias("y"))


@query(f"WITH b AS (SELECT {_BOX_SQL} FROM part) SELECT box, xmin - greatest(0.0, 10.0 - (xmax-xmin))/2 AS low, xmax + greatest(0.0, 10.0 - (xmax-xmin))/2 AS high FROM b")
def widened_windows(spark, sf_dir):
    """E11."""
    low, high = geometry.expand_to("xmin", "xmax", 10)
    return _boxes(spark, sf_dir).select("box", low.alias("low"), high.alias("high"))


@query(f"WITH b AS (SELECT {_BOX_SQL} FROM part) SELECT box, xmin - 4 AS low, xmax + 4 AS high FROM b")
def padded_bounds(spark, sf_dir):
    """E13."""
    low, high = geometry.pad("xmin", "xmax", 4.0)
    return _boxes(spark, sf_dir).select("box", low.alias("low"), high.alias("high"))


@query(f"""
WITH b AS (SELECT {_BOX_SQL} FROM part)
SELECT box, (xmin+xmax)/2 AS cx, (ymin+ymax)/2 AS cy, (xmin+xmax)/2 - 1.5 AS left_edge, (ymin+ymax)/2 + 1.5 AS top_edge, xmin + 3 AS moved_x, ymax - 2 AS moved_y, round(sqrt((xmax-xmin)*(xmax-xmin) + (ymax-ymin)*(ymax-ymin)), 6) AS diagonal FROM b
""")
def box_geometry(spark, sf_dir):
    """Centre, envelope of a buffer around it, translation, distance."""
    cx, cy = geometry.centroid()
    left, _, _, top = geometry.square(cx, cy, 1.5)
    moved = geometry.translated(Box(), 3, -2)
    away = geometry.distance("xmin", "ymin", "xmax", "ymax")
    return _boxes(spark, sf_dir).select("box", cx.alias("cx"), cy.alias("cy"), left.alias("left_edge"), top.alias("top_edge"), moved[0].alias("moved_x"), moved[3].alias("moved_y"), F.round(away, 6).alias("diagonal"))


@query("SELECT s_suppkey, 400000.0::DOUBLE + s_suppkey * 1000 AS xmin, 3280000.0::DOUBLE - (s_nationkey + 1) * 2.5 AS ymin, 400000.0::DOUBLE + s_suppkey * 1000 + 40 * 2.5 AS xmax, 3280000.0::DOUBLE AS ymax FROM supplier")
def raster_extents(spark, sf_dir):
    """E14."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", (400_000.0 + F.col("s_suppkey") * 1000).alias("left"), F.lit(3_280_000.0).alias("top"), (F.col("s_nationkey") + 1).alias("rows"), F.lit(40).alias("cols"))
    return raster.tile_bounds(s, resolution=2.5).select("s_suppkey", "xmin", "ymin", "xmax", "ymax")


@query(f"WITH b AS (SELECT {_BOX_SQL} FROM part) SELECT box, round_even((xmin - 0.5) / 2, 0)::BIGINT AS col, round_even((1000.5 - ymax) / 2, 0)::BIGINT AS row FROM b")
def pixel_indices(spark, sf_dir):
    """Halves to even."""
    b = _boxes(spark, sf_dir).withColumns({"left": F.lit(0.5), "top": F.lit(1000.5)})
    col, row = geometry.world_to_pixel("xmin", "ymax", "left", "top", 2.0)
    return b.select("box", col.alias("col"), row.alias("row"))


@query(f"""
WITH b AS (SELECT {_BOX_SQL} FROM part), i AS (SELECT box, round_even(xmin/4, 0)::BIGINT AS c0, round_even((1000-ymax)/4, 0)::BIGINT AS r0, round_even(xmax/4, 0)::BIGINT AS c1, round_even((1000-ymin)/4, 0)::BIGINT AS r1 FROM b),
r AS (SELECT *, unnest(range(r0, greatest(r0, r1 - 1) + 1)) AS row FROM i) SELECT box, row, unnest(range(c0, greatest(c0, c1 - 1) + 1)) AS col FROM r
""")
def overlapped_cells(spark, sf_dir):
    """R4."""
    b = _boxes(spark, sf_dir).withColumns({"left": F.lit(0.0), "top": F.lit(1000.0)})
    return raster.cells_of_boxes(b, left="left", top="top", resolution=4.0).select("box", "row", "col")


# ---- bands ---------------------------------------------------------------------------

_WIDE_SQL = "SELECT vec_id, list_transform(range(0, 425), lambda i: embedding[i % 64 + 1]::DOUBLE) AS b FROM embeddings"
_DRY = "list_filter(range(0, 425), lambda i: NOT (i BETWEEN 192 AND 209 OR i BETWEEN 283 AND 314 OR i BETWEEN 419 AND 424))"


def _wide(spark, sf_dir):
    e = _spectra(spark, sf_dir)
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(424)), lambda i: F.get("e", i % 64)).alias("bands"))


@query(f"WITH w AS ({_WIDE_SQL}) SELECT vec_id, len({_DRY})::BIGINT AS n, round(list_sum(list_transform({_DRY}, lambda i: b[i + 1])), 6) AS total, b[17] AS red, b[55] AS green, b[113] AS blue FROM w")
def band_choices(spark, sf_dir):
    """Without water, and false colour."""
    w = _wide(spark, sf_dir).select("vec_id", arrays.drop_water("bands").alias("dry"), arrays.pick_bands("bands").alias("rgb"))
    return w.select("vec_id", F.size("dry").cast("bigint").alias("n"), F.round(F.aggregate("dry", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), *(F.get("rgb", F.lit(k)).alias(n) for k, n in enumerate(("red", "green", "blue"))))


@query("SELECT vec_id, trunc(embedding[3]::DOUBLE * 1000)::SMALLINT AS band FROM embeddings")
def band_pick(spark, sf_dir):
    """E17."""
    s = _spectra(spark, sf_dir).select("vec_id", F.transform("e", lambda v: v * 1000).alias("b"))
    return s.select("vec_id", arrays.pick_band("b", 3).alias("band"))


def _square(spark, sf_dir):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("e", r * 8 + 1, 8))
    return _spectra(spark, sf_dir).select("vec_id", rows.alias("crop"))


def _pixels(df, crop: str = "crop"):
    rows = df.select("vec_id", F.posexplode(crop).alias("row", "cells"))
    return rows.select("vec_id", F.col("row").cast("bigint").alias("row"), F.posexplode("cells").alias("col", "v")).select("vec_id", "row", F.col("col").cast("bigint").alias("col"), "v")


_GRID = "(SELECT vec_id, embedding::DOUBLE[] AS e, r.r AS row, c.c AS col FROM embeddings, range(0, {n}) r(r), range(0, {n}) c(c))"


@query(f"SELECT vec_id, row, col, e[row * 8 // 5 * 8 + col * 8 // 5 + 1] AS v FROM {_GRID.format(n=5)}")
def resized_crops(spark, sf_dir):
    """E20."""
    return _pixels(_square(spark, sf_dir).select("vec_id", arrays.resize("crop", 5).alias("crop")))


@query(f"SELECT vec_id, row, col, e[(7 - row) * 8 + (7 - col) + 1] AS v FROM {_GRID.format(n=8)}")
def flipped_crops(spark, sf_dir):
    """E21."""
    return _pixels(_square(spark, sf_dir).select("vec_id", arrays.flip("crop").alias("crop")))


@query("SELECT vec_id, (embedding[1]::DOUBLE - 0.485) / 0.229 AS red, (embedding[2]::DOUBLE - 0.456) / 0.224 AS green, (embedding[3]::DOUBLE - 0.406) / 0.225 AS blue FROM embeddings")
def normalised_channels(spark, sf_dir):
    """E22."""
    n = _spectra(spark, sf_dir).select("vec_id", arrays.normalise(F.slice("e", 1, 3), (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)).alias("n"))
    return n.select("vec_id", *(F.get("n", F.lit(k)).alias(c) for k, c in enumerate(("red", "green", "blue"))))


@query("SELECT vec_id, k.k AS class, (k.k = label)::INT AS truth, embedding[k.k + 1]::DOUBLE AS score FROM embeddings, range(0, 10) k(k)")
def truth_and_scores(spark, sf_dir):
    """Truth as zeros and a one, beside the scores."""
    e = _spectra(spark, sf_dir)
    both = e.select("vec_id", F.posexplode(F.arrays_zip(arrays.one_hot("label", 10).alias("t"), F.slice("e", 1, 10).alias("s"))).alias("class", "p"))
    return both.select("vec_id", F.col("class").cast("bigint").alias("class"), F.col("p.t").alias("truth"), F.col("p.s").alias("score"))


@query("""
WITH c AS (SELECT vec_id, [(embedding::DOUBLE[])[11:22], (embedding::DOUBLE[])[43:54]] AS cells FROM embeddings),
g AS (SELECT vec_id, r.r AS row, k.k AS col, b.b AS band, cells[(2 - k.k) * 2 // 3 + 1] AS s FROM c, range(0, 3) r(r), range(0, 3) k(k), range(0, 12) b(b))
SELECT vec_id, row, col, band, round((s[band + 1] - list_min(s)) / (list_max(s) - list_min(s)), 6) AS v FROM g
""")
def preprocessed_crops(spark, sf_dir):
    """One row of two cells with 32 bands, trimmed, scaled, resized to 3 x 3 and flipped."""
    crop = _spectra(spark, sf_dir).select("vec_id", F.array(F.array(F.slice("e", 1, 32), F.slice("e", 33, 32))).alias("crop"))
    p = _pixels(crop.select("vec_id", raster.preprocess("crop", 3, augment=True).alias("crop")))
    bands = p.select("vec_id", "row", "col", F.posexplode("v").alias("band", "v"))
    return bands.select("vec_id", "row", "col", F.col("band").cast("bigint").alias("band"), F.round("v", 6).alias("v"))


@query(f"WITH w AS ({_WIDE_SQL}), p AS (SELECT *, {_xy_sql('vec_id')} FROM w) SELECT vec_id, unnest(range(0, 3)) AS place, unnest([b[17], b[55], b[113]]) AS v FROM p WHERE x BETWEEN 200 AND 800 AND y BETWEEN 100 AND 700")
def raster_subset(spark, sf_dir):
    """False colour, clipped."""
    cells = _wide(spark, sf_dir).withColumns(_xy("vec_id"))
    got = raster.subset_raster(cells, "false_color", bounds=(200, 100, 800, 700)).select("vec_id", F.posexplode("bands").alias("place", "v"))
    return got.select("vec_id", F.col("place").cast("bigint").alias("place"), "v")


# ---- windows of bands, large zones, many rings, one-pass audits, projection -----------


@query("""
WITH c AS (SELECT l_suppkey AS tile, l_partkey % 12 AS row, l_orderkey % 12 AS col, max(l_quantity) AS a, count(*)::DOUBLE AS b FROM lineitem GROUP BY ALL)
SELECT x.tile, x.row, x.col, sum(y.a) AS total_a, sum(y.b) AS total_b, max(y.b) AS top_b, coalesce(max(y.a) FILTER (y.row = x.row + 2 AND y.col = x.col + 1), 0) AS low_a, coalesce(max(y.b) FILTER (y.row = x.row AND y.col = x.col + 2), 0) AS right_b
FROM c x JOIN c y ON x.tile = y.tile AND y.row BETWEEN x.row AND x.row + 2 AND y.col BETWEEN x.col AND x.col + 2 GROUP BY ALL
""")
def neighbourhood_bands(spark, sf_dir):
    """Windows of 3 x 3 cells of two bands."""
    c = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tile"), (F.col("l_partkey") % 12).alias("row"), (F.col("l_orderkey") % 12).alias("col")).agg(F.array(F.max("l_quantity"), F.count("*").cast("double")).alias("value"))
    w = raster.neighbourhood(c, ["tile"], width=3, height=3)
    band = lambda k: F.transform("window", lambda cell: cell[k])
    total = lambda k: F.aggregate(band(k), F.lit(0.0), lambda a, v: a + v)
    return w.select("tile", "row", "col", total(0).alias("total_a"), total(1).alias("total_b"), F.array_max(band(1)).alias("top_b"), F.col("window")[7][0].alias("low_a"), F.col("window")[2][1].alias("right_b"))


@query("""
WITH c AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END AS zone, l_extendedprice / 1000 AS v FROM lineitem WHERE l_linenumber <> 4)
SELECT zone, round(quantile_cont(v, 0.99) + 3e-8, 6) AS p99 FROM c GROUP BY 1
""")
def large_zones(spark, sf_dir):
    """Exact quantiles where one zone has a third of all cells; zones of over a thousand cells are counted in bins."""
    zone = F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey"))
    cells = _t(spark, sf_dir, "lineitem").select(zone.cast("long").alias("zone"), F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice") / 1000).alias("v"))
    got = aggregates.exact_quantiles(staged(cells, "zone-cells"), "zone", "v", whole=1_000, bins=256)
    return got.select("zone", F.round(F.col("quantile") + 3e-8, 6).alias("p99"))


def _notched(x, y, width, height):
    """A box with a triangular notch in its upper edge."""
    at = lambda a, b: F.struct((x + a * width).alias("x"), (y + b * height).alias("y"))
    return F.array(at(0, 0), at(1, 0), at(1, 1), at(0.5, 0.5), at(0, 1))


_NOTCH_SQL = f"""p AS (SELECT o_orderkey, {_xy_sql('o_orderkey')} FROM orders),
r AS (SELECT p_partkey AS ring_id, (p_partkey*7919%1000)::DOUBLE AS x0, (p_partkey*104729%1000)::DOUBLE AS y0, (2 * (1 + p_size % 9) * CASE WHEN p_partkey % 50 = 0 THEN 16 ELSE 1 END)::DOUBLE AS w, (2 * (1 + p_size % 7))::DOUBLE AS h FROM part)"""


@query(f"""
WITH {_NOTCH_SQL}, m AS (SELECT o_orderkey, ring_id, (x - x0) / w AS u, (y - y0) / h AS v FROM p JOIN r ON x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + h)
SELECT o_orderkey, ring_id FROM m WHERE v <= greatest(u, 1 - u)
""")
def points_in_rings(spark, sf_dir):
    """Points in thousands of notched rings of unlike size."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in _xy("o_orderkey").items()])
    k, size = F.col("p_partkey"), F.col("p_size")
    at = _xy("p_partkey")
    width = (2 * (1 + size % 9) * F.when(k % 50 == 0, 16).otherwise(1)).cast("double")
    rings = _t(spark, sf_dir, "part").select(k.alias("ring_id"), _notched(at["x"], at["y"], width, (2 * (1 + size % 7)).cast("double")).alias("ring"))
    return spatial.points_in_rings(o, rings).select("o_orderkey", "ring_id")


@query("""
WITH a AS (SELECT * FROM events), b AS (SELECT * FROM a WHERE value > 3), c AS (SELECT * FROM b WHERE event_type <> 'error'), d AS (SELECT * FROM c WHERE event_id % 3 <> 1)
SELECT 0::INT AS step, 'raw' AS stage, count(*) AS rows, count(DISTINCT event_type) AS taxa FROM a UNION ALL SELECT 1, 'height', count(*), count(DISTINCT event_type) FROM b
UNION ALL SELECT 2, 'taxa', count(*), count(DISTINCT event_type) FROM c UNION ALL SELECT 3, 'kept', count(*), count(DISTINCT event_type) FROM d
""")
def observed_audit(spark, sf_dir):
    """Rows and taxa of four stages, counted while the last one's rows are written: one job."""
    e = _t(spark, sf_dir, "events")
    labels = staged(split.encode_labels(e, column="event_type"), "labels")
    seen = {}

    def stage(name, df):
        df, seen[name] = aggregates.audited(df, name, "label", "user_id")
        return df

    rows = stage("raw", e.join(labels, "event_type", "left"))
    rows = stage("height", rows.filter("value > 3"))
    rows = stage("taxa", clean.exclude(rows, "event_type", ["error"]))
    rows = stage("kept", rows.filter("event_id % 3 <> 1"))
    staged(rows, "audited")
    return aggregates.audit_of(spark, seen)


def _node_values(n: int = 24) -> str:
    """Nodes and weights of Gauss and Legendre on 0 to 1."""
    import numpy as np

    at, weight = np.polynomial.legendre.leggauss(n)
    return ", ".join(f"({(x + 1) / 2!r}::DOUBLE, {w / 2!r}::DOUBLE)" for x, w in zip(at.tolist(), weight.tolist(), strict=True))


_E2 = "(0.0066943799901413165::DOUBLE)"  # 2f - f*f of the WGS84 ellipsoid, f = 1 / 298.257223563
_PLANE_SQL = f"""
WITH RECURSIVE g AS (SELECT o_orderkey, -87.0 + (o_orderkey*7919%1200)/100.0::DOUBLE AS lon, (o_orderkey*104729%6000)/100.0::DOUBLE AS lat FROM orders),
w AS (SELECT o_orderkey, lon, lat, atanh(sin(radians(lat))) - sqrt({_E2}) * atanh(sqrt({_E2}) * sin(radians(lat))) AS wr, radians(lon + 81.0) AS wi FROM g),
s AS (
  SELECT o_orderkey, 0 AS k, wr, wi, sinh(2*wr) / (cosh(2*wr) + cos(2*wi)) AS sr, sin(2*wi) / (cosh(2*wr) + cos(2*wi)) AS si FROM w
  UNION ALL
  SELECT o_orderkey, k + 1, wr, wi, sinh(2*tr) / (cosh(2*tr) + cos(2*ti)), sin(2*ti) / (cosh(2*tr) + cos(2*ti)) FROM (
    SELECT o_orderkey, k, wr, wi, wr + sqrt({_E2}) * 0.25 * ln((pow(1 + er, 2) + er0) / (pow(1 - er, 2) + er0)) AS tr, wi + sqrt({_E2}) * 0.5 * atan2(2 * ei, 1 - er*er - ei*ei) AS ti
    FROM (SELECT *, sqrt({_E2}) * sr AS er, sqrt({_E2}) * si AS ei, {_E2} * si * si AS er0 FROM s)) WHERE k < 9
),
n(t, wt) AS (VALUES {_node_values()}),
q AS (SELECT o_orderkey, sr, si, wt, sr*sr*t*t - si*si*t*t AS ar, 2*sr*si*t*t AS ai FROM s, n WHERE k = 9),
z AS (SELECT o_orderkey, sr, si, wt, -0.75 * ln(pow(1 - {_E2}*ar, 2) + pow({_E2}*ai, 2)) - 0.25 * ln(pow(1 - ar, 2) + ai*ai) AS lr, -1.5 * atan2(-{_E2}*ai, 1 - {_E2}*ar) - 0.5 * atan2(-ai, 1 - ar) AS li FROM q),
m AS (SELECT o_orderkey, any_value(sr) AS sr, any_value(si) AS si, sum(wt * exp(lr) * cos(li)) AS ir, sum(wt * exp(lr) * sin(li)) AS ii FROM z GROUP BY 1)
SELECT o_orderkey, round(500000 + 0.9996 * 6378137.0 * (1 - {_E2}) * (sr*ii + si*ir), 2) AS easting, round(0.9996 * 6378137.0 * (1 - {_E2}) * (sr*ir - si*ii), 2) AS northing, round(lon, 7) AS lon, round(lat, 7) AS lat FROM m JOIN g USING (o_orderkey)
"""


@query(_PLANE_SQL)
def projected_places(spark, sf_dir):
    """Degrees to the plane of a zone and back, up to six degrees off its middle.

    The SQL has no series in common with ours: it integrates the meridian arc in the complex plane from the ellipsoid's two constants.
    """
    k = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (-87.0 + (k * 7919 % 1200) / 100.0).alias("lon"), ((k * 104729 % 6000) / 100.0).alias("lat"))
    x, y = projection.from_geographic("lon", "lat", F.lit(17))
    there = o.select("o_orderkey", x.alias("x"), y.alias("y"))
    lon, lat = projection.to_geographic("x", "y", F.lit(17))
    return there.select("o_orderkey", F.round("x", 2).alias("easting"), (F.round("y", 2) + 0.0).alias("northing"), F.round(lon, 7).alias("lon"), (F.round(lat, 7) + 0.0).alias("lat"))


_ALL_CODES = ("PSMEM", "BEPAP", "ACNEN", "ACRUR", "PICOL", "ABLAL", "ACSA3", "CECAC", "PRSES", "PIPOS", "BEPAC2", "JUVIV", "PRPEP", "COCOC", "NYBI", "BETUL", "FRAXI", "HALES", "PICEA", "PINUS", "QUERC", "ULMUS", "2PLANT", "PIPA2", "ACRU")
_ALL_PEOPLE = ("NEON.PLA.D03.OSBS.03422", "NEON.PLA.D03.OSBS.03382", "NEON.PLA.D17.TEAK.01883")
_ALL_PLOTS = ("SOAP_054", "OSBS_026", "OSBS_029", "OSBS_039", "OSBS_027", "OSBS_036")


@query(f"""
WITH s AS (SELECT event_id AS seq, CASE WHEN user_id % 9 < 3 THEN {list(_ALL_PEOPLE)}[user_id % 9 + 1] ELSE 'NEON.PLA.' || user_id END AS individual, {list(_ALL_CODES)}[user_id % 25 + 1] AS code,
  CASE WHEN user_id % 20 < 6 THEN {list(_ALL_PLOTS)}[user_id % 20 + 1] ELSE 'P' || user_id % 20 END AS plotID, value AS height FROM events WHERE value IS NULL OR value > 3),
r AS (SELECT seq, individual, plotID, height, CASE code WHEN 'PSMEM' THEN 'PSME' WHEN 'BEPAP' THEN 'BEPA' WHEN 'ACNEN' THEN 'ACNE2' WHEN 'ACRUR' THEN 'ACRU' WHEN 'PICOL' THEN 'PICO' WHEN 'ABLAL' THEN 'ABLA' WHEN 'ACSA3' THEN 'ACSAS'
  WHEN 'CECAC' THEN 'CECA4' WHEN 'PRSES' THEN 'PRSE2' WHEN 'PIPOS' THEN 'PIPO' WHEN 'BEPAC2' THEN 'BEPA' WHEN 'JUVIV' THEN 'JUVI' WHEN 'PRPEP' THEN 'PRPE2' WHEN 'COCOC' THEN 'COCO6' WHEN 'NYBI' THEN 'NYSY' ELSE code END AS taxonID FROM s
  WHERE code NOT IN ('BETUL','FRAXI','HALES','PICEA','PINUS','QUERC','ULMUS','2PLANT')),
k AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY height DESC, seq) AS n FROM r)
SELECT individual, seq, taxonID, plotID FROM k WHERE n = 1 AND individual NOT IN {_ALL_PEOPLE} AND plotID NOT IN {_ALL_PLOTS}
""")
def clean_all_codes(spark, sf_dir):
    """Stems with all recoded and all dropped codes, blocked individuals and blocked plots."""
    u, i = F.col("user_id"), F.col("event_id")
    pick = lambda values, at: F.get(F.lit(list(values)), at.cast("int"))
    stems = _t(spark, sf_dir, "events").select(
        F.when(u % 9 < 3, pick(_ALL_PEOPLE, u % 9)).otherwise(F.concat(F.lit("NEON.PLA."), u.cast("string"))).alias("individualID"), i.alias("seq"), F.lit("vst_2018_1").alias("eventID"), F.lit("Live").alias("plantStatus"),
        F.lit("single bole tree").alias("growthForm"), F.col("value").alias("height"), F.lit(20.0).alias("stemDiameter"), pick(_ALL_CODES, u % 25).alias("taxonID"),
        F.when(u % 20 < 6, pick(_ALL_PLOTS, u % 20)).otherwise(F.concat(F.lit("P"), (u % 20).cast("string"))).alias("plotID"), F.lit("S1").alias("siteID"), F.lit("Full sun").alias("canopyPosition"),
        F.lit(1.0).alias("itcEasting"), F.lit(1.0).alias("itcNorthing"), F.lit("17N").alias("utmZone"),
    )
    return pipelines.clean_stems(stems).select("individual", "seq", "taxonID", "plotID")

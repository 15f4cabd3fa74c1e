"""Driver queries: the operators on the driver's tables, each with its SQL where SQL can say it.

Positions are derived by whole-number arithmetic, so both engines agree:
x = (id * 7919) % 1000, y = (id * 104729) % 1000.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import arrays, projection, tiles
from canopy.functions.geometry import literal_ring
from canopy.operators import abundance, aggregates, clean, hierarchy, metrics, raster, scoring, spatial, split, windows
from canopy.plans import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _xy(key: str) -> dict[str, Column]:
    k = F.col(key)
    return {"x": (k * 7919 % 1000).cast("double"), "y": (k * 104729 % 1000).cast("double")}


def _xy_sql(key: str) -> str:
    return f"({key}*7919%1000)::DOUBLE AS x, ({key}*104729%1000)::DOUBLE AS y"


#: A boundary with a notch.
RING = ((100.0, 100.0), (900.0, 100.0), (900.0, 800.0), (500.0, 400.0), (100.0, 800.0))


def _inside_sql(x: str = "x", y: str = "y") -> str:
    parts, edges = [], []
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True):
        parts.append(f"(CASE WHEN ({y1}>{y})<>({y2}>{y}) AND {x} < ({x2 - x1})*({y}-{y1})/({(y2 - y1) or 1})+{x1} THEN 1 ELSE 0 END)")
        edges.append(f"(({x2 - x1})*({y}-{y1})-({y2 - y1})*({x}-{x1})=0 AND {x} BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND {y} BETWEEN {min(y1, y2)} AND {max(y1, y2)})")
    return f"(({'+'.join(parts)})%2=1 OR {' OR '.join(edges)})"


# ---- abundance -----------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT event_id, user_id, event_id % 3 AS model, event_type, {_xy_sql('event_id')} FROM events),
one AS (SELECT *, row_number() OVER (PARTITION BY model, user_id ORDER BY event_id) AS r FROM p WHERE event_type IS NOT NULL)
SELECT model, event_type AS taxon, count(*) AS count FROM one WHERE r = 1 AND {_inside_sql()} GROUP BY ALL
""")
def abundance_by_model(spark, sf_dir):
    """Individuals of each taxon inside the boundary, per model."""
    p = _t(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3).alias("model"), F.col("event_type").alias("taxon"), *[c.alias(n) for n, c in _xy("event_id").items()])
    return abundance.abundance(p.filter("taxon is not null"), literal_ring(RING), keys=["model"], individual="user_id", taxon="taxon", order=["event_id"])


_BOX_SQL = "p_partkey AS box, (p_partkey*7919%1000)::DOUBLE AS xmin, (p_partkey*104729%1000)::DOUBLE AS ymin, (p_partkey*7919%1000 + p_size%20)::DOUBLE AS xmax, (p_partkey*104729%1000 + p_size%15)::DOUBLE AS ymax"


def _boxes(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    at = _xy("p_partkey")
    return p.select(F.col("p_partkey").alias("box"), at["x"].alias("xmin"), at["y"].alias("ymin"), (at["x"] + F.col("p_size") % 20).alias("xmax"), (at["y"] + F.col("p_size") % 15).alias("ymax"))


_CORNER_INSIDE = " OR ".join(_inside_sql(a, b) for a in ("xmin", "xmax") for b in ("ymin", "ymax"))
_EDGE_MEETS = " OR ".join(
    f"(NOT ({max(x1, x2)} < xmin OR {min(x1, x2)} > xmax OR {max(y1, y2)} < ymin OR {min(y1, y2)} > ymax)"
    f" AND least({', '.join(s := [f'(({x2 - x1})*({b}-{y1})-({y2 - y1})*({a}-{x1}))' for a in ('xmin', 'xmax') for b in ('ymin', 'ymax')])}) <= 0 AND greatest({', '.join(s)}) >= 0)"
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True)
)


@query(f"WITH b AS (SELECT {_BOX_SQL} FROM part) SELECT box, xmin, ymin, xmax, ymax FROM b WHERE {_CORNER_INSIDE} OR {_EDGE_MEETS}")
def clipped_boxes(spark, sf_dir):
    """Boxes that meet the boundary."""
    return abundance.prediction_layer(_boxes(spark, sf_dir), literal_ring(RING), individual="box", order=["box"])


# ---- cleaning ------------------------------------------------------------------------

_STEMS_SQL = """
SELECT 'I' || user_id || CASE WHEN user_id % 17 = 0 THEN 'B' ELSE '' END AS individual, event_id AS seq,
       'vst_' || (2013 + event_id % 6) || '_' || lpad((event_id % 997)::VARCHAR, 3, '0') AS eventID,
       CASE event_id % 5 WHEN 0 THEN 'Live' WHEN 1 THEN 'Live, damaged' WHEN 2 THEN 'Dead' WHEN 3 THEN 'Live, broken' END AS plantStatus,
       CASE event_id % 7 WHEN 0 THEN 'liana' WHEN 1 THEN NULL ELSE 'single bole tree' END AS growthForm,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS height, value % 30 AS stemDiameter,
       CASE event_type WHEN 'click' THEN 'PSMEM' WHEN 'error' THEN 'QUERC' WHEN 'view' THEN 'BEPAP' WHEN 'signup' THEN 'NYBI' ELSE 'ACRU' END AS taxonID,
       CASE user_id % 11 WHEN 0 THEN 'SOAP_054' ELSE 'P' || user_id % 40 END AS plotID, CASE user_id % 5 WHEN 0 THEN 'ORNL' ELSE 'S' || user_id % 5 END AS siteID,
       CASE WHEN user_id % 4 = 1 AND event_id % 2 = 0 THEN 'Full shade' WHEN event_id % 50 = 3 THEN 'Full sun' WHEN event_id % 2 = 0 THEN 'Partially shaded' END AS canopyPosition
FROM events"""


def _stems(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    u, i = F.col("user_id"), F.col("event_id")
    status = F.when(i % 5 == 0, "Live").when(i % 5 == 1, "Live, damaged").when(i % 5 == 2, "Dead").when(i % 5 == 3, "Live, broken")
    taxon = F.when(F.col("event_type") == "click", "PSMEM").when(F.col("event_type") == "error", "QUERC").when(F.col("event_type") == "view", "BEPAP").when(F.col("event_type") == "signup", "NYBI").otherwise("ACRU")
    return e.select(
        F.concat(F.lit("I"), u.cast("string"), F.when(u % 17 == 0, "B").otherwise("")).alias("individual"), i.alias("seq"),
        F.concat(F.lit("vst_"), (2013 + i % 6).cast("string"), F.lit("_"), F.lpad((i % 997).cast("string"), 3, "0")).alias("eventID"), status.alias("plantStatus"),
        F.when(i % 7 == 0, "liana").when(i % 7 != 1, "single bole tree").alias("growthForm"), F.when(i % 3 != 0, F.col("value")).alias("height"), (F.col("value") % 30).alias("stemDiameter"),
        taxon.alias("taxonID"), F.when(u % 11 == 0, "SOAP_054").otherwise(F.concat(F.lit("P"), (u % 40).cast("string"))).alias("plotID"),
        F.when(u % 5 == 0, "ORNL").otherwise(F.concat(F.lit("S"), (u % 5).cast("string"))).alias("siteID"),
        F.when((u % 4 == 1) & (i % 2 == 0), "Full shade").when(i % 50 == 3, "Full sun").when(i % 2 == 0, "Partially shaded").alias("canopyPosition"),
    )


@query(f"""
WITH s AS ({_STEMS_SQL}), a AS (SELECT * FROM s WHERE growthForm IS NOT NULL AND growthForm NOT IN ('liana','small shrub') AND plantStatus LIKE '%Live%'),
shade AS (SELECT individual FROM a GROUP BY 1 HAVING bool_or(canopyPosition IN ('Full shade','Mostly shaded')) AND NOT coalesce(bool_or(canopyPosition IN ('Open grown','Full sun')), false)),
b AS (SELECT * REPLACE (CASE taxonID WHEN 'PSMEM' THEN 'PSME' WHEN 'BEPAP' THEN 'BEPA' WHEN 'NYBI' THEN 'NYSY' ELSE taxonID END AS taxonID) FROM a
      WHERE individual NOT IN (SELECT individual FROM shade) AND (height > 3 OR height IS NULL) AND stemDiameter > 10),
c AS (SELECT * FROM b WHERE taxonID NOT IN ('QUERC') AND eventID NOT LIKE '%2014%'),
t AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY height DESC, seq) r FROM c WHERE height IS NOT NULL) WHERE r = 1),
n AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY eventID DESC, seq) r FROM c WHERE height IS NULL AND individual NOT IN (SELECT individual FROM t)) WHERE r = 1),
u AS (SELECT * FROM t UNION ALL SELECT * FROM n)
SELECT individual, seq, eventID, taxonID, height, plotID, siteID FROM u WHERE NOT regexp_matches(individual, '[A-Z]$') AND plotID <> 'SOAP_054' AND siteID NOT IN ('PUUM','ORNL')
""")
def clean_stems(spark, sf_dir):
    """F1 to F11, W3, W4, U1."""
    s = _stems(spark, sf_dir)
    x, y = _xy("seq")["x"], _xy("seq")["y"]
    raw = s.withColumnRenamed("individual", "individualID").withColumns({"itcEasting": x, "itcNorthing": y, "utmZone": F.lit("17N")})
    return pipelines.clean_stems(raw).select("individual", "seq", "eventID", "taxonID", "height", "plotID", "siteID")


@query(f"""
WITH s AS ({_STEMS_SQL}), g AS (SELECT individual, bool_or(canopyPosition IN ('Full shade','Mostly shaded')) sh, bool_or(canopyPosition IN ('Open grown','Full sun')) su FROM s GROUP BY 1)
SELECT s.individual, s.seq FROM s JOIN g USING (individual) WHERE NOT (coalesce(sh, false) AND NOT coalesce(su, false))
""")
def shade_filter(spark, sf_dir):
    """F4."""
    return clean.drop_shaded(_stems(spark, sf_dir)).select("individual", "seq")


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity / 2 END AS chm, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE (l_partkey % 30)::DOUBLE END AS field FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(field, chm) AS height,
  CASE WHEN chm IS NULL THEN 'no canopy height' WHEN field IS NULL THEN 'keep: no field height' WHEN chm < 1 THEN 'canopy too low'
       WHEN chm > field AND chm - field < 4 THEN 'keep: canopy above field' WHEN chm > field THEN 'field too low'
       WHEN field - chm < 8 THEN 'keep: canopy below field' ELSE 'canopy far below field' END AS reason FROM h
""")
def height_rules(spark, sf_dir):
    """F16 to F18."""
    h = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity") / 2).alias("CHM_height"), F.when(F.col("l_suppkey") % 7 != 0, (F.col("l_partkey") % 30).cast("double")).alias("height"))
    return clean.fill_height(clean.height_rules(h)).select("l_orderkey", "l_linenumber", "l_partkey", "height", "reason")


@query("""
WITH r AS (SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'Brand#11' WHEN 'Brand#2' THEN 'Brand#12' WHEN 'Brand#3' THEN 'Brand#1' ELSE p_brand END AS taxon FROM part)
SELECT * FROM r WHERE taxon NOT IN ('Brand#4', 'Brand#5')
""")
def recode_taxa(spark, sf_dir):
    """F7, F8."""
    p = _t(spark, sf_dir, "part").select("p_partkey", clean.recode("p_brand", {"Brand#1": "Brand#11", "Brand#2": "Brand#12", "Brand#3": "Brand#1"}).alias("taxon"))
    return clean.exclude(p, "taxon", ["Brand#4", "Brand#5"])


@query("""
SELECT d.doc_id, CASE WHEN dead THEN 'DEAD' ELSE lang END AS taxon, CASE WHEN NOT dead THEN quality END AS ens_label, CASE WHEN NOT dead THEN score END AS ens_score
FROM (SELECT d.doc_id, d.lang, l.quality, (d.doc_id % 100) / 100.0::DOUBLE AS score, l.toxic = 1 AND (d.doc_id % 50) / 50.0::DOUBLE > 0.2 AS dead FROM documents d JOIN labels l USING (doc_id)) d
""")
def dead_mask(spark, sf_dir):
    """F20."""
    d = natural_docs(spark, sf_dir)
    rows = d.select("doc_id", F.col("lang").alias("taxon"), F.col("quality").alias("ens_label"), ((F.col("doc_id") % 100) / 100.0).alias("ens_score"), F.col("toxic").alias("dead_label"), ((F.col("doc_id") % 50) / 50.0).alias("dead_score"))
    return clean.mask_dead(rows, 0.2, taxon="taxon").select("doc_id", "taxon", "ens_label", "ens_score")


def natural_docs(spark, sf_dir):
    return spatial.natural(_t(spark, sf_dir, "documents").drop("text"), _t(spark, sf_dir, "labels"))


@query("""
WITH h AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), home AS (SELECT * FROM h WHERE c_nationkey = 3),
away AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) r FROM h WHERE c_nationkey <> 3 AND c_mktsegment IN (SELECT c_mktsegment FROM home))
SELECT * FROM home UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM away WHERE r <= 20
""")
def home_site_cap(spark, sf_dir):
    """F14."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return clean.home_and_capped(c, "c_nationkey", "c_mktsegment", 3, 20, ["c_custkey"])


@query("SELECT vec_id, list_sum(embedding::DOUBLE[]) > 0 AS up FROM embeddings WHERE len(list_filter(embedding, lambda v: isnan(v) OR isinf(v))) = 0")
def finite_bands(spark, sf_dir):
    """F24, F25."""
    e = clean.finite_only(clean.require(_t(spark, sf_dir, "embeddings"), "embedding"), "embedding")
    return e.select("vec_id", (F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v) > 0).alias("up"))


# ---- spatial joins -------------------------------------------------------------------


def _points(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("individual"), F.col("o_totalprice").alias("height"), (F.col("o_custkey") % 100).cast("double").alias("CHM_height"), *[c.alias(n) for n, c in _xy("o_orderkey").items()])


_POINT_SQL = f"SELECT o_orderkey AS individual, o_totalprice AS height, (o_custkey%100)::DOUBLE AS CHM_height, {_xy_sql('o_orderkey')} FROM orders"
_PAIR_SQL = f"p AS ({_POINT_SQL}), b AS (SELECT {_BOX_SQL} FROM part), m AS (SELECT p.*, b.* FROM p JOIN b ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)"


def _pairs(spark, sf_dir):
    return spatial.copies_in_boxes(_points(spark, sf_dir).select("individual", "x", "y"), _boxes(spark, sf_dir))


@query(f"WITH {_PAIR_SQL} SELECT individual, box FROM m")
def point_in_box(spark, sf_dir):
    """J1, R1."""
    return _pairs(spark, sf_dir).select("individual", "box")


@query(f"""
WITH {_PAIR_SQL}, f AS (SELECT * FROM p WHERE individual NOT IN (SELECT individual FROM m WHERE xmax - xmin >= 15))
SELECT a.individual, 'fixed_box_' || c.individual AS box_id, c.x - 1 AS xmin, c.y + 1 AS ymax FROM f a JOIN f c ON a.x BETWEEN c.x - 1 AND c.x + 1 AND a.y BETWEEN c.y - 1 AND c.y + 1
""")
def fallback_boxes(spark, sf_dir):
    """J2, J9."""
    points = _points(spark, sf_dir).select("individual", "x", "y", F.col("individual").alias("number"))
    got = spatial.fallback_boxes(points, spatial.points_in_any(points, _boxes(spark, sf_dir).filter("xmax - xmin >= 15")))
    return got.select("individual", "box_id", "xmin", "ymax")


@query(f"""
WITH {_PAIR_SQL}, r AS (SELECT individual, box, row_number() OVER (PARTITION BY individual ORDER BY pow((xmin+xmax)/2-x, 2)+pow((ymin+ymax)/2-y, 2), box) AS k FROM m)
SELECT individual, box FROM r WHERE k = 1
""")
def nearest_box(spark, sf_dir):
    """J3."""
    return spatial.nearest_of_boxes(_points(spark, sf_dir), _boxes(spark, sf_dir), box_id="box").select("individual", "box")


@query(f"""
WITH {_PAIR_SQL}, h AS (SELECT individual, box, CASE WHEN box % 4 <> 0 THEN height END AS height, CHM_height FROM m),
r AS (SELECT *, rank() OVER (PARTITION BY box ORDER BY height DESC NULLS LAST, CHM_height DESC NULLS LAST) k, count(*) OVER (PARTITION BY box) n, count(height) OVER (PARTITION BY box) known FROM h)
SELECT individual, box FROM r WHERE k = 1 AND (n = 1 OR known > 0)
""")
def tallest_in_box(spark, sf_dir):
    """J4."""
    p, b = _points(spark, sf_dir), _boxes(spark, sf_dir)
    measured = spatial.tallest_of_boxes(p, b.filter("box % 4 <> 0"), box_id="box")
    unmeasured = spatial.tallest_of_boxes(p.withColumn("height", F.lit(None).cast("double")), b.filter("box % 4 = 0"), box_id="box")
    return measured.select("individual", "box").union(unmeasured.select("individual", "box"))


@query(f"WITH {_PAIR_SQL}, r AS (SELECT individual, box, row_number() OVER (PARTITION BY box ORDER BY individual) k FROM m) SELECT individual, box FROM r WHERE k = 1")
def dedupe_box(spark, sf_dir):
    """J5."""
    return spatial.first_in_boxes(_points(spark, sf_dir), _boxes(spark, sf_dir), ["box"], ["individual"]).select("individual", "box")


@query(f"""
WITH p AS (SELECT c_custkey, {_xy_sql('c_custkey')} FROM customer), e AS (SELECT min(x) x0, min(y) y0, max(y) y1 FROM p)
SELECT c_custkey, (ceil((x-x0)/40) * ceil((y1+40-y0)/40) + greatest(ceil((y-y0)/40)-1, 0))::BIGINT || '_contrib' AS plotID FROM p, e
""")
def grid_assign(spark, sf_dir):
    """J6, E6."""
    c = _t(spark, sf_dir, "customer").select("c_custkey").withColumns(_xy("c_custkey"))
    return spatial.grid_plots(c).select("c_custkey", "plotID")


@query(f"""
WITH p AS (SELECT c_custkey AS position, {_xy_sql('c_custkey')} FROM customer)
SELECT a.position, max(b.position) AS plot FROM p a JOIN p b ON pow(a.x-b.x, 2) + pow(a.y-b.y, 2) <= 1600 GROUP BY 1
""")
def radius_plots(spark, sf_dir):
    """J7."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), *[v.alias(n) for n, v in _xy("c_custkey").items()])
    return spatial.radius_plots(c).select("position", "plot")


def _utm_boxes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", (400_000 + k * 7919 % 5000).cast("double").alias("xmin"), (3_280_000 + k * 104729 % 5000).cast("double").alias("ymin")).withColumns({"xmax": F.col("xmin") + 4.5, "ymax": F.col("ymin") + 3.5})


_GEO_SQL = """o AS (SELECT o_orderkey, 400000 + o_orderkey*7919%5000 AS x, 3280000 + o_orderkey*104729%5000 AS y FROM orders),
g AS (SELECT o_orderkey, (floor(trunc(x+2.25)/1000)*1000)::BIGINT || '_' || (floor(trunc(y+1.75)/1000)*1000)::BIGINT AS geo_index FROM o)"""
_CATALOG_SQL = """cat AS (SELECT DISTINCT (400000 + page_id%5*1000) || '_' || (3280000 + page_id*page_id%7*1000) AS geo_index, 2018 + page_id%4 AS tile_year,
  '/pool/' || (2018 + page_id%4) || '/' || (400000 + page_id%5*1000) || '_' || (3280000 + page_id*page_id%7*1000) || '_image.tif' AS path FROM pages)"""


def _catalog(spark, sf_dir):
    i = F.col("page_id")
    g = F.concat_ws("_", (400_000 + i % 5 * 1000).cast("string"), (3_280_000 + i * i % 7 * 1000).cast("string"))
    year = (2018 + i % 4).cast("string")
    p = _t(spark, sf_dir, "pages").select(F.concat(F.lit("/pool/"), year, F.lit("/"), g, F.lit("_image.tif")).alias("path")).distinct()
    return p.withColumns({"geo_index": tiles.geo_index_from_name("path"), "tile_year": tiles.year_from_path("path")})


@query(f"WITH {_GEO_SQL} SELECT * FROM g")
def geo_index(spark, sf_dir):
    """E1."""
    return _utm_boxes(spark, sf_dir).select("o_orderkey", tiles.geo_index("xmin", "ymin", "xmax", "ymax").alias("geo_index"))


@query(f"WITH {_GEO_SQL}, {_CATALOG_SQL} SELECT o_orderkey, geo_index, max(path) AS path FROM g JOIN cat USING (geo_index) GROUP BY ALL")
def tile_latest(spark, sf_dir):
    """J13, W9."""
    return spatial.tile_latest(geo_index(spark, sf_dir), _catalog(spark, sf_dir))


@query(f"WITH {_GEO_SQL}, {_CATALOG_SQL} SELECT o_orderkey, geo_index, path, tile_year FROM g JOIN cat USING (geo_index)")
def tile_all_years(spark, sf_dir):
    """J14, E2, E4."""
    return spatial.tile_all_years(geo_index(spark, sf_dir), _catalog(spark, sf_dir)).select("o_orderkey", "geo_index", "path", F.col("tile_year").cast("bigint").alias("tile_year"))


@query(f"WITH {_GEO_SQL}, {_CATALOG_SQL} SELECT DISTINCT geo_index, 'no raster' AS reason FROM g WHERE geo_index NOT IN (SELECT geo_index FROM cat)")
def tile_rejects(spark, sf_dir):
    """F27."""
    return clean.covered(geo_index(spark, sf_dir), _catalog(spark, sf_dir))[1]


@query(f"WITH {_CATALOG_SQL} SELECT a.path, b.path AS other_path, (regexp_extract(a.path, '([^/]*)\\.tif$', 1) || '_hyperspectral_' || b.tile_year) AS output FROM cat a JOIN cat b USING (geo_index) WHERE a.tile_year = 2018")
def paired_products(spark, sf_dir):
    """J17."""
    c = _catalog(spark, sf_dir)
    return spatial.pair_products(clean.one_year(c, 2018), c).select("path", "other_path", "output")


@query(r"""
WITH u AS (SELECT page_id, 'pool/AB_D0' || page_id%9 || '_SITE' || page_id%4 || '_DP1_' || page_id || '_' || (2015 + page_id%8) || '.tif' AS path FROM pages)
SELECT page_id, regexp_extract(path, '([^/]*)\.[^.]*$', 1) AS base, 2015 + page_id%8 AS tile_year, 'SITE' || page_id%4 AS site, 'D0' || page_id%9 AS domain FROM u
""")
def url_tokens(spark, sf_dir):
    """E2 to E5."""
    i = F.col("page_id")
    path = F.format_string("pool/AB_D0%d_SITE%d_DP1_%d_%d.tif", i % 9, i % 4, i, 2015 + i % 8)
    return _t(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", tiles.base_name("path").alias("base"), tiles.year_from_name("path").cast("bigint").alias("tile_year"), tiles.site_from_name("path").alias("site"), tiles.domain_from_name("path").alias("domain"))


def _series_sql(terms, angle: str, wave: str, other: str | None = None) -> str:
    return "(" + " + ".join(f"{c!r}::DOUBLE*{wave[0]}({2 * (j + 1)}*{angle})" + (f"*{wave[1]}({2 * (j + 1)}*{other})" if other else "") for j, c in enumerate(terms)) + ")"


_ZONE_SQL = f"""
WITH b AS (SELECT o_orderkey, 400000 + o_orderkey*7919%5000 AS x, 3280000 + o_orderkey*104729%5000 AS y FROM orders),
i AS (SELECT o_orderkey, y / {projection.SCALE!r}::DOUBLE AS xi, (x - 500000) / {projection.SCALE!r}::DOUBLE AS eta FROM b),
j AS (SELECT o_orderkey, xi - {_series_sql(projection._BETA, 'xi', ('sin', 'cosh'), 'eta')} AS xi, eta - {_series_sql(projection._BETA, 'xi', ('cos', 'sinh'), 'eta')} AS eta FROM i),
k AS (SELECT o_orderkey, asin(sin(xi) / cosh(eta)) AS chi, radians(-75.0::DOUBLE) + atan2(sinh(eta), cos(xi)) AS lon FROM j),
l AS (SELECT o_orderkey, lon, chi + {_series_sql(projection._DELTA, 'chi', ('sin',))} AS lat FROM k),
m AS (SELECT *, lon - radians(-81.0::DOUBLE) AS lam, sinh(atanh(sin(lat)) - {projection._E!r}::DOUBLE * atanh({projection._E!r}::DOUBLE * sin(lat))) AS t FROM l),
n AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM m)
SELECT o_orderkey, round(500000 + {projection.SCALE!r}::DOUBLE * (eta + {_series_sql(projection._ALPHA, 'xi', ('cos', 'sinh'), 'eta')}), 2) AS easting,
  round({projection.SCALE!r}::DOUBLE * (xi + {_series_sql(projection._ALPHA, 'xi', ('sin', 'cosh'), 'eta')}), 2) AS northing, round(degrees(lon), 7) AS lon, round(degrees(lat), 7) AS lat FROM n
"""


@query(_ZONE_SQL)
def zone_change(spark, sf_dir):
    """Coordinates from one UTM zone in the next, and in degrees."""
    b = _utm_boxes(spark, sf_dir)
    x, y = projection.change_zone("xmin", "ymin", 18, 17)
    lon, lat = projection.to_geographic("xmin", "ymin", F.lit(18))
    return b.select("o_orderkey", F.round(x, 2).alias("easting"), F.round(y, 2).alias("northing"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


# ---- raster --------------------------------------------------------------------------

def _cells(spark, sf_dir):
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return _t(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 4).alias("value"), (k * 7919 % 1000).cast("double").alias("x"), (k * 104729 % 1000).cast("double").alias("y"))


@query(f"""
WITH c AS (SELECT l_quantity / 4 AS value, ((l_orderkey*8+l_linenumber)*7919%1000)::DOUBLE AS x, ((l_orderkey*8+l_linenumber)*104729%1000)::DOUBLE AS y FROM lineitem), b AS (SELECT {_BOX_SQL} FROM part),
z AS (SELECT box, quantile_cont(value, 0.99) AS h FROM b JOIN c ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax WHERE value >= 0.5 GROUP BY 1)
SELECT box, round(h, 6) AS CHM_height FROM b LEFT JOIN z USING (box)
""")
def zonal_p99(spark, sf_dir):
    """J15, R6, A3."""
    return raster.zonal_p99(_cells(spark, sf_dir), _boxes(spark, sf_dir), "box").select("box", F.round("CHM_height", 6).alias("CHM_height"))


@query("""
WITH c AS (SELECT l_suppkey AS tile, l_partkey % 12 AS row, l_orderkey % 12 AS col, max(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT a.tile, a.row, a.col, sum(b.value) AS total, max(b.value) AS top, count(*) AS n FROM c a JOIN c b ON a.tile = b.tile AND b.row BETWEEN a.row AND a.row + 2 AND b.col BETWEEN a.col AND a.col + 2 GROUP BY ALL
""")
def neighbourhood(spark, sf_dir):
    """Windows of 3 x 3 cells."""
    c = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tile"), (F.col("l_partkey") % 12).alias("row"), (F.col("l_orderkey") % 12).alias("col")).agg(F.max("l_quantity").alias("value"))
    w = raster.neighbourhood(c, ["tile"], width=3, height=3)
    return w.select("tile", "row", "col", F.aggregate("window", F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max("window").alias("top"), F.size(F.filter("window", lambda v: v > 0)).cast("bigint").alias("n"))


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS geo_index, l_returnflag AS product, 2012 + l_orderkey % 11 AS tile_year FROM lineitem),
y AS (SELECT geo_index, tile_year FROM c WHERE tile_year > 2017 GROUP BY ALL HAVING count(DISTINCT product) = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY geo_index ORDER BY tile_year DESC) k FROM y)
SELECT geo_index, array_to_string(list(tile_year ORDER BY tile_year), ',') AS years FROM r WHERE k <= 3 GROUP BY 1 HAVING count(*) = 3
""")
def year_coverage(spark, sf_dir):
    """A14, U2, W10."""
    c = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("geo_index"), F.col("l_returnflag").alias("product"), (2012 + F.col("l_orderkey") % 11).alias("tile_year"))
    return aggregates.year_coverage(c).select("geo_index", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


@query("SELECT s.l_suppkey, round(avg(l_quantity), 6) AS elevation FROM lineitem s GROUP BY 1")
def mean_elevation(spark, sf_dir):
    """R10."""
    return raster.mean_elevation(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity").select("l_suppkey", F.round("elevation", 6).alias("elevation"))


# ---- spectra and scores --------------------------------------------------------------


def _spectra(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query("""
WITH t AS (SELECT vec_id, (embedding::DOUBLE[])[11:54] AS b FROM embeddings)
SELECT vec_id, unnest(range(1, len(b) + 1)) AS band, round((unnest(b) - list_min(b)) / (list_max(b) - list_min(b)), 6) AS v FROM t
""")
def spectrum_minmax(spark, sf_dir):
    """E18, E19."""
    s = _spectra(spark, sf_dir).select("vec_id", F.posexplode(arrays.min_max(arrays.trim("e"))).alias("b", "v"))
    return s.select("vec_id", (F.col("b") + 1).cast("bigint").alias("band"), F.round("v", 6).alias("v"))


@query("""
WITH l AS (SELECT vec_id, (embedding::DOUBLE[])[1:10] AS z FROM embeddings), x AS (SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM l),
p AS (SELECT vec_id, unnest(range(0, 10)) AS k, unnest(e) / list_sum(e) AS s FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS n FROM p)
SELECT a.vec_id, a.k AS top1, round(a.s, 6) AS score1, b.k AS top2, round(b.s, 6) AS score2 FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2
""")
def softmax_top2(spark, sf_dir):
    """E24, E25, W11, M4."""
    s = _spectra(spark, sf_dir).select("vec_id", *scoring.top_two(F.slice("e", 1, 10)))
    return s.select("vec_id", F.col("top1").cast("bigint").alias("top1"), F.round("score1", 6).alias("score1"), F.col("top2").cast("bigint").alias("top2"), F.round("score2", 6).alias("score2"))


@query("""
WITH r AS (SELECT vec_id // 4 AS individual, CASE WHEN vec_id % 4 = 3 THEN list_transform(range(0, 10), lambda i: 0.0) ELSE (embedding::DOUBLE[])[1:10] END AS s FROM embeddings),
u AS (SELECT individual, unnest(range(0, 10)) AS k, unnest(s) AS v FROM r WHERE len(list_filter(s, lambda v: v <> 0)) > 0)
SELECT individual, k AS class, round(avg(v), 6) AS score FROM u GROUP BY ALL
""")
def year_mean_scores(spark, sf_dir):
    """A11, E23."""
    s = _spectra(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("individual"), F.when(F.col("vec_id") % 4 == 3, F.array_repeat(F.lit(0.0), 10)).otherwise(F.slice("e", 1, 10)).alias("s"))
    m = aggregates.mean_scores(s, "individual", "s").select("individual", F.posexplode("s").alias("class", "score"))
    return m.select("individual", F.col("class").cast("bigint").alias("class"), F.round("score", 6).alias("score"))


_LEVEL_TAXA = {0: ["PIPA2", "OTHER"], 1: ["CONIFER", "BROADLEAF"], 2: ["ACRU", "NYSY", "OAK"], 3: ["PICL", "PIEL", "PITA"], 4: ["QULA2", "QUGE2", "QUNI"]}
_SLICE = {0: (1, 2), 1: (3, 2), 2: (5, 3), 3: (8, 3), 4: (11, 3)}


def _level_scores(spark, sf_dir):
    e = _spectra(spark, sf_dir)
    entries = F.array(*[F.struct(F.lit(k).alias("level"), F.slice("e", a, n).alias("yhat")) for k, (a, n) in _SLICE.items()])
    return e.select(F.col("vec_id").alias("individual"), F.explode(entries).alias("s")).select("individual", "s.level", "s.yhat")


def _level_labels(spark):
    return spark.createDataFrame([(k, i, t) for k, names in _LEVEL_TAXA.items() for i, t in enumerate(names)], "level int, label int, taxon string")


_TOP_SQL = ", ".join(f"list_max((embedding::DOUBLE[])[{a}:{a + n - 1}]) AS s{k}, list_extract({_LEVEL_TAXA[k]}, list_position((embedding::DOUBLE[])[{a}:{a + n - 1}], list_max((embedding::DOUBLE[])[{a}:{a + n - 1}]))::BIGINT) AS t{k}" for k, (a, n) in _SLICE.items())


@query(f"SELECT vec_id AS individual, {', '.join(f't{k} AS taxon_level_{k}, round(s{k}, 6) AS score_level_{k}' for k in _SLICE)} FROM (SELECT vec_id, {_TOP_SQL} FROM embeddings)")
def gather_levels(spark, sf_dir):
    """M2, A10, J12."""
    wide = scoring.gather_levels(_level_scores(spark, sf_dir), _level_labels(spark), list(_SLICE))
    return wide.select("individual", *[F.col(f"taxon_level_{k}") for k in _SLICE], *[F.round(f"score_level_{k}", 6).alias(f"score_level_{k}") for k in _SLICE])


@query(f"""
WITH w AS (SELECT vec_id, {_TOP_SQL} FROM embeddings), d AS (SELECT *, CASE WHEN t0 = 'PIPA2' THEN 0 WHEN t1 <> 'BROADLEAF' THEN 3 WHEN t2 = 'OAK' THEN 4 ELSE 2 END AS k FROM w)
SELECT vec_id AS individual, k AS ens_level, CASE k WHEN 0 THEN t0 WHEN 2 THEN t2 WHEN 3 THEN t3 ELSE t4 END AS ensembleTaxonID, round(CASE k WHEN 0 THEN s0 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END, 6) AS ens_score FROM d
""")
def route_levels(spark, sf_dir):
    """M3."""
    wide = scoring.gather_levels(_level_scores(spark, sf_dir), _level_labels(spark), list(_SLICE))
    return scoring.route_levels(wide).select("individual", "ens_level", "ensembleTaxonID", F.round("ens_score", 6).alias("ens_score"))


# ---- metrics -------------------------------------------------------------------------

_PRED_SQL = "SELECT vec_id, label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS raw, CASE WHEN vec_id % 3 <> 0 THEN label ELSE list_position(embedding[1:10], list_max(embedding[1:10])) - 1 END AS pred, vec_id % 5 AS site FROM embeddings"


def _preds(spark, sf_dir):
    e = _spectra(spark, sf_dir)
    raw = arrays.argmax(F.slice("e", 1, 10))
    return e.select("vec_id", "label", F.when(F.col("vec_id") % 3 != 0, F.col("label")).otherwise(raw).alias("pred"), (F.col("vec_id") % 5).alias("site"), F.slice("e", 1, 10).alias("s"))


@query(f"""
WITH p AS ({_PRED_SQL}), t AS (SELECT label AS c, count(*) n, sum((label = pred)::INT) h FROM p GROUP BY 1), q AS (SELECT pred AS c, count(*) n, sum((label = pred)::INT) h FROM p GROUP BY 1)
SELECT coalesce(t.c, q.c) AS taxon, coalesce(t.n, 0) AS n_truth, coalesce(q.n, 0) AS n_pred, round(t.h / t.n, 6) AS accuracy, round(q.h / q.n, 6) AS precision FROM t FULL JOIN q ON t.c = q.c
""")
def accuracy_tables(spark, sf_dir):
    """V4, V5, V12."""
    c = metrics.class_table(_preds(spark, sf_dir))
    return c.select("taxon", "n_truth", "n_pred", F.round("accuracy", 6).alias("accuracy"), F.round("precision", 6).alias("precision"))


@query(f"""
WITH p AS ({_PRED_SQL}), c AS (SELECT site, label AS c FROM p UNION SELECT site, pred FROM p),
r AS (SELECT c.site, c.c, avg((p.label = p.pred)::INT) AS a FROM c LEFT JOIN p ON p.site = c.site AND p.label = c.c GROUP BY ALL),
m AS (SELECT site, avg(coalesce(a, 0)) AS macro FROM r GROUP BY 1), i AS (SELECT site, avg((label = pred)::INT) AS micro FROM p GROUP BY 1)
SELECT site, round(micro, 6) AS micro, round(macro, 6) AS macro FROM i JOIN m USING (site)
""")
def site_scores(spark, sf_dir):
    """V1, V2, V6."""
    s = metrics.site_scores(_preds(spark, sf_dir), "site")
    return s.select("site", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query("""
WITH u AS (SELECT vec_id, label, unnest(range(0, 10)) AS k, unnest(embedding[1:10]) AS v FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) n FROM u)
SELECT round(avg(hit), 6) AS top_k FROM (SELECT vec_id, max((k = label AND n <= 4)::INT) AS hit FROM r GROUP BY 1)
""")
def topk_accuracy(spark, sf_dir):
    """V3."""
    return metrics.top_k_accuracy(_preds(spark, sf_dir), "s", k=4).select(F.round("top_k", 6).alias("top_k"))


@query(f"WITH p AS ({_PRED_SQL}) SELECT label AS truth, pred, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark, sf_dir):
    """V7."""
    return metrics.confusion(_preds(spark, sf_dir))


@query(f"WITH p AS ({_PRED_SQL}), c AS (SELECT label AS truth, pred, count(*) AS n FROM p GROUP BY ALL) SELECT truth, pred, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM c")
def confusion_norm(spark, sf_dir):
    """V8, E26."""
    return metrics.confusion_norm(_preds(spark, sf_dir)).select("truth", "pred", F.round("share", 6).alias("share"))


@query(f"""
WITH p AS ({_PRED_SQL}), w AS (SELECT label, pred FROM p WHERE label <> pred), n AS (SELECT n_regionkey % 10 AS taxon, n_nationkey % 7 AS site FROM nation UNION SELECT n_nationkey % 10, n_nationkey % 7 FROM nation)
SELECT round(coalesce(avg((EXISTS (SELECT 1 FROM n a JOIN n b ON a.site = b.site WHERE a.taxon = w.label AND b.taxon = w.pred))::INT), 0), 6) AS within FROM w
""")
def site_confusion(spark, sf_dir):
    """V9."""
    n = _t(spark, sf_dir, "nation")
    s = n.select((F.col("n_regionkey") % 10).alias("taxon"), (F.col("n_nationkey") % 7).alias("site")).union(n.select(F.col("n_nationkey") % 10, F.col("n_nationkey") % 7)).groupBy("taxon").agg(F.collect_set("site").alias("sites"))
    return metrics.site_confusion(_preds(spark, sf_dir), s).select(F.round("within", 6).alias("within"))


@query(f"""
WITH p AS ({_PRED_SQL}), w AS (SELECT label, pred FROM p WHERE label <> pred), n AS (SELECT n_nationkey AS taxon, 'Genus' || n_nationkey % 4 AS genus FROM nation)
SELECT round(coalesce(avg(coalesce((a.genus = b.genus)::INT, 0)), 0), 6) AS within FROM w LEFT JOIN n a ON a.taxon = w.label LEFT JOIN n b ON b.taxon = w.pred
""")
def genus_confusion(spark, sf_dir):
    """V10."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("taxon"), F.format_string("Genus%d species%d", F.col("n_nationkey") % 4, F.col("n_nationkey")).alias("name"))
    return metrics.genus_confusion(_preds(spark, sf_dir), n).select(F.round("within", 6).alias("within"))


@query("""
WITH d AS (SELECT (d.n_chars % 97)::DOUBLE AS score, l.toxic AS hit FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT score, sum(hit) h, count(*) n FROM d GROUP BY 1)
SELECT score AS threshold, round(sum(h) OVER w / sum(n) OVER w, 6) AS precision, round(sum(h) OVER w / (SELECT sum(hit) FROM d), 6) AS recall FROM g WINDOW w AS (ORDER BY score DESC)
""")
def pr_curve(spark, sf_dir):
    """V11, W12."""
    d = natural_docs(spark, sf_dir).select((F.col("n_chars") % 97).cast("double").alias("score"), (F.col("toxic") == 1).alias("hit"))
    return metrics.pr_curve(d, "score", "hit").select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


# ---- aggregates, windows, sets -------------------------------------------------------


@query("""
WITH a AS (SELECT * FROM events), b AS (SELECT * FROM a WHERE value > 3), c AS (SELECT * FROM b WHERE event_type <> 'error')
SELECT 0 AS step, 'raw' AS stage, count(*) AS rows, count(DISTINCT user_id) AS individuals, count(DISTINCT event_type) AS taxa FROM a UNION ALL SELECT 1, 'height', count(*), count(DISTINCT user_id), count(DISTINCT event_type) FROM b UNION ALL SELECT 2, 'taxa', count(*), count(DISTINCT user_id), count(DISTINCT event_type) FROM c
""")
def stage_audit(spark, sf_dir):
    """A4, A9."""
    a = _t(spark, sf_dir, "events")
    b = a.filter("value > 3")
    return aggregates.stage_audit({"raw": a, "height": b, "taxa": clean.exclude(b, "event_type", ["error"])}, "event_type", "user_id")


@query("SELECT label, count(*) AS n, round(greatest((1.0/count(*)) / max(1.0/count(*)) OVER (), 0.2), 6) AS weight FROM embeddings GROUP BY 1")
def class_weights(spark, sf_dir):
    """A13."""
    w = aggregates.class_weights(_t(spark, sf_dir, "embeddings"), "label", 0.2)
    return w.select("label", "n", F.round("weight", 6).alias("weight"))


@query("""
WITH n AS (SELECT l_suppkey, count(*) c, count(DISTINCT l_orderkey) o FROM lineitem GROUP BY 1)
SELECT l_suppkey, min(l_shipdate) AS first_date, round(greatest(0.05 * any_value(o), 20.0), 6)::DOUBLE AS floor FROM lineitem JOIN n USING (l_suppkey) WHERE c > 590 GROUP BY 1
""")
def species_filter(spark, sf_dir):
    """A5 to A7."""
    l_ = _t(spark, sf_dir, "lineitem")
    usable = aggregates.enough_rows(l_, "l_suppkey", 590)
    floors = aggregates.species_floor(usable, "l_suppkey", "l_orderkey", 20)
    return usable.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first_date")).join(floors, "l_suppkey").select("l_suppkey", "first_date", F.round("floor", 6).alias("floor"))


@query("""
WITH h AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) r, count(*) OVER (PARTITION BY event_type) n FROM events)
SELECT event_id, event_type FROM h WHERE r <= 50 AND n >= 50
""")
def hash_sample(spark, sf_dir):
    """W5, W7, W13."""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type")
    return windows.sample_or_skip(e, ["event_type"], "event_id", 50, seed=7)


@query("""
WITH i AS (SELECT DISTINCT event_type, user_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) k FROM i)
SELECT e.event_id FROM events e JOIN r USING (event_type, user_id) WHERE k <= 10
""")
def first_individuals(spark, sf_dir):
    """W6."""
    return windows.n_individuals(_t(spark, sf_dir, "events"), ["event_type"], "user_id", 10).select("event_id")


_SPLIT_SQL = "e AS (SELECT event_id, user_id, event_type || (user_id % 60) AS taxon, CASE WHEN md5(user_id::VARCHAR) < '6' THEN 'train' WHEN md5(user_id::VARCHAR) < 'a' THEN 'test' ELSE 'none' END AS role FROM events), tr AS (SELECT * FROM e WHERE role = 'train'), te AS (SELECT * FROM e WHERE role = 'test')"


def _split(spark, sf_dir):
    """All rows, and those whose individuals a hash puts into train and into test."""
    h = F.md5(F.col("user_id").cast("string").cast("binary"))
    role = F.when(h < "6", "train").when(h < "a", "test").otherwise("none")
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.concat("event_type", (F.col("user_id") % 60).cast("string")).alias("taxon"), role.alias("role"))
    return e, e.filter("role = 'train'"), e.filter("role = 'test'")


@query(f"WITH {_SPLIT_SQL}, u AS (SELECT * FROM tr UNION ALL SELECT * FROM te) SELECT event_id, user_id, taxon FROM e WHERE user_id NOT IN (SELECT user_id FROM u) AND taxon NOT IN (SELECT taxon FROM u)")
def novel_taxa(spark, sf_dir):
    """U3, P4, J8, J9."""
    e, train, test = _split(spark, sf_dir)
    return aggregates.never_sampled(e, train, test, "user_id", "taxon").select("event_id", "user_id", "taxon")


@query(f"WITH {_SPLIT_SQL}, r AS (SELECT DISTINCT taxon FROM tr WHERE taxon IN (SELECT taxon FROM te)) SELECT taxon FROM r")
def shared_taxa(spark, sf_dir):
    """U2, U4."""
    _, train, test = _split(spark, sf_dir)
    return aggregates.distinct_pairs(aggregates.shared_taxa(train, test, "taxon")[0], "taxon")


@query(f"WITH {_SPLIT_SQL}, l AS (SELECT taxon FROM tr UNION SELECT taxon FROM te) SELECT taxon, (row_number() OVER (ORDER BY taxon) - 1)::INT AS label FROM l")
def label_encode(spark, sf_dir):
    """P3, U5."""
    _, train, test = _split(spark, sf_dir)
    return split.encode_labels(train, test, column="taxon")


@query()
def fingerprint(spark, sf_dir):
    """A12."""
    return aggregates.fingerprint(_t(spark, sf_dir, "orders"))


# ---- split, hierarchy, draws, training -----------------------------------------------


def _labelled(spark, sf_dir):
    taxa = ["PIPA2", "PICL", "PIEL", "PITA", "QULA2", "QUGE2", "ACRU", "NYSY"]
    u = F.col("user_id")
    return _t(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("seq"), F.concat(F.lit("I"), u.cast("string")).alias("individual"), F.get(F.lit(taxa), (u * 7 % 8).cast("int")).alias("taxonID"), F.concat(F.lit("P"), (u % 40).cast("string")).alias("plotID"), F.concat(F.lit("S"), (u % 2).cast("string")).alias("siteID"))


_BEST_SQL = """
WITH RECURSIVE l AS (SELECT event_id, 'I' || user_id AS individual, ['PIPA2','PICL','PIEL','PITA','QULA2','QUGE2','ACRU','NYSY'][(user_id*7%8)+1] AS taxon, 'P' || user_id % 40 AS plot, user_id % 2 = 0 AS home FROM events),
d AS (SELECT * FROM l WHERE taxon IN (SELECT taxon FROM l GROUP BY 1 HAVING count(*) > 3)),
tx AS (SELECT taxon, row_number() OVER (ORDER BY taxon) AS k, greatest(0.05 * count(DISTINCT individual), 1.0)::DOUBLE AS least FROM d GROUP BY 1),
pl AS (SELECT plot, list({'k': k, 'n': n, 'least': least}) AS has FROM (SELECT plot, taxon, count(DISTINCT individual) AS n FROM d WHERE home GROUP BY ALL) JOIN tx USING (taxon) GROUP BY 1),
o AS (SELECT i AS iteration, plot, has, row_number() OVER (PARTITION BY i ORDER BY md5('3:' || i || ':' || plot), plot) AS place FROM pl, range(0, 20) t(i)),
walk AS (
  SELECT i AS iteration, 0::BIGINT AS place, '' AS plot, false AS test, [0 for t in range(0, 8)]::BIGINT[] AS have FROM range(0, 20) t(i)
  UNION ALL
  SELECT w.iteration, o.place, o.plot, len([x for x in o.has if w.have[x.k] <= x.least]) > 0,
         CASE WHEN len([x for x in o.has if w.have[x.k] <= x.least]) > 0 THEN list_transform(w.have, lambda v, i: v + coalesce(list_sum([x.n for x in o.has if x.k = i]), 0)::BIGINT) ELSE w.have END
  FROM walk w JOIN o ON o.iteration = w.iteration AND o.place = w.place + 1
),
chosen AS (SELECT iteration, plot FROM walk WHERE test),
s AS (SELECT i AS iteration, d.*, EXISTS (SELECT 1 FROM chosen c WHERE c.iteration = i AND c.plot = d.plot) AS test FROM d, range(0, 20) t(i)),
ok AS (SELECT iteration, taxon, count(*) FILTER (NOT test) AS train_rows FROM s GROUP BY ALL HAVING count(DISTINCT individual) FILTER (test) >= 1 AND count(DISTINCT individual) FILTER (NOT test) >= 2),
best AS (SELECT iteration FROM ok GROUP BY 1 ORDER BY count(*) DESC, sum(train_rows) DESC, iteration LIMIT 1)
SELECT event_id, CASE WHEN test THEN 'test' ELSE 'train' END AS side FROM s WHERE iteration = (SELECT iteration FROM best) AND taxon IN (SELECT taxon FROM ok WHERE iteration = (SELECT iteration FROM best))
"""


@query(_BEST_SQL)
def split_best(spark, sf_dir):
    """The best of twenty seeded searches; the SQL walks the plots one by one in the same order."""
    train, test, _ = split.best_split(_labelled(spark, sf_dir), "S0", iterations=20, min_train=2, min_test=1, seed=3)
    return train.select("event_id", F.lit("train").alias("side")).union(test.select("event_id", F.lit("test")))


_TAXA_SQL = "['PIPA2','PICL','PIEL','PITA','QULA2','QUGE2','ACRU','NYSY'][(user_id*7%8)+1]"


@query(f"""
WITH d AS (SELECT event_id AS seq, 'I' || user_id AS individual, {_TAXA_SQL} AS taxonID FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY seq) r FROM d WHERE taxonID <> 'PIPA2'), o AS (SELECT individual, row_number() OVER (PARTITION BY taxonID ORDER BY individual, seq) k FROM f WHERE r = 1),
l0 AS (SELECT seq, 0 AS level, 'PIPA2' AS t FROM d WHERE taxonID = 'PIPA2' UNION ALL SELECT seq, 0, 'OTHER' FROM d WHERE taxonID <> 'PIPA2' AND individual IN (SELECT individual FROM o WHERE k <= 8)),
c AS (SELECT count(*) n FROM d WHERE taxonID IN ('PICL','PIEL','PITA')), b AS (SELECT individual, row_number() OVER (PARTITION BY taxonID ORDER BY individual) k FROM (SELECT DISTINCT taxonID, individual FROM d WHERE taxonID NOT IN ('PIPA2','PICL','PIEL','PITA'))),
l1 AS (SELECT seq, 1 AS level, CASE WHEN taxonID IN ('PICL','PIEL','PITA') THEN 'CONIFER' ELSE 'BROADLEAF' END AS t FROM d, c WHERE taxonID <> 'PIPA2' AND (taxonID IN ('PICL','PIEL','PITA') OR individual IN (SELECT individual FROM b WHERE k <= ceil(n / 400)))),
s AS (SELECT count(*) n FROM d WHERE taxonID IN ('ACRU','NYSY')), q AS (SELECT individual, row_number() OVER (PARTITION BY taxonID ORDER BY md5('0:' || individual || '|' || seq), individual || '|' || seq) k FROM d WHERE taxonID LIKE '%QU%'),
l2 AS (SELECT seq, 2 AS level, CASE WHEN taxonID LIKE '%QU%' THEN 'OAK' ELSE taxonID END AS t FROM d, s WHERE taxonID NOT IN ('PIPA2','PICL','PIEL','PITA') AND (taxonID NOT LIKE '%QU%' OR individual IN (SELECT individual FROM q WHERE k <= n // 500))),
l3 AS (SELECT seq, 3 AS level, taxonID AS t FROM (SELECT *, row_number() OVER (PARTITION BY taxonID ORDER BY seq) k FROM d WHERE taxonID IN ('PICL','PIEL','PITA')) WHERE k <= 70),
l4 AS (SELECT seq, 4 AS level, taxonID AS t FROM d WHERE individual IN (SELECT individual FROM (SELECT individual, row_number() OVER (PARTITION BY taxonID ORDER BY individual) k FROM (SELECT DISTINCT taxonID, individual FROM d WHERE taxonID LIKE '%QU%')) WHERE k <= 5))
SELECT level, t AS level_taxon, seq FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4)
""")
def level_datasets(spark, sf_dir):
    """H0 to H4."""
    caps = hierarchy.Caps(other=8, evergreen=70, oaks=5, conifer_share=400, oak_share=500)
    return hierarchy.all_levels(_labelled(spark, sf_dir), hierarchy.levels(caps)).select("level", "level_taxon", "seq")


@query("""
WITH d AS (SELECT DISTINCT c_mktsegment AS t, min(c_custkey) AS f FROM customer GROUP BY 1)
SELECT t AS level_taxon, (row_number() OVER (ORDER BY t = 'MACHINERY', f) - 1)::INT AS label FROM d
""")
def label_order(spark, sf_dir):
    """H2: labels by first appearance, one at the end."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("level_taxon"), F.col("c_custkey").alias("seq"))
    return hierarchy.label_order(c, last="MACHINERY")


_DRAW_LABELS = ["click", "view", "error"]
_DRAW_ROWS = {"click": [0.7, 0.2, 0.1], "view": [0.1, 0.6, 0.3], "error": [0.25, 0.25, 0.5]}


def _draws(spark, sf_dir, iterations):
    p = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "signup", "DEAD").otherwise(F.col("event_type")).alias("taxon"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 100 / 100.0).alias("score"), (2018 + F.col("event_id") % 4).alias("tile_year"))
    confusion_rows = spark.createDataFrame(list(_DRAW_ROWS.items()), "taxon string, p array<double>")
    return abundance.permute(p, confusion_rows, iterations=iterations, labels=_DRAW_LABELS, key="event_id", taxon="taxon", score="score", year=2021, seed=5)


_DRAW_SQL = """
u AS (SELECT i AS iteration, event_id, CASE event_type WHEN 'signup' THEN 'DEAD' ELSE event_type END AS taxon, CASE WHEN event_id % 13 <> 0 THEN event_id % 100 / 100.0::DOUBLE END AS score,
  ('0x' || substr(md5('5:keep:' || i || ':' || event_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS k, ('0x' || substr(md5('5:draw:' || i || ':' || event_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS d
  FROM events, range(0, {n}) t(i) WHERE 2018 + event_id % 4 = 2021),
s AS (SELECT iteration, CASE WHEN taxon = 'DEAD' OR score IS NULL OR k < score OR taxon NOT IN ('click','view','error') THEN taxon
  WHEN taxon = 'click' THEN CASE WHEN d < 0.7 THEN 'click' WHEN d < 0.7 + 0.2 THEN 'view' ELSE 'error' END
  WHEN taxon = 'view' THEN CASE WHEN d < 0.1 THEN 'click' WHEN d < 0.1 + 0.6 THEN 'view' ELSE 'error' END
  ELSE CASE WHEN d < 0.25 THEN 'click' WHEN d < 0.5 THEN 'view' ELSE 'error' END END AS sampled FROM u),
c AS (SELECT iteration, sampled, count(*) AS n FROM s GROUP BY ALL)"""


@query(f"WITH {_DRAW_SQL.format(n=10)} SELECT iteration, sampled, n FROM c")
def perm_draws(spark, sf_dir):
    """X3 to X5, F22."""
    return aggregates.counts(_draws(spark, sf_dir, 10), "iteration", "sampled", name="n").select(F.col("iteration").cast("bigint").alias("iteration"), "sampled", "n")


@query(f"WITH {_DRAW_SQL.format(n=20)} SELECT sampled, round(sum(n) / 20.0, 6) AS mean FROM c GROUP BY 1")
def perm_summary(spark, sf_dir):
    """X6."""
    counted = aggregates.counts(_draws(spark, sf_dir, 20), "iteration", "sampled", name="n")
    return abundance.permutation_summary(counted, 20).select("sampled", F.round("mean", 6).alias("mean"))


@query("""
WITH e AS (SELECT label, 'S' || vec_id % 3 AS site, (embedding::DOUBLE[])[1:6] AS f FROM embeddings), w AS (SELECT label, (1.0 / count(*)) / max(1.0 / count(*)) OVER () AS weight FROM e GROUP BY 1),
t AS (SELECT sum(weight) AS total FROM e JOIN w USING (label)),
x AS (SELECT label, weight, '1' AS input, 1.0::DOUBLE AS v FROM e JOIN w USING (label) UNION ALL SELECT label, weight, site, 1.0 FROM e JOIN w USING (label)
  UNION ALL SELECT label, weight, 'f' || unnest(range(0, 6)), unnest(f) FROM e JOIN w USING (label)),
i AS (SELECT DISTINCT input FROM x), c AS (SELECT DISTINCT label FROM x)
SELECT c.label::BIGINT AS class, i.input, round(coalesce(sum(x.weight * x.v), 0) / any_value(total) + 1e-7, 3) + 0.0 AS moment, 0.0::DOUBLE AS gradient
FROM c CROSS JOIN i CROSS JOIN t LEFT JOIN x ON x.label = c.label AND x.input = i.input GROUP BY ALL
""")
def train_moments(spark, sf_dir):
    """At the fitted coefficients the weighted log-loss has no gradient: probabilities and labels have the same moments."""
    e = _spectra(spark, sf_dir).select("label", F.slice("e", 1, 6).alias("features"), F.format_string("S%d", F.col("vec_id") % 3).alias("site"))
    model = scoring.train_level(e, site="site", max_iter=50, tol=1e-7)
    m = scoring.fitted_moments(e, model, site="site")
    whole = lambda c: F.round(c + 1e-7, 3) + 0.0  # noqa: E731  (no ties, no negative zero)
    return m.select(F.col("class").cast("long").alias("class"), "input", whole(F.col("observed")).alias("moment"), whole(F.col("fitted") - F.col("observed")).alias("gradient"))


@query()
def train_levels(spark, sf_dir):
    """A weighted classifier with a site input, scored on its table (rows only)."""
    e = _spectra(spark, sf_dir).select("vec_id", "label", F.col("e").alias("features"), F.format_string("S%d", F.col("vec_id") % 5).alias("site"))
    score = scoring.scorer_of(scoring.train_level(e, site="site", max_iter=15))
    return score(e).select("vec_id", "label", arrays.argmax("yhat").alias("pred"))

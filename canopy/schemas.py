"""Fixed schemas of the tables (types are declared, never inferred)."""

from pyspark.sql.types import StructType

_box = "xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE"

STEMS = StructType.fromDDL("individualID STRING, eventID STRING, plotID STRING, siteID STRING, taxonID STRING, growthForm STRING, plantStatus STRING, canopyPosition STRING, height DOUBLE, stemDiameter DOUBLE, itcEasting DOUBLE, itcNorthing DOUBLE, utmZone STRING")
CROWNS = StructType.fromDDL(f"individual STRING, plotID STRING, siteID STRING, taxonID STRING, height DOUBLE, CHM_height DOUBLE, box_id STRING, score DOUBLE, label STRING, RGB_tile STRING, {_box}")
ANNOTATIONS = StructType.fromDDL(f"individual STRING, geo_index STRING, tile_year INT, CHM_height DOUBLE, plotID STRING, height DOUBLE, {_box}, taxonID STRING, RGB_tile STRING, filename STRING, siteID STRING, image_path STRING, score DOUBLE, box_id STRING")
CELLS = StructType.fromDDL("geo_index STRING, tile_year INT, row INT, col INT, x DOUBLE, y DOUBLE, bands ARRAY<SMALLINT>")
CATALOG = StructType.fromDDL("product STRING, site STRING, tile_year INT, geo_index STRING, path STRING")
SCORES = StructType.fromDDL("individual STRING, level INT, yhat ARRAY<DOUBLE>")
CONFUSION = StructType.fromDDL("taxon STRING, p ARRAY<DOUBLE>")
BOUNDARY = StructType.fromDDL("name STRING, srid INT, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")

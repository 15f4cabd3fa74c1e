"""Tile keys, file names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 1_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _corner(low, high) -> Column:
    return (F.floor(((_c(low) + _c(high)) / 2).cast("bigint") / TILE) * TILE).cast("bigint")


def geo_index(xmin, ymin, xmax, ymax) -> Column:
    """easting_northing of the 1 km cell that holds the centre (truncated to whole metres)."""
    return F.concat_ws("_", _corner(xmin, xmax), _corner(ymin, ymax))


def geo_index_from_name(path) -> Column:
    """The digits_digits before ``_image``; null if there is none."""
    return F.nullif(F.regexp_extract(_c(path), r"(\d+_\d+)_image", 1), F.lit(""))


def base_name(path) -> Column:
    """File name without directories and last extension."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.[^.]*$", "")


def year_from_name(path) -> Column:
    """The last ``_`` token of the base name as a number; null if it isn't one."""
    return F.element_at(F.split(base_name(path), "_"), -1).try_cast("int")


def year_from_path(path) -> Column:
    """A path segment that is a year (19xx or 20xx); null if there is none."""
    return F.nullif(F.regexp_extract(_c(path), r"/((?:19|20)\d\d)(?=/|$)", 1), F.lit("")).cast("int")


def path_segment(path, index: int) -> Column:
    """The segment at a fixed place, counted from 0; null beyond the end."""
    return F.get(F.split(_c(path), "/"), F.lit(index))


def site_from_name(path) -> Column:
    """E5: site code in names like AAAA_D01_SITE_DP1_..."""
    return F.nullif(F.regexp_extract(base_name(path), r"_D\d+_(\w+?)_D", 1), F.lit(""))


def domain_from_name(path) -> Column:
    """E5: domain code in names like AAAA_D01_SITE_DP1_..."""
    return F.nullif(F.regexp_extract(base_name(path), r"_(D\d+)_\w+?_D", 1), F.lit(""))


def contributed_id(site, number) -> Column:
    """Id of a contributed stem."""
    return F.format_string("%s.contrib.%d", _c(site), _c(number))


def contributed_plot(name, number) -> Column:
    """Id of a plot made by grouping contributed stems."""
    return F.format_string("%s_contrib_%d", _c(name), _c(number))


def fixed_box_id(number) -> Column:
    """Id of a fallback box."""
    return F.format_string("fixed_box_%d", _c(number))


def tile_item_id(number, tile) -> Column:
    """Id of a crown found in a tile."""
    return F.format_string("%d_%s", _c(number), _c(tile))


def crop_name(individual, year) -> Column:
    """Name of a crop."""
    return F.format_string("%s_%d", _c(individual), _c(year))


def is_multi_bole(individual) -> Column:
    """Ids that end in a capital letter."""
    return _c(individual).rlike("[A-Z]$")


def prefix_token(name, separator: str = "_") -> Column:
    """The part before the first separator."""
    return F.substring_index(_c(name), separator, 1)


def crop_metadata(site, xmin, ymin, xmax, ymax, srid) -> Column:
    """JSON record of a crop's site, bounds and coordinate system."""
    bounds = F.struct(*[_c(v).alias(n) for n, v in (("xmin", xmin), ("ymin", ymin), ("xmax", xmax), ("ymax", ymax))])
    return F.to_json(F.struct(_c(site).alias("site"), bounds.alias("bounds"), _c(srid).alias("epsg")))


def is_missing(value) -> Column:
    """Null or not a number."""
    return _c(value).isNull() | F.isnan(_c(value))


def nan_to_null(value) -> Column:
    """NaN is the null of the sources; comparisons must drop it."""
    return F.when(~F.isnan(_c(value)), _c(value))

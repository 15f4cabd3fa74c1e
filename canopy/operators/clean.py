"""Field-record cleaning: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.functions.arrays import all_finite

#: Growth forms that aren't trees, canopy positions, taxon codes and hand-made lists.
NOT_TREES = ("liana", "small shrub")
SHADED = ("Full shade", "Mostly shaded")
SUNLIT = ("Open grown", "Full sun")
SUBSPECIES = {
    "PSMEM": "PSME", "BEPAP": "BEPA", "ACNEN": "ACNE2", "ACRUR": "ACRU", "PICOL": "PICO",
    "ABLAL": "ABLA", "ACSA3": "ACSAS", "CECAC": "CECA4", "PRSES": "PRSE2", "PIPOS": "PIPO",
    "BEPAC2": "BEPA", "JUVIV": "JUVI", "PRPEP": "PRPE2", "COCOC": "COCO6", "NYBI": "NYSY",
}
GENUS_ONLY = ("BETUL", "FRAXI", "HALES", "PICEA", "PINUS", "QUERC", "ULMUS", "2PLANT")
BLOCKED_INDIVIDUALS = ("NEON.PLA.D03.OSBS.03422", "NEON.PLA.D03.OSBS.03382", "NEON.PLA.D17.TEAK.01883")
BLOCKED_PLOTS = ("SOAP_054", "OSBS_026", "OSBS_029", "OSBS_039", "OSBS_027", "OSBS_036")
BLOCKED_SITES = ("PUUM", "ORNL")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """rows that have all of these."""
    return df.dropna(subset=list(columns))


def exclude(df: DataFrame, column: str, values, keep_null: bool = False) -> DataFrame:
    """Rows whose value isn't listed."""
    hit = F.col(column).isin(list(values))
    return df.filter(~F.coalesce(hit, F.lit(not keep_null)))


def containing(df: DataFrame, column: str, text: str) -> DataFrame:
    """rows whose value contains a text; null drops."""
    return df.filter(F.col(column).contains(text))


def not_containing(df: DataFrame, column: str, text: str, keep_null: bool = False) -> DataFrame:
    """rows whose value doesn't contain a text."""
    return df.filter(~F.coalesce(F.col(column).contains(text), F.lit(not keep_null)))


def drop_shaded(df: DataFrame, individual: str = "individual", position: str = "canopyPosition", shaded=SHADED, sunlit=SUNLIT) -> DataFrame:
    """individuals with a shaded record stay only if some record is sunlit. Null ids stay."""
    any_of = lambda values: F.coalesce(F.bool_or(F.col(position).isin(list(values))), F.lit(False))
    seen = df.groupBy(individual).agg(any_of(shaded).alias("__shaded"), any_of(sunlit).alias("__sunlit"))
    return df.join(seen.filter("__shaded and not __sunlit").select(individual), individual, "left_anti")


def min_height(df: DataFrame, height: str = "height", least: float = 3.0) -> DataFrame:
    """taller than ``least``, or unknown."""
    return df.filter((F.col(height) > least) | F.col(height).isNull())


def min_diameter(df: DataFrame, diameter: str = "stemDiameter", least: float = 10.0) -> DataFrame:
    """strictly thicker; null drops."""
    return df.filter(F.col(diameter) > least)


def recode(column: str | Column, mapping: dict[str, str] = SUBSPECIES) -> Column:
    """one pass of a code map; other values stay."""
    c = F.col(column) if isinstance(column, str) else column
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def drop_multi_bole(df: DataFrame, individual: str = "individual") -> DataFrame:
    """ids that end in a capital letter go; null goes."""
    return df.filter(~F.col(individual).rlike("[A-Z]$"))


def collapse_code(site: str, taxon: str, at_site: str, source: str, target: str) -> Column:
    """one code for another at one site."""
    return F.when((F.col(site) == at_site) & (F.col(taxon) == source), F.lit(target)).otherwise(F.col(taxon))


def route_by_name(df: DataFrame, column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """rows whose file name contains a text, and the others (null included)."""
    hit = F.coalesce(F.col(column).contains(text), F.lit(False))
    return df.filter(hit), df.filter(~hit)


def home_and_capped(df: DataFrame, site: str, taxon: str, home, cap: int, order: list[str]) -> DataFrame:
    """all rows of the home site; of other sites only its taxa, the first ``cap`` rows each."""
    at_home = df.filter(F.col(site) == home)
    taxa = at_home.select(taxon).distinct()
    away = df.filter(F.col(site) != home).join(taxa, taxon, "left_semi")
    first = F.row_number().over(Window.partitionBy(taxon).orderBy(*order))
    return at_home.unionByName(away.withColumn("__n", first).filter(F.col("__n") <= cap).drop("__n"))


def height_reason(canopy: str | Column, field: str | Column, least: float = 1.0, above: float = 4.0, below: float = 8.0) -> Column:
    """F16: why a record is kept or dropped, by the first rule that applies."""
    c, f = (F.col(x) if isinstance(x, str) else x for x in (canopy, field))
    return (
        F.when(c.isNull(), "no canopy height")
        .when(f.isNull(), "keep: no field height")
        .when(c < least, "canopy too low")
        .when((c > f) & (c - f < above), "keep: canopy above field")
        .when(c > f, "field too low")
        .when(f - c < below, "keep: canopy below field")
        .otherwise("canopy far below field")
    )


def height_rules(df: DataFrame, canopy: str = "CHM_height", field: str = "height", *, least: float | None = 1.0, above: float = 4.0, below: float = 8.0) -> DataFrame:
    """All rows plus reason and keep; ``least`` None keeps everything. The limits are honoured."""
    if least is None:
        return df.withColumn("reason", F.lit("not filtered")).withColumn("keep", F.lit(True))
    reason = df.withColumn("reason", height_reason(canopy, field, least, above, below))
    return reason.withColumn("keep", F.col("reason").startswith("keep"))


def fill_height(df: DataFrame, field: str = "height", canopy: str = "CHM_height") -> DataFrame:
    """canopy height where no height was measured."""
    return df.withColumn(field, F.coalesce(field, canopy))


def tall_crowns(df: DataFrame, canopy: str = "CHM_height", least: float = 3.0) -> DataFrame:
    """crowns higher than ``least``; an error if none is left."""
    tall = df.filter(F.col(canopy) > least)
    if tall.isEmpty():
        raise ValueError(f"no crown is higher than {least}")
    return tall


def mask_dead(df: DataFrame, threshold: float = 0.95, *, dead_label: str = "dead_label", dead_score: str = "dead_score", taxon: str = "ensembleTaxonID", label: str = "ens_label", score: str = "ens_score") -> DataFrame:
    """dead crowns above the threshold get taxon DEAD and lose label and score."""
    dead = F.coalesce((F.col(dead_label) == 1) & (F.col(dead_score) > threshold), F.lit(False))
    return df.withColumns({taxon: F.when(dead, F.lit("DEAD")).otherwise(F.col(taxon)), label: F.when(~dead, F.col(label)), score: F.when(~dead, F.col(score))})


def choose_tiles(catalog: DataFrame, *, site: str, year: int, without: str | None = None, x: tuple[float, float] | None = None, y: tuple[float, float] | None = None) -> DataFrame:
    """tiles of a site and year, without a text in the path, with the corner strictly inside a range."""
    got = catalog.filter(F.col("path").contains(site) & (F.col("tile_year") == year))
    if without:
        got = got.filter(~F.col("path").contains(without))
    for k, span in enumerate((x, y)):
        if span:
            corner = F.get(F.split("geo_index", "_"), F.lit(k)).cast("bigint")
            got = got.filter((corner > span[0]) & (corner < span[1]))
    return got


def one_year(df: DataFrame, year: int, column: str = "tile_year") -> DataFrame:
    """rows of one year, compared as numbers."""
    return df.filter(F.col(column) == year)


def keep_columns(df: DataFrame, wanted) -> DataFrame:
    """those of the wanted columns that exist, in that order."""
    return df.select(*[c for c in wanted if c in df.columns])


def finite_only(df: DataFrame, bands: str = "bands") -> DataFrame:
    """arrays without NaN or infinity; null drops."""
    return df.filter(all_finite(bands))


def without_fixed(df: DataFrame, box_id: str = "box_id") -> DataFrame:
    """no fallback boxes; null stays."""
    return not_containing(df, box_id, "fixed", keep_null=True)


def covered(df: DataFrame, catalog: DataFrame, key: str = "geo_index") -> tuple[DataFrame, DataFrame]:
    """rows whose tile exists, and the rejected keys with a reason."""
    known = catalog.select(key).distinct()
    rejects = df.join(known, key, "left_anti").select(key).distinct().withColumn("reason", F.lit("no raster"))
    return df.join(known, key, "left_semi"), rejects

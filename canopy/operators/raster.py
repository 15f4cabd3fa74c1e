"""Raster cells as rows: zonal statistics, crops, windows, preprocessing.

A cell is a row (tile, year, row, col, x, y, bands). Bands stay one array; cells meet crowns
by tile and grid bucket, never by a raw range join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from canopy.functions.arrays import drop_water, fill_missing, flip, min_max, pick_bands, resize, trim
from canopy.functions.draws import hash_order
from canopy.functions.geometry import Box, raster_extent, world_to_pixel
from canopy.operators.aggregates import exact_quantiles, year_coverage
from canopy.operators.spatial import _extent, copies_in_boxes, places_in_extents
from canopy.sources.io import staged


def crop_cells(cells: DataFrame, crowns: DataFrame, *, on: list[str], x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None) -> DataFrame:
    """The cells (centres) in each crown's box, for every year of the crown's tile."""
    return copies_in_boxes(cells, crowns, x=x, y=y, box=box, size=size, on=on)


def empty_crops(crowns: DataFrame, cropped: DataFrame, key: str) -> DataFrame:
    """Crowns without a cell, with a reason."""
    return crowns.join(cropped.select(key).distinct(), key, "left_anti").select(key).withColumn("reason", F.lit("no cells"))


def crowns_with_cells(cells: DataFrame, crowns: DataFrame, *, on: list[str], x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None) -> DataFrame:
    """The crowns that have a cell in their box, each row once; no crop is made."""
    held = places_in_extents(cells, crowns, x=x, y=y, box=box, size=size, on=on).select(*on, *_extent(box)).distinct()
    return crowns.join(held, [*on, *_extent(box)], "left_semi")


def crown_sums(cells: DataFrame, crowns: DataFrame, *, on: list[str], bands: str = "bands", x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None) -> DataFrame:
    """For each distinct extent of crowns and each band b the sum and the number of its cells' values, without the crops.

    Bands of a place add up before places meet extents.
    """
    tall = cells.select(*on, x, y, F.posexplode(bands).alias("b", "v"))
    spots = tall.groupBy(*on, x, y, "b").agg(F.sum("v").alias("sum"), F.count("v").alias("n"))
    met = places_in_extents(cells, crowns, x=x, y=y, box=box, size=size, on=on).join(spots, [*on, x, y])
    return met.groupBy(*on, *_extent(box), "b").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))


def zonal_p99(cells: DataFrame, shapes: DataFrame, key: str, *, value: str = "value", on: list[str] | None = None, name: str = "CHM_height", **places) -> DataFrame:
    """Each shape's 99th percentile of cells of at least 0.5 (NaN is none); null where there is none.

    Cells of one place and height count as one with a weight, shapes of one extent as one zone (those whose key comes
    again as one zone of that key). Zone, height and weight are written once; zones of any number of cells are
    worked out in bounded memory.
    """
    on, v = on or [], F.col(value).cast("double")
    x, y, box = places.get("x", "x"), places.get("y", "y"), places.get("box", Box())
    again = shapes.groupBy(key).count().filter("count > 1").select(F.col(key).alias("__again"))
    zone = F.when(F.col("__again").isNotNull(), F.concat(F.lit("key "), F.col("__again").cast("string"))).otherwise(F.to_json(F.struct(*on, *_extent(box))))
    zoned = shapes.join(again, F.col(key) == F.col("__again"), "left").withColumn("__zone", zone).drop("__again")
    spots = cells.filter((v >= 0.5) & ~F.isnan(v)).groupBy(*on, x, y, v.alias("__value")).agg(F.count("*").alias("__weight"))
    met = places_in_extents(spots, zoned, on=on, **places).join(spots, [*on, x, y])
    zones = zoned.filter(F.col(key).isNotNull()).groupBy("__zone", *on, *_extent(box)).agg(F.when(F.col("__zone").startswith("key "), F.count("*")).otherwise(1).alias("__times"))
    held = zones.join(met, [*on, *_extent(box)]).groupBy("__zone", "__value").agg(F.sum(F.col("__weight") * F.col("__times")).alias("__weight"))
    heights = exact_quantiles(staged(held, "zone-cells"), "__zone", "__value", name=name, weight="__weight")
    return zoned.join(heights, "__zone", "left").drop("__zone")


def point_values(cells: DataFrame, points: DataFrame, *, left: str = "left", top: str = "top", resolution: float = 1.0, on: list[str], value: str = "value", name: str = "CHM_height") -> DataFrame:
    """A point takes the value of its own cell (values under 0.5 count as none)."""
    col = F.floor((F.col("x") - F.col(left)) / resolution).cast("bigint")
    row = F.floor((F.col(top) - F.col("y")) / resolution).cast("bigint")
    keyed = points.withColumns({"__row": row, "__col": col})
    own = cells.select(*on, F.col("row").alias("__row"), F.col("col").alias("__col"), F.when(F.col(value) >= 0.5, F.col(value)).alias(name))
    return keyed.join(own, [*on, "__row", "__col"], "left").drop("__row", "__col")


#: Windows that start in one block of so many rows and columns are cut out together; bytes of windows that leave a task at once.
WINDOW_BLOCK, WINDOW_BYTES = 64, 16 << 20


def _windows(keys: list[str], width: int, height: int, side: int, layered: bool):
    """Cut the windows of one block out of a dense tensor (row, col and, if ``layered``, band) with its halo."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        r0, c0 = t["__br"][0].as_py() * side, t["__bc"][0].as_py() * side
        r, c = t["__r"].to_numpy() - r0, t["__c"].to_numpy() - c0
        values = t["__v"].combine_chunks()
        if layered:
            given = np.flatnonzero(values.is_valid())
            bands = pc.list_value_length(values.drop_null()).unique()
            if len(bands) > 1:
                raise ValueError(f"cells of one block have {bands.to_pylist()} bands")
            flat = values.drop_null().flatten()
            n = bands[0].as_py() if len(bands) else 0
            dense = np.zeros((side + height - 1, side + width - 1, n), flat.type.to_pandas_dtype())
            dense[r[given], c[given]] = flat.to_numpy(zero_copy_only=False).reshape(-1, n)
        else:
            n = 1
            dense = np.zeros((side + height - 1, side + width - 1), values.type.to_pandas_dtype())
            dense[r, c] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        own = np.flatnonzero((r < side) & (c < side))
        every = np.lib.stride_tricks.sliding_window_view(dense, (height, width), (0, 1))
        step = max(1, WINDOW_BYTES // max(1, width * height * n * dense.itemsize))
        lists = lambda v, size: pa.ListArray.from_arrays(pa.array(np.arange(len(v) // size + 1, dtype=np.int32) * size), v)
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            got = every[r[some], c[some]]
            if layered:
                cells = np.moveaxis(got, 1, -1).reshape(-1)
                got = lists(pa.array(cells), n) if n else pa.array([[]] * (len(some) * width * height), pa.list_(values.type.value_type))
            else:
                got = pa.array(got.reshape(-1))
            head = t.select(keys).take(pa.array(some))
            columns = [*(x.combine_chunks() for x in head.columns), pa.array(r[some] + r0), pa.array(c[some] + c0), lists(got, width * height)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "__r", "__c", "window"])

    return cut


def neighbourhood(cells: DataFrame, keys: list[str], *, width: int = 11, height: int = 11, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """For every cell the window that starts at it, row by row, as an array; cells outside are 0. One cell a place.

    ``value`` is a number or an array of bands (as many in all cells; a window is then an array of arrays, and a
    null cell is like one outside). Cells go to the block of windows that start around them, and those near
    a block's top or left also to the blocks before it (a halo), so a cell moves four times at most for any
    window of up to a block's size. A block is one small dense array, whatever the tile's size, and its windows leave
    it a few MB at a time.
    """
    side = max(WINDOW_BLOCK, width, height)
    kind = cells.schema[value].dataType
    spread = lambda c, n: F.sequence(F.floor((F.col(c) - (n - 1)) / side), F.floor(F.col(c) / side))
    sent = cells.select(*keys, F.col(row).cast("long").alias("__r"), F.col(col).cast("long").alias("__c"), F.col(value).alias("__v"))
    sent = sent.withColumn("__br", F.explode(spread("__r", height))).withColumn("__bc", F.explode(spread("__c", width)))
    schema = StructType([cells.schema[k] for k in keys]).add("__r", "long").add("__c", "long").add("window", ArrayType(kind))
    got = sent.groupBy(*keys, "__br", "__bc").applyInArrow(_windows(keys, width, height, side, isinstance(kind, ArrayType)), schema)
    return got.select(*keys, F.col("__r").cast(cells.schema[row].dataType).alias(row), F.col("__c").cast(cells.schema[col].dataType).alias(col), "window")


def cells_of_boxes(boxes: DataFrame, *, left: str, top: str, resolution: float, box: Box = Box()) -> DataFrame:
    """Row and column numbers that each box overlaps."""
    c0, r0 = world_to_pixel(F.col(box.xmin), F.col(box.ymax), F.col(left), F.col(top), resolution)
    c1, r1 = world_to_pixel(F.col(box.xmax), F.col(box.ymin), F.col(left), F.col(top), resolution)
    span = lambda a, b: F.sequence(a, F.greatest(a, b - 1))
    return boxes.withColumn("row", F.explode(span(r0, r1))).withColumn("col", F.explode(span(c0, c1)))


def subset_raster(cells: DataFrame, bands: str = "no_water", *, bounds: tuple[float, float, float, float] | None = None, column: str = "bands") -> DataFrame:
    """A band choice (no_water, false_color, all), clipped to bounds."""
    choices = {"no_water": drop_water, "false_color": pick_bands, "all": lambda b: F.col(b)}
    if bands not in choices:
        raise ValueError(f"bands is one of {sorted(choices)}")
    if bounds:
        cells = cells.filter(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]))
    return cells.withColumn(column, choices[bands](column))


def mine_crowns(crowns: DataFrame, cells: DataFrame, *, layer: str, key: str, n: int = 1_000, seed=0, on: list[str]) -> DataFrame:
    """Cells of n random crowns of each layer (layers with fewer are left out), finite bands only."""
    from canopy.operators.clean import finite_only
    from canopy.operators.windows import sample_or_skip

    return finite_only(crop_cells(cells, sample_or_skip(crowns, [layer], key, n, seed), on=on))


def crop_rows(cropped: DataFrame, keys: list[str]) -> DataFrame:
    """Each crop as rows of cells of bands."""
    line = cropped.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "bands"))).alias("__l"))
    whole = line.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", F.transform("__l", lambda c: c["bands"]).alias("cells")))).alias("__r"))
    return whole.select(*keys, F.transform("__r", lambda r: r["cells"]).alias("crop"))


def preprocess(crop: str | Column, size: int = 11, augment: bool = False) -> Column:
    """Trim the bands of each cell, scale them to 0..1, resize to size x size; flipped for training."""
    c = F.col(crop) if isinstance(crop, str) else crop
    scaled = F.transform(c, lambda r: F.transform(r, lambda b: min_max(trim(b))))
    out = resize(scaled, size)
    return flip(out) if augment else out


def yearly_records(df: DataFrame, years: DataFrame, *, individual: str = "individual", year: str = "tile_year", bands: str = "bands", size: int) -> DataFrame:
    """Individual -> map of year to spectrum, zeros for years without one. ``years`` is a short list."""
    wanted = [r[0] for r in years.select(year).distinct().orderBy(year).collect()]
    seen = df.groupBy(individual).agg(F.map_from_entries(F.collect_list(F.struct(year, bands))).alias("__m"))
    each = F.array(*[F.struct(F.lit(y).alias(year), fill_missing(F.try_element_at("__m", F.lit(y)), size).alias(bands)) for y in wanted])
    return seen.select(individual, F.map_from_entries(each).alias("years"))


def sample_windows(cells: DataFrame, catalog: DataFrame, *, size: float = 64.0, resolution: float = 1.0, seed=0, key: str = "geo_index") -> DataFrame:
    """For each place with three full years one random window that doesn't touch the edge: its bounds and years.

    The start is the cell with the least seeded hash, kept by an aggregate: cells are read twice and none is shuffled.
    """
    places = year_coverage(catalog, key=key)
    e = cells.join(places.select(key), key, "left_semi").groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    starts = cells.join(e, key).filter((F.col("x") > F.col("x0")) & (F.col("y") > F.col("y0")) & (F.col("x") + size < F.col("x1")) & (F.col("y") + size < F.col("y1")))
    one = starts.groupBy(key).agg(F.min(F.struct(hash_order(seed, key, "x", "y").alias("h"), "x", "y")).alias("w")).select(key, "w.x", "w.y")
    return one.join(places, key).select(key, F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + size).alias("xmax"), (F.col("y") + size).alias("ymax"), "years")


def mean_elevation(cells: DataFrame, key: str = "geo_index", value: str = "elevation") -> DataFrame:
    """Mean elevation of each tile."""
    return cells.groupBy(key).agg(F.avg(value).alias("elevation"))


def tile_bounds(tiles: DataFrame, **names) -> DataFrame:
    """E14 as columns of a tile table with left, top, rows, cols."""
    xmin, ymin, xmax, ymax = raster_extent("left", "top", "rows", "cols", names.get("resolution", 1.0))
    return tiles.withColumns({"xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax})

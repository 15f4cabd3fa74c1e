"""Spatial joins by grid buckets, grids, radius groups and tile lookups.

A range join has no equality to shuffle on. Both sides get the grid cells they touch, the
join runs on cells, and the exact predicate follows. A point lies in one cell of a grid and a
box is in one grid, so pairs never come twice.

Many points may lie at one place, and many boxes have one extent: whether such a point is in such a box is
asked once (``places_in_extents``). What is wanted of each point or box (the nearest, the first, the tallest, a sum)
is worked out of places and extents, and only then handed to their rows, so nothing grows with pairs of rows but
a result that holds them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.functions.geometry import Box, box_meets_ring, point_in_ring, ring_crosses, ring_envelope, square
from canopy.operators.windows import first_n
from canopy.sources.io import staged


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


#: Cells on a side that a box may touch; larger boxes go to a grid that is so many times coarser.
WIDE = 8


def _side(box: Box) -> Column:
    return F.greatest(F.col(box.xmax) - F.col(box.xmin), F.col(box.ymax) - F.col(box.ymin))


def _level(box: Box, size: float) -> Column:
    """0 for boxes of up to WIDE cells on a side, one more for each further factor of WIDE."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(WIDE), _side(box) / (WIDE * size) * (1 - 1e-12)))).cast("int")


def _box_cells(box: Box, size: Column) -> Column:
    xs = F.sequence(F.floor(F.col(box.xmin) / size), F.floor(F.col(box.xmax) / size))
    ys = F.sequence(F.floor(F.col(box.ymin) / size), F.floor(F.col(box.ymax) / size))
    return F.explode(F.flatten(F.transform(xs, lambda a: F.transform(ys, lambda b: F.struct(a.alias("cx"), b.alias("cy"))))))


def cell_size(boxes: DataFrame, box: Box = Box(), share: float = 0.95) -> tuple[float, int]:
    """A bucket about as large as most boxes (a quantile of their longer sides), and the levels of grids that the largest box needs."""
    found = boxes.agg(F.percentile_approx(_side(box), share, 1000).alias("s"), F.max(_side(box)).alias("m")).first()
    size = float(found["s"]) if found["s"] and found["s"] > 0 else 1.0
    top = float(found["m"] or 0) / (WIDE * size)
    return size, 1 if top <= 1 else 1 + math.ceil(math.log(top, WIDE) + 1e-9)


def points_in_boxes(points: DataFrame, boxes: DataFrame, *, x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None, on: list[str] | None = None) -> DataFrame:
    """Every (point, box) with the point in the box, edges included.

    ``on``: further equality columns of both sides (plot, tile). Boxes without extent match
    points on them; rows with null coordinates or an inverted box match nothing. Boxes much larger
    than most are looked up in coarser grids, so none touches more than about WIDE x WIDE cells;
    points get a row for each grid that some box is in (one, unless box sizes differ by more than WIDE).
    ``size`` says that no box is larger.
    """
    size, levels = (size, 1) if size else cell_size(boxes, box)
    on = on or []
    valid = boxes.filter((F.col(box.xmin) <= F.col(box.xmax)) & (F.col(box.ymin) <= F.col(box.ymax)))
    scale = lambda level: size * F.pow(F.lit(float(WIDE)), level)
    keys = ["__cx", "__cy"]
    if levels == 1:
        right, left = valid.withColumn("__cell", _box_cells(box, F.lit(size))), points
        own = F.lit(size)
    else:
        keys, own = ["__level", *keys], scale(F.col("__level"))
        right = valid.withColumn("__level", _level(box, size)).withColumn("__cell", _box_cells(box, own))
        present = sorted(r[0] for r in valid.select(_level(box, size)).distinct().collect())  # as many as there are grids
        left = points.withColumn("__level", F.explode(F.array(*map(F.lit, present)).cast("array<int>")))
    right = right.withColumns({"__cx": F.col("__cell.cx"), "__cy": F.col("__cell.cy")}).drop("__cell")
    left = left.withColumns({"__cx": F.floor(F.col(x) / own), "__cy": F.floor(F.col(y) / own)})
    met = left.join(right, [*on, *keys])
    return met.filter(F.col(x).between(F.col(box.xmin), F.col(box.xmax)) & F.col(y).between(F.col(box.ymin), F.col(box.ymax))).drop(*keys)


def _extent(box: Box) -> list[str]:
    return [box.xmin, box.ymin, box.xmax, box.ymax]


def places_in_extents(points: DataFrame, boxes: DataFrame, *, x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None, on: list[str] | None = None) -> DataFrame:
    """J1 without copies: every distinct place of points (``on``, x, y) that is in a distinct extent of boxes, once."""
    on = on or []
    return points_in_boxes(points.select(*on, x, y).distinct(), boxes.select(*on, *_extent(box)).distinct(), x=x, y=y, box=box, size=size, on=on)


def points_in_any(points: DataFrame, boxes: DataFrame, *, x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None, on: list[str] | None = None) -> DataFrame:
    """The points that are in some box, each row once."""
    on = on or []
    return points.join(places_in_extents(points, boxes, x=x, y=y, box=box, size=size, on=on).select(*on, x, y).distinct(), [*on, x, y], "left_semi")


#: Rows with equal keys that make up a block at most: log2 of their number.
BLOCK_BITS = 8

#: Tasks that pairs come apart in, for each shuffle partition. All pairs of a place are one task's, so many tasks even out.
PAIR_TASKS = 4


def _pair_tasks(df: DataFrame) -> int:
    return PAIR_TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _blocks(df: DataFrame, keys: list[str], name: str, spread: int = 1) -> DataFrame:
    """The other columns of rows with equal keys as arrays of structs, at most 2 ** BLOCK_BITS rows each; rows with a null key go.

    __salt (of the other columns) is under ``spread``; rows are partitioned by __at, a hash of keys and salt. They are sorted by it
    before they are cut, so that blocks are full wherever a key has the rows.
    """
    rest = [F.col(c) for c in df.columns if c not in keys] or [F.lit(True).alias("__row")]
    salt = F.pmod(F.xxhash64(*rest), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
    known = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in keys]))
    some = known.withColumn("__salt", salt).withColumn("__at", F.xxhash64(*keys, "__salt")).repartition(_pair_tasks(df), "__at").sortWithinPartitions("__at")
    some = some.withColumn("__some", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    return some.groupBy("__at", *keys, "__salt", "__some").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("__some")


def _unblocked(met: DataFrame, points: DataFrame, place: list[str], extent: list[str], spread: int) -> DataFrame:
    """Every row of each block __b with every point at its place.

    Blocks are small and their rows many, so both sides are sent to a fixed number of tasks, which isn't lowered by size: by __at, since
    a join on places that are floating-point numbers would send them anew; the places themselves are compared as ranges.
    Spark holds all rows that a step makes of one row, so a step is ended (``coalesce``, which moves nothing here) before each side comes
    apart: one point's block with one row of __b makes 2 ** BLOCK_BITS rows. Rows of __b come first, so that a written column either
    stays the same or comes again within a block.
    """
    n, at = _pair_tasks(points), [*place, "__salt"]
    met = met.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("__at", F.xxhash64(*at)).repartition(n, "__at")
    stands = _blocks(points, place, "__p", spread).withColumnsRenamed({c: f"__own_{c}" for c in at})
    pairs = met.join(stands, "__at").filter(reduce(Column.__and__, [F.col(c).between(F.col(f"__own_{c}"), F.col(f"__own_{c}")) for c in at]))
    keys = list(dict.fromkeys([*place, *extent]))
    pairs = pairs.select(*keys, "__p", "__b").coalesce(n).select(*keys, "__p", F.explode("__b").alias("__b"))
    rows = pairs.coalesce(n).select(*keys, F.explode("__p").alias("__p"), "__b")
    return rows.select(*keys, "__p.*", "__b.*").drop("__row")


def copies_in_boxes(points: DataFrame, boxes: DataFrame, *, x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None, on: list[str] | None = None, spread: int = 1) -> DataFrame:
    """The rows of ``points_in_boxes``, for points of which many are at one place and boxes of which many have one extent.

    Places meet extents; their rows are joined as blocks and come apart at the very end, so that neither what is
    compared nor what is sent or sorted grows with pairs of rows. Blocks hold all columns given: leave out those not wanted. Where few places
    may hold most points, ``spread`` lets so many tasks share a place (boxes are sent so many times).
    """
    on = on or []
    met = places_in_extents(points, boxes, x=x, y=y, box=box, size=size, on=on)
    met = met.join(_blocks(boxes, [*on, *_extent(box)], "__b").drop("__at", "__salt"), [*on, *_extent(box)])
    return _unblocked(met, points, [*on, x, y], _extent(box), spread)


def nearest_of_boxes(points: DataFrame, boxes: DataFrame, *, individual: str = "individual", box_id: str = "box_id", x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None, on: list[str] | None = None) -> DataFrame:
    """J3 from points and boxes: the rows of ``nearest_box(points_in_boxes(...))``, without the pairs.

    Of the boxes of one extent the first id can win only, and all points of a place have the same nearest box.
    """
    on = on or []
    place, extent = [*on, x, y], [*on, *_extent(box)]
    firsts = boxes.groupBy(*extent).agg(F.min(F.struct(box_id)).alias("__id"))
    met = places_in_extents(points, boxes, x=x, y=y, box=box, size=size, on=on).join(firsts, extent)
    away = F.pow((F.col(box.xmin) + F.col(box.xmax)) / 2 - F.col(x), 2) + F.pow((F.col(box.ymin) + F.col(box.ymax)) / 2 - F.col(y), 2)
    best = met.groupBy(*place).agg(F.min(F.struct(away.alias("away"), F.col("__id")[box_id].alias("id"), *_extent(box))).alias("__best"))
    best = best.select(*place, F.struct("__best.away", "__best.id").alias("__order"), F.col("__best.id").alias(box_id), *[F.col("__best")[c].alias(c) for c in _extent(box)])
    rows = points.join(best, place)
    if rest := [c for c in boxes.columns if c not in (*extent, box_id)]:
        own = boxes.groupBy(*extent, box_id).agg(F.first(F.struct(*rest)).alias("__rest"))
        same = [F.col("p." + c).eqNullSafe(F.col("b." + c)) for c in (*extent, box_id)]
        rows = rows.alias("p").join(own.alias("b"), reduce(Column.__and__, same)).select("p.*", "b.__rest.*")
    return first_n(rows, [individual], ["__order"]).drop("__order")


def first_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], order: list[str], *, x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None, on: list[str] | None = None) -> DataFrame:
    """J5 from points and boxes: the rows of ``dedupe_boxes(points_in_boxes(...), keys, order)``, without the pairs; ``keys`` are of the boxes, ``order`` of the points."""
    on = on or []
    firsts = first_n(points, [*on, x, y], order)
    met = points_in_boxes(firsts, boxes.select(*on, *_extent(box)).distinct(), x=x, y=y, box=box, size=size, on=on)
    each = first_n(met, [*on, *_extent(box)], order)
    return first_n(boxes.join(each, [*on, *_extent(box)]), keys, order)


def tallest_of_boxes(points: DataFrame, boxes: DataFrame, *, box_id: str = "box_id", height: str = "height", canopy: str = "CHM_height", drop_unmeasured: bool = True, x: str = "x", y: str = "y", box: Box = Box(), size: float | None = None, on: list[str] | None = None) -> DataFrame:
    """J4 from points and boxes: the rows of ``tallest_in_box(points_in_boxes(...))``, without the pairs (remaining ties stay).

    The greatest (height, canopy height) and the numbers of stems add up from places to extents to boxes; then the
    boxes' rows meet the stems that have just that.
    """
    on = on or []
    place, extent = [*on, x, y], [*on, *_extent(box)]
    stands = points.withColumn("__h", F.struct(F.col(height).alias("h"), F.col(canopy).alias("c")))  # null is the least of a struct's values
    spots = stands.groupBy(*place).agg(F.max("__h").alias("__top"), F.count("*").alias("__n"), F.count(height).alias("__known"))
    met = places_in_extents(points, boxes, x=x, y=y, box=box, size=size, on=on).join(spots, place)
    sums = [F.max("__top").alias("__top"), F.sum("__n").alias("__n"), F.sum("__known").alias("__known")]
    named = boxes.dropna(subset=[box_id])
    best = named.join(met.groupBy(*extent).agg(*sums), extent).groupBy(box_id).agg(*sums)
    if drop_unmeasured:
        best = best.filter((F.col("__n") == 1) | (F.col("__known") > 0))
    ranked = named.join(best.select(box_id, F.col("__top").alias("__h")), box_id)
    won = met.select(*place, *_extent(box), F.col("__top").alias("__h"))
    return ranked.join(won, [*extent, "__h"]).join(stands, [*place, "__h"]).drop("__h")


def ring_cover(rings: DataFrame, *, ring: str = "ring", size: float, cells: int = 8) -> DataFrame:
    """Each ring's cover by grid cells: its row once a cell, with __level, __cx, __cy, and __edge (an edge of the ring meets the cell).

    A ring goes to the grid (``size`` times a power of two) on which its extent is ``cells`` cells wide or fewer, so a cover has
    at most about ``cells`` squared cells; cells outside the ring aren't in it. Rings without extent or vertices have no cover.
    """
    xmin, ymin, xmax, ymax = ring_envelope(ring)
    side = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"))
    placed = rings.withColumns({"__x0": xmin, "__y0": ymin, "__x1": xmax, "__y1": ymax}).filter(side.isNotNull())
    placed = placed.withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2(side / (cells * size)))).cast("int"))
    placed = placed.withColumn("__s", size * F.pow(F.lit(2.0), "__level"))
    placed = placed.withColumn("__cell", _box_cells(Box("__x0", "__y0", "__x1", "__y1"), F.col("__s"))).withColumns({"__cx": F.col("__cell.cx"), "__cy": F.col("__cell.cy")})
    west, south = F.col("__cx") * F.col("__s"), F.col("__cy") * F.col("__s")
    placed = placed.withColumn("__edge", ring_crosses(west, south, west + F.col("__s"), south + F.col("__s"), F.col(ring)))
    inner = point_in_ring(west + F.col("__s") / 2, south + F.col("__s") / 2, F.col(ring))
    return placed.filter(F.col("__edge") | inner).drop("__x0", "__y0", "__x1", "__y1", "__s", "__cell")


def points_in_rings(points: DataFrame, rings: DataFrame, *, ring: str = "ring", x: str = "x", y: str = "y", on: list[str] | None = None, size: float | None = None, cells: int = 8) -> DataFrame:
    """Every (point, ring) with the point in the ring, its edge included, for any number of rings.

    Rings are covered by grid cells; points meet them by cell. In a cell that no edge meets there is nothing to
    ask; in the others the exact predicate decides. Places get a row for each grid that some ring is on (few,
    whatever the number of rings). ``on``: further equality columns; points without coordinates match nothing.
    Only distinct places meet distinct rings; their rows are joined as blocks (see ``copies_in_boxes``).
    """
    on = on or []
    if size is None:
        xmin, ymin, xmax, ymax = ring_envelope(ring)
        typical = rings.agg(F.percentile_approx(F.greatest(xmax - xmin, ymax - ymin), 0.5, 1000)).first()[0]
        size = float(typical) / cells if typical else 1.0
    size = 2.0 ** math.floor(math.log2(size))  # so that cell borders are exact
    shapes = staged(rings.select(*on, ring).distinct().withColumn("__shape", F.monotonically_increasing_id()), "ring-shapes")
    cover = staged(ring_cover(shapes, ring=ring, size=size, cells=cells), "ring-cover")
    levels = sorted(r[0] for r in cover.select("__level").distinct().collect())  # a grid for each doubling of size
    if not levels:
        levels = [0]
    scale = size * F.pow(F.lit(2.0), F.col("__level"))
    left = points.select(*on, x, y).distinct().withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels])))
    left = left.withColumns({"__cx": F.floor(F.col(x) / scale), "__cy": F.floor(F.col(y) / scale)})
    met = left.join(cover, [*on, "__level", "__cx", "__cy"]).filter(~F.col("__edge") | point_in_ring(x, y, F.col(ring))).select(*on, x, y, "__shape")
    met = met.join(_blocks(rings.join(shapes, [*on, ring]), [*on, ring, "__shape"], "__b").drop("__at", "__salt"), [*on, "__shape"])
    return _unblocked(met, points, [*on, x, y], [ring], 1)


def without_box(points: DataFrame, matched: DataFrame, individual: str = "individual") -> DataFrame:
    """Points of individuals that no box holds."""
    return points.join(matched.select(individual).distinct(), individual, "left_anti")


def squares(points: DataFrame, *, number: str = "number", half: float = 1.0, x: str = "x", y: str = "y", on: list[str] | None = None) -> DataFrame:
    """Squares around points, with box_id fixed_box_{number}."""
    xmin, ymin, xmax, ymax = square(x, y, half)
    return points.select(*(on or []), F.format_string("fixed_box_%d", F.col(number)).alias("box_id"), xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def fallback_boxes(points: DataFrame, matched: DataFrame, *, individual: str = "individual", number: str = "number", half: float = 1.0, x: str = "x", y: str = "y", on: list[str] | None = None) -> DataFrame:
    """Squares around points without a box, each joined to every unmatched point inside; box_id fixed_box_{number}, score null."""
    on = on or []
    missing = without_box(points, matched, individual)
    boxes = squares(missing, number=number, half=half, x=x, y=y, on=on)
    found = copies_in_boxes(missing, boxes, x=x, y=y, size=2 * half, on=on, spread=16)
    return found.withColumn("score", F.lit(None).cast("double"))


def nearest_box(pairs: DataFrame, *, individual: str = "individual", box_id: str = "box_id", x: str = "x", y: str = "y", box: Box = Box()) -> DataFrame:
    """Of an individual's boxes the one with the closest centre; ties by box id."""
    away = F.pow((F.col(box.xmin) + F.col(box.xmax)) / 2 - F.col(x), 2) + F.pow((F.col(box.ymin) + F.col(box.ymax)) / 2 - F.col(y), 2)
    return first_n(pairs, [individual], [away, box_id])


def tallest_in_box(pairs: DataFrame, *, box_id: str = "box_id", height: str = "height", canopy: str = "CHM_height", drop_unmeasured: bool = True) -> DataFrame:
    """Of a box's stems the tallest; ties by canopy height, remaining ties stay.

    With ``drop_unmeasured`` boxes of several stems without any height disappear (null is
    not equal to null there); else they compete by canopy height.
    """
    w = Window.partitionBy(box_id)
    rank = F.rank().over(w.orderBy(F.col(height).desc_nulls_last(), F.col(canopy).desc_nulls_last()))
    marked = pairs.dropna(subset=[box_id]).withColumns({"__rank": rank, "__n": F.count("*").over(w), "__known": F.count(height).over(w)})
    keep = F.col("__rank") == 1
    if drop_unmeasured:
        keep &= (F.col("__n") == 1) | (F.col("__known") > 0)
    return marked.filter(keep).drop("__rank", "__n", "__known")


def dedupe_boxes(pairs: DataFrame, keys: list[str], order) -> DataFrame:
    """The first row of each (plot, box); null keys go."""
    return first_n(pairs, keys, order)


def grid_plots(points: DataFrame, *, x: str = "x", y: str = "y", size: float = 40.0, name: str = "plotID") -> DataFrame:
    """Ids of grid cells over the layer's extent, x-major; a point on a border takes the lowest cell."""
    e = points.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if e["x0"] is None:
        return points.withColumn(name, F.lit(None).cast("string"))
    rows = -int(-(e["y1"] + size - e["y0"]) // size)
    ix = F.ceil((F.col(x) - e["x0"]) / size)
    iy = F.greatest(F.ceil((F.col(y) - e["y0"]) / size) - 1, F.lit(0))
    return points.withColumn(name, F.format_string("%d_contrib", (ix * rows + iy).cast("bigint")))


def radius_plots(points: DataFrame, *, position: str = "position", x: str = "x", y: str = "y", radius: float = 40.0, name: str = "plot") -> DataFrame:
    """Every point gets the largest position among points within ``radius`` (itself included). Places meet, not points."""
    size = radius
    spots = points.groupBy(F.col(x).alias("__x2"), F.col(y).alias("__y2")).agg(F.max(position).alias("__q"))
    near = F.explode(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda a: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda b: F.struct((_cell(F.col("__x2"), size) + a).alias("cx"), (_cell(F.col("__y2"), size) + b).alias("cy"))))))
    left = spots.select(F.col("__x2").alias("__x"), F.col("__y2").alias("__y"), near.alias("__c")).select("__x", "__y", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy"))
    right = spots.withColumns({"__cx": _cell(F.col("__x2"), size), "__cy": _cell(F.col("__y2"), size)})
    met = left.join(right, ["__cx", "__cy"]).filter(F.pow(F.col("__x") - F.col("__x2"), 2) + F.pow(F.col("__y") - F.col("__y2"), 2) <= radius * radius)
    top = met.groupBy(F.col("__x").alias(x), F.col("__y").alias(y)).agg(F.max("__q").alias(name))
    own = points.select(position, x, y).join(top, [x, y]).groupBy(position).agg(F.max(name).alias(name))
    return points.join(own, position)


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows whose key isn't listed."""
    return df.join(keys, on, "left_anti")


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all shared columns."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared)


def look_up(df: DataFrame, table: DataFrame, on: str, wanted: str, strict: bool = True) -> DataFrame:
    """Add a column from a dictionary table; with ``strict`` a missing key fails the job, as a dictionary would."""
    got = df.join(table.select(on, wanted), on, "left")
    if strict:
        known = F.col(wanted).isNotNull()
        message = F.concat(F.lit(f"{on} has no {wanted}: "), F.coalesce(F.col(on).cast("string"), F.lit("null")))
        got = got.withColumn(wanted, F.when(known, F.col(wanted)).otherwise(F.raise_error(message).cast(got.schema[wanted].dataType)))
    return got


def tile_latest(df: DataFrame, catalog: DataFrame, key: str = "geo_index", path: str = "path") -> DataFrame:
    """With the greatest path of each row's tile; rows without a tile go (see clean.covered)."""
    best = catalog.groupBy(key).agg(F.max(path).alias(path))
    return df.join(best, key)


def tile_all_years(df: DataFrame, catalog: DataFrame, key: str = "geo_index") -> DataFrame:
    """Every row with every tile of its place, one per year."""
    return df.join(catalog, key)


def pair_products(tiles: DataFrame, others: DataFrame, key: str = "geo_index", path: str = "path", year: str = "tile_year", suffix: str = "hyperspectral") -> DataFrame:
    """Tiles of another product at the same place, with the output name from the first one's base name and the year."""
    right = others.select(key, F.col(path).alias("other_path"), F.col(year).alias("other_year"))
    base = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")
    return tiles.join(right, key).withColumn("output", F.concat_ws("_", base, F.lit(suffix), F.col("other_year").cast("string")))


def clip_points(df: DataFrame, ring: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Points in a ring, its edge included. ``ring`` is a constant or a column."""
    return df.filter(point_in_ring(x, y, ring))


def clip_boxes(df: DataFrame, ring: Column, box: Box = Box()) -> DataFrame:
    """Boxes that meet a ring; touching counts."""
    return df.filter(box_meets_ring(box, ring))


def surveyed_boxes(polygons: DataFrame, order, ring: str = "ring", keys: list[str] | None = None) -> DataFrame:
    """envelopes of surveyed rings with numbers from 0 as box ids."""
    from canopy.operators.windows import number_rows

    xmin, ymin, xmax, ymax = ring_envelope(ring)
    return number_rows(polygons.withColumns({"xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax}), order, "box_id", keys)

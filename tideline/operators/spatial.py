"""Grid cells: numbering, extraction at points, nearest valid cell, neighbor fill."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import natural_join, natural_left_join, with_one_row
from .materialize import written

EARTH_RADIUS_KM = 6371.0
DISTANCE_DIGITS = 6  # distances closer than a millimetre are ties, won by the lowest cell


def columns_of(res: float) -> int:
    return round(360 / res)


def rows_of(res: float) -> int:
    return round(180 / res)


def cell_of(lon: Column, lat: Column, res: float = 1.0) -> Column:
    """1-based cell number, row by row from the north-west corner; NULL off the globe."""
    ncol, nrow = columns_of(res), rows_of(res)
    col = F.least(F.floor((lon + 180) / res), F.lit(ncol - 1))
    row = F.least(F.floor((90 - lat) / res), F.lit(nrow - 1))
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), row * ncol + col + 1).cast("long")


def cell_center(cell: Column, res: float = 1.0) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's center."""
    ncol = columns_of(res)
    row = F.floor((cell - 1) / ncol)
    return (F.pmod(cell - 1, F.lit(ncol)) + 0.5) * res - 180, 90 - (row + 0.5) * res


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlon, dlat = F.radians(lon2 - lon1), F.radians(lat2 - lat1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


#: A level's cubes have 4 times the edge of the level below: two bits of a cube's index.
_BITS = 2
_XYZ = ("x", "y", "z")


def _on_sphere(df: DataFrame, lon: str, lat: str, edge: float) -> DataFrame:
    """``df`` with each point's place on the unit sphere (_x, _y, _z) and its cube of the finest level (_cx, _cy, _cz)."""
    places = {
        "x": f"cos(radians(`{lat}`)) * cos(radians(`{lon}`))",
        "y": f"cos(radians(`{lat}`)) * sin(radians(`{lon}`))",
        "z": f"sin(radians(`{lat}`))",
    }
    return df.selectExpr("*", *[f"{e} AS _{c}" for c, e in places.items()]).selectExpr(
        "*", *[f"CAST(floor((_{c} + 1) / {edge!r}D) AS BIGINT) AS _c{c}" for c in _XYZ])


def _level_cubes(level: str) -> list[str]:
    return [f"shiftright(_c{c}, {_BITS} * {level}) AS _c{c}" for c in _XYZ]


def _cell_pyramid(placed: DataFrame, top: int) -> DataFrame:
    """One row per level and cube that holds cells: the box around them. Each cell is rolled up into each level once."""
    leveled = placed.selectExpr("_x", "_y", "_z", "_cx", "_cy", "_cz", f"explode(sequence(0, {top})) AS _level")
    leveled = leveled.selectExpr("_x", "_y", "_z", "_level", *_level_cubes("_level"))
    return leveled.groupBy("_level", "_cx", "_cy", "_cz").agg(
        *[f(f"_{c}").alias(f"_{end}{c}") for c in _XYZ for end, f in (("lo", F.min), ("hi", F.max))])


def _box_distance(far: bool) -> Column:
    """Chord from (_x, _y, _z) to the nearest, or to the farthest, place of the box _lox.._hiz."""
    if far:
        steps = [f"greatest(abs(_{c} - _lo{c}), abs(_{c} - _hi{c}))" for c in _XYZ]
    else:
        steps = [f"greatest(_lo{c} - _{c}, _{c} - _hi{c}, 0D)" for c in _XYZ]
    return F.sqrt(F.expr(" + ".join(f"pow({s}, 2)" for s in steps)))


def nearest_valid_cell(
    points: DataFrame, cells: DataFrame, res: float = 1.0, lon: str = "Longitude", lat: str = "Latitude"
) -> DataFrame:
    """Nearest cell by great-circle distance for each distinct point.

    ``cells`` holds the valid cells (cell, cell_lon, cell_lat). Points and cells are placed in cubes of the
    unit sphere, which has neither a date line nor poles. A pyramid has, for cubes of ever wider levels, the
    box around their cells; the finest cubes hold a few cells each. The boxes that a point's own cubes have
    bound its distance from above. It then goes, from the level whose edge is about that bound, through the
    boxes that are no farther than the bound, which tightens level by level, down to the cells. Points
    amid cells start at the finest level. Ties go to the lowest cell; a point without coordinates, or all
    if there are no cells, gets none. Points and cells are read once; each level's state is written.
    """
    edge = math.radians(2.5 * res)
    top = max(0, math.ceil(math.log(2 / edge, 2 ** _BITS) - 1e-9))
    places = written(_on_sphere(points.select(lon, lat).distinct(), lon, lat, edge))
    placed = written(_on_sphere(cells.select("cell", "cell_lon", "cell_lat"), "cell_lon", "cell_lat", edge))
    pyramid = written(_cell_pyramid(placed, top))
    cube = ["_cx", "_cy", "_cz"]
    point = [lon, lat, "_x", "_y", "_z"]
    slack = 1e-8  # of the radius: some centimetres, above any rounding

    own = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_level")).selectExpr(
        *[f"`{c}`" for c in point], "_level", *_level_cubes("_level"))
    bound = own.join(pyramid, ["_level", *cube]).groupBy(*point).agg(F.min(_box_distance(True) + slack).alias("_reach"))
    # the finest level whose cubes are few within reach
    level = F.greatest(F.lit(0), F.ceil(F.log(F.col("_reach") / (1.75 * edge)) / math.log(2 ** _BITS)))
    state = bound.withColumn("_level", F.least(level, F.lit(top)).cast("int"))
    wide = f"({edge!r}D * pow({2 ** _BITS}, _level))"
    for c in _XYZ:
        ends = [f"CAST(floor((_{c} + 1 {sign} _reach) / {wide}) AS BIGINT)" for sign in "-+"]
        state = state.selectExpr("*", f"explode(sequence({ends[0]}, {ends[1]})) AS _c{c}")
    sides = [f"pow(greatest(_c{c} * {wide} - 1 - _{c}, _{c} + 1 - (_c{c} + 1) * {wide}, 0D), 2)" for c in _XYZ]
    state = written(state.where(f"sqrt({' + '.join(sides)}) <= _reach"))

    widest = state.agg(F.max("_level")).first()[0] or 0
    for k in range(widest, 0, -1):
        below = pyramid.where(F.col("_level") == k - 1).selectExpr(
            "*", *[f"shiftright(_c{c}, {_BITS}) AS _p{c}" for c in _XYZ]).drop("_level")
        met = state.where(F.col("_level") == k).withColumnsRenamed({f"_c{c}": f"_p{c}" for c in _XYZ}).join(
            below, [f"_p{c}" for c in _XYZ])
        met = met.withColumns({"_near": _box_distance(False), "_far": _box_distance(True) + slack})
        tightest = F.min("_far").over(Window.partitionBy(lon, lat))  # a point has few boxes in reach
        met = met.withColumn("_reach", F.least("_reach", tightest)).where("_near <= _reach")
        state = written(met.withColumn("_level", F.lit(k - 1)).select(*state.columns).unionByName(
            state.where(F.col("_level") < k)))

    km = F.round(great_circle_km(F.col(lon), F.col(lat), F.col("cell_lon"), F.col("cell_lat")), DISTANCE_DIGITS)
    best = (
        state.select(lon, lat, *cube).join(placed.select("cell", "cell_lon", "cell_lat", *cube), cube)
        .groupBy(lon, lat).agg(F.min(F.struct(km.alias("km"), F.col("cell").cast("long").alias("cell"))).alias("_best"))
    )
    return places.select(lon, lat).join(best, [lon, lat], "left").select(
        lon, lat, F.col("_best.cell").alias("non_na_cell"), F.col("_best.km").alias("km"))


def extract_at_points(points: DataFrame, grid: DataFrame, cell: str = "cell") -> DataFrame:
    """Series of the distinct cells in use, joined back to the points."""
    used = points.select(cell).distinct()
    series = natural_join(grid.withColumnRenamed("cell", cell), used, [cell], "left_semi")
    return natural_join(points, series, [cell], "left")


def neighbors(cell: Column, res: float = 1.0) -> Column:
    """Array of the (up to) eight adjacent cells; longitude wraps, the poles do not."""
    ncol, nrow = columns_of(res), rows_of(res)
    row, col = F.floor((cell - 1) / ncol), F.pmod(cell - 1, F.lit(ncol))
    around = F.array(*[
        F.when((row + i).between(0, nrow - 1), (row + i) * ncol + F.pmod(col + j, F.lit(ncol)) + 1)
        for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)
    ])
    return F.filter(around, lambda c: c.isNotNull())


def neighbor_fill(cells: DataFrame, grid: DataFrame, res: float = 1.0, judged_on=None) -> DataFrame:
    """Series (cell, date, value) of the cells; a missing cell takes its neighbors' mean per date.

    A cell is missing if it has no value on the judging date, by default the
    grid's first. Then its whole series is replaced. The grid has one row per cell and date and is read
    twice: for the cells' first dates, and for their values, which one join deals out to whom they serve.
    """
    wanted = cells.select("cell").distinct()
    grid = grid.select("cell", "date", "value")
    valued = F.when(F.col("value").isNotNull(), F.col("date"))
    if judged_on is None:
        # a cell has a value on the grid's first date if its own first date with a value is that date
        firsts = written(grid.groupBy("cell").agg(F.min("date").alias("_any"), F.min(valued).alias("_valued")))
        valid = with_one_row(firsts, firsts.agg(F.min("_any").alias("_first"))).where(F.col("_valued") == F.col("_first"))
    else:
        valid = grid.where((F.col("date") == judged_on) & F.col("value").isNotNull())
    judged = natural_join(wanted, valid.select("cell").distinct().withColumn("_valid", F.lit(True)), ["cell"], "left")
    # A missing cell itself rides along so that its dates stay even without neighbors.
    around = F.when(F.col("_valid"), F.array("cell")).otherwise(F.concat(F.array("cell"), neighbors(F.col("cell"), res)))
    serves = judged.select(F.col("cell").alias("_for"), "_valid", F.explode(around).alias("cell"))
    own = F.col("_for") == F.col("cell")
    return grid.join(serves, "cell").groupBy("_for", "date").agg(
        F.max(F.when(own & F.col("_valid"), F.col("value"))).alias("_own"), F.avg(F.when(~own, F.col("value"))).alias("_around"),
    ).select(F.col("_for").alias("cell"), "date", F.coalesce("_own", "_around").alias("value"))


def join_mean_max(mean_epochs: Sequence[DataFrame], max_epochs: Sequence[DataFrame]) -> DataFrame:
    """Stack each series' grid epochs, then join mean to maximum on point and date."""
    def stack(frames: Sequence[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    return natural_left_join(stack(mean_epochs), stack(max_epochs))


def cells_not_extracted(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Distinct cells still to be read."""
    return natural_join(wanted.select("cell").distinct(), have, ["cell"], "left_anti")


def in_extent(
    df: DataFrame, lon_min: float, lon_max: float, lat_min: float, lat_max: float,
    lon: str = "Longitude", lat: str = "Latitude",
) -> DataFrame:
    """Rows inside a closed box."""
    return df.where(F.col(lon).between(lon_min, lon_max) & F.col(lat).between(lat_min, lat_max))

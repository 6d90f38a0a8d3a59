"""Places near an address."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barriometrics import dims
from barriometrics.functions.geo import EARTH_RADIUS_M, cell_index, haversine_m
from barriometrics.operators.lookups import attach
from barriometrics.session import materialise

METRES_PER_DEGREE = 111_194.9
HOT_CELL_ROWS = 100_000
#: Levels of the pyramid below cells one radius high.
LEVELS = 4
#: Most spots, and most origins, of a tile that one task takes at a time; beyond that they are dealt.
TILE_ROWS = 400_000
#: Rows of tiles handed to one group, and distances held at once.
GROUP_ROWS, BLOCK_PAIRS = 100_000, 1_000_000


def with_defaults(places: DataFrame) -> DataFrame:
    """Map elements as (amenity, name, lat, lon); missing tags and coordinates get their defaults."""
    keep = [c for c in places.columns if c not in ("tags", "lat", "lon")]
    tag = lambda name, default: F.coalesce(F.col("tags").getItem(name), F.lit(default))
    return places.select(
        *keep,
        tag("amenity", dims.UNKNOWN_AMENITY).alias("amenity"),
        tag("name", dims.UNNAMED_PLACE).alias("name"),
        F.coalesce("lat", F.lit(0.0)).alias("lat"),
        F.coalesce("lon", F.lit(0.0)).alias("lon"),
    )


def place_group(amenity: Column, name: Column) -> Column:
    """Report group of a place, NULL where it is not reported; untagged transit counts by its name."""
    table = F.create_map(*[F.lit(x) for pair in dims.AMENITY_GROUPS.items() for x in pair])
    transit = (amenity == dims.UNKNOWN_AMENITY) & F.contains(name, F.lit(dims.TRANSIT_MARK))
    return F.when(transit, F.lit("transporte")).otherwise(F.try_element_at(table, amenity))


def grouped_places(places: DataFrame) -> DataFrame:
    """Reported places with their group, one row each; lists per group stay rows, never one array."""
    rows = with_defaults(places).withColumn("place_group", place_group(F.col("amenity"), F.col("name")))
    return rows.filter(F.col("place_group").isNotNull())


def group_totals(places: DataFrame) -> DataFrame:
    """Number of places in each of the six groups, zeros included."""
    groups = dims.constant_table(places.sparkSession, [(g,) for g in dims.PLACE_GROUPS], "place_group")
    counts = grouped_places(places).groupBy("place_group").agg(F.count("*").alias("total"))
    return groups.join(counts, "place_group", "left").na.fill(0)


def places_by_amenity(places: DataFrame) -> DataFrame:
    """Every place with its amenity (default filled in) and the number of places of that amenity."""
    rows = with_defaults(places)
    totals = rows.groupBy("amenity").agg(F.count("*").alias("total"))
    return attach(rows, totals, ["amenity"])


def _cells(df: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    return df.withColumns({"cell_lat": cell_index(F.col(lat), size), "cell_lon": cell_index(F.col(lon), size)})


def near(requests: DataFrame, places: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """Requests (request_id, lat, lon) joined to the places within ``radius_m``.

    Both sides meet on grid cells one radius high: a request is listed in every cell its bounding
    box touches, a place in its own cell. A cell with very many places is split by salts, with the
    requests that touch it repeated once per salt. Boxes do not wrap at the antimeridian.
    """
    size = radius_m / METRES_PER_DEGREE
    cell = ["cell_lat", "cell_lon"]
    placed = _cells(places.withColumnsRenamed({"lat": "place_lat", "lon": "place_lon"}), "place_lat", "place_lon", size)
    hot = (
        placed.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_CELL_ROWS)
        .select(*cell, F.ceil(F.col("n") / HOT_CELL_ROWS).cast("int").alias("salts"))
    )
    hot = materialise(hot, "hot-cells")
    half = F.lit(size * 1.001)
    # Half width of the box in degrees of longitude, at its edge nearest to the pole.
    half_lon = F.least(half / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + half, F.lit(89.9)))), F.lit(1e-3)), F.lit(180.0))
    covering = requests.select(
        "*", F.explode(F.sequence(cell_index(F.col("lat") - half, size), cell_index(F.col("lat") + half, size))).alias("cell_lat"), half_lon.alias("_half")
    ).select(
        "*",
        F.explode(
            F.sequence(cell_index(F.col("lon") - F.col("_half"), size), cell_index(F.col("lon") + F.col("_half"), size))
        ).alias("cell_lon"),
    ).drop("_half")
    salts = F.coalesce("salts", F.lit(1))
    placed = attach(placed, hot, cell, stored=True).withColumn("salt", F.pmod(F.xxhash64("place_lat", "place_lon"), salts).cast("int")).drop("salts")
    covering = attach(covering, hot, cell, stored=True).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    return (
        covering.join(placed, [*cell, "salt"])
        .withColumn("distance_m", distance)
        .filter(F.col("distance_m") <= radius_m)
        .drop(*cell, "salt")
    )


def _columns_of(band: Column, size: float) -> Column:
    """Cells around the globe in a band ``size`` degrees high: about square at its edge nearest to the pole, one at the pole."""
    edge = F.least(F.greatest(F.abs(band * size), F.abs((band + 1) * size)), F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * 360 / size)).cast("long")


def _east(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0))


def _tile(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    """The cell one radius high that holds the point: its band and its column."""
    band = F.floor(lat / size)
    return band, F.floor(_east(lon) / 360 * _columns_of(band, size)).cast("long")


def _bounds(size: float) -> tuple[Column, Column]:
    """Least and greatest distance in metres from lat, lon to a point of the cell (level, cy, cx)."""
    height = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    width = F.lit(360.0) / (F.col("columns") * F.pow(F.lit(2.0), F.col("level")))
    south = F.col("cy") * height
    apart = F.abs(F.col("lat") - south - height / 2)
    along = F.abs(_east(F.col("lon")) - (F.col("cx") + 0.5) * width)
    along = F.least(along, 360 - along)
    edges = F.abs(south), F.abs(south + height)
    wide = F.when((south <= 0) & (south + height >= 0), F.lit(1.0)).otherwise(F.cos(F.radians(F.least(*edges, F.lit(90.0)))))
    narrow = F.cos(F.radians(F.least(F.greatest(*edges), F.lit(90.0))))

    def metres(dlat: Column, dlon: Column, cosine: Column) -> Column:
        h = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians("lat")) * cosine * F.pow(F.sin(F.radians(dlon) / 2), 2)
        return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_RADIUS_M)

    least = metres(F.greatest(apart - height / 2, F.lit(0.0)), F.greatest(along - width / 2, F.lit(0.0)), narrow)
    most = metres(F.least(apart + height / 2, F.lit(180.0)), F.least(along + width / 2, F.lit(180.0)), wide)
    return least * (1 - 1e-9), most * (1 + 1e-9)


def _cover(origins: DataFrame, radius_m: float, size: float, levels: int = LEVELS) -> DataFrame:
    """The cells of each origin's disc: lat, lon, level, cy, cx, low, high, whole.

    Whole cells lie inside the disc and are no larger than their distance allows: about a half of it, so that
    they also bound the nearest place. The others are cells of the last level that the edge crosses. How
    many there are follows from the levels alone, at any latitude.
    """
    reach = F.lit(size * 1.001)
    band = lambda lat: F.floor(lat / size)
    cosine = F.cos(F.radians(F.least(F.abs("lat"), F.lit(90.0))))
    spans_pole = F.abs("lat") + reach >= 90
    half = F.when(spans_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / cosine))) * 1.001)
    cells = origins.select("lat", "lon", F.explode(F.sequence(band(F.greatest(F.col("lat") - reach, F.lit(-90.0))), band(F.least(F.col("lat") + reach, F.lit(90.0))))).alias("cy"))
    cells = cells.withColumn("columns", _columns_of(F.col("cy"), size)).withColumn("_half", half)
    first = F.floor((_east(F.col("lon")) - F.col("_half")) / 360 * F.col("columns"))
    last = F.floor((_east(F.col("lon")) + F.col("_half")) / 360 * F.col("columns"))
    cells = cells.withColumn("cx", F.explode(F.sequence(first, F.least(last, first + F.col("columns") - 1)))).drop("_half")
    cells = cells.withColumns({"cx": F.pmod("cx", "columns"), "level": F.lit(0)})
    for level in range(levels + 1):
        low, high = _bounds(size)
        cells = cells.withColumns({"low": low, "high": high}).where(F.col("low") <= radius_m)
        if level < levels:
            settled = (F.col("level") < level) | ((F.col("high") <= radius_m) & (F.col("high") <= 2 * F.col("low")))
            child = lambda y, x: F.struct((F.col("level") + 1).alias("level"), (F.col("cy") * 2 + y).alias("cy"), (F.col("cx") * 2 + x).alias("cx"))
            own = F.array(F.struct("level", "cy", "cx"))
            parts = F.explode(F.when(settled, own).otherwise(F.array(child(0, 0), child(0, 1), child(1, 0), child(1, 1))))
            cells = cells.select("lat", "lon", "columns", parts.alias("cell")).select("lat", "lon", "columns", "cell.*")
    return cells.drop("columns").withColumn("whole", F.col("high") <= radius_m)


def _point(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    y, x = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1)


def _metres(lat, lon, to_lat, to_lon) -> np.ndarray:
    """As ``haversine_m``."""
    dlat, dlon = np.radians(to_lat - lat) / 2, np.radians(to_lon - lon) / 2
    h = np.sin(dlat) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(to_lat)) * np.sin(dlon) ** 2
    return np.arcsin(np.minimum(1.0, np.sqrt(h))) * (2 * EARTH_RADIUS_M)


def _near_block(lat, lon, spot_lat, spot_lon, copies, radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """For each origin the copies of the spots within the radius, and the nearest one's distance.

    Distances are told by squared chords, taken from one of the origins so that none of their digits are lost;
    the nearest spot and those that lie on the radius by a hair are measured as ``haversine_m`` does.
    """
    centre = _point(lat[:1], lon[:1])
    origin, spot = _point(lat, lon) - centre, _point(spot_lat, spot_lon) - centre
    chord = -2 * (origin @ spot.T)
    chord += (origin**2).sum(1)[:, None]
    chord += (spot**2).sum(1)
    limit = 4 * np.sin(min(radius_m / EARTH_RADIUS_M / 2, np.pi / 2)) ** 2
    n = (chord <= limit * (1 - 1e-8)) @ copies
    doubt = np.nonzero((chord > limit * (1 - 1e-8)) & (chord <= limit * (1 + 1e-8)))
    inside = _metres(lat[doubt[0]], lon[doubt[0]], spot_lat[doubt[1]], spot_lon[doubt[1]]) <= radius_m
    np.add.at(n, doubt[0][inside], copies[doubt[1][inside]])
    nearest = chord.argmin(1)
    return n, _metres(lat, lon, spot_lat[nearest], spot_lon[nearest])


def _near_tile(origins: pd.DataFrame, spots: pd.DataFrame, radius_m: float) -> Iterator[pd.DataFrame]:
    """lat, lon, kind, n, m of the origins and spots of one tile, kind by kind, some distances at a time."""
    lat, lon = origins["lat"].to_numpy(), origins["lon"].to_numpy()
    for at in spots.groupby("kind", dropna=False).indices.values():
        of_kind = spots.iloc[at]
        values = [of_kind[c].to_numpy(np.float64) for c in ("place_lat", "place_lon", "copies")]
        step = max(1, BLOCK_PAIRS // len(at))
        for start in range(0, len(lat), step):
            here = slice(start, start + step)
            n, m = _near_block(lat[here], lon[here], *values, radius_m)
            found = n > 0
            yield pd.DataFrame({"lat": lat[here][found], "lon": lon[here][found], "kind": of_kind["kind"].iloc[0], "n": n[found].astype(np.int64), "m": m[found]})


def near_counts(requests: DataFrame, places: DataFrame, kind: str, radius_m: float = 500.0) -> DataFrame:
    """Places of each ``kind`` within the radius of each request, and the nearest distance.

    Requests meet the places by tiles, cells one radius high: a request goes to its own tile, a place to the tiles
    with a request whose disc touches its cell. A task works a tile's distances out in blocks and hands on one row
    a request and kind, so what is shuffled grows with the rows, not with the pairs. A tile with very many of
    either is dealt over groups whose counts add up. Copies of a place at one spot, and requests from one spot,
    are folded first; rows without coordinates take no part. Discs go on across the antimeridian and over the poles.
    """
    size = radius_m / METRES_PER_DEGREE
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    tile, cell = ["ty", "tx"], ["cy", "cx"]
    ty, tx = _tile(F.col("lat"), F.col("lon"), size)
    spots = places.where(known).groupBy("lat", "lon", F.col(kind).cast("string").alias("kind")).agg(F.count("*").alias("copies"))
    spots = materialise(spots.withColumns({"cy": ty, "cx": tx}).withColumnsRenamed({"lat": "place_lat", "lon": "place_lon"}), "spots")
    origins = materialise(requests.where(known).select("lat", "lon").distinct().withColumns({"ty": ty, "tx": tx}), "origins")
    links = materialise(_cover(origins, radius_m, size, levels=0).select(ty.alias("ty"), tx.alias("tx"), *cell).distinct(), "links")

    # How many groups the spots, and the origins, of a tile are dealt over.
    weight = links.join(spots.groupBy(*cell).agg(F.count("*").alias("spots")), cell).groupBy(*tile).agg(F.sum("spots").alias("spots"))
    weight = materialise(weight.join(origins.groupBy(*tile).agg(F.count("*").alias("origins")), tile), "tiles")
    total = weight.agg(F.coalesce(F.sum(F.col("spots") + F.col("origins")), F.lit(0))).first()[0]
    groups = max(64, int(total) // GROUP_ROWS)
    parts = lambda c: F.ceil(F.col(c) / TILE_ROWS).cast("int")
    hot = weight.where((F.col("spots") > TILE_ROWS) | (F.col("origins") > TILE_ROWS)).select(*tile, parts("spots").alias("_spots"), parts("origins").alias("_origins"))
    hot = F.broadcast(materialise(hot, "hot-tiles"))

    def dealt(df: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        n, m = F.coalesce(f"_{own}", F.lit(1)), F.coalesce(f"_{other}", F.lit(1))
        df = df.join(hot, tile, "left").withColumn(own, F.pmod(F.xxhash64(*by), n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), m - 1)))
        return df.drop("_spots", "_origins").withColumn("group", F.pmod(F.xxhash64(*tile, "spots", "origins"), F.lit(groups)))

    tiles_of = links.groupBy(*cell).agg(F.collect_list(F.struct(*tile)).alias("tiles"))  # some ten a cell
    offered = attach(spots, tiles_of, cell, "inner").select("place_lat", "place_lon", "kind", "copies", F.inline("tiles"))
    offered = dealt(offered, "spots", "origins", "place_lat", "place_lon", "kind")
    asked = dealt(origins, "origins", "spots", "lat", "lon")
    key = [*tile, "spots", "origins"]

    def count(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        of = offered.groupby(key).indices
        found = [x for k, at in asked.groupby(key).indices.items() if k in of for x in _near_tile(asked.iloc[at], offered.iloc[of[k]], radius_m)]
        return pd.concat(found) if found else pd.DataFrame(columns=["lat", "lon", "kind", "n", "m"])

    found = asked.groupBy("group").cogroup(offered.groupBy("group")).applyInPandas(count, "lat double, lon double, kind string, n long, m double")
    whole = found.groupBy("lat", "lon", "kind").agg(F.sum("n").alias("places"), F.min("m").alias("nearest_m"))
    whole = whole.select("lat", "lon", F.col("kind").cast(places.schema[kind].dataType).alias(kind), "places", "nearest_m")
    return attach(requests, whole, ["lat", "lon"], "inner").select("request_id", kind, "places", "nearest_m")

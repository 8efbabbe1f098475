"""Nearest-machine, within-radius and cell jobs on grid keys.

Both sides collapse to distinct places first (a place holding a third of all rows is
one row), so the pair work depends on how many places there are, not on how many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage

CELL_RADIUS_KM = 12.0
CANDIDATES = 25
FINEST = 0.005                       # degrees
LEVELS = tuple(range(0, 17))         # 0.005 deg * 2^16 = 327 deg: the top level spans the globe


def _size(level):
    return F.lit(FINEST) * F.pow(F.lit(2.0), level)


def finite_points(df: DataFrame, lat="lat", lon="lon") -> DataFrame:
    lat, lon = F.col(lat), F.col(lon)
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return df.filter(ok & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf")))


def places_of(df: DataFrame) -> DataFrame:
    return df.select("lat", "lon").distinct()


def _pyramid(points: DataFrame) -> DataFrame:
    """Points per grid cell at every level, built from the finest level up."""
    finest = (points.groupBy(geo.grid_index("lat", FINEST).alias("gx"), geo.grid_index("lon", FINEST).alias("gy"))
              .agg(F.sum("n").alias("n")))
    levels = F.explode(F.array(*[F.lit(v) for v in LEVELS])).alias("level")
    up = finest.select("gx", "gy", "n", levels)
    shift = F.pow(F.lit(2.0), F.col("level"))
    return (up.groupBy("level", F.floor(F.col("gx") / shift).cast("int").alias("gx"), F.floor(F.col("gy") / shift).cast("int").alias("gy"))
            .agg(F.sum("n").alias("n")))


def _coarse_index(coord: str, level):
    # integer parent of the finest grid line: identical to what _pyramid holds
    return F.floor(geo.grid_index(coord, FINEST) / F.pow(F.lit(2.0), level)).cast("int")


def nearest_k(queries: DataFrame, points: DataFrame, k: int = CANDIDATES, point_id="atm_id") -> DataFrame:
    """Exact k nearest points of every distinct query place.

    Returns (lat, lon, rank, ``point_id``, plat, plon, dist_km), ties broken by id.

    1. The finest grid cell around the place that already holds k points bounds the k-th
       distance. 2. Counts of smaller cells around it tighten that bound without touching a
       point. 3. Only points within the bound are fetched. At most k points of one spot can
       matter, so spots keep their first k ids.
    """
    rank_spot = Window.partitionBy("plat", "plon").orderBy(point_id)
    spots = (finite_points(points).select(F.col(point_id), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
             .withColumn("__r", F.row_number().over(rank_spot)).filter(F.col("__r") <= k).drop("__r"))
    # written once: the steps below each look at it again
    spots = cut_lineage(spots)
    spot_counts = spots.groupBy(F.col("plat").alias("lat"), F.col("plon").alias("lon")).agg(F.count(F.lit(1)).alias("n"))
    pyramid = cut_lineage(_pyramid(spot_counts))
    places = cut_lineage(places_of(finite_points(queries)))

    # 1. own cell, finest level with k points
    levels = F.explode(F.array(*[F.lit(v) for v in LEVELS])).alias("level")
    own = (places.select("lat", "lon", levels)
           .withColumn("gx", _coarse_index("lat", F.col("level"))).withColumn("gy", _coarse_index("lon", F.col("level"))))
    level = (own.join(pyramid, ["level", "gx", "gy"]).filter(F.col("n") >= k).groupBy("lat", "lon").agg(F.min("level").alias("level")))
    # a directory smaller than k, or one split by the equator or meridian, is searched whole
    top = LEVELS[-1]
    bounded = (places.join(level, ["lat", "lon"], "left")
               .withColumn("bound_km", F.when(F.col("level").isNull(), F.lit(geo.EARTH_KM * 3.1415927))
                           .otherwise(geo.KM_PER_DEGREE * 1.4142136 * 1.0001 * _size(F.col("level")))))
    bounded = cut_lineage(bounded)

    # 2. tighten with cells two levels finer
    fine = F.greatest(F.coalesce("level", F.lit(top)) - 2, F.lit(0))
    tight = (bounded.filter(F.col("level").isNotNull()).withColumn("fine", fine)
             .withColumn("c", F.explode(geo.covering_cells("lat", "lon", "bound_km", _size(F.col("fine")))))
             .select("lat", "lon", "bound_km", F.col("fine").alias("level"), "c.gx", "c.gy")
             .join(pyramid, ["level", "gx", "gy"]))
    edge = _size(F.col("level"))
    reach = geo.haversine_km("lat", "lon", (F.col("gx") + 0.5) * edge, (F.col("gy") + 0.5) * edge) \
        + geo.KM_PER_DEGREE * 0.7071068 * 1.0001 * edge
    by_reach = Window.partitionBy("lat", "lon").orderBy("reach").rowsBetween(Window.unboundedPreceding, 0)
    tight = (tight.withColumn("reach", reach).withColumn("have", F.sum("n").over(by_reach)).filter(F.col("have") >= k)
             .groupBy("lat", "lon").agg(F.min("reach").alias("tight_km")))
    search = (bounded.join(tight, ["lat", "lon"], "left")
              .withColumn("km", F.coalesce(F.least("bound_km", "tight_km"), "bound_km")))
    search = cut_lineage(search)

    # 3. fetch at the level whose cell is about the size of the search circle
    fetch_level = F.least(F.lit(top), F.greatest(F.lit(0), F.ceil(F.log2(F.col("km") / geo.KM_PER_DEGREE / FINEST)))).cast("int")
    asks = (search.withColumn("level", fetch_level)
            .withColumn("c", F.explode(geo.covering_cells("lat", "lon", "km", _size(F.col("level")))))
            .select("lat", "lon", "km", "level", "c.gx", "c.gy"))
    used = asks.select("level", "gx", "gy").distinct()
    homes = (spots.select("*", levels)
             .withColumn("gx", F.floor(geo.grid_index("plat", FINEST) / F.pow(F.lit(2.0), F.col("level"))).cast("int"))
             .withColumn("gy", F.floor(geo.grid_index("plon", FINEST) / F.pow(F.lit(2.0), F.col("level"))).cast("int"))
             .join(used, ["level", "gx", "gy"], "left_semi"))
    near = (asks.join(homes, ["level", "gx", "gy"])
            .withColumn("dist_km", geo.haversine_km("lat", "lon", "plat", "plon"))
            .filter(F.col("dist_km") <= F.col("km")))
    order = Window.partitionBy("lat", "lon").orderBy("dist_km", point_id)
    return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("lat", "lon", "rank", point_id, "plat", "plon", "dist_km"))


def count_within(queries: DataFrame, points: DataFrame, km: float, out: str) -> DataFrame:
    """Points within ``km`` of every distinct query place (lat, lon, ``out``), zero included.

    Grid cells that lie wholly inside the circle add their count; only cells the rim
    crosses are opened point by point.
    """
    size = max(km / geo.KM_PER_DEGREE / 4, 1e-4)
    half_diag = geo.KM_PER_DEGREE * 0.7071068 * 1.0001 * size
    spots = (finite_points(points).groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.count(F.lit(1)).alias("n"))
             .withColumn("gx", geo.grid_index("plat", size)).withColumn("gy", geo.grid_index("plon", size)))
    cells = spots.groupBy("gx", "gy").agg(F.sum("n").alias("n"))
    places = places_of(finite_points(queries))
    asks = (places.withColumn("c", F.explode(geo.covering_cells("lat", "lon", km, size)))
            .select("lat", "lon", "c.gx", "c.gy").join(cells, ["gx", "gy"])
            .withColumn("mid_km", geo.haversine_km("lat", "lon", (F.col("gx") + 0.5) * size, (F.col("gy") + 0.5) * size)))
    inside = asks.filter(F.col("mid_km") + half_diag <= km).select("lat", "lon", "n")
    rim = (asks.filter((F.col("mid_km") + half_diag > km) & (F.col("mid_km") - half_diag <= km)).drop("n")
           .join(spots, ["gx", "gy"])
           .filter(geo.haversine_km("lat", "lon", "plat", "plon") <= km).select("lat", "lon", "n"))
    found = inside.unionByName(rim).groupBy("lat", "lon").agg(F.sum("n").alias("n"))
    return places.join(found, ["lat", "lon"], "left").select("lat", "lon", F.coalesce("n", F.lit(0)).cast("long").alias(out))


def build_cells(points: DataFrame, radius_km: float = CELL_RADIUS_KM) -> DataFrame:
    """Greedy-leader cells: (atm_id, leader_id, seed_lat, seed_lon).

    In order (most fraud first, then id) a point joins the earliest leader in range or
    becomes one. That leader set is the lexicographically first maximal independent set
    of the in-range graph, found in parallel rounds. In each round only the earliest
    undecided place of a grid cell can become a leader, so a place is compared with the few
    contenders of the cells around it and never with all places near it.
    """
    rows = finite_points(points).select("atm_id", "lat", "lon", F.coalesce(F.col("fraud_count").cast("double"), F.lit(0.0)).alias("fraud"))
    order = F.struct((-F.col("fraud")).alias("o"), F.col("atm_id").alias("id"))
    size = radius_km / geo.KM_PER_DEGREE / 1.5
    # the first point of a place decides for all points of that place
    places = (rows.groupBy("lat", "lon").agg(F.min(order).alias("ord"))
              .withColumn("gx", geo.grid_index("lat", size)).withColumn("gy", geo.grid_index("lon", size)))
    places = cut_lineage(places)
    undecided, leaders = places, None

    def around(df):
        return (df.select(F.col("lat").alias("llat"), F.col("lon").alias("llon"), F.col("ord").alias("lord"),
                          F.explode(geo.covering_cells("lat", "lon", radius_km, size)).alias("c"))
                .select("llat", "llon", "lord", "c.gx", "c.gy"))

    in_range = geo.haversine_km("lat", "lon", "llat", "llon") <= radius_km
    while not undecided.isEmpty():
        contenders = (undecided.groupBy("gx", "gy").agg(F.min_by(F.struct("lat", "lon", "ord"), F.col("ord")).alias("s")).select("s.*"))
        beaten = (undecided.join(around(contenders), ["gx", "gy"])
                  .filter((F.col("ord") < F.col("lord")) & in_range).select(F.col("lord").alias("ord")).distinct())
        fresh = contenders.join(beaten, "ord", "left_anti")
        settled = (undecided.join(around(fresh), ["gx", "gy"]).filter(in_range)
                   .groupBy("ord").agg(F.max(F.col("ord") == F.col("lord")).alias("leads")))
        # leads: true = leader, false = in range of one, NULL = still open
        outcome = cut_lineage(undecided.join(settled, "ord", "left"))
        won = outcome.filter("leads").select("lat", "lon", "ord")
        leaders = won if leaders is None else leaders.unionByName(won)
        undecided = outcome.filter("leads is null").drop("leads")
    if leaders is None:
        leaders = places.select("lat", "lon", "ord")

    home = (places.join(around(leaders), ["gx", "gy"]).filter(in_range)
            .groupBy("lat", "lon").agg(F.min_by(F.struct("lord", "llat", "llon"), F.col("lord")).alias("h")))
    return (rows.select("atm_id", "lat", "lon").join(home, ["lat", "lon"])
            .select("atm_id", F.col("h.lord.id").alias("leader_id"), F.col("h.llat").alias("seed_lat"), F.col("h.llon").alias("seed_lon")))


def _plurality(members: DataFrame, column: str) -> DataFrame:
    """Most common non-blank value per leader; the earliest member's value wins ties."""
    votes = (members.filter(F.coalesce(F.trim(column), F.lit("")) != "").groupBy("leader_id", column)
             .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")))
    best = F.struct((-F.col("n")).alias("n"), F.col("first"))
    return votes.groupBy("leader_id").agg(F.min_by(column, best).alias(column))


def _steady(column: str):
    """Six decimals; the nudge makes half-way means round alike whatever order they were summed in."""
    return F.round(F.col(column) + 1e-10, 6)


def describe_cells(points: DataFrame, membership: DataFrame) -> DataFrame:
    """One row per cell: id by size then seed latitude, centre of members, place names by plurality."""
    members = (points.join(membership, "atm_id")
               .withColumn("ord", F.struct((-F.coalesce(F.col("fraud_count").cast("double"), F.lit(0.0))).alias("o"), F.col("atm_id").alias("id"))))
    base = members.groupBy("leader_id").agg(
        F.count(F.lit(1)).alias("atm_count"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"),
        F.first("seed_lat").alias("seed_lat"))
    base = number_cells(cut_lineage(base))
    for name in ("district", "state", "city"):
        if name in points.columns:
            base = base.join(_plurality(members, name), "leader_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return base.select("cell_id", "leader_id", _steady("clat").alias("lat"), _steady("clon").alias("lon"),
                       *[c for c in ("district", "state", "city") if c in points.columns], "atm_count")


def number_cells(cells: DataFrame) -> DataFrame:
    """``CELL-001`` is the cell with most members; equal sizes go by seed latitude, then leader id.

    Cells are counted in blocks of member count, so numbering needs no global sort.
    """
    sizes = cells.groupBy("atm_count").agg(F.count(F.lit(1)).alias("n"))
    from .distribution import cumulative
    ahead = (cumulative(sizes.withColumn("neg", -F.col("atm_count")), [], "neg", ["n"])
             .select("atm_count", (F.col("cum_n") - F.col("n")).alias("ahead")))
    w = Window.partitionBy("atm_count").orderBy("seed_lat", "leader_id")
    number = (F.col("ahead") + F.row_number().over(w)).cast("string")
    # at least three digits, never cut
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    return cells.join(ahead, "atm_count").withColumn("cell_id", F.concat(F.lit("CELL-"), padded)).drop("ahead")


def count_in_circles(circles: DataFrame, points: DataFrame, out: str) -> DataFrame:
    """Points inside each distinct circle (lat, lon, km): as ``count_within``, radius per row.

    The grid level follows the radius, so a circle asks a bounded number of cells.
    """
    spots = (finite_points(points).groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon"))
             .agg(F.count(F.lit(1)).alias("n")))
    pyramid = _pyramid(spots.select(F.col("plat").alias("lat"), F.col("plon").alias("lon"), "n"))
    level = F.floor(F.log2(F.greatest(F.col("km"), F.lit(1e-6)) / geo.KM_PER_DEGREE / 3 / FINEST))
    level = F.least(F.lit(LEVELS[-1]), F.greatest(F.lit(0), level)).cast("int")
    base = cut_lineage(circles.select("lat", "lon", "km").distinct())
    spots, pyramid = cut_lineage(spots), cut_lineage(pyramid)
    edge = _size(F.col("level"))
    half_diag = geo.KM_PER_DEGREE * 0.7071068 * 1.0001 * edge
    asks = (base.withColumn("level", level)
            .withColumn("c", F.explode(geo.covering_cells("lat", "lon", "km", edge)))
            .select("lat", "lon", "km", "level", "c.gx", "c.gy").join(pyramid, ["level", "gx", "gy"])
            .withColumn("mid_km", geo.haversine_km("lat", "lon", (F.col("gx") + 0.5) * edge, (F.col("gy") + 0.5) * edge))
            .withColumn("slack_km", half_diag))
    inside = asks.filter(F.col("mid_km") + F.col("slack_km") <= F.col("km")).select("lat", "lon", "km", "n")
    rim = asks.filter((F.col("mid_km") + F.col("slack_km") > F.col("km")) & (F.col("mid_km") - F.col("slack_km") <= F.col("km"))).drop("n")
    used = rim.select("level", "gx", "gy").distinct()
    homes = (spots.select("*", F.explode(F.array(*[F.lit(v) for v in LEVELS])).alias("level"))
             .withColumn("gx", F.floor(geo.grid_index("plat", FINEST) / F.pow(F.lit(2.0), F.col("level"))).cast("int"))
             .withColumn("gy", F.floor(geo.grid_index("plon", FINEST) / F.pow(F.lit(2.0), F.col("level"))).cast("int"))
             .join(used, ["level", "gx", "gy"], "left_semi"))
    opened = (rim.join(homes, ["level", "gx", "gy"])
              .filter(geo.haversine_km("lat", "lon", "plat", "plon") <= F.col("km")).select("lat", "lon", "km", "n"))
    found = inside.unionByName(opened).groupBy("lat", "lon", "km").agg(F.sum("n").alias("n"))
    return base.join(found, ["lat", "lon", "km"], "left").select("lat", "lon", "km", F.coalesce("n", F.lit(0)).cast("long").alias(out))

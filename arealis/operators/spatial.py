"""Spatial joins on grid cells.

Every join here is an equi-join on a cell key followed by an exact test; nothing compares
all points with all shapes. Polygons are cut into row strips, so a test walks the few edges
of one strip rather than a whole coastline. Copies of a coordinate are folded before pairs
are formed, and AQE splits a hot cell's partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import tasks_for

PAIRS_PER_TASK = 20_000_000  # pairs of rows that share a cell or lie in adjacent ones
COPIES = 1000  # rows of one coordinate that travel as one

def floor_to_cell(x: Column, cell: float) -> Column:
    return F.floor(x / cell).cast("long")


def _lon_reach(metres: float, lat: Column) -> Column:
    """Degrees of longitude that hold ``metres`` anywhere up to the latitude; a half circle at the poles."""
    there = F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat))))
    return F.when(there > 1e-9, F.least(F.lit(180.0), metres / (G.M_PER_LAT * there))).otherwise(180.0) if metres else F.lit(0.0)


# --- point in polygon -------------------------------------------------------------------


def ring_edge_rows(polygons: DataFrame, code: str = "code", polygon: str = "polygon") -> DataFrame:
    """(code, feat, part, ring, e): one row per edge; ring 0 is a part's outer ring.

    An area may come as several features; equal features are taken once.
    """
    features = polygons.groupBy(F.col(code).alias("code"), F.xxhash64(polygon).alias("feat")).agg(F.first(polygon).alias("_p"))
    return (
        features.select("code", "feat", F.posexplode("_p").alias("part", "_rings"))
        .select("code", "feat", "part", F.posexplode("_rings").alias("ring", "_pts"))
        .select("code", "feat", "part", "ring", F.explode(G.ring_edges(F.col("_pts"))).alias("e"))
    )


def area_index(polygons: DataFrame, cell: float, code: str = "code", polygon: str = "polygon", tolerance_m: float = 0.0) -> DataFrame:
    """(cy, cx, cands): per grid cell the parts that may contain its points, smallest code
    first, each with only the edges that reach the cell's row."""
    pad_lat = tolerance_m / G.M_PER_LAT
    e = F.col("e")
    rows = F.sequence(
        floor_to_cell(F.least(e.a_lat, e.b_lat) - pad_lat, cell), floor_to_cell(F.greatest(e.a_lat, e.b_lat) + pad_lat, cell)
    )
    strips = (
        ring_edge_rows(polygons, code, polygon).withColumn("cy", F.explode(rows))
        .groupBy("code", "feat", "part", "ring", "cy")
        .agg(F.collect_list("e").alias("edges"), F.min(F.least(e.a_lon, e.b_lon)).alias("lo"), F.max(F.greatest(e.a_lon, e.b_lon)).alias("hi"))
    )
    parts = strips.groupBy("code", "feat", "part", "cy").agg(
        F.max(F.when(F.col("ring") == 0, F.struct("edges"))).alias("rim"),
        F.collect_list(F.when(F.col("ring") > 0, F.col("edges"))).alias("holes"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    pad_lon = _lon_reach(tolerance_m, F.greatest(F.abs("cy"), F.abs(F.col("cy") + 1)) * cell)
    cols = F.sequence(floor_to_cell(F.col("lo") - pad_lon, cell), floor_to_cell(F.col("hi") + pad_lon, cell))
    cand = F.struct("code", "feat", "part", F.coalesce(F.col("rim.edges"), F.array().cast(_EDGES)).alias("rim"), "holes")
    return (
        parts.select("cy", F.explode(cols).alias("cx"), cand.alias("c"))
        .groupBy("cy", "cx").agg(F.sort_array(F.collect_list("c")).alias("cands"))
    )


_EDGES = "array<struct<a_lat:double,a_lon:double,b_lat:double,b_lon:double>>"


def _hits(lat: Column, lon: Column, tolerance_m: float) -> Column:
    """Candidates of the joined cell that contain the point (or come within the tolerance)."""

    def test(c: Column) -> Column:
        inside = G.odd_crossings(c.rim, lat, lon) & ~F.exists(c.holes, lambda h: G.odd_crossings(h, lat, lon))
        if not tolerance_m:
            return inside
        near = lambda edges: F.exists(edges, lambda e: G.segment_distance(lat, lon, e) <= tolerance_m)
        return inside | near(c.rim) | F.exists(c.holes, near)

    return F.filter(F.col("cands"), test)


def _with_cands(points: DataFrame, index: DataFrame, cell: float) -> DataFrame:
    keyed = points.withColumns({"cy": floor_to_cell(F.col("lat"), cell), "cx": floor_to_cell(F.col("lon"), cell)})
    return keyed.join(index, ["cy", "cx"], "left").drop("cy", "cx")


def locate(points: DataFrame, index: DataFrame, cell: float, name: str = "code", tolerance_m: float = 0.0) -> DataFrame:
    """Every point with the smallest code of the areas that contain it; null where none does.

    One join and no second shuffle: a cell has one index row, so points are never multiplied.
    """
    hit = F.get(_hits(F.col("lat"), F.col("lon"), tolerance_m), 0)
    return _with_cands(points, index, cell).withColumn(name, hit.code).drop("cands")


def locate_all(points: DataFrame, index: DataFrame, cell: float, name: str = "code", tolerance_m: float = 0.0) -> DataFrame:
    """One row per point and area that contains it."""
    codes = F.array_distinct(F.transform(_hits(F.col("lat"), F.col("lon"), tolerance_m), lambda c: c.code))
    return _with_cands(points, index, cell).withColumn(name, F.explode(codes)).drop("cands")


def locate_levels(points: DataFrame, levels: dict[str, DataFrame], cell: float) -> DataFrame:
    """One column per level, each from its own index."""
    for name, index in levels.items():
        points = locate(points, index, cell, name)
    return points


# --- distance joins ---------------------------------------------------------------------


def _columns(row: Column, height: float) -> Column:
    """Into how many cells a row of cells, ``height`` degrees high, is cut around the globe, so that a
    step of one radius from the row or its neighbours never leaps over a cell; 1 at the poles."""
    poleward = F.least(F.lit(90.0), F.greatest(F.abs(row - 1), F.abs(row + 2)) * height)
    reach = math.sin(math.radians(height) / 2) / F.cos(F.radians(poleward))
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), reach))) * 1.0001
    return F.when(reach < 1, F.greatest(F.lit(1), F.floor(360 / width))).otherwise(1).cast("long")


def _neighbour_pairs(a: DataFrame, b: DataFrame, radius_m: float, on: Sequence[str] = (), lon_factor: float | None = None) -> DataFrame:
    """Pairs of rows in the same or adjacent cells. ``a`` and ``b`` hold lat/lon under
    ``a_lat, a_lon`` and ``b_lat, b_lon``; ``b`` is the side that is repeated up to nine times.

    Rows of cells are one radius high. Each has cells as wide as its own latitude needs, closed to a ring
    across the 180th meridian; ``b`` enters a neighbouring row by that row's cells. With ``lon_factor``
    distances are those of a plane with that factor everywhere, which has no ring.

    Tasks go by the pairs that cells can form, which bytes don't show; a crowded cell is dealt out over several. A row that
    stands for several has their number in ``_n``.
    """
    height = radius_m / G.M_PER_LAT * 1.001  # no degree of latitude is shorter than this one
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    n = _columns(F.col("_cy"), height)
    flat = radius_m / (G.M_PER_LON * (lon_factor or 1.0)) * 1.001
    column = lambda lon: floor_to_cell(lon, flat) if lon_factor else F.floor(F.pmod(lon + 180, F.lit(360.0)) * n / 360).cast("long")
    side = F.array(*[F.col("_c") + i for i in (-1, 0, 1)])
    beside = side if lon_factor else F.array_distinct(F.transform(side, lambda c: F.pmod(c, n)))
    left = a.withColumn("_cy", floor_to_cell(F.col("a_lat"), height)).withColumn("_cx", column(F.col("a_lon")))
    right = (
        b.withColumn("_dy", near).withColumn("_cy", floor_to_cell(F.col("b_lat"), height) + F.col("_dy"))
        .withColumn("_c", column(F.col("b_lon"))).withColumn("_cx", F.explode(beside)).drop("_dy", "_c")
    )
    keys = ["_cy", "_cx", *on]
    size = lambda df: F.sum("_n") if "_n" in df.columns else F.count(F.lit(1))
    pairs = F.col("_na").cast("double") * F.col("_nb")
    work = left.groupBy(*keys).agg(size(left).alias("_na")).join(right.groupBy(*keys).agg(size(right).alias("_nb")), keys)
    n = tasks_for(work.agg(F.sum(pairs)).first()[0], PAIRS_PER_TASK)
    crowded = work.select(*keys, F.ceil(pairs / PAIRS_PER_TASK).cast("int").alias("_of")).filter("_of > 1")
    of = F.coalesce("_of", F.lit(1))
    left = left.join(crowded, keys, "left").withColumn("_deal", F.pmod(F.xxhash64("a_lat", "a_lon"), of).cast("int"))
    right = right.join(crowded, keys, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), of - 1)))
    met = left.drop("_n", "_of").repartition(n, *keys, "_deal").join(right.drop("_n", "_of").repartition(n, *keys, "_deal"), [*keys, "_deal"])
    return met.drop("_cy", "_cx", "_deal")


def _prefixed(df: DataFrame, p: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else f"{p}_{c}") for c in df.columns])


def _spots(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows of one coordinate as one, with the other columns in the array ``name`` and their number in ``_n``; a
    coordinate with more than ``COPIES`` rows is several."""
    own = [c for c in df.columns if c not in keys] or [keys[0]]
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*own)))
    batch = df.withColumn("_batch", F.floor((row - 1) / COPIES))
    return batch.groupBy(*keys, "_batch").agg(F.collect_list(F.struct(*own)).alias(name), F.count(F.lit(1)).alias("_n")).drop("_batch")


def within_radius(a: DataFrame, b: DataFrame, radius_m: float, earth: float = G.EARTH_MEAN, on: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """All pairs at most ``radius_m`` apart with their distance, rounded to ``digits`` if given; columns get ``a_``/``b_``.

    Distances are computed once per pair of distinct coordinates. Rows sharing a coordinate travel with it and
    are told apart at the end, so copies never multiply the distance work and pairs are never moved.
    """
    a2, b2 = _prefixed(a, "a", on), _prefixed(b, "b", on)
    ka, kb = ["a_lat", "a_lon", *on], ["b_lat", "b_lon", *on]
    spots = _neighbour_pairs(_spots(a2, ka, "_as"), _spots(b2, kb, "_bs"), radius_m, on)
    d = G.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), earth)
    close = spots.withColumn("dist", d).filter(F.col("dist") <= radius_m)
    if digits is not None:
        close = close.withColumn("dist", F.round("dist", digits))
    each = close.withColumn("_a", F.explode("_as")).drop("_as").withColumn("_b", F.explode("_bs")).drop("_bs")
    own = [F.col(f"{s}.{c}") for s, df, k in (("_a", a2, ka), ("_b", b2, kb)) for c in df.columns if c not in k]
    return each.select("a_lat", "a_lon", "b_lat", "b_lon", *on, "dist", *own)


def nearest(a: DataFrame, b: DataFrame, radius_m: float, label: str, flat: bool = False, earth: float = G.EARTH_MEAN) -> DataFrame:
    """Every row of ``a`` with the ``label`` of the closest ``b`` under ``radius_m`` (smallest
    label on a tie); null where none is close. Copies on both sides are folded first."""
    targets = b.groupBy(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).agg(F.min(label).alias("_label"))
    spots = a.select(F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")).distinct()
    cols = [F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
    d = G.flat_distance(*cols) if flat else G.haversine(*cols, earth)
    best = (
        _neighbour_pairs(spots, targets, radius_m, lon_factor=G.NAME_LON_FACTOR if flat else None).withColumn("_d", d)
        .filter(F.col("_d") < radius_m if flat else F.col("_d") <= radius_m)
        .groupBy("a_lat", "a_lon").agg(F.min(F.struct("_d", "_label")).alias("_b"))
        .select(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), F.col("_b._label").alias(f"nearest_{label}"), F.col("_b._d").alias("dist"))
    )
    return a.join(best, ["lat", "lon"], "left")


def preferred_class_within(a: DataFrame, b: DataFrame, radius_m: float, a_id: str, class_rank: Column,
                           earth: float = G.EARTH_ROUND, digits: int | None = None) -> DataFrame:
    """Pairs within the radius whose class is the best one the ``a`` row has any of: the
    preferred class where it occurs, else the fallback. The best class is found by coordinates, then only its pairs are formed."""
    ranked = b.withColumn("rank", class_rank).filter(F.col("rank").isNotNull())
    places = ranked.select(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.col("rank").alias("_rank")).distinct()
    spots = _neighbour_pairs(a.select(F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")).distinct(), places, radius_m)
    d = G.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), earth)
    near = spots.filter(d <= radius_m).groupBy(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).agg(F.min("_rank").alias("_rank"))
    best = a.select(a_id, "lat", "lon").join(near, ["lat", "lon"]).groupBy(a_id).agg(F.min("_rank").alias("_rank"))
    return within_radius(a.join(best, a_id), ranked.withColumn("_rank", F.col("rank")), radius_m, earth, ["_rank"], digits).drop("_rank")


def around_pins(pins: DataFrame, kinds: dict[str, DataFrame], radius_m: float) -> DataFrame:
    """Everything within a radius of each pin: (pin, kind, id, name, dist)."""
    out = None
    for kind, pts in kinds.items():
        p = within_radius(pts.select("id", "name", "lat", "lon"), pins.select(F.col("id").alias("pin"), "lat", "lon"), radius_m)
        p = p.select(F.col("b_pin").alias("pin"), F.lit(kind).alias("kind"), F.col("a_id").cast("string").alias("id"),
                     F.col("a_name").alias("name"), "dist")
        out = p if out is None else out.unionByName(p)
    return out


def category_counts(near: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total and nearest distance per category of a radius read."""
    return near.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("nearest"))


def fold_near_duplicates(near: DataFrame, key: Sequence[str], metres: float) -> DataFrame:
    """Rows of one key in the same distance step become one row with a count, the nearest kept."""
    step = F.floor(F.col("dist") / metres + 0.5)
    return near.groupBy(*key, step.alias("_step")).agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("dist")
    ).drop("_step")


# --- shapes against shapes --------------------------------------------------------------


def edge_cells(edges: DataFrame, cell: float, pad_m: float = 0.0) -> DataFrame:
    """Edges with the cells that they come within ``pad_m`` of: row by row, only the stretch inside the row."""
    e, pad = F.col("e"), pad_m / G.M_PER_LAT
    low, high = F.least(e.a_lat, e.b_lat), F.greatest(e.a_lat, e.b_lat)
    rows = edges.withColumn("cy", F.explode(F.sequence(floor_to_cell(low - pad, cell), floor_to_cell(high + pad, cell))))
    # longitudes of the edge between the row's padded borders
    at = lambda lat: F.when(high > low, e.a_lon + (e.b_lon - e.a_lon) * (lat - e.a_lat) / (e.b_lat - e.a_lat))
    south, north = F.greatest(low, F.col("cy") * cell - pad), F.least(high, (F.col("cy") + 1) * cell + pad)
    west = F.coalesce(F.least(at(south), at(north)), F.least(e.a_lon, e.b_lon))
    east = F.coalesce(F.greatest(at(south), at(north)), F.greatest(e.a_lon, e.b_lon))
    side = _lon_reach(pad_m, F.greatest(F.abs("cy"), F.abs(F.col("cy") + 1)) * cell + pad) + 1e-9
    return rows.withColumn("cx", F.explode(F.sequence(floor_to_cell(west - side, cell), floor_to_cell(east + side, cell))))


def _side(p: Column, q: Column, e: Column) -> Column:
    """Sign of the turn from edge ``e`` to the point (p, q)."""
    return F.signum((e.b_lon - e.a_lon) * (p - e.a_lat) - (e.b_lat - e.a_lat) * (q - e.a_lon))


def _on_box(p: Column, q: Column, e: Column) -> Column:
    return p.between(F.least(e.a_lat, e.b_lat), F.greatest(e.a_lat, e.b_lat)) & q.between(F.least(e.a_lon, e.b_lon), F.greatest(e.a_lon, e.b_lon))


def segments_meet(e: Column, f: Column) -> Column:
    """Two closed segments share a point."""
    s1, s2 = _side(f.a_lat, f.a_lon, e), _side(f.b_lat, f.b_lon, e)
    s3, s4 = _side(e.a_lat, e.a_lon, f), _side(e.b_lat, e.b_lon, f)
    proper = (s1 * s2 < 0) & (s3 * s4 < 0)
    touch = (
        ((s1 == 0) & _on_box(f.a_lat, f.a_lon, e)) | ((s2 == 0) & _on_box(f.b_lat, f.b_lon, e))
        | ((s3 == 0) & _on_box(e.a_lat, e.a_lon, f)) | ((s4 == 0) & _on_box(e.b_lat, e.b_lon, f))
    )
    return proper | touch


def line_edge_rows(lines: DataFrame, id_col: str = "id", path: str = "path") -> DataFrame:
    """(id, e) of open lines given as arrays of vertices."""
    return lines.select(F.col(id_col).alias("id"), F.explode(G.path_edges(F.col(path))).alias("e"))


def lines_touch_areas(lines: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Distinct (id, code) of lines that cross an area's border or start inside it."""
    border = edge_cells(ring_edge_rows(polygons).select("code", F.col("e").alias("f")).withColumn("e", F.col("f")), cell).drop("e")
    mine = edge_cells(line_edge_rows(lines), cell)
    crossing = mine.join(border, ["cy", "cx"]).filter(segments_meet(F.col("e"), F.col("f"))).select("id", "code")
    start = lines.select("id", F.get("path", 0).alias("p")).select("id", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    inside = locate_all(start, area_index(polygons, cell), cell).select("id", "code")
    return crossing.unionByName(inside).distinct()


def with_override(touching: DataFrame, items: DataFrame, override: str = "override") -> DataFrame:
    """Touched areas, or the hand-written list where the join found none."""
    missing = items.join(touching.select("id").distinct(), "id", "left_anti")
    listed = F.filter(F.transform(F.split(F.coalesce(F.col(override), F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    return touching.select("id", "code").unionByName(missing.select("id", F.explode(listed).alias("code")))


def points_near_areas(points: DataFrame, polygons: DataFrame, cell: float, radius_m: float) -> DataFrame:
    """(id, code, dist): points inside an area at distance 0, others at most ``radius_m`` from
    its border, measured on the plane true at the area's middle latitude."""
    inside = locate_all(points, area_index(polygons, cell), cell).select("id", "code", F.lit(0.0).alias("dist"))
    mid = ring_edge_rows(polygons).filter("ring = 0").groupBy("code").agg(
        ((F.min("e.a_lat") + F.max("e.a_lat")) / 2).alias("lat0")
    )
    border = edge_cells(ring_edge_rows(polygons).select("code", "e"), cell, radius_m)
    keyed = points.select("id", "lat", "lon").withColumns({"cy": floor_to_cell(F.col("lat"), cell), "cx": floor_to_cell(F.col("lon"), cell)})
    near = (
        keyed.join(border, ["cy", "cx"]).join(mid, "code")
        .groupBy("id", "code").agg(F.min(G.segment_distance(F.col("lat"), F.col("lon"), F.col("e"), F.col("lat0"), G.M_PER_LON)).alias("dist"))
        .filter(F.col("dist") <= radius_m)
    )
    return inside.unionByName(near).groupBy("id", "code").agg(F.min("dist").alias("dist"))


def sample_lines(lines: DataFrame, metres: float) -> DataFrame:
    """(id, lat, lon): points along lines, every segment cut into equal steps of at most
    ``metres``, both ends of the line included."""
    e = F.col("e")
    kx = F.cos(F.radians((e.a_lat + e.b_lat) / 2)) * G.M_PER_LON
    length = F.hypot((e.b_lon - e.a_lon) * kx, (e.b_lat - e.a_lat) * G.M_PER_LAT)
    n = F.greatest(F.lit(1), F.ceil(length / metres)).cast("long")
    edges = lines.select("id", F.posexplode(G.path_edges(F.col("path"))).alias("i", "e")).withColumn("n", n)
    steps = edges.select("id", "i", "e", "n", F.explode(F.sequence(F.when(F.col("i") == 0, F.lit(0)).otherwise(F.lit(1)).cast("long"), "n")).alias("k"))
    share = F.col("k") / F.col("n")
    return steps.select(
        "id", F.col("i").alias("seg"), "k",
        (e.a_lat + (e.b_lat - e.a_lat) * share).alias("lat"), (e.a_lon + (e.b_lon - e.a_lon) * share).alias("lon"),
    )


def assign_by_majority(samples: DataFrame, stretches: DataFrame, metres: float, max_m: float, cell: float) -> DataFrame:
    """Per area, the stretch most of its samples are nearest to, and the others by length.

    ``samples``: (id, seg, k, lat, lon); ``stretches``: (code, path).
    """
    edges = edge_cells(line_edge_rows(stretches, "code").withColumnRenamed("id", "stretch"), cell, max_m)
    keyed = samples.withColumns({"cy": floor_to_cell(F.col("lat"), cell), "cx": floor_to_cell(F.col("lon"), cell)})
    d = G.segment_distance(F.col("lat"), F.col("lon"), F.col("e"))
    best = (
        keyed.join(edges, ["cy", "cx"]).withColumn("d", d).filter(F.col("d") <= max_m)
        .groupBy("id", "seg", "k").agg(F.min(F.struct("d", "stretch")).alias("b"))
    )
    shared = best.groupBy("id", F.col("b.stretch").alias("stretch")).agg((F.count(F.lit(1)) * metres).alias("shared_m"))
    order = Window.partitionBy("id").orderBy(F.col("shared_m").desc(), "stretch")  # few stretches per area
    return shared.withColumn("pos", F.row_number().over(order))


def boxes(polygons: DataFrame, code: str = "code", polygon: str = "polygon") -> DataFrame:
    """Bounding box per area from the outer rings' vertices."""
    pts = polygons.select(F.col(code).alias("code"), F.explode(F.transform(F.col(polygon), lambda part: F.element_at(part, 1))).alias("r"))
    v = pts.select("code", F.explode("r").alias("p"))
    return v.groupBy("code").agg(
        F.min("p.lat").alias("south"), F.min("p.lon").alias("west"), F.max("p.lat").alias("north"), F.max("p.lon").alias("east")
    )


def boxes_touching_circle(bbox: DataFrame, pins: DataFrame, radius_m: float, cell: float) -> DataFrame:
    """(pin, code, own): areas whose box meets the box of a circle, the pin's own area first.

    Both boxes are spread over coarse cells, so this is an equi-join as well.
    """
    dlat, dlon = F.lit(radius_m / G.M_PER_LAT), F.lit(radius_m) / (F.cos(F.radians("lat")) * G.M_PER_LON)
    p = pins.select("pin", "own", (F.col("lat") - dlat).alias("s"), (F.col("lon") - dlon).alias("w"),
                    (F.col("lat") + dlat).alias("n"), (F.col("lon") + dlon).alias("e"))

    def spread(df: DataFrame, s: str, w: str, n: str, e: str) -> DataFrame:
        return df.withColumn("cy", F.explode(F.sequence(floor_to_cell(F.col(s), cell), floor_to_cell(F.col(n), cell)))).withColumn(
            "cx", F.explode(F.sequence(floor_to_cell(F.col(w), cell), floor_to_cell(F.col(e), cell))))

    j = spread(p, "s", "w", "n", "e").join(spread(bbox, "south", "west", "north", "east"), ["cy", "cx"])
    meets = (F.col("south") <= F.col("n")) & (F.col("north") >= F.col("s")) & (F.col("west") <= F.col("e")) & (F.col("east") >= F.col("w"))
    hits = j.filter(meets).select("pin", "code", (F.col("code") == F.col("own")).alias("own")).distinct()
    mine = pins.filter(F.col("own").isNotNull()).select("pin", F.col("own").alias("code"), F.lit(True).alias("own"))
    return hits.unionByName(mine).distinct()


# --- cell coverage ------------------------------------------------------------------------


def coverage(polygons: DataFrame, cell: float, code: str = "code", polygon: str = "polygon") -> DataFrame:
    """(code, cy, cx): cells whose centre lies in the area, by filling each row between the
    crossings of its middle line; cells are never tested one by one."""
    e = F.col("e")
    half = cell / 2
    rows = F.sequence(floor_to_cell(F.least(e.a_lat, e.b_lat), cell), floor_to_cell(F.greatest(e.a_lat, e.b_lat), cell))
    mid = F.col("cy") * cell + half
    at = (e.b_lon - e.a_lon) * (mid - e.a_lat) / (e.b_lat - e.a_lat) + e.a_lon
    crossings = (
        ring_edge_rows(polygons, code, polygon).withColumn("cy", F.explode(rows))
        .filter((e.a_lat > mid) != (e.b_lat > mid))
        .groupBy("code", "feat", "part", "cy").agg(F.sort_array(F.collect_list(at)).alias("xs"))
    )
    pairs = F.explode(F.sequence(F.lit(0), (F.floor(F.size("xs") / 2) - 1).cast("int"))).alias("i")
    spans = crossings.filter(F.size("xs") >= 2).select("code", "cy", "xs", pairs)
    lo, hi = F.get("xs", (F.col("i") * 2).cast("int")), F.get("xs", (F.col("i") * 2 + 1).cast("int"))
    # first and last cell whose centre x satisfies lo <= x < hi
    first, last = F.ceil((lo - half) / cell).cast("long"), (F.ceil((hi - half) / cell) - 1).cast("long")
    filled = spans.select("code", "cy", first.alias("f"), last.alias("l")).filter(F.col("f") <= F.col("l"))
    return filled.select("code", "cy", F.explode(F.sequence("f", "l")).alias("cx")).distinct()


def overlap(a: DataFrame, b: DataFrame, cell_area: Column | float) -> DataFrame:
    """(a, b, area): overlap of two coverages, largest first per ``a`` (position in ``pos``)."""
    area = cell_area if isinstance(cell_area, Column) else F.lit(cell_area)
    j = a.withColumnRenamed("code", "a").join(b.withColumnRenamed("code", "b"), ["cy", "cx"])
    s = j.groupBy("a", "b").agg(F.sum(area).alias("area"), F.count(F.lit(1)).alias("cells"))
    order = Window.partitionBy("a").orderBy(F.col("cells").desc(), "b")  # areas overlapping one area
    return s.withColumn("pos", F.row_number().over(order))


def members_and_marginal(shares: DataFrame, min_area: float) -> DataFrame:
    """Areas overlapped by at least ``min_area`` are members, the others marginal."""
    big = F.col("area") >= min_area
    return shares.groupBy("a").agg(
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(big, F.col("b"))))).alias("members"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(~big, F.col("b"))))).alias("marginal"),
    )


def merge_same_name(features: DataFrame) -> DataFrame:
    """Features sharing name and dominant parent become one under the lowest code, with all
    codes kept and their parts joined."""
    return features.groupBy("name", "parent").agg(
        F.min("code").alias("code"), F.sort_array(F.collect_list("code")).alias("codes"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("code", "polygon"))), lambda s: s.polygon)).alias("polygon"),
    )


def pool_cells(cells: DataFrame, value: str) -> DataFrame:
    """2 x 2 max pooling of a cell table; cells without data are dropped first."""
    return (
        cells.filter(F.col(value) > 0)
        .groupBy(F.floor(F.col("cy") / 2).alias("cy"), F.floor(F.col("cx") / 2).alias("cx")).agg(F.max(value).alias(value))
    )


def line_through(stations: DataFrame) -> DataFrame:
    """A line's path through its stations in order; fewer than two give none."""
    s = stations.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("ord", "lat", "lon"))).alias("s"))
    return s.filter(F.size("s") >= 2).select("line", F.transform("s", lambda p: F.struct(p.lat.alias("lat"), p.lon.alias("lon"))).alias("path"))


def density_clusters(points: DataFrame, cell_lat: float, cell_lon: float) -> DataFrame:
    """Per grid cell: count, centroid and dominant category (smallest name on a tie)."""
    per_cat = points.groupBy(
        F.floor(F.col("lat") / cell_lat).alias("cy"), F.floor(F.col("lon") / cell_lon).alias("cx"), "cat"
    ).agg(F.count(F.lit(1)).alias("k"), F.sum("lat").alias("sy"), F.sum("lon").alias("sx"))
    return per_cat.groupBy("cy", "cx").agg(
        F.sum("k").alias("n"), (F.sum("sy") / F.sum("k")).alias("lat"), (F.sum("sx") / F.sum("k")).alias("lon"),
        F.min_by("cat", F.struct(-F.col("k"), F.col("cat"))).alias("top_cat"),
    )


def exposure(points: DataFrame, zones: DataFrame, horizons: Sequence[str], levels: dict[str, str], cell: float,
             tolerance_m: float = 5.0) -> DataFrame:
    """(level, code, horizon, n, n_in_zone, pct): units inside each horizon's zone, as a share
    of the level's own units. Zones: (horizon, polygon); a unit is counted once per horizon."""
    index = area_index(zones, cell, code="horizon", tolerance_m=tolerance_m)
    hit = locate_all(points, index, cell, "horizon", tolerance_m)
    by_level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).cast("string").alias("code")) for k, c in levels.items()]))
    total = points.select(by_level.alias("a")).groupBy("a.level", "a.code").agg(F.count(F.lit(1)).alias("n"))
    inside = hit.select("horizon", by_level.alias("a")).groupBy("a.level", "a.code", "horizon").agg(F.count(F.lit(1)).alias("k"))
    spine = total.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    j = spine.join(inside, ["level", "code", "horizon"], "left")
    k = F.coalesce("k", F.lit(0).cast("long"))
    return j.select("level", "code", "horizon", "n", k.alias("n_in_zone"), (k * 100 / F.col("n")).alias("pct"))

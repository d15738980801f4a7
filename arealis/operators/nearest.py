"""The k nearest of every category to every pin, however far they are.

No radius is given and none is guessed. Items hang in a tree of grid cells, each with the box of what it holds and the number of
items; a cell is cut into sixty-four as long as it holds more than ``LEAF``. A search goes down level by level for all
pins at once: per pin and category, the cells taken in order of the farthest they can be hold k items at some distance D, so
whatever is nearer than the k-th item lies in a cell that can come within D. Other cells go, the rest are cut. What is
left are a few leaves per pin at any density, and only their items are measured. Each level is a join by cell and a window over
one pin's cells; there is no step that pairs pins with all items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut_lineage, tasks_for
from .graph import box_far, box_near
from .overlay import contained, path_segments
from .spatial import ring_edge_rows

LEAF = 32  # items that a cell may hold uncut
DEEPEST = 24  # halvings of the globe: cells of about two metres
STEP = 3  # halvings from one level to the next
ROWS_PER_TASK = 200_000  # pins beside cells, or beside the items of a leaf

def _planar(lat: Column, lon: Column, box: Column, far: bool) -> Column:
    """Metres to the nearest or farthest place of a box, on the plane true at the pin's latitude."""
    kx, ky = F.cos(F.radians(lat)) * G.M_PER_LON, G.M_PER_LAT
    if far:
        dy, dx = F.greatest(F.abs(box.n - lat), F.abs(lat - box.s)), F.greatest(F.abs(box.e - lon), F.abs(lon - box.w))
    else:
        dy, dx = F.greatest(F.lit(0.0), box.s - lat, lat - box.n), F.greatest(F.lit(0.0), box.w - lon, lon - box.e)
    return F.hypot(dy * ky, dx * kx)


def _spherical(lat: Column, lon: Column, box: Column, far: bool) -> Column:
    spot = F.struct(lat.alias("s"), lat.alias("n"), lon.alias("w"), lon.alias("e"))
    return (box_far if far else box_near)(spot, box)


def _finest(items: DataFrame) -> DataFrame:
    """Items with the finest cell (``fy``, ``fx``) of the middle of their box; rows and columns count from the south-west."""
    side = 1 << DEEPEST
    whole = lambda share: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(share * side))).cast("long")
    lat, lon = (F.col("box.s") + F.col("box.n")) / 2, (F.col("box.w") + F.col("box.e")) / 2
    return items.withColumns({"fy": whole((lat + 90) / 180), "fx": whole((lon + 180) / 360)})


def _by_level(df: DataFrame, deepest: int) -> DataFrame:
    """A row for every level, with the cell (``y``, ``x``) that the finest one lies in there."""
    at = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest), F.lit(STEP))))
    cut = lambda c: F.expr(f"shiftright({c}, {DEEPEST} - level)")
    return at.withColumns({"y": cut("fy"), "x": cut("fx")})


def _above(df: DataFrame) -> DataFrame:
    """Cells with the one they were cut from."""
    return df.withColumns({"py": F.shiftright("y", STEP), "px": F.shiftright("x", STEP)})


def _tree(placed: DataFrame) -> DataFrame:
    """(cat, level, y, x, n, home, box, leaf) of every cell that a search can come to: pieces, items that have their first
    piece there (those of different cells are different items), and whether it is cut no further."""
    box = F.struct(F.min("box.s").alias("s"), F.max("box.n").alias("n"), F.min("box.w").alias("w"), F.max("box.e").alias("e")).alias("box")
    finest = placed.groupBy("cat", "fy", "fx").agg(F.count(F.lit(1)).alias("n"), F.sum("home").alias("home"), box)
    every = _by_level(finest, DEEPEST).groupBy("cat", "level", "y", "x").agg(F.sum("n").alias("n"), F.sum("home").alias("home"), box)
    every = cut_lineage(every.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == DEEPEST)))
    inner = every.filter(~F.col("leaf")).select("cat", (F.col("level") + STEP).alias("level"), F.col("y").alias("py"), F.col("x").alias("px"))
    below = _above(every).join(inner, ["cat", "level", "py", "px"], "left_semi").select(*every.columns)
    return every.filter("level = 0").unionByName(below)


def _beside(reached: DataFrame, held: DataFrame) -> tuple[DataFrame, int]:
    """Rows of ``reached`` joined with those of ``held`` under the same cell, and the number of tasks they are dealt out over.

    A few pins can stand for many rows, so tasks go by the rows that come out. A cell with more of them than a task
    takes is cut by its pins and has what it holds once for every cut; there are no more such cells than tasks.
    """
    cell = ["cat", "level", "y", "x"]
    asked, given = (df.groupBy(*cell).agg(F.count(F.lit(1)).alias(n)) for df, n in ((reached, "_asked"), (held, "_held")))
    pairs = cut_lineage(asked.join(given, cell).select(*cell, (F.col("_asked") * F.col("_held")).alias("_rows")))
    n = tasks_for(pairs.agg(F.sum("_rows")).first()[0], ROWS_PER_TASK)
    crowded = F.broadcast(pairs.filter(F.col("_rows") > ROWS_PER_TASK).select(*cell, F.ceil(F.col("_rows") / ROWS_PER_TASK).alias("_cuts")))
    cuts = F.coalesce("_cuts", F.lit(1))
    of_pins = reached.join(crowded, cell, "left").withColumn("_cut", F.pmod(F.xxhash64("lat", "lon"), cuts)).drop("_cuts")
    copies = held.join(crowded, cell, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1))).drop("_cuts")
    return of_pins.repartition(n, *cell, "_cut").join(copies, [*cell, "_cut"]).drop("_cut"), n


def _search(spots: DataFrame, items: DataFrame, k: int, bound: Callable[..., Column], distance: Column) -> DataFrame:
    """(lat, lon, cat, id, dist): for every spot (lat, lon) at least all items that can be among its k nearest.

    ``items``: (cat, id, home, box, ...), with ``home`` 1 for one piece of each item and 0 for its others.
    """
    placed = cut_lineage(_finest(items))
    tree = cut_lineage(_tree(placed))
    deepest = tree.agg(F.max("level")).first()[0] or 0
    lat, lon, own = F.col("lat"), F.col("lon"), ["lat", "lon", "cat"]
    # a cell goes on as those it is cut into, a leaf as itself
    at = ["level", "y", "x"]
    step = F.struct(*at, "home", "box").alias("next")
    onward = _above(tree.filter("level > 0")).select("cat", (F.col("level") - STEP).alias("level"), F.col("py").alias("y"), F.col("px").alias("x"), step)
    onward = onward.unionByName(tree.filter("leaf").select("cat", *at, step))
    reachable = lambda far: F.col("limit").isNull() | (far <= F.col("limit") * (1 + 1e-9) + 1e-6)
    # the roots are one row a category, and every pin reaches them
    roots = F.broadcast(tree.filter("level = 0").select("cat", *at))
    reached = cut_lineage(spots.join(roots, how="inner", on=F.lit(True)).select(*own, *at, F.lit(None).cast("double").alias("limit")))
    for _ in range(STEP, deepest + 1, STEP):
        cut, n = _beside(reached.drop("limit"), onward)
        by_far = Window.partitionBy(*own).orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = cut.select(*own, "next.*").repartition(n, *own).withColumn("far", bound(lat, lon, F.col("box"), True)).withColumn("so_far", F.sum("home").over(by_far))
        limit = F.min(F.when(F.col("so_far") >= k, F.col("far"))).over(Window.partitionBy(*own))
        near = bound(lat, lon, F.col("box"), False)
        reached = cut_lineage(seen.withColumn("limit", limit).filter(reachable(near)).select(*own, *at, "limit"))
    leaves = tree.filter("leaf").select("cat", "level", "y", "x")
    hung = cut_lineage(_by_level(placed, deepest).join(leaves, ["cat", "level", "y", "x"]).drop("fy", "fx"))
    met, _ = _beside(reached, hung)
    # k items lie within the limit, so what lies beyond it isn't measured
    measured = met.filter(reachable(bound(lat, lon, F.col("box"), False))).select(*own, "id", distance.alias("dist"))
    return measured.groupBy(*own, "id").agg(F.min("dist").alias("dist"))


def _first(found: DataFrame, pins: DataFrame, k: int) -> DataFrame:
    """(pin, cat, pos, id, dist) of the k nearest, the smaller id on a tie."""
    order = Window.partitionBy("lat", "lon", "cat").orderBy("dist", "id")  # a few leaves' items
    best = found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
    return pins.join(best, ["lat", "lon"]).select("pin", "cat", "pos", "id", "dist")


def nearest_points(pins: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(pin, cat, pos, id, dist): the k nearest points (cat, id, lat, lon) of every category by great-circle distance. Pins
    (pin, lat, lon) at one place are searched once. Of points at one place the k smallest ids are enough."""
    known = points.filter("lat is not null and lon is not null")
    same = Window.partitionBy("cat", "lat", "lon").orderBy("id")
    few = known.select("cat", "id", "lat", "lon").distinct().withColumn("_k", F.row_number().over(same)).filter(F.col("_k") <= k)
    box = F.struct(F.col("lat").alias("s"), F.col("lat").alias("n"), F.col("lon").alias("w"), F.col("lon").alias("e"))
    items = few.select("cat", "id", F.lit(1).alias("home"), box.alias("box"))
    spots = pins.filter("lat is not null and lon is not null")
    dist = G.haversine(F.col("lat"), F.col("lon"), F.col("box.s"), F.col("box.w"))
    return _first(_search(spots.select("lat", "lon").distinct(), items, k, _spherical, dist), spots, k)


def nearest_shapes(pins: DataFrame, shapes: DataFrame, k: int, cell: float) -> DataFrame:
    """(pin, cat, pos, id, dist): the k nearest lines and polygons of every category; 0 inside a polygon. ``shapes``: (cat,
    id, polygon, path), one of both null; distances on the plane true at the pin's latitude. ``cell`` (degrees) serves the test for inside,
    and longer edges hang in the tree as parts of its size; distances are to whole edges."""
    known = shapes.select("cat", "id", "polygon", "path")
    solid = known.filter("polygon is not null")
    name = F.struct("cat", "id")
    rims = ring_edge_rows(solid.select(name.alias("code"), "polygon")).select("code", "e")
    lines = known.filter("polygon is null and path is not null").select(name.alias("code"), F.explode(path_segments(F.col("path"))).alias("e"))
    e, i, cuts = F.col("e"), F.col("part"), F.col("cuts")
    edges = rims.unionByName(lines).distinct().select("code.cat", "code.id", "e")
    # the box of a long slanting edge lies around many pins that are far from it, those of its parts don't
    longest = F.greatest(F.abs(e.b_lat - e.a_lat), F.abs(e.b_lon - e.a_lon))
    parts = edges.withColumn("cuts", F.greatest(F.lit(1), F.coalesce(F.ceil(longest / cell), F.lit(1)))).withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), cuts)))
    at = lambda a, b, k: F.when(k == cuts, b).otherwise(a + (b - a) * (k / cuts))
    lat, lon = [at(e.a_lat, e.b_lat, k) for k in (i - 1, i)], [at(e.a_lon, e.b_lon, k) for k in (i - 1, i)]
    box = F.struct(F.least(*lat).alias("s"), F.greatest(*lat).alias("n"), F.least(*lon).alias("w"), F.greatest(*lon).alias("e"))
    first = edges.groupBy("cat", "id").agg(F.min("e").alias("_first"))
    home = F.when((e == F.col("_first")) & (i == 1), 1).otherwise(0)
    items = parts.join(first, ["cat", "id"]).select("cat", "id", "e", box.alias("box"), home.alias("home"))
    spots = pins.filter("lat is not null and lon is not null")
    places = spots.select("lat", "lon").distinct()
    found = _search(places, items, k, _planar, G.segment_distance(F.col("lat"), F.col("lon"), F.col("e")))
    inside = contained(places.select(F.struct("lat", "lon").alias("id"), "lat", "lon"), solid.select(name.alias("code"), "polygon"), cell)
    within = inside.select("id.lat", "id.lon", "code.cat", F.col("code.id").alias("id"), F.lit(0.0).alias("dist"))
    both = found.unionByName(within.select(*found.columns)).groupBy("lat", "lon", "cat", "id").agg(F.min("dist").alias("dist"))
    return _first(both, spots, k)

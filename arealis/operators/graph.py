"""Single-linkage clusters and connected components."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut_lineage

_LOW, _HIGH = 111100.0, 111400.0  # bounds on metres per degree of latitude
_SUB = 8  # each step of refinement cuts a side into this many
_DEPTH = 2  # steps of refinement before single points are compared


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): smallest node id of each connected component.

    Alternating large-star and small-star rewiring (Kiveris et al., 2014): the number of
    rounds grows with the logarithm of the graph, and a hub only ever meets an aggregate and
    a join. Each round is checkpointed to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = cut_lineage(e)
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        )
        e = cut_lineage(small)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def _is_star_forest(e: DataFrame) -> bool:
    """Every node is either a root or points at exactly one root."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(
        e.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("root"))
    )
    per = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return per.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("root") > 0))).isEmpty()


def box_far(a: Column, b: Column) -> Column:
    """Upper bound of the distance between any two points of two boxes."""
    dy = F.greatest(a.n, b.n) - F.least(a.s, b.s)
    across = F.greatest(a.e, b.e) - F.least(a.w, b.w)
    around = 360 - (F.greatest(a.w, b.w) - F.least(a.e, b.e))  # over the 180th meridian
    lowest = F.least(*[F.when((x.s <= 0) & (x.n >= 0), 0.0).otherwise(F.least(F.abs(x.s), F.abs(x.n))) for x in (a, b)])
    return _arc(dy, F.least(across, around), lowest) * _HIGH


def box_near(a: Column, b: Column) -> Column:
    """Lower bound of the distance between two boxes."""
    dy = F.greatest(F.lit(0.0), a.s - b.n, b.s - a.n)
    across = F.greatest(F.lit(0.0), a.w - b.e, b.w - a.e)
    around = F.greatest(F.lit(0.0), 360 - (F.greatest(a.e, b.e) - F.least(a.w, b.w)))
    highest = F.greatest(*[F.greatest(F.abs(x.s), F.abs(x.n)) for x in (a, b)])
    return _arc(dy, F.least(across, around), highest) * (_LOW * 0.999)


def _arc(dy: Column, dx: Column, lat: Column) -> Column:
    """Degrees of the great circle over ``dy`` and ``dx`` degrees where both ends lie at ``lat``: a bound for ends that
    lie above or below it."""
    up, side = F.sin(F.radians(F.least(F.lit(180.0), dy)) / 2), F.cos(F.radians(lat)) * F.sin(F.radians(F.least(F.lit(180.0), dx)) / 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(up * up + side * side))))


def contracted(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of the links (a, b): component is some member, the same for all of them.

    Each round a node follows its smallest neighbour, and that one's, in an order drawn anew by a hash; nodes that
    follow the same one become one, and links inside it go. A path loses a constant share of its nodes a round whatever their
    numbers, and what is left shrinks, so the rounds together cost about as much as the first. One job a
    round stores who follows whom beside the links that are left, and counts those.
    """
    flat = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    links = cut_lineage(flat(links))
    steps = []
    for salt in range(max_rounds):
        place = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        both = links.select("a", place("b").alias("p")).unionByName(links.select(F.col("b").alias("a"), place("a").alias("p")))
        once = both.groupBy("a").agg(F.min("p").alias("p")).select("a", F.least("p", place("a")).to.alias("b"))
        step = once.join(once.select(F.col("a").alias("b"), F.col("b").alias("to")), "b").select("a", F.col("to").alias("b"))
        ends = links
        for c in "ab":
            ends = ends.join(step.select(F.col("a").alias(c), F.col("b").alias("_to")), c).drop(c).withColumnRenamed("_to", c)
        seen = Observation()
        left = F.count_if(~F.col("step")).alias("left")
        kept = cut_lineage(flat(ends).withColumn("step", F.lit(False)).unionByName(step.withColumn("step", F.lit(True))).observe(seen, left))
        links = kept.filter("not step").drop("step")
        steps.append(kept.filter("step").drop("step"))
        if not seen.get["left"]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # from the last round, which has the fewest nodes, back to the first
    found = steps.pop()
    while steps:
        later = found.select(F.col("a").alias("b"), F.col("b").alias("last"))
        found = steps.pop().join(later, "b", "left").select("a", F.coalesce("last", "b").alias("b"))
    return found.select(F.col("a").alias("id"), F.col("b").alias("component"))


def single_linkage(points: DataFrame, group: Sequence[str], radius_m: Column | float) -> DataFrame:
    """Points (id, lat, lon, group...) with ``component``: chains of steps up to the radius
    inside a group. The radius may depend on the group. Any latitude and the 180th meridian are covered:
    rows of tiles close to a ring, and a tile looks as far along its row as its latitude needs.

    Tiles small enough that all their points are linked become the nodes, so a crowded spot
    is one node instead of all its pairs. Two tiles are linked when the boxes of their points prove it.
    Pairs that boxes cannot decide are cut finer, and only what is still open then is compared
    point by point, on distinct coordinates. Every level is stored once, and nodes are plain numbers.
    """
    keys = list(group)
    radius = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    # a whole number of tiles around the globe
    around = F.ceil(360 * math.sqrt(2) * _HIGH / radius).cast("long")
    finest = 360 / (around * _SUB**_DEPTH)
    # the finest grid is counted once and coarser ones follow from it, so all levels agree
    east = F.pmod(F.col("lon") + 180, F.lit(360.0))
    grid = {f"y{_DEPTH}": F.floor(F.col("lat") / finest), f"x{_DEPTH}": F.floor(east / finest), "_r": radius,
            "_g": F.struct(*keys) if keys else F.lit(0)}  # a struct, so that a null key is a key
    tiled = points.withColumns(grid)
    for d in range(_DEPTH - 1, -1, -1):
        tiled = tiled.withColumns({f"{c}{d}": F.floor(F.col(f"{c}{d + 1}") / _SUB) for c in "yx"})
    # read several times below, and whatever produced the points may be a long job
    tiled = cut_lineage(tiled)
    own = lambda d: [f"y{d}", f"x{d}"]
    box = F.struct(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")).alias("box")
    # numbered once and checkpointed: an id may occur in several groups
    nodes = cut_lineage(
        tiled.groupBy("_g", "_r", *own(0)).agg(F.min("id").alias("first"), box).withColumn("node", F.monotonically_increasing_id())
    )
    tiled = cut_lineage(tiled.join(nodes.select("_g", *own(0), "node"), ["_g", *own(0)]).drop("_g", "_r", *own(0)))
    # a group of one tile has nothing to link
    several = nodes.groupBy("_g").agg(F.min("node").alias("g"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("_g", "g")
    tiles = nodes.join(several, "_g").select("g", "node", "_r", "box", *own(0))

    reach_y = math.ceil(math.sqrt(2) * _HIGH / _LOW)
    # columns that a row's tiles look through: as many as the poleward end of what they reach needs
    tile = 360 / F.ceil(360 * math.sqrt(2) * _HIGH / F.col("_r"))
    poleward = F.least(F.lit(90.0), (F.greatest(F.abs("y0"), F.abs(F.col("y0") + 1)) + reach_y) * tile)
    need = F.sin(F.radians(F.col("_r") / (_LOW * 0.999)) / 2) / F.cos(F.radians(poleward))
    span = F.when(need < 1, F.degrees(2 * F.asin(F.least(F.lit(1.0), need)))).otherwise(180.0)
    n_around = F.ceil(360 * math.sqrt(2) * _HIGH / F.col("_r")).cast("long")
    reach_x = F.least(F.ceil(span / tile).cast("long"), F.floor(n_around / 2).cast("long"))
    seek = tiles.withColumns({"_n": n_around, "_x": F.explode(F.sequence(-reach_x, reach_x))}).withColumn(
        "_y", F.explode(F.array(*[F.lit(i) for i in range(reach_y + 1)]))).filter("_y > 0 or _x > 0")
    there = seek.select("g", "_r", F.col("node").alias("a"), F.col("box").alias("box_a"),
                        (F.col("y0") + F.col("_y")).alias("y0"), F.pmod(F.col("x0") + F.col("_x"), F.col("_n")).alias("x0"))
    here = tiles.select("g", F.col("node").alias("b"), F.col("box").alias("box_b"), *own(0))

    def judged(pairs: DataFrame) -> DataFrame:
        """Pairs that may be near, stored, with whether their boxes prove it."""
        near = pairs.filter(box_near(F.col("box_a"), F.col("box_b")) <= F.col("_r"))
        return cut_lineage(near.withColumn("sure", box_far(F.col("box_a"), F.col("box_b")) <= F.col("_r")).drop("box_a", "box_b"))

    def side(df: DataFrame, up: Sequence[str], tag: str, keep: Sequence[str]) -> DataFrame:
        """One side of a pair: its node, the cell it lies in and what it brings, named after the side."""
        return df.select(F.col("node").alias(tag), *[F.col(c).alias(f"{c}_{tag}") for c in (*up, *keep)])

    def cut(pairs: DataFrame, df: DataFrame, d: int, keep: Sequence[str]) -> DataFrame:
        """Open pairs of level ``d`` with all rows of ``df`` that lie in their two cells."""
        up = own(d) if d else []
        for t in "ab":
            pairs = pairs.join(side(df, up, t, keep), [t, *[f"{c}_{t}" for c in up]]).drop(*[f"{c}_{t}" for c in up])
        return pairs

    found = judged(there.join(here, ["g", *own(0)]).select("a", "b", "_r", "box_a", "box_b"))
    links, open_pairs = found.filter("sure").select("a", "b"), found.filter("not sure").drop("sure")
    for d in range(1, _DEPTH + 1):
        up = own(d - 1) if d > 1 else []
        found = judged(cut(open_pairs, tiled.groupBy("node", *up, *own(d)).agg(box), d - 1, [*own(d), "box"]))
        sure = found.filter("sure").select("a", "b").distinct()
        links = links.unionByName(sure)
        open_pairs = found.join(sure, ["a", "b"], "left_anti").drop("sure")
    close = cut(open_pairs, tiled.select("node", *own(_DEPTH), "lat", "lon").distinct(), _DEPTH, ["lat", "lon"])
    near = G.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= F.col("_r")
    comp = contracted(links.unionByName(close.filter(near).select("a", "b")))
    member = nodes.select("node", "first").join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("_c", F.coalesce("component", "node"))
    label = member.groupBy("_c").agg(F.min("first").alias("component"))
    placed = member.drop("component").join(label, "_c").select("node", "component")
    return tiled.join(placed, "node").drop("node", *[c for d in range(1, _DEPTH + 1) for c in own(d)])


def cluster_summary(clustered: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Per cluster: centroid, member count and most common name (smallest on a tie)."""
    per_name = clustered.groupBy(*group, "component", name).agg(
        F.count(F.lit(1)).alias("k"), F.sum("lat").alias("sy"), F.sum("lon").alias("sx")
    )
    return per_name.groupBy(*group, "component").agg(
        F.sum("k").alias("platforms"), (F.sum("sy") / F.sum("k")).alias("lat"), (F.sum("sx") / F.sum("k")).alias("lon"),
        F.min_by(name, F.struct(-F.col("k"), F.col(name))).alias("name"),
    )

"""Scans over files that Spark itself derives from the given tables, in the published formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registers as G
from ..operators import timetable as TT
from ..session import scratch_path
from ..sources import cubes as SC
from ..sources import geometry as SG
from ..sources import registers as SR
from . import services as SV
from . import tables as T
from .common import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


def cube_rows(spark, sf):
    """The order cube as the publisher writes it: padded codes, decimal comma, two dots where suppressed."""
    c = T.order_cube(spark, sf).cells()
    cell = F.when(F.col("value").isNull(), "..").otherwise(F.replace(F.format_string("%.1f", "value"), F.lit("."), F.lit(",")))
    return c.select(F.concat(F.lit(" "), F.lpad("area", 4, "0")).alias("OMRÅDE"), F.col("prio").alias("PRIO"), F.col("period").alias("TID"), cell.alias("INDHOLD"))


def write_cube_pulls(spark, sf, folder: str) -> None:
    """The order cube as dated pulls: an older full one and a newer one that lacks two years."""
    rows = cube_rows(spark, sf)
    for date, part in (("2026-06-01", rows), ("2026-07-01", rows.filter(F.substring("TID", 1, 4) > "1996"))):
        part.coalesce(8).write.mode("overwrite").option("sep", ";").option("header", True).csv(f"{folder}/{date}")


@query(f"WITH {T.ORDER_CUBE} SELECT area, prio, period, value FROM oc")
def cube_file_scan(spark, sf):
    """SC1, H1, H3: semicolon file to cube: header and cells trimmed, decimal comma, markers null, codes normalised."""
    folder = scratch_path(spark, "cube")
    write_cube_pulls(spark, sf, folder)
    cube = SC.as_cube(SC.read_raw(spark, f"{folder}/2026-06-01"), "ORDERS1")
    return cube.cells().withColumnRenamed("PRIO", "prio").drop("snapshot_date")


def dated(spark, sf):
    folder = scratch_path(spark, "pulls")
    write_cube_pulls(spark, sf, folder)
    out = None
    for d in ("2026-06-01", "2026-07-01"):
        part = SC.read_raw(spark, f"{folder}/{d}").withColumn("snapshot_date", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {T.ORDER_CUBE} SELECT period, count(*) AS cells FROM oc WHERE y > 1996 GROUP BY period")
def newest_pull_only(spark, sf):
    """SC2, SC3: rows of the newest date, whatever number of files it has."""
    return SC.newest_snapshot(dated(spark, sf)).groupBy(F.col("TID").alias("period")).agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH {T.ORDER_CUBE} SELECT period, count(*) AS cells FROM oc GROUP BY period")
def newest_pull_that_covers(spark, sf):
    """SC4: the newest pull that has every required period (the newer one lacks 1995)."""
    d = SC.newest_covering(dated(spark, sf), {"TID": ["1995K1", "2001K2"], "PRIO": ["1-URGENT"]})
    return d.groupBy(F.col("TID").alias("period")).agg(F.count(F.lit(1)).alias("cells"))


@query("""SELECT 'ORDERS1' AS "table", 'PRIO' AS var, code, text FROM (SELECT DISTINCT o_orderpriority AS code, 'Priority ' || o_orderpriority AS text FROM orders) UNION ALL SELECT 'ORDERS1', 'OMRÅDE', CAST(n_nationkey AS VARCHAR), n_name FROM nation""")
def code_list_scan(spark, sf):
    """SC5, J16: code-list document to one row per code."""
    path = scratch_path(spark, "meta")
    pr = T.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("id"), F.concat(F.lit(" Priority "), "o_orderpriority").alias("text")).distinct().agg(F.collect_list(F.struct("id", "text")).alias("values")).withColumn("var", F.lit("PRIO"))
    ar = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("text")).agg(F.collect_list(F.struct("id", "text")).alias("values")).withColumn("var", F.lit("OMRÅDE"))
    v = pr.unionByName(ar).agg(F.collect_list(F.struct(F.col("var").alias("id"), F.lit(True).alias("elimination"), "values")).alias("variables"))
    v.select(F.lit("ORDERS1").alias("id"), F.lit("Orders").alias("text"), F.lit("2026-07-01T08:00").alias("updated"), "variables").coalesce(1).write.json(path)
    return SC.code_labels(spark, path).select("table", "var", "code", "text")


@query(f"WITH {T.POINTS}, {T.EDGES} SELECT code, CAST(count(DISTINCT ring) AS INTEGER) AS rings, CAST(count(*) AS INTEGER) AS vertices, round(sum(a_lat), 6) AS lat_sum FROM ed GROUP BY code")
def geometry_file_scan(spark, sf):
    """SC7: GeoJSON features to polygons with holes, the closing vertex dropped."""
    path = scratch_path(spark, "geo")
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p.lon, p.lat))
    parts = F.transform("polygon", lambda part: F.transform(part, ring))
    feats = T.nation_polygons(spark, sf).select(
        F.struct(F.col("code").alias("kode"), F.col("name").alias("navn")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")).alias("geometry"))
    feats.write.json(path)
    d = SG.polygons(SG.read_features(spark, path, lines=True), ["kode", "nr"])
    pts = F.flatten(F.element_at("polygon", 1))
    return d.select("code", F.size(F.element_at("polygon", 1)).alias("rings"), F.size(pts).alias("vertices"), F.round(F.aggregate(F.transform(pts, lambda p: p.lat), F.lit(0.0), lambda s, x: s + x), 6).alias("lat_sum"))


@query("SELECT geometry AS kind, n FROM (SELECT 'MultiPolygon' AS geometry, count(*) AS n FROM nation UNION ALL SELECT 'Point', count(*) FROM supplier)")
def feature_counts_by_kind(spark, sf):
    """A51, SC7: features counted by kind of geometry."""
    path = scratch_path(spark, "kinds")
    pt = T.supplier_points(spark, sf).select(F.struct(F.col("id").cast("string").alias("kode")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.to_json(F.array("lon", "lat")).alias("coordinates")).alias("geometry"))
    po = T.nation_polygons(spark, sf).select(F.struct(F.col("code").alias("kode")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), F.lit("[]").alias("coordinates")).alias("geometry"))
    pt.unionByName(po).write.json(path)
    return SG.kinds(SG.read_features(spark, path, lines=True))


@query(f"WITH {SV.CHAIN} SELECT mode, count(*) AS stops FROM md GROUP BY mode")
def timetable_file_scan(spark, sf):
    """SC8, J23: a timetable feed of four files, only the needed columns read."""
    folder = scratch_path(spark, "feed")
    st, trips, routes = SV.timetable(spark, sf)
    text = lambda d: d.select(*[F.col(c).cast("string") for c in d.columns])
    stops = SV.stops(spark, sf).select("stop_id", "stop_name", F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"))
    for name, d in (("stop_times", st.withColumn("arrival_time", F.lit("08:00:00"))), ("trips", trips.withColumn("service_id", F.lit(1))), ("routes", routes), ("stops", stops)):
        text(d).write.option("header", True).csv(f"{folder}/{name}.txt")
    feed = SR.timetable(spark, folder)
    modes = TT.stop_modes(TT.stop_route_types(feed["stop_times"], feed["trips"], feed["routes"]))
    return modes.join(feed["stops"].select("stop_id"), "stop_id", "left_semi").groupBy("mode").agg(F.count(F.lit(1)).alias("stops"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS building, count(*) AS units FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 7 < 5 GROUP BY ALL""")
def register_line_scan(spark, sf):
    """SC6, F8: register lines under an explicit schema, dwelling units only."""
    from ..model import UNIT_SCHEMA

    path = scratch_path(spark, "units")
    k = F.col("o_orderkey")
    T.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("bygning"), F.lit("6").alias("status"), (k % 7 + 1).cast("string").alias("enh023Boligtype"),
                                       F.lit("1").alias("enh045Udlejningsforhold"), F.lit(70.5).alias("enh026EnhedensSamledeAreal"), F.lit(3).alias("enh031AntalVaerelser"), F.lit("x").alias("unused")).write.json(path)
    u = G.dwellings(SR.read_lines(spark, path, UNIT_SCHEMA), status=True)
    return u.groupBy(F.col("bygning").alias("building")).agg(F.count(F.lit(1)).alias("units"))


@query("""SELECT r_name AS name, CAST(round(sum(CAST(round(c_acctbal * 100) AS BIGINT)) / 100 / 1000) AS DOUBLE) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 GROUP BY r_name""")
def piped_text_scan(spark, sf):
    """SC13, H2: ``name | figure`` lines with comments, the national row apart and 0 suppressed."""
    path = scratch_path(spark, "piped")
    c, n, r = (T.table(spark, sf, t) for t in ("customer", "nation", "region"))
    s = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "r_regionkey").agg(F.sum(T.cents("c_acctbal")).alias("s"))
    # thousands get a point, as published
    whole = F.round(F.col("s") / 100 / 1000).cast("long")
    figure = F.when(F.col("r_regionkey") == 2, "0").otherwise(F.regexp_replace(F.format_number(whole, 0), ",", "."))
    lines = s.select(F.concat("r_name", F.lit(" | "), figure).alias("value"))
    extra = s.select(F.explode(F.array(F.lit("# comment | 1"), F.lit(""), F.lit("Hele landet | 9.999"))).alias("value"))
    lines.unionByName(extra).write.text(path)
    areas, _national = SR.piped_lines(spark.read.text(path))
    return areas


@query("SELECT CAST(s_suppkey AS VARCHAR) AS code, CAST(s_suppkey AS DOUBLE) + 0.5::DOUBLE AS value FROM supplier WHERE s_suppkey % 10 <> 3")
def key_value_file_scan(spark, sf):
    """SC12: ``key;value`` rows, unreadable ones skipped."""
    path = scratch_path(spark, "kv")
    k = F.col("s_suppkey")
    d = T.table(spark, sf, "supplier")
    d.select(F.lpad(k.cast("string"), 8, "0").alias("kommune"), F.when(k % 10 == 3, "n/a").otherwise(F.concat(k.cast("string"), F.lit(",5"))).alias("value"), F.lit("name").alias("name")).write.option("sep", ";").option("header", True).csv(path)
    return SR.key_value_csv(spark, path)


@query("SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS komnavn, CAST(s_suppkey * 2 AS VARCHAR) AS value FROM supplier")
def delimiter_sniffed_scan(spark, sf):
    """SC14: tab or comma by the header line, required columns checked."""
    path = scratch_path(spark, "tabs")
    k = F.col("s_suppkey")
    T.table(spark, sf, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("komnavn"), (k * 2).cast("string").alias("value")).write.option("sep", "\t").option("header", True).csv(path)
    return SR.sniffed_csv(spark, path, ["komnavn", "value"])


@query("""SELECT CAST(o_custkey AS VARCHAR) AS institution, CAST(year(o_orderdate) AS VARCHAR) AS year, CASE WHEN count(*) % 4 <> 0 THEN count(*) * 1000.0::DOUBLE + 5 END AS pupils FROM orders GROUP BY ALL""")
def education_row_scan(spark, sf):
    """SC10, H2: bracketed column names to plain ones, Danish figures, suppression null."""
    path = scratch_path(spark, "edu")
    inst, year = "[Institution].[Institutionsnummer]", "[Tid].[Skoleår]"
    n = F.count(F.lit(1))
    d = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("i"), F.year("o_orderdate").cast("string").alias("y")).agg(n.alias("n"))
    fig = F.when(F.col("n") % 4 == 0, "..").otherwise(F.concat(F.col("n").cast("string"), F.lit(".005,0")))
    d.select(F.col("i").alias(SR.bracketed(inst)), F.col("y").alias(SR.bracketed(year)), fig.alias("Antal elever")).write.json(path)
    return SR.education_rows(spark, path, {SR.bracketed(inst): "institution", SR.bracketed(year): "year"}, {"Antal elever": "pupils"})


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS nr, CASE s_suppkey % 5 WHEN 0 THEN 'folkeskole' WHEN 1 THEN 'fri grundskole' WHEN 2 THEN 'specialskole' ELSE 'fri grundskole' END AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'København' ELSE 'NATION_' || CAST(s_nationkey AS VARCHAR) END AS municipality,
  CASE WHEN s_suppkey % 3 > 0 THEN 55.5::DOUBLE + s_suppkey % 10 / 10.0::DOUBLE END AS lat FROM supplier WHERE s_suppkey % 5 <> 4""")
def institution_register_scan(spark, sf):
    """SC11: institution register filtered by type, coordinates null where unreadable."""
    path = scratch_path(spark, "inst")
    k = F.col("s_suppkey")
    kinds = F.when(k % 5 == 0, "Folkeskoler").when(k % 5 == 1, "Friskoler og private grundskoler").when(k % 5 == 2, "Specialskoler for børn").when(k % 5 == 3, "Kommunale internationale skoler").otherwise("Efterskoler")
    lat = F.when(k % 3 > 0, (F.lit(55.5) + k % 10 / F.lit(10.0)).cast("string")).otherwise("ukendt")
    T.table(spark, sf, "supplier").select(
        k.cast("string").alias("Institutionsnummer"), F.col("s_name").alias("Institutionsnavn"), kinds.alias("Institutionstype, navn"),
        F.when(k % 2 == 0, "Københavns Kommune").otherwise(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"), F.lit(" Kommune"))).alias("Beliggenhedskommune"),
        F.lit(" ").alias("Hovedinstitution"), F.lit("2100").alias("Postnummer"), lat.alias("Geokode: Breddegrad"), F.lit("12.5").alias("Geokode: Længdegrad")).write.option("sep", ";").option("header", True).csv(path)
    return SR.institution_register(spark, path).select("nr", "type", "municipality", "lat")


@query(f"WITH {SV.OBJECTS} SELECT DISTINCT type, id FROM cl WHERE cat IS NOT NULL")
def map_object_file_scan(spark, sf):
    """SC9, U8, H24: element documents to classified objects, each once."""
    path = scratch_path(spark, "osm")
    ob = SV.objects(spark, sf).filter(F.size("tags") > 0)
    el = F.struct("type", "id", F.lit(55.0).alias("lat"), F.lit(12.0).alias("lon"), "tags")
    # many small documents, as the source delivers them
    ob.select(F.array(el).alias("elements")).write.json(path)
    one = SR.services(SR.map_object_rows(spark, path))
    return one.select(F.when(F.startswith("osm", F.lit("w")), "way").otherwise("node").alias("type"), F.substring("osm", 2, 20).cast("long").alias("id")).distinct()

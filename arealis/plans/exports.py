"""Exports: inheritance, source cascade, long and wide files, documents and point files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..model import PROPERTY_COLUMNS
from ..operators import exports as E
from ..session import scratch_path
from ..sources import sinks as W
from . import peers as PP
from . import registers as RG
from . import spatial as SP
from . import tables as T
from .common import VALUES, indicator_values, registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

BUILT = "2001-09-01"


def indicators(spark, sf):
    """One registry entry per nation, so that every branch of the source cascade occurs."""
    n = F.col("n_nationkey")
    t = n.cast("string")
    six = n % 6
    text = F.when(six == 3, F.concat(F.lit("Københavns Kommune, KKBOL"), t)).when(six == 5, F.concat(F.lit("BOL10"), t, F.lit(" and FOLK1A")))
    return T.table(spark, sf, "nation").select(
        F.concat(F.lit("ind"), t).alias("key"), F.concat(F.lit("Label "), F.col("n_name")).alias("label"),
        F.when(n % 5 == 0, "kDKK").when(n % 5 == 1, "per 1,000").otherwise("%").alias("unit"), F.when(n % 5 == 0, "kdkk").when(n % 7 == 1, "per1000").otherwise("pct1").alias("fmt"),
        F.when(n % 2 == 0, "higher_better").otherwise("lower_better").alias("direction"),
        F.when(six == 0, F.array(F.concat(F.lit("dst/TAB"), t), F.concat(F.lit("s20/EJ"), t))).alias("tables"),
        F.when(six == 1, F.when(n % 4 == 1, "KKFR2026").otherwise("FRKM126")).alias("proj_table"), F.when(six == 1, F.when(n % 4 == 1, "KK").otherwise("DST")).alias("proj_publisher"),
        F.lit(None).cast("string").alias("proj_db"), F.when(six == 2, F.concat(F.lit("https://klima.example/"), t)).alias("climate_url"),
        F.when(six == 4, "Landsbyggefonden").alias("page_label"), F.when(six == 4, F.when(n % 4 == 0, "https://lbf.example/stat")).alias("page_url"), text.alias("source"))


INDICATORS = """
ind AS (SELECT n_nationkey AS n, 'ind' || CAST(n_nationkey AS VARCHAR) AS key, 'Label ' || n_name AS label,
  CASE n_nationkey % 5 WHEN 0 THEN 'kDKK' WHEN 1 THEN 'per 1,000' ELSE '%' END AS unit, CASE WHEN n_nationkey % 5 = 0 THEN 'kdkk' WHEN n_nationkey % 7 = 1 THEN 'per1000' ELSE 'pct1' END AS fmt,
  CASE WHEN n_nationkey % 2 = 0 THEN 'higher_better' ELSE 'lower_better' END AS direction, n_nationkey % 6 AS br, CAST(n_nationkey AS VARCHAR) AS t FROM nation),
cat AS (SELECT * FROM (
  SELECT 'dst/TAB' || CAST(n_nationkey AS VARCHAR) AS key, 'Danmarks Statistik TAB' || CAST(n_nationkey AS VARCHAR) AS label, '2001-0' || CAST(n_nationkey % 9 + 1 AS VARCHAR) || '-01' AS stamp, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '2001-08-01' END AS fetched,
    CASE WHEN n_nationkey % 12 = 0 THEN 'https://own.example/' || CAST(n_nationkey AS VARCHAR) ELSE '' END AS url, 'free' AS licence FROM nation WHERE n_nationkey % 18 <> 6
  UNION ALL SELECT 's30/KKBOL' || CAST(n_nationkey AS VARCHAR), 'KK', '2001-07-01', '2001-07-02', '', 'cc' FROM nation WHERE n_nationkey % 2 = 1
  UNION ALL SELECT DISTINCT CASE r_regionkey WHEN 0 THEN 'forecast' WHEN 1 THEN 'cph_forecast' WHEN 2 THEN 'climate/climate_index' WHEN 3 THEN 'lbf' ELSE 'bbr' END, r_name || ', projection', '', '2001-06-01', 'https://cat.example/' || r_name, '' FROM region)),
src AS (SELECT ind.*, CASE br WHEN 0 THEN 'TAB' || t || ' EJ' || t WHEN 1 THEN CASE WHEN n % 4 = 1 THEN 'KKFR2026' ELSE 'FRKM126' END WHEN 3 THEN 'KKBOL' || t WHEN 5 THEN 'BOL10' || t ELSE 'n/a (register/curated)' END AS table_id,
  CASE br WHEN 0 THEN 'dst/TAB' || t WHEN 1 THEN CASE WHEN n % 4 = 1 THEN 'cph_forecast' ELSE 'forecast' END WHEN 2 THEN 'climate/climate_index' WHEN 3 THEN 's30/KKBOL' || t WHEN 4 THEN 'lbf' ELSE 'dst/BOL10' || t END AS ck,
  CASE br WHEN 0 THEN 'https://api.statbank.dk/v1/tableinfo/TAB' || t WHEN 1 THEN CASE WHEN n % 4 = 1 THEN 'https://api.statbank.dk/v1/s30/tableinfo/KKFR2026' ELSE 'https://api.statbank.dk/v1/tableinfo/FRKM126' END
    WHEN 2 THEN 'https://klima.example/' || t WHEN 3 THEN 'https://api.statbank.dk/v1/s30/tableinfo/KKBOL' || t WHEN 4 THEN CASE WHEN n % 4 = 0 THEN 'https://lbf.example/stat' END ELSE 'https://api.statbank.dk/v1/tableinfo/BOL10' || t END AS page,
  CASE br WHEN 3 THEN 'Københavns Kommune, KKBOL' || t WHEN 5 THEN 'BOL10' || t || ' and FOLK1A' END AS txt FROM ind),
ws AS (SELECT src.key, src.label, unit, fmt, direction, n, br, table_id, coalesce(txt, nullif(cat.label, ''), 'see Data › Sources') AS source,
  coalesce(CASE WHEN br IN (1, 2, 4) THEN coalesce(page, nullif(url, '')) ELSE coalesce(nullif(url, ''), page) END, '') AS source_url,
  coalesce(nullif(stamp, ''), '2001-09-01') AS cat_as_of, coalesce(nullif(fetched, ''), '2001-09-01') AS fetched, coalesce(licence, '') AS licence FROM src LEFT JOIN cat ON cat.key = src.ck)"""


def catalogue(spark, sf):
    n = F.col("n_nationkey")
    t = n.cast("string")
    nat, reg = T.table(spark, sf, "nation"), T.table(spark, sf, "region")
    dst = nat.filter(n % 18 != 6).select(
        F.concat(F.lit("dst/TAB"), t).alias("key"), F.concat(F.lit("Danmarks Statistik TAB"), t).alias("label"), F.concat(F.lit("2001-0"), (n % 9 + 1).cast("string"), F.lit("-01")).alias("asof"),
        F.when(n % 4 == 0, "").otherwise("2001-08-01").alias("fetched"), F.when(n % 12 == 0, F.concat(F.lit("https://own.example/"), t)).otherwise("").alias("url"), F.lit("free").alias("licence"))
    kk = nat.filter(n % 2 == 1).select(F.concat(F.lit("s30/KKBOL"), t).alias("key"), *[F.lit(v).alias(k) for k, v in (("label", "KK"), ("asof", "2001-07-01"), ("fetched", "2001-07-02"), ("url", ""), ("licence", "cc"))])
    names = K.lookup(F.col("r_regionkey").cast("string"), {"0": "forecast", "1": "cph_forecast", "2": "climate/climate_index", "3": "lbf"}, F.lit("bbr"))
    rest = reg.select(names.alias("key"), F.concat("r_name", F.lit(", projection")).alias("label"), F.lit("").alias("asof"), F.lit("2001-06-01").alias("fetched"), F.concat(F.lit("https://cat.example/"), "r_name").alias("url"), F.lit("").alias("licence"))
    return dst.unionByName(kk).unionByName(rest)


@query(f"WITH {INDICATORS} SELECT key, table_id, source, source_url, cat_as_of, fetched, licence FROM ws")
def source_cascade(spark, sf):
    """Source columns by cascade, catalogue joined once."""
    return E.with_source(indicators(spark, sf), catalogue(spark, sf), BUILT).select("key", "table_id", "source", "source_url", "cat_as_of", "fetched", "licence")


# Values per area and indicator: every nation publishes the indicators whose number shares its
# parity, regions publish all of them.
EXPORT = f"""{VALUES}, {INDICATORS},
v AS (SELECT iv.level, iv.code, ind.key, iv.period, iv.value * (ind.n + 1) AS value FROM iv JOIN ind ON iv.key = 'revenue' AND iv.level IN ('nation', 'region')
  AND ((iv.level = 'nation' AND CAST(iv.code AS INT) % 2 = ind.n % 2) OR (iv.level = 'region' AND ind.n % 3 <> 0))),
ar AS (SELECT 'nation' AS level, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, CAST(n_regionkey AS VARCHAR) AS parent_code, r_name AS parent_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name, '', '', r_name FROM region),
inh AS (SELECT level, code, key, period, value, '' AS inherited_from FROM v
  UNION ALL SELECT a.level, a.code, p.key, max(p.period), max_by(p.value, p.period), a.parent_code FROM ar a JOIN v p ON a.level = 'nation' AND p.level = 'region' AND p.code = a.parent_code
  WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.level = a.level AND o.code = a.code AND o.key = p.key) GROUP BY ALL)"""


def export_values(spark, sf):
    v = indicator_values(spark, sf, ("nation", "region")).filter(F.col("key") == "revenue").drop("key", "parent")
    n = F.substring("ikey", 4, 9).cast("int")
    keys = indicators(spark, sf).select(F.col("key").alias("ikey"))
    j = v.withColumn("_par", F.explode(F.array(F.lit(0), F.lit(1)))).join(keys.withColumn("_par", n % 2), "_par")
    keep = ((F.col("level") == "nation") & (F.col("code").cast("int") % 2 == F.col("_par"))) | ((F.col("level") == "region") & (n % 3 != 0))
    # areas x indicators x periods, read by every step of the inheritance
    return j.filter(keep).select("level", "code", F.col("ikey").alias("key"), "period", (F.col("value") * (n + 1)).alias("value")).persist()


def export_areas(spark, sf):
    n, r = T.table(spark, sf, "nation"), T.table(spark, sf, "region")
    pop = T.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("population"))
    a = n.join(r, n.n_regionkey == r.r_regionkey).join(pop, n.n_nationkey == pop.c_nationkey, "left").select(
        F.lit("nation").alias("level"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("parent_code"),
        F.col("r_name").alias("parent_name"), F.col("r_name").alias("region"), F.coalesce("population", F.lit(0)).alias("population"))
    b = a.groupBy("parent_code", "region").agg(F.sum("population").alias("population")).select(
        F.lit("region").alias("level"), F.col("parent_code").alias("code"), F.col("region").alias("name"), F.lit("").alias("parent_code"), F.lit("").alias("parent_name"), "region", "population")
    return a.unionByName(b)


def inherited(spark, sf):
    return E.inherit(export_areas(spark, sf).withColumn("up", F.nullif("parent_code", F.lit(""))), export_values(spark, sf), [("region", "up")])


@query(f"WITH {EXPORT} SELECT level, code, key, period, round(value, 4) AS value, inherited_from FROM inh")
def inherited_values(spark, sf):
    """Own figures, else the newest of the parent, with where they came from."""
    return rounded(inherited(spark, sf), digits=4)


LONG = f"""{EXPORT}, pop AS (SELECT 'nation' AS level, CAST(n_nationkey AS VARCHAR) AS code, count(c_custkey) AS population FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL
  UNION ALL SELECT 'region', CAST(n_regionkey AS VARCHAR), count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
lg AS (SELECT inh.level, inh.code, ar.name, ar.parent_code, ar.parent_name, ar.region, population, ws.key AS indicator, ws.label, CASE WHEN fmt = 'kdkk' THEN 'DKK' ELSE unit END AS unit, period,
  CASE WHEN br = 1 THEN 'projection' ELSE 'year' END AS period_type, round(value, 4) AS value,
  CASE WHEN inherited_from <> '' THEN 'inherited' WHEN br = 1 THEN 'projection' WHEN fmt = 'per1000' OR unit = 'per 1,000' THEN 'derived' ELSE 'actual' END AS value_type,
  inherited_from, direction, source, table_id, source_url, period AS as_of, fetched, licence
  FROM inh JOIN ar USING (level, code) JOIN pop USING (level, code) JOIN ws ON ws.key = inh.key)"""


def long_rows(spark, sf):
    ind = E.with_source(indicators(spark, sf), catalogue(spark, sf), BUILT)
    return E.area_rows(inherited(spark, sf), export_areas(spark, sf), ind)


@query(f"WITH {LONG} SELECT * FROM lg")
def long_area_export(spark, sf):
    """SK5, U2, F25, F26, F27: the 22-column long export with a source on every row."""
    return rounded(long_rows(spark, sf), digits=4)


@query(f"""WITH {LONG}, pins AS (SELECT c_name AS property_label, 54.5::DOUBLE + (c_custkey * 37 % 3000) / 1000.0::DOUBLE AS lat, CAST(c_nationkey AS VARCHAR) AS code FROM customer)
SELECT property_label, round(lat, 6) AS lat, 0.0::DOUBLE AS lon, lg.* FROM pins JOIN lg ON (lg.level = 'nation' AND lg.code = pins.code) OR (lg.level = 'region' AND lg.code = CAST(CAST(pins.code AS INT) % 5 AS VARCHAR))""")
def property_export(spark, sf):
    """SK11: all figures of every level that contains a pin, in the published columns."""
    p = T.table(spark, sf, "customer")
    n = F.col("c_nationkey")
    lv = F.explode(F.array(F.struct(F.lit("nation").alias("level"), n.cast("string").alias("code")), F.struct(F.lit("region").alias("level"), (n % 5).cast("string").alias("code"))))
    pins = p.select(F.col("c_name").alias("property_label"), F.round(F.lit(54.5) + (F.col("c_custkey") * 37 % 3000) / F.lit(1000.0), 6).alias("lat"), F.lit(0.0).alias("lon"), lv.alias("a")).select("property_label", "lat", "lon", "a.*")
    # rounded before the join: once a figure and a pin, not once a row
    return E.property_rows(rounded(long_rows(spark, sf), digits=4), pins).select(*PROPERTY_COLUMNS)


@query(f"""WITH {VALUES}, o AS (SELECT code, parent, max(CASE WHEN period = '1999' AND CAST(code AS INT) % 3 <> 0 THEN value END) AS a, max(CASE WHEN period = '2000' THEN value END) AS b FROM iv WHERE level = 'nation' AND key = 'revenue' GROUP BY ALL),
p AS (SELECT code, max(CASE WHEN period = '1999' THEN value END) AS a, max(CASE WHEN period = '2000' THEN value END) AS b FROM iv WHERE level = 'region' AND key = 'revenue' GROUP BY ALL)
SELECT o.code, o.parent AS parent_code, round(coalesce(o.a, p.a), 4) AS y1999, round(coalesce(o.b, p.b), 4) AS y2000 FROM o LEFT JOIN p ON p.code = o.parent""")
def wide_export(spark, sf):
    """SK6: one row per area, one column per indicator, the parent's value where there is no own."""
    v = indicator_values(spark, sf, ("nation", "region")).filter(F.col("key") == "revenue")
    gap = (F.col("level") == "nation") & (F.col("period") == "1999") & (F.col("code").cast("int") % 3 == 0)
    v = v.filter(~gap).withColumns({"key": F.concat(F.lit("y"), "period"), "level": F.when(F.col("level") == "nation", "own").otherwise("parent")})
    areas = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_regionkey").cast("string").alias("parent_code"))
    return rounded(E.wide(v, areas, ["y1999", "y2000"]), "y1999", "y2000", digits=4)


@query(f"""WITH {VALUES}, d AS (SELECT level, code, key, max(CASE WHEN period = '2001' AND CAST(code AS INT) % 4 > 0 THEN value + 1 END) AS latest FROM iv WHERE level = 'nation' GROUP BY ALL),
r AS (SELECT iv.level, iv.code, iv.key, period, CASE WHEN period = '2001' AND latest IS NOT NULL THEN latest ELSE value END AS value FROM iv JOIN d ON d.level = iv.level AND d.code = iv.code AND d.key = iv.key)
SELECT level, code, key, period, round(value, 4) AS value FROM r""")
def period_map_to_rows(spark, sf):
    """Yearly map to rows, the latest figure replacing the stored one of its year."""
    v = indicator_values(spark, sf, ("nation",)).drop("parent")
    last = F.max(F.when((F.col("period") == "2001") & (F.col("code").cast("int") % 4 > 0), F.col("value") + 1))
    docs = v.groupBy("level", "code", "key").agg(last.alias("latest"), F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("hist"))
    return rounded(E.period_rows(docs, "2001"), digits=4)


@query(f"""WITH {VALUES}, {INDICATORS}, s AS (SELECT 'orders_n' AS key, period, sum(value) AS value FROM iv WHERE level = 'region' AND key = 'orders_n' GROUP BY period)
SELECT 'denmark' AS level, key AS indicator, 'Orders' AS label, period, CASE WHEN regexp_matches(period, '^[0-9]{{4}}$') THEN 'year' END AS period_type, value, 'DST TAB7 monthly' AS source, 'TAB7' AS table_id,
 (SELECT coalesce(nullif(url, ''), 'https://api.statbank.dk/v1/tableinfo/TAB7') FROM cat WHERE key = 'dst/TAB7') AS source_url, period AS as_of FROM s""")
def national_series_export(spark, sf):
    """SK8: national series in the export's columns."""
    v = indicator_values(spark, sf, ("region",)).filter(F.col("key") == "orders_n").groupBy("key", "period").agg(F.sum("value").alias("value"))
    meta = v.select("key").distinct().select("key", F.lit("Orders").alias("label"), F.lit("").alias("unit"), F.lit("DST TAB7 monthly").alias("src"))
    cat = catalogue(spark, sf).withColumn("url", F.nullif("url", F.lit("")))
    return E.national_rows(v, meta, cat, BUILT).select("level", "indicator", "label", "period", "period_type", "value", "source", "table_id", "source_url", "as_of")


@query(f"""WITH {INDICATORS} SELECT key, label, CASE WHEN key LIKE 'dst/%' THEN 'Danmarks Statistik' WHEN key LIKE 's30/%' THEN 'Københavns Kommune' WHEN key IN ('forecast', 'climate/climate_index') THEN 'Danmarks Statistik' WHEN key = 'cph_forecast' THEN 'Københavns Kommune'
  WHEN key = 'lbf' THEN 'Landsbyggefonden' ELSE 'BBR via Datafordeler' END AS publisher, '' AS tables, stamp AS as_of, coalesce(nullif(fetched, ''), '2001-09-01') AS fetched,
  CASE WHEN url <> '' THEN url WHEN key LIKE 'dst/%' THEN 'https://api.statbank.dk/v1/tableinfo/' || substr(key, 5) ELSE 'https://api.statbank.dk/v1/s30/tableinfo/' || substr(key, 5) END AS url, licence,
  CASE WHEN key LIKE 'dst/%' THEN 'indicator ' || substr(key, 5) ELSE '' END AS used_for FROM cat""")
def source_catalogue_export(spark, sf):
    """SK9, U7: the source catalogue with fallback fetch date and what it is used for."""
    c = catalogue(spark, sf).dropDuplicates(["key"]).withColumn("tables", F.lit(""))
    used = c.filter(F.startswith("key", F.lit("dst/"))).select("key", F.concat(F.lit("indicator "), F.substring("key", 5, 20)).alias("used_for"))
    return E.source_rows(c, used, BUILT)


@query(f"""WITH {SP.EXPO} SELECT level, ex.code, CASE WHEN level = 'nation' THEN 'NATION_' || ex.code ELSE r_name END AS name, horizon, CASE horizon WHEN 'today' THEN '2020' ELSE horizon END AS zone_year, n AS dwellings, n_in_zone AS dwellings_in_zone,
  round(n_in_zone * 100 / n, 6) AS surge_dw_pct, CASE WHEN horizon = 'today' THEN 'derived' ELSE 'projection' END AS value_type FROM ex LEFT JOIN region ON level = 'region' AND CAST(r_regionkey AS VARCHAR) = ex.code""")
def zone_exposure_export(spark, sf):
    """SK10: zone exposure as rows per level and horizon."""
    d = E.exposure_rows(SP.exposed(spark, sf), export_areas(spark, sf).select("level", "code", "name", "parent_code"))
    return rounded(d.drop("parent_code"), "surge_dw_pct")


@query(f"""WITH {RG.SERVING}, c AS (SELECT id, string_agg(code, ' ' ORDER BY code) FILTER (WHERE level = 'nation') AS a, string_agg(code, ' ' ORDER BY code) FILTER (WHERE level = 'region') AS b FROM sv GROUP BY id)
SELECT pj.id, name, type, status, coalesce(CAST(open_year AS VARCHAR), '') AS opening, coalesce(a, '') AS municipalities, coalesce(b, '') AS postal_codes, '' AS quarters, round(pj.id * 1.5::DOUBLE, 2) AS length_km, CAST(NULL AS BIGINT) AS stations FROM pj LEFT JOIN c ON c.id = pj.id""")
def projects_export(spark, sf):
    """SK7: projects in their own schema, with the areas they serve."""
    from ..operators import registers as G

    served = G.areas_served(RG.serving(spark, sf).withColumn("level", K.lookup("level", {"nation": "kommune", "region": "postnr"})).withColumnRenamed("id", "project"))
    p = RG.projects(spark, sf).withColumns({"open_window": F.lit(""), "length_km": F.col("id") * 1.5, "stations": F.lit(None).cast("long")})
    return E.project_rows(p, served)


@query(f"WITH {T.POINTS}, {SP.PINS}, {SP.NEAR} SELECT CAST(pin AS INTEGER) AS pin, kind, name, CAST(round(dist) AS BIGINT) AS distance_m FROM near WHERE dist <= 30000")
def nearby_export(spark, sf):
    """SK11: what lies near each pin, in whole metres."""
    return E.nearby_rows(SP.around(spark, sf))


@query(f"""WITH {VALUES}, h AS (SELECT level, code, key, max_by(value, period) AS latest, count(*) AS years, max(period) AS newest FROM iv WHERE level = 'nation' GROUP BY ALL)
SELECT level, code, CAST(max(CASE WHEN key = 'orders_n' THEN latest END) AS BIGINT) AS orders_latest, CAST(max(years) AS BIGINT) AS years FROM h GROUP BY ALL""")
def area_documents(spark, sf):
    """SK4: one JSON document per area, read back with JSON functions."""
    d = W.area_documents(indicator_values(spark, sf, ("nation",)))
    latest = F.get_json_object("document", "$.orders_n.latest").cast("double").cast("long")
    hist = F.from_json(F.get_json_object("document", "$.orders_n.hist"), "map<string,double>")
    return d.select("level", "code", latest.alias("orders_latest"), F.size(hist).cast("long").alias("years"))


@query(f"""WITH {T.POINTS}, p AS (SELECT CAST(nation AS VARCHAR) AS kommune, segment AS cat, 'k' || CAST(id % 3 AS VARCHAR) AS sub, lat, lon FROM cp)
SELECT kommune, count(*) AS n_points, round(min(lat), 4) AS south, round(min(lon), 4) AS west, round(max(lat), 4) AS north, round(max(lon), 4) AS east, count(*) FILTER (WHERE cat = 'BUILDING') AS building_n, count(*) FILTER (WHERE cat = 'BUILDING' AND sub = 'k1') AS building_k1 FROM p GROUP BY kommune""")
def point_index(spark, sf):
    """SK3, A12: per-area index of points with box and counts."""
    d = W.point_index(export_points(spark, sf))
    num = lambda col, path: F.coalesce(F.get_json_object(col, path).cast("long"), F.lit(0).cast("long"))
    return d.select("kommune", "n_points", "south", "west", "north", "east", num("by_cat", "$.BUILDING").alias("building_n"), num("by_sub", "$['BUILDING:k1']").alias("building_k1"))


def export_points(spark, sf):
    p = T.customer_points(spark, sf)
    return p.select(F.col("nation").cast("string").alias("kommune"), F.col("segment").alias("cat"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("sub"),
                    F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"), "lat", "lon")


@query(f"""WITH {T.POINTS} SELECT CAST(nation AS VARCHAR) AS kommune, segment AS cat, 'k' || CAST(id % 3 AS VARCHAR) AS sub, 'name ' || CAST(id AS VARCHAR) AS name, round(lat, 5) AS lat, round(lon, 5) AS lon FROM cp""")
def partitioned_point_files(spark, sf):
    """SK1, SK2: points written per area and read back from the shared folder."""
    path = scratch_path(spark, "points")
    W.write_points(export_points(spark, sf), path)
    back = spark.read.schema("cat string, sub string, name string, lat double, lon double, kommune string").json(path)
    return back.select(F.col("kommune"), "cat", "sub", "name", "lat", "lon")


@query(f"WITH {LONG} SELECT level, code, indicator, period, value, source, table_id FROM lg")
def export_file_round_trip(spark, sf):
    """SK5, SK13: the long export as a semicolon file with a byte-order mark, read back."""
    from ..model import AREA_COLUMNS

    path = scratch_path(spark, "export")
    W.write_export(rounded(long_rows(spark, sf), digits=4), path, AREA_COLUMNS)
    back = spark.read.option("sep", ";").option("header", True).csv(path).toDF(*AREA_COLUMNS)
    return back.select("level", "code", "indicator", "period", F.col("value").cast("double").alias("value"), "source", "table_id")


@query(f"""WITH {PP.AREAS}, z AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, n_nationkey % 2 = 0 AS hh, n_nationkey % 3 <> 0 AS listed, n_nationkey % 6 = 0 AS pz FROM nation)
SELECT code, CASE WHEN listed THEN CASE WHEN hh THEN population * 2.0::DOUBLE ELSE CAST(population AS DOUBLE) END WHEN pz THEN 0.0::DOUBLE END AS value FROM z JOIN ar USING (code)""")
def horizon_resolution(spark, sf):
    """The figure at the wanted horizon, today's where there are none, zero or null where unlisted."""
    n = F.col("code").cast("int")
    d = PP.areas(spark, sf).select("code", (n % 2 == 0).alias("has_horizons"), F.col("population").cast("double").alias("today"), (F.col("population") * 2.0).alias("h2070"),
                                   (n % 3 != 0).alias("listed"), (n % 6 == 0).alias("parent_has_zone"))
    return E.resolve_horizon(d, "h2070")


@query("""SELECT 'k' || CAST(n_nationkey AS VARCHAR) AS key, 'https://api.statbank.dk/v1/' || CASE WHEN n_nationkey % 3 = 0 THEN 's20/' ELSE '' END || 'data/T' || CAST(n_regionkey AS VARCHAR) || '/CSV?OMR%C3%85DE=*&Tid=*' ||
  CASE WHEN n_nationkey % 2 = 0 THEN '&ALDER=IALT%2C' || CAST(n_nationkey AS VARCHAR) ELSE '' END || '&K%C3%98N=TOT' AS url FROM nation""")
def verify_query_links(spark, sf):
    """The query that returns a figure's own cells."""
    n = F.col("n_nationkey")
    t = F.concat(F.lit("T"), F.col("n_regionkey").cast("string"))
    codes = F.map_filter(F.create_map(
        F.lit("OMRÅDE"), F.array(F.lit("*")), F.lit("ALDER"), F.when(n % 2 == 0, F.array(F.lit("IALT"), n.cast("string"))).otherwise(F.array(F.lit("*"))), F.lit("KØN"), F.array(F.lit("TOT")), F.lit("X"), F.array(F.lit("SUM"))), lambda _k, v: v.isNotNull())
    ind = T.table(spark, sf, "nation").select(F.concat(F.lit("k"), n.cast("string")).alias("key"), F.when(n % 3 == 0, "s20").otherwise("").alias("db"), t.alias("table"), codes.alias("codes"))
    av = T.table(spark, sf, "region").select(F.concat(F.lit("T"), F.col("r_regionkey").cast("string")).alias("table"), F.lit("OMRÅDE").alias("area_var"))
    return E.verify_links(ind, av)

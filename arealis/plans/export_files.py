"""The exports in all published columns over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..model import EXPOSURE_COLUMNS, PROPERTY_COLUMNS
from ..operators import export_files as X
from ..operators import exports as E
from ..operators import registers as G
from ..operators import spatial as S
from . import exports as PE
from . import registers as RG
from . import spatial as SP
from . import tables as T
from .common import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query(f"""WITH {RG.SERVING}, c AS (SELECT id, string_agg(code, ' ' ORDER BY code) FILTER (WHERE level = 'nation') AS a, string_agg(code, ' ' ORDER BY code) FILTER (WHERE level = 'region') AS b FROM sv GROUP BY id)
SELECT pj.id, name, type, status, CASE WHEN pj.id % 4 = 0 THEN 'note ' || s_name ELSE '' END AS status_note,
  CASE WHEN pj.id % 7 = 0 THEN 'after 2035' ELSE coalesce(CAST(open_year AS VARCHAR), '') END AS opening, CASE WHEN pj.id % 5 = 1 THEN CAST(2010 + pj.id % 8 AS VARCHAR) ELSE '' END AS opening_original,
  CASE WHEN pj.id % 3 = 1 THEN round(s_acctbal / 1000, 2) END AS budget_mdkk, CASE WHEN type = 'metro' THEN 'Metroselskabet' ELSE '' END AS agency,
  coalesce(a, '') AS municipalities, coalesce(b, '') AS postal_codes, '' AS quarters, CASE WHEN type = 'metro' THEN 'line' ELSE 'point' END AS geometry_kind, round(pj.id * 1.375::DOUBLE, 2) AS length_km,
  CASE WHEN parent = '' THEN CAST(5 - 1 AS BIGINT) END AS stations, 'plan ' || CAST(pj.id % 9 AS VARCHAR) AS source_doc, CASE WHEN pj.id % 2 = 0 THEN 'https://plan.example/' || CAST(pj.id AS VARCHAR) ELSE '' END AS source_url, '2001-08-0' || CAST(pj.id % 9 + 1 AS VARCHAR) AS updated
FROM pj JOIN supplier ON s_suppkey = pj.id LEFT JOIN c ON c.id = pj.id""")
def projects_export_all_columns(spark, sf):
    """SK7: the projects file in its 18 columns."""
    level = K.lookup("level", {"nation": "municipalities", "region": "postal_codes"})
    served = G.areas_served(RG.serving(spark, sf).withColumn("level", level).withColumnRenamed("id", "project"))
    k, metro = F.col("id"), F.col("type") == "metro"
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    text = lambda lead, c: F.concat(F.lit(lead), c.cast("string"))
    p = RG.projects(spark, sf).join(s, "id").withColumns({
        "notes": F.when(k % 4 == 0, text("note ", F.col("name"))), "open_window": F.when(k % 7 == 0, "after 2035").otherwise(""), "open_year_original": F.when(k % 5 == 1, k % 8 + 2010),
        "budget_mdkk": F.when(k % 3 == 1, F.round(F.col("s_acctbal") / 1000, 2)), "agency": F.when(metro, "Metroselskabet"), "geometry_kind": F.when(metro, "line").otherwise("point"),
        "length_km": k * F.lit(1.375), "stations": F.when(F.col("parent") == "", F.lit(4).cast("long")), "source_doc": text("plan ", k % 9),
        "source_url": F.when(k % 2 == 0, text("https://plan.example/", k)), "updated": text("2001-08-0", k % 9 + 1)})
    return X.projects(p, served)


@query(f"""WITH {SP.EXPO}, {PE.INDICATORS}, ar AS (SELECT 'nation' AS level, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, CAST(n_regionkey AS VARCHAR) AS parent_code, r_name AS parent_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name, '', '' FROM region)
SELECT level, ex.code, name, parent_code, parent_name, horizon, CASE horizon WHEN 'today' THEN '2020' ELSE horizon END AS zone_year, ex.n AS dwellings, n_in_zone AS dwellings_in_zone,
  round(n_in_zone * 100 / ex.n, 6) AS surge_dw_pct, n_in_zone / 8.0::DOUBLE AS zone_km2, CASE WHEN horizon = 'today' THEN 'derived' ELSE 'projection' END AS value_type,
  source, table_id, source_url, CASE WHEN horizon = 'today' THEN '2020-02-01' ELSE cat_as_of END AS as_of, fetched, licence
FROM ex JOIN ar USING (level, code), (SELECT * FROM ws WHERE key = 'ind2') w""")
def zone_exposure_export_all_columns(spark, sf):
    """SK10: the climate file in its 18 columns, with the indicator's source on every row."""
    ind = E.with_source(PE.indicators(spark, sf).filter("key = 'ind2'"), PE.catalogue(spark, sf), PE.BUILT)
    d = SP.exposed(spark, sf).withColumns({"zone_km2": F.col("n_in_zone") / F.lit(8.0), "as_of": F.when(F.col("horizon") == "today", "2020-02-01")})
    return rounded(X.exposure(d, PE.export_areas(spark, sf), ind), "surge_dw_pct").select(*EXPOSURE_COLUMNS)


@query(f"""WITH {T.POINTS}, {SP.PINS}, {SP.NEAR} SELECT CAST(pin AS INTEGER) AS pin, kind, 'no. ' || id AS name, name AS type, CASE WHEN kind = 'supplier' THEN CASE CAST(id AS INT) % 3 WHEN 0 THEN 'opened' ELSE 'decided' END ELSE '' END AS status,
  CAST(round(dist) AS BIGINT) AS distance_m, CASE WHEN kind = 'supplier' THEN 'project layer' ELSE 'OpenStreetMap' END AS source, CASE WHEN kind = 'customer' THEN 'https://osm.example/' || id ELSE '' END AS source_url
FROM near WHERE dist <= 30000""")
def nearby_export_all_columns(spark, sf):
    """SK11: what lies near each pin, in the 7 published columns."""
    own = F.col("kind") == "supplier"
    d = SP.around(spark, sf).withColumns({
        "type": F.col("name"), "status": F.when(own, F.when(F.col("id").cast("int") % 3 == 0, "opened").otherwise("decided")), "name": F.concat(F.lit("no. "), "id"),
        "source": F.when(own, "project layer").otherwise("OpenStreetMap"), "source_url": F.when(~own, F.concat(F.lit("https://osm.example/"), "id"))})
    return X.nearby(d)


@query(f"""WITH {PE.LONG}, {T.POINTS}, {T.EDGES}, {T.inside_sql('cp', 'hit')},
found AS (SELECT c_name AS property_label, lat, lon, CAST(hit.code AS INT) AS n FROM hit JOIN cp USING (id) JOIN customer ON c_custkey = id),
pins AS (SELECT property_label, lat, lon, 'nation' AS level, CAST(n AS VARCHAR) AS code FROM found UNION ALL SELECT property_label, lat, lon, 'region', CAST(n_regionkey AS VARCHAR) FROM found JOIN nation ON n_nationkey = n)
SELECT property_label, round(lat, 6) AS lat, round(lon, 6) AS lon, lg.* FROM pins JOIN lg ON lg.level = pins.level AND lg.code = pins.code""")
def property_export_located(spark, sf):
    """SK11, J6: all figures of the areas that contain each pin, found by its place."""
    nations = T.nation_polygons(spark, sf)
    regions = nations.select(F.col("region").cast("string").alias("code"), "polygon")
    pins = T.customer_points(spark, sf).join(T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("property_label")), "id").select("property_label", "lat", "lon")
    area = F.col("_area")
    levels = {"nation": (S.area_index(nations, SP.CELL), area.cast("int").cast("string")), "region": (S.area_index(regions, SP.CELL), area)}
    found = rounded(X.located(pins, levels, SP.CELL), "lat", "lon")
    return X.property_rows(rounded(PE.long_rows(spark, sf), digits=4), found).select(*PROPERTY_COLUMNS)


@query(f"""WITH {PE.LONG} SELECT * FROM lg WHERE ((level = 'nation' AND CAST(code AS INT) % 4 = 1) OR (level = 'region' AND code = '2')) AND indicator IN (SELECT key FROM ind WHERE direction = 'higher_better')""")
def chart_series_export(spark, sf):
    """SK12: the plotted areas and indicators in the 22 columns of the long export."""
    n = T.table(spark, sf, "nation").filter("n_nationkey % 4 = 1").select(F.lit("nation").alias("level"), F.col("n_nationkey").cast("string").alias("code"))
    r = T.table(spark, sf, "region").filter("r_regionkey = 2").select(F.lit("region").alias("level"), F.col("r_regionkey").cast("string").alias("code"))
    shown = PE.indicators(spark, sf).filter("direction = 'higher_better'").select(F.col("key").alias("indicator"))
    return rounded(X.plotted(PE.long_rows(spark, sf), n.unionByName(r), shown), digits=4)

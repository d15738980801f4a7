"""Parsing and labelling functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import parsing as P
from . import tables as T
from .common import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_N, _COMMA = "-?[0-9]{1,3}(?:[.][0-9]+)?", "[ \\t\\n\\r]*[,;][ \\t\\n\\r]*"


def _pairs(pieces: str, between: str = _COMMA) -> str:
    """SQL: the first of the pieces that starts with two numbers, as a list of both."""
    both = f"^({_N}){between}({_N})"
    return f"list_filter(list_transform({pieces}, lambda p: [regexp_extract(p, '{both}', 1), regexp_extract(p, '{both}', 2)]), lambda x: x[1] <> '')[1]"


def _location_sql(src: str) -> str:
    keys = ", ".join(f"'{k}'" for k in P.POSITION_KEYS)
    ways = {
        "place": _pairs("string_split(s, '!3d')[2:]", "!4d"), "at": _pairs("string_split(s, '@')[2:]"),
        "param": _pairs(f"list_transform(list_filter(string_split_regex(s, '[?&#]'), lambda p: contains(p, '=') and lower(split_part(p, '=', 1)) in ({keys})), lambda p: substr(p, strpos(p, '=') + 1))"),
        "search": _pairs("string_split(s, '/search/')[2:]"),
        "plain": f"CASE WHEN len(w) = 2 AND regexp_full_match(w[1], '{_N}') AND regexp_full_match(w[2], '{_N}') THEN w END",
    }
    found = ", ".join(f"{sql} AS by_{name}" for name, sql in ways.items())
    source = " ".join(f"WHEN by_{name} IS NOT NULL THEN '{name}'" for name in ways)
    hit = f"coalesce({', '.join(f'by_{name}' for name in ways)})"
    return f"""
dec AS (SELECT id, trim(t) AS raw, url_decode(replace(trim(t), '+', ' ')) AS s FROM {src}),
wd AS (SELECT *, string_split_regex(s, '{_COMMA}|[ \\t\\n\\r]+') AS w FROM dec),
fnd AS (SELECT *, {found} FROM wd),
hit AS (SELECT id, raw, s, CASE {source} END AS source, CAST({hit}[1] AS DOUBLE) AS lat, CAST({hit}[2] AS DOUBLE) AS lon FROM fnd),
err AS (SELECT *, CASE WHEN raw = '' THEN 'empty' WHEN regexp_matches(s, '(?i)\\b(?:maps\\.app\\.goo\\.gl|goo\\.gl|g\\.co/kgs)\\b') THEN 'short_link' WHEN lat IS NULL OR lon IS NULL THEN 'no_match' WHEN NOT (lat BETWEEN 54 AND 58 AND lon BETWEEN 7 AND 16) THEN 'outside_dk' END AS error FROM hit)
SELECT id, CASE WHEN error IS NULL THEN lat END AS lat, CASE WHEN error IS NULL THEN lon END AS lon, CASE WHEN error IS NULL THEN source END AS source, error FROM err"""


@query(f"""WITH c AS (SELECT c_custkey AS id, CAST(50 + c_custkey % 9 AS VARCHAR) || '.' || CAST(c_custkey % 9 + 1 AS VARCHAR) AS la, CAST(7 + c_custkey % 8 AS VARCHAR) || '.25' AS lo FROM customer),
x AS (SELECT id, CASE id % 9 WHEN 0 THEN 'https://maps.example/place/A/@55.6,12.5,17z/data=!3d' || la || '!4d' || lo WHEN 1 THEN 'https://maps.example/@' || la || ',' || lo || ',17z' WHEN 2 THEN 'https://maps.example/?Q=' || la || '%2C' || lo
  WHEN 3 THEN 'https://maps.example/search/' || la || ',+' || lo WHEN 4 THEN '  ' || la || ' ; ' || lo WHEN 5 THEN la || ' ' || lo WHEN 6 THEN 'https://goo.gl/abc' || la WHEN 7 THEN '' ELSE 'near ' || la END AS t FROM c),{_location_sql('x')}""")
def location_text_parsed(spark, sf):
    """H9: coordinates out of links and text in five formats, with the reason where none is read."""
    k = F.col("c_custkey")
    la = F.concat((F.lit(50) + k % 9).cast("string"), F.lit("."), (k % 9 + 1).cast("string"))
    lo = F.concat((F.lit(7) + k % 8).cast("string"), F.lit(".25"))
    c = F.concat
    t = (
        F.when(k % 9 == 0, c(F.lit("https://maps.example/place/A/@55.6,12.5,17z/data=!3d"), la, F.lit("!4d"), lo))
        .when(k % 9 == 1, c(F.lit("https://maps.example/@"), la, F.lit(","), lo, F.lit(",17z"))).when(k % 9 == 2, c(F.lit("https://maps.example/?Q="), la, F.lit("%2C"), lo))
        .when(k % 9 == 3, c(F.lit("https://maps.example/search/"), la, F.lit(",+"), lo)).when(k % 9 == 4, c(F.lit("  "), la, F.lit(" ; "), lo))
        .when(k % 9 == 5, c(la, F.lit(" "), lo)).when(k % 9 == 6, c(F.lit("https://goo.gl/abc"), la)).when(k % 9 == 7, "").otherwise(c(F.lit("near "), la))
    )
    d = T.table(spark, sf, "customer").select(k.alias("id"), P.parse_location(t).alias("r"))
    return d.select("id", "r.lat", "r.lon", "r.source", "r.error")


@query(f"WITH x AS (SELECT page_id AS id, url AS t FROM pages),{_location_sql('x')}")
def page_urls_parsed_for_coordinates(spark, sf):
    """H9: the same parser over every page address."""
    d = T.table(spark, sf, "pages").select(F.col("page_id").alias("id"), P.parse_location(F.col("url")).alias("r"))
    return d.select("id", "r.lat", "r.lon", "r.source", "r.error")


@query(r"""WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN CAST(o_custkey % 9 + 1 AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN CAST(o_custkey % 90 AS VARCHAR) || ',5' WHEN 2 THEN CAST(o_custkey % 100 AS VARCHAR) || ',0 %'
  WHEN 3 THEN '..' WHEN 4 THEN '-' WHEN 5 THEN ' 1 ' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') WHEN 6 THEN '*' ELSE 'abc' END AS t FROM orders)
SELECT id, CASE id % 8 WHEN 0 THEN CAST(replace(t, '.', '') AS DOUBLE) WHEN 1 THEN CAST(replace(t, ',', '.') AS DOUBLE) WHEN 2 THEN CAST(replace(replace(t, ' %', ''), ',', '.') AS DOUBLE) END AS danish,
  CASE id % 8 WHEN 0 THEN CAST(t AS DOUBLE) WHEN 1 THEN CAST(replace(t, ',', '.') AS DOUBLE) WHEN 5 THEN CAST(replace(t, ' ', '') AS DOUBLE) END AS cube FROM x""")
def published_number_text(spark, sf):
    """H1, H2: two notations of published figures; markers become null, never zero."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    t = (
        F.when(k % 8 == 0, F.concat(s(c % 9 + 1), F.lit("."), F.lpad(s(k % 1000), 3, "0"))).when(k % 8 == 1, F.concat(s(c % 90), F.lit(",5"))).when(k % 8 == 2, F.concat(s(c % 100), F.lit(",0 %")))
        .when(k % 8 == 3, "..").when(k % 8 == 4, "-").when(k % 8 == 5, F.concat(F.lit(" 1 "), F.lpad(s(c % 1000), 3, "0"))).when(k % 8 == 6, "*").otherwise("abc")
    )
    return T.table(spark, sf, "orders").select(k.alias("id"), P.danish_number(t).alias("danish"), P.cube_number(t).alias("cube"))


@query("""SELECT s_suppkey AS id, CAST(s_suppkey AS VARCHAR) AS muni, CASE WHEN s_suppkey = 0 THEN '0000' ELSE lpad(CAST(s_suppkey AS VARCHAR), 4, '0') END AS padded,
  substr(lpad(CAST(s_suppkey * 37 AS VARCHAR), 4, '0') || ' Town', 1, 4) AS postal, trim(' ' || CAST(s_suppkey AS VARCHAR) || ' ') AS district FROM supplier""")
def area_code_forms(spark, sf):
    """H3: leading zeros, postal codes and district codes."""
    k = F.col("s_suppkey")
    raw = F.concat(F.lit("K-"), F.lpad(k.cast("string"), 6, "0"))
    return T.table(spark, sf, "supplier").select(
        k.alias("id"), P.area_code("KOMMUNEDK", raw).alias("muni"), P.pad_code(k).alias("padded"),
        P.area_code("PNR20", F.concat(F.lpad((k * 37).cast("string"), 4, "0"), F.lit(" Town"))).alias("postal"), P.area_code("OMRKK", F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).alias("district"))


@query(r"""SELECT doc_id, md5(trim(replace(regexp_replace(text, '[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'), ';', ','))) AS cell_md5 FROM documents""")
def text_as_export_cells(spark, sf):
    """SK13: whole texts as export cells, without separators or line breaks."""
    return T.table(spark, sf, "documents").select("doc_id", F.md5(P.csv_cell("text")).alias("cell_md5"))


@query(r"""SELECT page_id AS id, regexp_matches(url, '(?i)https?://|(?:^|\s)www\.|/wms\b') AS is_url, regexp_matches(replace(url, 'https://', ''), '(?i)https?://|(?:^|\s)www\.|/wms\b') AS still FROM pages""")
def names_that_are_addresses(spark, sf):
    """a name that is really a service address."""
    p = T.table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), P.looks_like_url("url").alias("is_url"), P.looks_like_url(F.replace("url", F.lit("https://"), F.lit(""))).alias("still"))


@query(r"""SELECT p_partkey AS id, string_split('City - ' || p_name, ' - ')[2] AS short, p_name || ' ' || lower(p_type) AS first_three,
  'https://api.statbank.dk/v1/data?t=' || replace(url_encode(p_name || ' & ' || p_brand), '+', '%20') AS url, CASE WHEN p_partkey % 2 = 0 THEN 'KKBOL' || CAST(p_size AS VARCHAR) ELSE '' END AS city_table, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'PRIS' || CAST(p_size AS VARCHAR) END AS state_table FROM part""")
def labels_links_and_table_ids(spark, sf):
    """Short labels, query addresses, and table ids out of prose."""
    k = F.col("p_partkey")
    prose = F.when(k % 2 == 0, F.concat(F.lit("Københavns Kommune, KKBOL"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("kilde: PRIS"), F.col("p_size").cast("string"), F.lit(" mv.")))
    return T.table(spark, sf, "part").select(
        k.alias("id"), P.last_segment(F.concat(F.lit("City - "), F.col("p_name"))).alias("short"),
        P.first_words(F.concat_ws("  ", "p_name", F.lower("p_type"), F.lit("tail")), 3).alias("first_three"),
        P.query_url(P.STATBANK + "/data", {"t": F.concat("p_name", F.lit(" & "), "p_brand")}).alias("url"),
        P.city_table_id(prose).alias("city_table"), F.when(k % 2 == 0, "").otherwise(P.state_table_id(prose)).alias("state_table"))


@query("""WITH x AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS VARCHAR) AS y, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS m, CAST(quarter(o_orderdate) AS VARCHAR) AS q, o_orderkey % 8 AS b, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders)
SELECT id, CASE b WHEN 0 THEN 'year' WHEN 1 THEN 'quarter' WHEN 2 THEN 'month' WHEN 3 THEN 'school_year' WHEN 4 THEN 'window' WHEN 5 THEN 'window' WHEN 6 THEN 'snapshot' ELSE 'projection' END AS period_type,
  CASE b % 4 WHEN 0 THEN 'DKK' WHEN 1 THEN 'kDKK' WHEN 2 THEN 'DKK/m²' ELSE '%' END AS unit, CASE WHEN b % 4 = 1 AND v >= 10000 THEN v / 1000 ELSE CAST(v AS DOUBLE) END AS value,
  CASE WHEN b = 7 THEN 'inherited' WHEN b = 6 THEN 'projection' WHEN b % 4 = 3 THEN 'derived' ELSE 'actual' END AS value_type FROM x""")
def period_unit_and_value_types(spark, sf):
    """period type from a label, value type, and the unit fix."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    y = F.year(d).cast("string")
    b = k % 8
    label = (
        F.when(b == 0, y).when(b == 1, F.concat(y, F.lit("K"), F.quarter(d).cast("string"))).when(b == 2, F.concat(y, F.lit("M"), F.lpad(F.month(d).cast("string"), 2, "0")))
        .when(b == 3, F.concat(y, F.lit("/"), y)).when(b == 4, F.concat(y, F.lit("K1→"), y, F.lit("K4"))).when(b == 5, F.concat(y, F.lit("–"), y)).when(b == 6, F.date_format(d, "yyyy-MM-dd")).otherwise(y)
    )
    fmt = F.when(b % 4 == 0, "kdkk").when(b % 4 == 2, "kdkk").when(b % 4 == 3, "per1000").otherwise("pct1")
    unit = F.when(b % 4 == 0, "").when(b % 4 == 1, "kDKK").when(b % 4 == 2, "kDKK/m²").otherwise("%")
    v = F.round("o_totalprice").cast("long").cast("double")
    none = F.lit(None).cast("string")
    return T.table(spark, sf, "orders").select(
        k.alias("id"), K.period_type(label, F.when(b == 7, "projection")).alias("period_type"), K.unit_text(fmt, unit).alias("unit"), K.unit_value(fmt, unit, v).alias("value"),
        K.value_type(b == 7, F.when(b == 6, "horizon"), F.when(b == 6, "2070"), F.lit(False), K.is_derived(fmt, unit, none)).alias("value_type"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'muni' END ELSE CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 4 = 0 AND c_custkey % 2 = 0 THEN 'postnr' ELSE 'muni' END END AS inherits FROM customer""")
def level_a_figure_is_read_from(spark, sf):
    """own, postal code or municipality, by level and registry."""
    k = F.col("c_custkey")
    level = F.when(k % 3 == 0, "kommune").when(k % 3 == 1, "postnr").otherwise("kvarter")
    own = (k % 3 == 2) & (k % 5 == 0)
    return T.table(spark, sf, "customer").select(k.alias("id"), K.own_or_inherited(level, own, F.when(k % 2 == 0, "postnr").otherwise("kommune"), k % 4 == 0).alias("inherits"))


@query("""SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS missing FROM events GROUP BY ALL""")
def json_field_with_fallback(spark, sf):
    """A field out of JSON text, counted where it is missing."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return T.table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count_if(k.isNull()).alias("missing"))

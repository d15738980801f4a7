"""Registers, map objects, education rows and small reference files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify as K
from ..functions import geometry as G
from ..functions import parsing as P
from ..functions import text as X
from ..model import MAP_OBJECT_SCHEMA
from . import documents

# Institution types of the register that are kept, and what they are called.
SCHOOL_TYPES = {
    "Folkeskoler": "folkeskole",
    "Friskoler og private grundskoler": "fri grundskole",
    "Specialskoler for børn": "specialskole",
    "Kommunale internationale skoler": "fri grundskole",
}
REGISTER_ALIASES = {"Københavns": "København"}


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under an explicit schema: no inference pass, unused fields pruned."""
    return spark.read.schema(schema).json(path)


def with_point(df: DataFrame, wkt: str = "byg404Koordinat.wkt") -> DataFrame:
    """Zone-32 coordinate text to lat/lon."""
    p = df.withColumn("_p", P.wkt_point(F.col(wkt)))
    lat, lon = G.from_utm32(F.col("_p.x"), F.col("_p.y"))
    return p.withColumns({"lat": lat, "lon": lon}).drop("_p")


def map_object_rows(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, lat, lon, tags) as often as the documents hold them: nodes at their point, ways at the centre given or the mean
    of their vertices, nothing without a position. A large document is read by many tasks."""
    element = MAP_OBJECT_SCHEMA["elements"].dataType.elementType
    e = documents.elements(spark, path, "elements").select(F.from_json("text", element).alias("e"))
    shape = F.col("e.geometry")
    lat = F.coalesce("e.center.lat", "e.lat", G.vertex_mean(shape, "lat"))
    lon = F.coalesce("e.center.lon", "e.lon", G.vertex_mean(shape, "lon"))
    return e.select("e.type", "e.id", lat.alias("lat"), lon.alias("lon"), "e.tags").filter(F.col("lat").isNotNull())


def map_objects(spark: SparkSession, path: str) -> DataFrame:
    """Map objects, each once however many documents carry it."""
    return map_object_rows(spark, path).dropDuplicates(["type", "id"])


def services(objects: DataFrame) -> DataFrame:
    """Map objects of the kept tags with category, kind, name and brand."""
    c = objects.withColumn("c", K.service_class(F.col("tags"))).filter(F.col("c").isNotNull())
    name, brand = F.trim(F.coalesce(F.col("tags")["name"], F.lit(""))), F.trim(F.coalesce(F.col("tags")["brand"], F.lit("")))
    return c.select(F.concat(F.substring("type", 1, 1), F.col("id").cast("string")).alias("osm"), "c.cat", "c.sub", "lat", "lon",
                    name.alias("name"), F.when(brand != name, brand).otherwise("").alias("brand"), "c.n_hits")


def named_facilities(objects: DataFrame) -> DataFrame:
    """Points with a usable name: service addresses in a name field are not names."""
    n = F.col("tags")["name"]
    return objects.filter(n.isNotNull() & (n != "") & ~P.looks_like_url(n)).select("lat", "lon", n.alias("name"), F.col("tags")["amenity"].alias("amenity"))


def education_rows(spark: SparkSession, path: str, dimensions: dict[str, str], measures: dict[str, str]) -> DataFrame:
    """Rows whose columns are named ``[Dim].[Level].[Level]``, under plain names; measures are
    Danish figures."""
    wanted = {**dimensions, **measures}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in wanted])
    raw = spark.read.schema(schema).json(path)
    dims = [F.col(f"`{c}`").alias(n) for c, n in dimensions.items()]
    vals = [P.danish_number(F.col(f"`{c}`")).alias(n) for c, n in measures.items()]
    return raw.select(*dims, *vals)


def bracketed(dim: str) -> str:
    """The name the source gives a detail column: the last level is repeated."""
    return f"{dim}.[{dim.rsplit('.', 1)[1].strip('[]')}]"


def institution_register(spark: SparkSession, path: str, areas: DataFrame | None = None) -> DataFrame:
    """Kept institutions with municipality name, parent and coordinate (null when unreadable)."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    df = raw.toDF(*[c.replace("\ufeff", "").strip() for c in raw.columns])
    muni = F.trim(F.replace(F.col("Beliggenhedskommune"), F.lit(" Kommune"), F.lit("")))
    muni = F.coalesce(K.lookup(muni, REGISTER_ALIASES), muni)
    lat = F.col("`Geokode: Breddegrad`").try_cast("double")
    lon = F.col("`Geokode: Længdegrad`").try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    out = df.withColumn("type", K.lookup(F.col("`Institutionstype, navn`"), SCHOOL_TYPES)).filter(F.col("type").isNotNull()).select(
        F.col("Institutionsnummer").alias("nr"), F.trim("Institutionsnavn").alias("name"), "type", muni.alias("municipality"),
        F.nullif(F.trim("Hovedinstitution"), F.lit("")).alias("parent"), F.nullif(F.trim("Postnummer"), F.lit("")).alias("postcode"),
        F.when(both, F.round(lat, 6)).alias("lat"), F.when(both, F.round(lon, 6)).alias("lon"),
    )
    return out if areas is None else out.join(areas.select(F.col("name").alias("municipality"), "code"), "municipality", "left")


def key_value_csv(spark: SparkSession, path: str) -> DataFrame:
    """(code, value) of a ``key;value`` file; rows that cannot be read are skipped."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    value = F.replace(F.col(raw.columns[1]), F.lit(","), F.lit(".")).try_cast("double")
    return raw.select(P.municipality_code(F.col(raw.columns[0])).alias("code"), value.alias("value")).na.drop()


def piped_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(areas, national) of ``name | figure`` lines: comments skipped, the national row apart,
    0 meaning suppressed. ``lines`` has one text column ``value``."""
    v = F.col("value")
    kept = lines.filter((F.trim(v) != "") & ~F.startswith(v, F.lit("#")) & F.contains(v, F.lit("|")))
    d = kept.select(F.trim(F.substring_index(v, "|", 1)).alias("name"), P.danish_number(F.regexp_replace(v, r"^[^|]*\|", "")).alias("value"))
    whole = F.lower("name") == "hele landet"
    return d.filter(~whole & (F.col("value") > 0)), d.filter(whole)


def sniffed_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV with tab or comma, judged by the header line; required columns must be there."""
    head = spark.read.text(path).first()[0].replace("\ufeff", "")
    sep = "\t" if head.count("\t") > head.count(",") else ","
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    df = raw.toDF(*[c.replace("\ufeff", "").strip() for c in raw.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: expected columns {missing}, got {df.columns}")
    return df.filter(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in df.columns]) != "")


def timetable(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Routes, trips, stop times and stops of a timetable feed; only the needed columns."""
    def scan(name: str, columns: Sequence[str]) -> DataFrame:
        raw = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{name}.txt")
        df = raw.toDF(*[c.replace("\ufeff", "").strip() for c in raw.columns])
        return df.select(*columns)

    stops = scan("stops", ["stop_id", "stop_name", "stop_lat", "stop_lon"])
    return {
        "routes": scan("routes", ["route_id", "route_type"]), "trips": scan("trips", ["trip_id", "route_id"]),
        "stop_times": scan("stop_times", ["trip_id", "stop_id"]),
        "stops": stops.select("stop_id", "stop_name", F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon")),
    }


def name_key(df: DataFrame, column: str, target: str = "name_key") -> DataFrame:
    """Area-name key beside a name column."""
    return X.with_unicode_form(df, column, target, "NFKC").withColumn(target, X.area_name_key(F.col(target)))

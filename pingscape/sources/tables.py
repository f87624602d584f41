"""Scans and text formats."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import MAX_ACCURACY_M, OPTION_JUNK, OPTION_PATTERN

PING_FIELDS = [
    T.StructField("utc_timestamp", T.LongType()),
    T.StructField("caid", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("altitude", T.DoubleType()),
]
PING_SCHEMA = T.StructType(PING_FIELDS)
RAW_PING_SCHEMA = T.StructType(
    PING_FIELDS
    + [
        T.StructField("id_type", T.StringType()),
        T.StructField("geo_hash", T.StringType()),
        T.StructField("horizontal_accuracy", T.DoubleType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("iso_country_code", T.StringType()),
    ]
)
DWELL_SCHEMA = T.StructType(
    [
        T.StructField("caid", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("utc_timestamp_start", T.LongType()),
        T.StructField("stay_length_sec", T.IntegerType()),
    ]
)


def day_list(span: str) -> list[str]:
    """Days of "a/b" (both ends in) or of a single date, as yyyy/MM/dd."""
    ends = span.split("/")
    first, last = date.fromisoformat(ends[0]), date.fromisoformat(ends[-1])
    return [(first + timedelta(n)).strftime("%Y/%m/%d") for n in range((last - first).days + 1)]


def day_rows(spans: DataFrame, span: str) -> DataFrame:
    """The same as rows: one row per day folder of each span in a column."""
    ends = F.split(F.col(span), "/")
    first, last = F.to_date(ends[0]), F.to_date(F.element_at(ends, -1))
    return spans.withColumn("day", F.explode(F.sequence(first, last))).withColumn(
        "folder", F.date_format("day", "yyyy/MM/dd")
    )


def scan_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def scan_csv(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; typed when a schema is given, all strings otherwise."""
    reader = spark.read.option("header", True)
    return (reader if schema is None else reader.schema(schema)).csv(list(paths))


def scan_days(spark: SparkSession, base: str, span: str, schema: T.StructType = RAW_PING_SCHEMA) -> DataFrame:
    """Raw pings of a date range stored in one folder per day."""
    return scan_parquet(spark, *[base + day for day in day_list(span)], schema=schema)


def select_pings(raw: DataFrame, country: str, max_accuracy: float = MAX_ACCURACY_M) -> DataFrame:
    """Accurate pings of one country; both filters reach the scan, other columns are not read."""
    return raw.filter(
        (F.col("horizontal_accuracy") <= max_accuracy) & (F.col("iso_country_code") == country)
    ).select("caid", "latitude", "longitude", "utc_timestamp", "altitude")


def toggle_rows(entries: DataFrame, place: str = "place", locations: str = "locations") -> DataFrame:
    """One row per recorded switch time: place, position in its list, epoch seconds (nulls left out)."""
    return entries.select(place, F.posexplode(locations).alias("position", "t")).filter("t IS NOT NULL")


def scan_toggle_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of {locations: [seconds...]}, a byte order mark allowed; the place is the entry's position.

    With several files the positions go on from file to file in the order of their paths, however the files are read;
    what orders them is one row per file.  A file is parsed whole by one task.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.from_json(F.ltrim(F.regexp_replace("value", "^\ufeff", "")), "array<struct<locations:array<bigint>>>").alias("entries"),
    )
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    counts = files.select("file", F.size("entries").alias("entries")).withColumn(
        "first", F.coalesce(F.sum("entries").over(before), F.lit(0))
    ).drop("entries")
    entries = files.join(counts, "file").select("first", F.posexplode("entries").alias("at", "entry"))
    return toggle_rows(entries.select((F.col("first") + F.col("at")).cast("long").alias("place"), "entry.locations"))


def label_dictionary(
    pages: DataFrame, html: str, keys: list[str] | None = None, pattern: str = OPTION_PATTERN,
    junk: str = OPTION_JUNK,
) -> DataFrame:
    """(value, label) pairs of the tags in a text; values may be comma lists, the last label wins."""
    keys = keys or []
    found = pages.select(
        *keys,
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all(html, F.lit(pattern), 1).alias("value"),
                F.regexp_extract_all(html, F.lit(pattern), 2).alias("label"),
            )
        ).alias("position", "tag"),
    )
    single = found.select(
        *keys,
        "position",
        F.explode(F.split("tag.value", ", ")).alias("value"),
        F.replace(F.col("tag.label"), F.lit(junk), F.lit("")).alias("label"),
    )
    return single.groupBy(*keys, "value").agg(F.max_by("label", "position").alias("label"))


def wkt_rings(wkt: Column) -> Column:
    """Rings of POLYGON / MULTIPOLYGON text as array<array<struct<x,y>>>; holes are rings too."""
    return F.transform(
        F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1)),
        lambda ring: F.transform(
            F.split(F.trim(ring), r"\s*,\s*"),
            lambda point: F.struct(
                F.split(F.trim(point), r"\s+")[0].cast("double").alias("x"),
                F.split(F.trim(point), r"\s+")[1].cast("double").alias("y"),
            ),
        ),
    )


def date_of_column_name(name: Column) -> Column:
    """ctr_YYYYMMDD -> date."""
    return F.to_date(F.substring(name, 5, 8), "yyyyMMdd")

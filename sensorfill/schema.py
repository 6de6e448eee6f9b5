"""Input schemas, column names and fixed values of the count data."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per site-season, per sensor, per day. Keys are always several columns:
# a packed number collides once a site id passes 99 or a location passes 9.
SEASON = ["year", "site_id"]
SENSOR = ["site_id", "location"]
SEASON_DAY = ["year", "site_id", "julian_day"]

RAW_OBSERVATIONS = T.StructType(
    [
        T.StructField("Year", T.IntegerType()),
        T.StructField("Name", T.StringType()),
        T.StructField("Region", T.StringType()),
        T.StructField("Method", T.StringType()),
        T.StructField("Hour", T.IntegerType()),
        T.StructField("TotalAnglerCount", T.IntegerType()),
        T.StructField("DoY", T.IntegerType()),
        T.StructField("ToD", T.IntegerType()),
        T.StructField("datetime", T.DoubleType()),
        T.StructField("location", T.IntegerType()),
        T.StructField("weekend", T.IntegerType()),
        T.StructField("Date", T.StringType()),
        T.StructField("Day", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("WBID", T.StringType()),
        T.StructField("Time", T.StringType()),
        T.StructField("Include", T.IntegerType()),
        T.StructField("DoW", T.StringType()),
    ]
)

RAW_SITES = T.StructType(
    [
        T.StructField("Lake", T.StringType()),
        T.StructField("SA", T.DoubleType()),
        T.StructField("Access", T.IntegerType()),
        T.StructField("DistKam", T.DoubleType()),
        T.StructField("DistVan", T.DoubleType()),
        T.StructField("Pseen", T.DoubleType()),
        T.StructField("Launch", T.IntegerType()),
        T.StructField("Camp", T.IntegerType()),
        T.StructField("Resort", T.IntegerType()),
        T.StructField("WBID", T.StringType()),
        T.StructField("Region", T.StringType()),
        T.StructField("Elevation", T.DoubleType()),
        T.StructField("Perim", T.DoubleType()),
        T.StructField("Mdepth", T.DoubleType()),
        T.StructField("MuDepth", T.DoubleType()),
        T.StructField("Distgravel", T.DoubleType()),
    ]
)

# Raw to engine column names, columns not used, method codes,
# the two sites whose sensor is invalid, and default settings.
OBSERVATION_NAMES = {
    "Year": "year",
    "Name": "name",
    "Region": "region",
    "Method": "method",
    "Hour": "hour",
    "TotalAnglerCount": "angler_count",
    "DoY": "julian_day",
    "ToD": "time_of_day",
}
OBSERVATION_UNUSED = ["Date", "Day", "Month", "WBID", "Time", "Include", "DoW"]
SITE_NAMES = {
    "Lake": "name",
    "SA": "area",
    "Access": "access",
    "DistKam": "dist_kam",
    "DistVan": "dist_van",
    "Pseen": "p_seen",
    "Launch": "launch",
    "Camp": "camp",
    "Resort": "resort",
}
SITE_UNUSED = ["WBID", "Region", "Elevation", "Perim", "Mdepth", "MuDepth", "Distgravel"]
GROUND = "GR"
CAMERA = "CAM"
EXCLUDED_SITES = ("CHIEFGRAY", "ROCHE")
FIRST_IMPUTED_YEAR = 2009
COVERAGE_CUTOFF = 0.3
N_DONORS = 2
TRAINING_SHARE = 0.8
SITE_ATTRIBUTES = [
    "area", "access", "dist_kam", "dist_van", "p_seen", "launch", "camp", "resort",
]
SEASON_ATTRIBUTES = [
    "site_id", "year", "area", "region", "access", "launch", "camp", "resort",
    "dist_kam", "dist_van",
]

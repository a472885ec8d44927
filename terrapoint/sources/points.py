"""Point sources: comma-separated lines, GeoJSON, Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapoint.operators.query import numbered

#: A decimal number as the line format has it; nan and infinities are not points.
_NUMBER = "^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _double(c: Column) -> Column:
    value = F.when(F.trim(c).rlike(_NUMBER), F.trim(c).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """x0, x1 and label of the lines (column value) that are points: "x,y" or "x,y,label". Blank lines, # comments,
    headers and rows with a bad number are skipped; a label keeps its commas; label is null where none is given."""
    line = F.trim("value")
    parts = F.split(line, ",", 3)
    kept = lines.where((line != "") & ~line.startswith("#")).select("*", parts.alias("parts_"))
    made = kept.select(*[c for c in lines.columns if c != "value"], _double(F.get("parts_", F.lit(0))).alias("x0"), _double(F.get("parts_", F.lit(1))).alias("x1"), F.trim(F.get("parts_", F.lit(2))).alias("label"))
    return made.where("x0 is not null and x1 is not null")


def _named(df: DataFrame, order: list[str], start: int) -> DataFrame:
    """id in file order and a default label pt{place among the accepted rows of this load}."""
    out = numbered(df, order, start)
    place = (F.col("id") - F.lit(start)).cast("string")
    return out.select("id", "x0", "x1", F.coalesce(F.when(F.col("label") != "", F.col("label")), F.concat(F.lit("pt"), place)).alias("label"))


def read_csv(spark: SparkSession, path: str, start_id: int = 0) -> DataFrame:
    """id, x0, x1, label of a file or folder of lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("line_"))
    return _named(parsed_lines(lines), ["file_", "block_", "line_"], start_id)


def read_geojson(spark: SparkSession, path: str, start_id: int = 0) -> DataFrame:
    """id, x0, x1, label of every "coordinates" array that starts with two numbers; nested arrays (lines, polygons)
    are skipped, further ordinates and properties ignored. A document is one value, as JSON has no line structure."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_"), "value")
    found = text.select("file_", F.posexplode(F.regexp_extract_all("value", F.lit('"coordinates"[ \\t\\r\\n]*:?[ \\t\\r\\n]*\\[([^\\]]*)\\]'), F.lit(1))).alias("line_", "body"))
    parts = F.split("body", ",")
    rows = found.select("file_", "line_", _double(F.get(parts, F.lit(0))).alias("x0"), _double(F.get(parts, F.lit(1))).alias("x1"), F.lit(None).cast("string").alias("label"))
    return _named(rows.where("x0 is not null and x1 is not null"), ["file_", "line_"], start_id)


def load(spark: SparkSession, path: str, start_id: int = 0) -> DataFrame:
    """By suffix: .geojson and .json are GeoJSON, .parquet a table with id, x0, x1 and label, all else lines."""
    lower = path.lower().rstrip("/")
    if lower.endswith((".geojson", ".json")):
        return read_geojson(spark, path, start_id)
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, start_id)

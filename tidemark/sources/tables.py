"""Scans of the engine's tables, registries and dictionaries [S01-S14 S41 S45 D4]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schemas
from tidemark.functions import classify
from tidemark.functions import fixed as V
from tidemark.functions import period as P


def padded(code: Column) -> Column:
    """A prefecture code of two digits at least; longer ones stay whole."""
    return F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)


def scan(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table with just the columns of schema, whatever the files hold: missing ones are null, others are
    cast, what can't be cast is null. A table that isn't there is empty."""
    try:
        found = spark.read.parquet(path)
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x):
            raise
        return spark.createDataFrame([], schema)
    there = {c.lower(): c for c in found.columns}
    return found.select(*((F.col(there[f.name.lower()]).try_cast(f.dataType) if f.name.lower() in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def market_stats(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.MARKET_STATS).withColumn("pref_code", padded(F.col("pref_code")))


def occupancy(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a rate; those without a prefecture are national."""
    df = scan(spark, path, schemas.OCCUPANCY)
    return df.select(
        "ym", F.coalesce(padded(F.col("pref_code")), F.lit(V.NATIONAL[0])).alias("pref_code"), F.coalesce("pref_name", F.lit(V.NATIONAL[1])).alias("pref_name"),
        F.regexp_replace("facility_type", r"(?U)\s+", "").alias("facility_type"), "occupancy_rate",
    ).dropna(subset=["occupancy_rate"])


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all text; quotes are doubled inside quotes, and fields may hold line breaks."""
    return spark.read.csv(path, header=True, escape='"', multiLine=True)


def _list(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def artist_registry(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select("artist_id", "canonical_name", _list(F.col("aliases_json")).alias("aliases"), text("source").alias("source"), text("updated_at").alias("updated_at"), classify.tolerant_bool(text("is_enabled"), True).alias("is_enabled"), classify.tolerant_bool(text("ticketjam_watch"), False).alias("ticketjam_watch"), text("ticketjam_benchmark_tier").alias("ticketjam_benchmark_tier"), text("ticketjam_watch_reason").alias("ticketjam_watch_reason"))


def venue_registry(spark: SparkSession, path: str) -> DataFrame:
    """Venues; a blank capacity is null."""
    df = csv(spark, path)
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    special = {"capacity": text("capacity").try_cast("int"), "pref_code": padded(text("pref_code")), "is_enabled": classify.tolerant_bool(text("is_enabled"), True)}
    return df.select(*((special.get(f.name, text(f.name))).cast(f.dataType).alias(f.name) for f in schemas.VENUES.fields))


def venue_aliases(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    return df.select("venue_id", "canonical_name", _list(F.col("aliases_json")).alias("aliases"), "source", "updated_at", classify.tolerant_bool(F.col("is_enabled"), True).alias("is_enabled"))


def inferred_artists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(by event_uid, by title), each with artist_name and artist_confidence; the last row counts, a blank confidence is high."""
    from tidemark.operators.rows import first_of

    df = csv(spark, path).withColumn("artist_confidence", F.coalesce(F.nullif(F.trim("artist_confidence"), F.lit("")), F.lit("high"))).withColumn("__n", F.monotonically_increasing_id())
    last = lambda k: first_of(df.where(F.coalesce(F.trim(k), F.lit("")) != ""), [k], [F.desc("updated_at"), F.desc("__n")]).select(k, "artist_name", "artist_confidence")
    return last("event_uid"), last("title")


def metadata(spark: SparkSession, path: str) -> dict:
    """A metadata document; empty if there is none."""
    import json

    try:
        text = spark.read.text(path, wholetext=True).first()
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x):
            raise
        return {}
    return json.loads(text[0]) if text else {}


def target_sources(sources: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Sources by id if ids are given, also disabled ones, else the enabled ones; in the order of ids."""
    return (sources.where(F.col("source_id").isin(*only)) if only else sources.where("is_enabled")).orderBy("source_id")


def option_values(df: DataFrame, column: str, pinned: str | None = None) -> DataFrame:
    """The different values in order, the pinned one first [P34 O08]."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.orderBy(F.col(column) != pinned, column) if pinned is not None else values.orderBy(column)


def region_members(df: DataFrame, code: str, region: str) -> DataFrame:
    """Rows of a region's prefectures [P06 P07 P22]."""
    return df.where(classify.region(F.col(code)) == region)


def last_months(df: DataFrame, ym: str, months: int = 36) -> DataFrame:
    """Rows of the last so many months that df has [P20]."""
    recent = df.select(ym).distinct().orderBy(F.desc(ym)).limit(months)
    return df.join(F.broadcast(recent), ym, "left_semi")


def last_years(df: DataFrame, ym: str, years: int = 4) -> DataFrame:
    """Rows of the last so many years that df has [P21]."""
    dated = df.withColumn("__year", P.year_of(F.col(ym)))
    recent = dated.select("__year").distinct().orderBy(F.desc("__year")).limit(years)
    return dated.join(F.broadcast(recent), "__year", "left_semi").drop("__year")

"""Gap, overlap and normalisation audits [A24-A29 A34-A38 F38 F39 X09]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.records import ratio


def gaps(**checks: Column) -> Column:
    """The names of the checks that hold, in the given order [F38 F39]."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))


def normalisation_gaps() -> Column:
    """What is missing or unmatched in a record's date, venue, artist and category."""
    no = lambda *c: F.coalesce(*(F.nullif(F.trim(F.col(x)), F.lit("")) for x in c)).isNull()
    return gaps(
        missing_event_date=no("event_date"),
        missing_venue=no("venue_name", "raw_venue_name"),
        unmatched_venue=~no("venue_name", "raw_venue_name") & ~F.coalesce("venue_matched", F.lit(False)),
        missing_artist=no("artist_name", "raw_artist_name"),
        unmatched_artist=~no("artist_name", "raw_artist_name") & ~F.coalesce("artist_matched", F.lit(False)),
        missing_category=no("event_category"),
    )


def label_counts(df: DataFrame, labels: str, by: list[str] | None = None) -> DataFrame:
    """(label, n): rows by each of their labels [A27 A28]."""
    return df.select(*(by or []), F.explode(labels).alias("label")).groupBy(*(by or []), "label").agg(F.count("*").alias("n"))


def same_event(df: DataFrame, keys: list[str], source: str = "source_id", least: int = 2) -> DataFrame:
    """(keys, sources, records, source_list) of the groups with records of at least that many sources [A26]."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.countDistinct(source).alias("sources"), F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("source_list")).where(F.col("sources") >= least)


def scope_metrics(resale: DataFrame, baseline: DataFrame, keys: list[str], watched: DataFrame, name: str) -> DataFrame:
    """For each watched name, also without hits: its different schedules, how many are new against the baseline,
    how many overlap, and the overlap's share [A24 J19]."""
    hits = resale.select(*keys).distinct().join(baseline.select(*keys).distinct().withColumn("__known", F.lit(1)), keys, "left")
    each = hits.groupBy(name).agg(F.count("*").alias("hits"), F.count("__known").alias("overlap"))
    rows = watched.select(name).distinct().join(each, name, "left").fillna(0, ["hits", "overlap"])
    return rows.select(name, "hits", (F.col("hits") - F.col("overlap")).alias("additional"), "overlap", ratio(F.col("overlap"), F.col("hits")).alias("noise_rate"))


def scope_summary(resale: DataFrame, baseline: DataFrame, keys: list[str], watched_artists: DataFrame, watched_venues: DataFrame, artist: str, venue: str) -> DataFrame:
    """One row: different schedules, those in scope (artist or venue watched), new and overlapping ones, and both rates [A24 U03]."""
    unique = resale.select(*keys).distinct()
    for names, c, flag in ((watched_artists, artist, "__a"), (watched_venues, venue, "__v")):
        unique = unique.join(names.select(c).distinct().withColumn(flag, F.lit(True)), c, "left")
    unique = unique.join(baseline.select(*keys).distinct().withColumn("__known", F.lit(True)), keys, "left")
    scoped = F.coalesce("__a", "__v", F.lit(False))
    sums = unique.agg(F.count("*").alias("unique"), F.count_if(scoped).alias("in_scope"), F.count_if(scoped & F.col("__known").isNull()).alias("additional"), F.count_if(scoped & F.col("__known").isNotNull()).alias("overlap"))
    return sums.select("*", ratio(F.col("overlap"), F.col("in_scope")).alias("noise_rate"), ratio(F.col("unique") - F.col("in_scope"), F.col("unique")).alias("out_of_scope_rate"))


def extent(df: DataFrame, **columns: str) -> DataFrame:
    """One row: how many rows, and minimum, maximum and different values of each column [A35 A36 K14]."""
    made = [F.count("*").alias("rows")]
    for n, c in columns.items():
        made += [F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), F.countDistinct(c).alias(f"{n}_distinct")]
    return df.agg(*made)


def grouped_schedules(df: DataFrame, by: list[str], info: str) -> DataFrame:
    """Schedules of one date and venue, their different infos joined in order [A38]."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(info)), " | ").alias(info))


def merged_reports(**reports: DataFrame) -> DataFrame:
    """Rows of several reports in one table, each with the name of its bucket [X09]."""
    made = None
    for bucket, df in reports.items():
        named = df.withColumn("bucket", F.lit(bucket))
        made = named if made is None else made.unionByName(named, allowMissingColumns=True)
    if made is None:
        raise ValueError("no report is given")
    return made

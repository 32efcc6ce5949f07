"""Choice and comparison of rows: de-duplication, best rows, forward fill, sets [W02-W08 W10-W12 W15 U01-U05 J15 J18 J19 J21-J24 P17 P25 P29-P31]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. The order must be total; it is what decides, not the order of the input [W02-W05 W07 W11]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def least_of(df: DataFrame, keys: list[str], by: Column, columns: list[str]) -> DataFrame:
    """As first_of for a few columns, by aggregation: rows of a popular key are combined before they move [W06 W15]."""
    best = F.min_by(F.struct(*columns), by).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__best.{c}") for c in columns))


def filled_forward(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """column with the last value that isn't null, in the order of each series [W12 W10]."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Place of each row within its group, from 1 [W08]."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def prune_missing_rows(known: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Known rows that were fetched again; an empty fetch leaves none [J15]."""
    return known.join(fetched.select(key).distinct(), key, "left_semi")


def prune_missing_unless_empty(known: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """As prune_missing_rows, but an empty fetch leaves all [J18]."""
    some = fetched.agg((F.count("*") > 0).alias("__some"))
    flagged = known.join(fetched.select(key).distinct().withColumn("__there", F.lit(True)), key, "left").join(F.broadcast(some))
    return flagged.where(F.coalesce("__there", F.lit(False)) | ~F.col("__some")).select(*known.columns)


def not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def also_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, *columns): rows that are in one of two sets alone [U05]."""
    return before.subtract(after).withColumn("side", F.lit("removed")).unionByName(after.subtract(before).withColumn("side", F.lit("added")))


def filled_blanks(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row a key: of each column the first value that isn't blank, in the given order [J22]."""
    value = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return df.groupBy(*keys).agg(*(F.min_by(value(c), F.when(value(c).isNotNull(), order)).alias(c) for c in columns))


def following(anchors: DataFrame, cells: DataFrame, by: list[str], row: str, count: int) -> DataFrame:
    """(by, anchor, row...) of the up to ``count`` rows below each anchor in its group: an equi-join on the group and on
    blocks of rows, so that a large group isn't joined whole with itself [J24]."""
    a = anchors.select(*by, F.col(row).alias("anchor")).withColumn("__block", F.explode(F.array_distinct(F.array(F.floor((F.col("anchor") + 1) / count), F.floor((F.col("anchor") + count) / count)))))
    b = cells.withColumn("__block", F.floor(F.col(row) / count))
    return a.join(b, [*by, "__block"]).where((F.col(row) > F.col("anchor")) & (F.col(row) <= F.col("anchor") + count)).drop("__block")


def overlapping(df: DataFrame, start: str, end: str, lo: str, hi: str) -> DataFrame:
    """Rows whose range meets the given one [P09]."""
    return df.where((F.col(end) >= min(lo, hi)) & (F.col(start) <= max(lo, hi)))


def repaired_range(start: Column, end: Column, fallback: Column) -> tuple[Column, Column]:
    """(start, end): a missing start becomes the fallback, an end before the start becomes the start [P25]."""
    first = F.coalesce(start, fallback)
    return first, F.greatest(first, F.coalesce(end, first))


def within_history(df: DataFrame, end: str, as_of: str, days: int = 90) -> DataFrame:
    """Rows that end no more than ``days`` before as_of [P17]."""
    if days < 0:
        raise ValueError("the history window can't be negative")
    return df.where(F.col(end) >= F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd"))


def around(df: DataFrame, date: str, as_of: str, before: int = 30, after: int = 365) -> DataFrame:
    """Rows dated from ``before`` days before as_of to ``after`` days after [P15]."""
    day = F.lit(as_of).cast("date")
    return df.where(F.col(date).between(F.date_format(F.date_sub(day, before), "yyyy-MM-dd"), F.date_format(F.date_add(day, after), "yyyy-MM-dd")))


def without_past(df: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Rows whose end, or start if they have none, isn't before as_of; rows without a valid date stay [P30]."""
    last = F.coalesce(F.nullif(F.col(end), F.lit("")), F.col(start))
    return df.where(~F.coalesce(last.rlike(r"^\d{4}-\d{2}-\d{2}$") & (last < as_of), F.lit(False)))


def complete(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all of the columns filled, one row of counts: kept, dropped) [P29 P31]."""
    full = F.lit(True)
    for c in columns:
        full = full & (F.coalesce(F.trim(c), F.lit("")) != "")
    counts = df.agg(F.count_if(full).alias("kept"), F.count_if(~full).alias("dropped"))
    return df.where(full), counts

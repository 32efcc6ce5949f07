"""Statistics over months, regions, segments and items [A01-A20 W01 W09 W14 U06 O02 O05 O06 J06 J07].

All are declarative: grouping keys are what the caller names, so rows are combined on each task before they
move, and windows are over aggregated rows, one for each key and month, not over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed as V
from tidemark.functions import period as P


def cents(c: Column) -> Column:
    """Hundredths as a long: sums of them don't depend on order."""
    return F.round(c * 100).cast("long")


def summed(df: DataFrame, by: list[str], measures: list[str], keep_null: bool = False) -> DataFrame:
    """Sums by key [A01 A07-A14]. The sum of no values is 0, or null with keep_null; rows without a key are left out."""
    total = lambda m: F.sum(m) if keep_null else F.coalesce(F.sum(m), F.lit(0))
    return df.dropna(subset=by).groupBy(*by).agg(*(total(m).alias(m) for m in measures))


def with_national(df: DataFrame, code: str, by: list[str], measures: list[str]) -> DataFrame:
    """The rows of single areas and their sum as area 00, which replaces one that the data bring along [A02]."""
    single = df.where(F.col(code) != V.NATIONAL[0])
    whole = summed(single, by, measures).withColumn(code, F.lit(V.NATIONAL[0]))
    return single.select(code, *by, *measures).unionByName(whole.select(code, *by, *measures))


def rolling(df: DataFrame, by: list[str], order: str, measures: list[str], rows: int = 12) -> DataFrame:
    """Sums of each measure over the last ``rows`` rows of its series, where all measures have all of them [W01].

    It counts rows: a month that is missing isn't filled in. Filter ranges after it, not before.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)
    over = df.select(*by, order, *(F.sum(m).over(w).alias(m) for m in measures), *(F.count(m).over(w).alias(f"__{m}") for m in measures))
    whole = F.lit(True)
    for m in measures:
        whole = whole & (F.col(f"__{m}") == rows)
    return over.where(whole).select(*by, order, *(F.bround(m).cast("long").alias(m) for m in measures))


def fiscal_mean(df: DataFrame, ym: str, value: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Mean by fiscal year and month (and other keys) of values in cents [A03 A04]."""
    dated = df.withColumn("month", P.month_of(F.col(ym))).withColumn("fiscal_year", P.fiscal_year(P.year_of(F.col(ym)), F.col("month")))
    return dated.groupBy(*(by or []), "fiscal_year", "month").agg(F.round(F.sum(value) / F.count(value) / 100, digits).alias("mean"))


def latest_mean(df: DataFrame, ym: str, value: str) -> DataFrame:
    """(ym, mean) of the last month; mean 0.0 if it has no values [A05]."""
    last = df.agg(F.max(ym).alias(ym))
    return df.join(F.broadcast(last), ym, "left_semi").groupBy(ym).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def length_of_stay(df: DataFrame, open_bin_nights: float = V.OPEN_BIN_NIGHTS, digits: int = 6) -> DataFrame:
    """Estimated length of stay by segment, from (segment, bin 1 to 8, value in nights); bin 8 is open [A06 J07].

    (segment, total_nights, estimated_stays, one_night_stays, los, one_night_share, two_plus_share); segments without stays drop out.
    """
    nights = F.when(F.col("bin") == 8, F.lit(open_bin_nights)).when(F.col("bin").between(1, 7), F.col("bin").cast("double"))
    sums = df.dropna(subset=["segment", "bin"]).groupBy("segment", "bin").agg(F.sum("value").alias("value"))
    stays = sums.withColumn("stays", F.col("value") / nights).where(F.col("stays").isNotNull())
    each = stays.groupBy("segment").agg(
        F.sum("value").alias("total_nights"),
        F.round(F.sum("stays"), digits).alias("estimated_stays"),
        F.coalesce(F.sum(F.when(F.col("bin") == 1, F.col("stays"))), F.lit(0.0)).alias("one_night_stays"),
    )
    each = each.where(F.col("estimated_stays") > 0)
    share = lambda c: F.round(c / F.col("estimated_stays") * 100, digits)
    return each.select(
        "segment", "total_nights", "estimated_stays", "one_night_stays",
        F.round(F.col("total_nights") / F.col("estimated_stays"), digits).alias("los"),
        share(F.col("one_night_stays")).alias("one_night_share"),
        share(F.greatest(F.col("estimated_stays") - F.col("one_night_stays"), F.lit(0.0))).alias("two_plus_share"),
    )


def monthly_average(df: DataFrame, by: list[str], ym: str, value: str, digits: int = 4) -> DataFrame:
    """Total by key over the number of different months in all of df [A12 A14 A15]."""
    months = df.agg(F.countDistinct(ym).alias("months"))
    totals = df.groupBy(*by).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    return totals.join(F.broadcast(months)).select(*by, "total", "months", F.round(F.col("total") / F.col("months"), digits).alias("average"))


def pivoted(df: DataFrame, by: list[str], name: str, values: list[str], measure: str, fill: bool = True) -> DataFrame:
    """Sums of measure with a column for each of the given values of name; 0 for none if fill [A18 A20]."""
    wide = df.groupBy(*by).pivot(name, values).agg(F.sum(measure))
    return wide.fillna(0, values) if fill else wide


def year_by_month(df: DataFrame, years: list[int], ym: str, measure: str, fill: bool = True) -> DataFrame:
    """Twelve rows, one for each month, and a column y<year> for each year, there or not [A19]."""
    dated = df.select(P.year_of(F.col(ym)).alias("year"), P.month_of(F.col(ym)).alias("month"), F.col(measure).alias("v")).where(F.col("year").isin(*years))
    sums = dated.groupBy("month").agg(*(F.sum(F.when(F.col("year") == y, F.col("v"))).alias(f"y{y}") for y in years))
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    wide = months.join(sums, "month", "left")
    return wide.fillna(0, [f"y{y}" for y in years]) if fill else wide


def releases(df: DataFrame, period: str, release: str) -> DataFrame:
    """(period, releases): the different releases of each period as one text [A21 A39]."""
    return df.groupBy(period).agg(F.array_join(F.array_sort(F.collect_set(release)), ",").alias("releases"))


def latest_release(df: DataFrame, period: str, release: str, preference: list[str]) -> DataFrame:
    """Rows of the last period, of the most preferred release that it has [W09]."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, preference)), F.col(release)), F.lit(0))
    rank = F.when(rank == 0, len(preference) + 1).otherwise(rank)
    best = df.agg(F.max_by(F.struct(F.col(period).alias("p"), F.lit(0).alias("x")), F.col(period)).alias("b")).select(F.col("b.p").alias(period))
    last = df.withColumn("__rank", rank).join(F.broadcast(best), period, "left_semi")
    return last.join(F.broadcast(last.agg(F.min("__rank").alias("__rank"))), "__rank", "left_semi").drop("__rank")


def shares(df: DataFrame, by: list[str], parts: list[str], digits: int = 4) -> DataFrame:
    """Long form: for each row of df, each part's value and its share of the parts' sum, rounded half to even [W14 U06]."""
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    long = df.withColumn("__total", total).unpivot([*by, "__total"], parts, "part", "value")
    return long.select(*by, "part", "value", F.coalesce(F.bround(F.try_divide(F.col("value") * 100, F.col("__total")), digits), F.lit(0.0)).alias("share_pct"))


def top(df: DataFrame, measure: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows with the greatest measure; ties go by the given columns [O05 A34]."""
    return df.dropna(subset=[measure]).orderBy(F.desc(measure), *ties).limit(n)


def of_top(df: DataFrame, by: str, measure: str, n: int) -> DataFrame:
    """The rows of df whose key is among the n with the greatest sum [O06]."""
    best = top(summed(df, [by], [measure]), measure, n, [by]).select(by)
    return df.join(F.broadcast(best), by, "left_semi")


def in_order(c: Column, values: tuple[str, ...]) -> Column:
    """Place of a value in a fixed order; 999 for others [O02]."""
    place = F.array_position(F.array(*map(F.lit, values)), c)
    return F.when(place > 0, place).otherwise(999)


def merged_metrics(nights: DataFrame, spend: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two metric tables, whose null keys match; respondents from the first that has them;
    spend per night where there are nights [J06 F44]."""
    a, b = nights.alias("a"), spend.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, same, "full")
    return both.select(
        *(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys),
        F.coalesce("a.respondents", "b.respondents").alias("respondents"),
        F.col("b.spend").alias("spend"),
        F.col("a.nights").alias("nights"),
        F.when(F.col("a.nights") > 0, F.round(F.col("b.spend") / F.col("a.nights"), 4)).alias("spend_per_night"),
    )

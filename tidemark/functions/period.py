"""Months, quarters, fiscal years, period keys and numbers, as column expressions [P01-P05 P15 P20 P23 F10-F16 F18 O03 O04]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ym_of(date: Column) -> Column:
    """YYYY-MM of a date or timestamp."""
    return F.date_format(date, "yyyy-MM")


def year_of(ym: Column) -> Column:
    return F.substring(ym, 1, 4).try_cast("int")


def month_of(ym: Column) -> Column:
    return F.substring(ym, 6, 2).try_cast("int")


def month_label(ym: Column) -> Column:
    return F.substring(ym, 6, 2)


def build_ym(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year, month)


def ym_number(ym: Column) -> Column:
    """YYYYMM as a number."""
    return year_of(ym) * 100 + month_of(ym)


def clamped(ym: Column, least: str, most: str) -> Column:
    """(ym within the range, whether it had to be moved)."""
    inside = F.greatest(F.lit(least), F.least(F.lit(most), ym))
    return F.struct(inside.alias("ym"), (inside != ym).alias("moved"))


def between(c: Column, a: str, b: str) -> Column:
    """Inclusive range of text; bounds given the wrong way round are swapped."""
    return c.between(min(a, b), max(a, b))


def fiscal_year(year: Column, month: Column) -> Column:
    """April to March."""
    return F.when(month >= 4, year).otherwise(year - 1)


def quarter_key(ym: Column) -> Column:
    """YYYYQn of YYYY-MM; null if it isn't one."""
    month = month_of(ym)
    return F.when(ym.rlike(r"^\d{4}-\d{2}$") & month.between(1, 12), F.concat(F.substring(ym, 1, 4), F.lit("Q"), F.ceil(month / 3).cast("string")))


def period_order(key: Column) -> Column:
    """Sort key of mixed period keys: by year, then the whole year, quarters, months; 'total' and others last."""
    year = F.regexp_extract(key, r"^(\d{4})", 1).try_cast("int")
    quarter = F.regexp_extract(key, r"^\d{4}Q([1-4])$", 1).try_cast("int")
    month = F.regexp_extract(key, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    kind = F.when(key.rlike(r"^\d{4}$"), 0).when(quarter.isNotNull(), 1).when(month.isNotNull(), 2).otherwise(3)
    return F.struct(F.coalesce(year, F.lit(9999)).alias("year"), kind.alias("kind"), F.coalesce(quarter, month, F.lit(0)).alias("part"))


def company_period_order(key: Column) -> Column:
    """Sort key of travel-agency periods: 'total' first, months in order, what isn't known last."""
    return F.struct(F.when(key == "total", 0).when(key.rlike(r"^\d{4}-\d{2}$"), 1).otherwise(2).alias("kind"), key.alias("key"))


def number(text: Column) -> Column:
    """A double from text with thousands separators; dashes, dots and blanks stand for no value."""
    bare = F.regexp_replace(text.cast("string"), r"(?U)[,\s]", "")
    return F.when(bare.isin("", "-", "－", "…", "***"), F.lit(None)).otherwise(bare).try_cast("double")


def gregorian(era: Column, year: Column) -> Column:
    """Year of an era; its first year is written 元."""
    n = F.when(year == "元", F.lit(1)).otherwise(year.try_cast("int"))
    return n + F.when(era == "令和", 2018).when(era == "平成", 1988).when(era == "昭和", 1925)


def stay_period(title: Column) -> Column:
    """(period_type, period_key, period_label) of a statistics title; null fields if it names no period."""
    t = F.regexp_replace(title, "[〜～−－―]", "-")
    # The forms in which titles write a period.
    span = r"(20\d{2})年(?U)\s*([1-9]|1[0-2])\s*-\s*([1-9]|1[0-2])月"
    named = r"(?i)(20\d{2})年(?U)\s*Q([1-4])"
    year = F.when(t.rlike(span), F.regexp_extract(t, span, 1)).when(t.rlike(named), F.regexp_extract(t, named, 1))
    quarter = F.when(t.rlike(span), F.floor((F.regexp_extract(t, span, 2).try_cast("int") + 2) / 3).cast("string")).when(t.rlike(named), F.regexp_extract(t, named, 2))
    annual = F.nullif(F.regexp_extract(t, r"(20\d{2})年", 1), F.lit(""))
    return F.struct(
        F.when(year.isNotNull(), "quarter").when(annual.isNotNull(), "annual").alias("period_type"),
        F.when(year.isNotNull(), F.concat(year, F.lit("Q"), quarter)).otherwise(annual).alias("period_key"),
        F.when(year.isNotNull(), F.concat(year, F.lit("年Q"), quarter)).otherwise(F.concat(annual, F.lit("年"))).alias("period_label"),
    )


def spend_period(text: Column) -> Column:
    """(period_label, period_key, release_type) of a spending release's title; a null key if it names no period."""
    t = F.regexp_replace(F.regexp_replace(text, "[〜～－]", "-"), " ", "")
    # The forms in which titles write a period.
    span, annual = r"(20\d{2})年([0-9]{1,2})-([0-9]{1,2})月期", r"(20\d{2})年(?:（令和\d+年）)?(?:年間|暦年)"
    quarter = F.floor((F.regexp_extract(t, span, 2).try_cast("int") + 2) / 3).cast("string")
    is_span, is_annual = t.rlike(span), t.rlike(annual)
    return F.struct(
        F.when(is_span, F.concat(F.regexp_extract(t, span, 1), F.lit("年"), F.regexp_extract(t, span, 2), F.lit("-"), F.regexp_extract(t, span, 3), F.lit("月期"))).when(is_annual, F.concat(F.regexp_extract(t, annual, 1), F.lit("年年間"))).alias("period_label"),
        F.when(is_span, F.concat(F.regexp_extract(t, span, 1), F.lit("Q"), quarter)).when(is_annual, F.regexp_extract(t, annual, 1)).alias("period_key"),
        F.regexp_extract(t, "【([^】]+)】", 1).alias("release_type"),
    )


def release(text: Column) -> Column:
    return F.when(text.contains("確報"), "確報").when(text.rlike("[2２]次速報"), "2次速報")


def hhmm(text: Column) -> Column:
    """HH:MM of the first time in text that isn't part of a longer number; null if there is none or it isn't a time of day."""
    # Fixed value: the form of a time of day.
    form = r"(?<!\d)(\d{1,2}):(\d{2})(?!\d)"
    hour, minute = (F.regexp_extract(text, form, i).try_cast("int") for i in (1, 2))
    return F.when((hour <= 23) & (minute <= 59), F.format_string("%02d:%02d", hour, minute))


def start_time(text: Column) -> Column:
    """The time that stands before 開演, else after a date, else the first one."""
    first = lambda form: F.nullif(F.regexp_extract(text, form, 1), F.lit(""))
    return hhmm(F.coalesce(first(r"(?<!\d)(\d{1,2}:\d{2})(?!\d)(?U)\s*開演"), first(r"\d{4}-\d{2}-\d{2}(?U)\s+(\d{1,2}:\d{2})"), first(r"(?<!\d)(\d{1,2}:\d{2})(?!\d)")))


def fiscal_year_of_text(text: Column) -> Column:
    """YYYY of YYYY年度, one in brackets first."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\((20\d{2})年度\)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(20\d{2})年度", 1), F.lit("")))


def link_period(text: Column) -> Column:
    """total or YYYY-MM of a link's text."""
    t = F.regexp_replace(text, r"(?U)\s+", "")
    form = r"(20\d{2})年.*?([0-9]{1,2})月"
    return F.when(t.contains("総計"), "total").when(t.rlike(form), F.format_string("%s-%02d", F.regexp_extract(t, form, 1), F.regexp_extract(t, form, 2).try_cast("int")))


def to_utc(date: Column, form: str = "yyyy-MM-dd") -> Column:
    """UTC text of a Japanese date or time."""
    return F.date_format(F.to_utc_timestamp(F.try_to_timestamp(date, F.lit(form)), "Asia/Tokyo"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_japan(utc: Column) -> Column:
    """Japanese wall-clock timestamp of UTC text; null if it isn't one."""
    return F.from_utc_timestamp(F.try_to_timestamp(utc), "Asia/Tokyo")

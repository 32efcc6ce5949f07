import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify, fixed, records, text
from tidemark.functions import period as P


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_months_and_fiscal_years(spark):
    ym = F.col("a")
    assert one(spark, "a string", ("2024-03",), P.year_of(ym), P.month_of(ym), P.quarter_key(ym), P.ym_number(ym), P.fiscal_year(P.year_of(ym), P.month_of(ym))) == (2024, 3, "2024Q1", 202403, 2023)
    assert one(spark, "a string", ("2024-04",), P.fiscal_year(P.year_of(ym), P.month_of(ym))) == (2024,)
    assert one(spark, "a string", ("x",), P.year_of(ym), P.quarter_key(ym)) == (None, None)


def test_period_order(spark):
    keys = ["total", "2024-02", "2024Q1", "2024", "2023Q4"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").orderBy(P.period_order(F.col("k")))
    assert [r.k for r in df.collect()] == ["2023Q4", "2024", "2024Q1", "2024-02", "total"]


@pytest.mark.parametrize(("value", "expected"), [("1,234", 1234.0), ("－", None), ("…", None), ("　12.5 ", 12.5), ("x", None), (None, None)])
def test_numbers(spark, value, expected):
    assert one(spark, "a string", (value,), P.number(F.col("a"))) == (expected,)


@pytest.mark.parametrize(("era", "year", "expected"), [("令和", "元", 2019), ("令和", "6", 2024), ("平成", "31", 2019), ("昭和", "64", 1989), ("明治", "1", None)])
def test_eras(spark, era, year, expected):
    assert one(spark, "a string, b string", (era, year), P.gregorian(F.col("a"), F.col("b"))) == (expected,)


@pytest.mark.parametrize(("title", "expected"), [("2025年1-3月期", ("quarter", "2025Q1", "2025年Q1")), ("2025年7～9月期（確報）", ("quarter", "2025Q3", "2025年Q3")), ("2024年", ("annual", "2024", "2024年")), ("x", (None, None, None))])
def test_stay_period(spark, title, expected):
    assert tuple(one(spark, "a string", (title,), P.stay_period(F.col("a")))[0]) == expected


@pytest.mark.parametrize(("title", "key", "kind"), [("2025年10-12月期 【2次速報】", "2025Q4", "2次速報"), ("2025年（令和7年）年間【確報】", "2025", "確報"), ("none", None, "")])
def test_spend_period(spark, title, key, kind):
    found = one(spark, "a string", (title,), P.spend_period(F.col("a")))[0]
    assert (found.period_key, found.release_type) == (key, kind)


@pytest.mark.parametrize(("value", "expected"), [("開場17:00 18:00 開演", "18:00"), ("2026-01-02 9:30", "09:30"), ("25:00", None), ("no", None)])
def test_start_time(spark, value, expected):
    assert one(spark, "a string", (value,), P.start_time(F.col("a"))) == (expected,)


@pytest.mark.parametrize(
    ("title", "artist", "description", "expected"),
    [
        ("サッカー vs 阪神", "", "", fixed.OTHER),
        ("プロ野球", "", "", fixed.BASEBALL),
        ("阪神 vs 巨人", "", "", fixed.BASEBALL),
        ("卒業式", "", "", fixed.OTHER),
        ("卒業式", "X", "", fixed.OTHER),
        ("卒業式 ライブ", "X", "", fixed.CONCERT),
        ("夜会", "X", "", fixed.CONCERT),
        ("World Tour", None, None, fixed.CONCERT),
        ("夜会", " ", None, fixed.OTHER),
    ],
)
def test_event_category(spark, title, artist, description, expected):
    c = [F.col(x) for x in "abc"]
    assert one(spark, "a string, b string, c string", (title, artist, description), classify.event_category(*c)) == (expected,)


def test_app_variant_lacks_the_first_rule(spark):
    c = [F.col(x) for x in "abc"]
    row = ("サッカー vs 阪神", "", "")
    assert one(spark, "a string, b string, c string", row, classify.event_category(*c, variant="app")) == (fixed.BASEBALL,)


def test_resale_and_labels(spark):
    a = [F.lit(x) for x in ("夜会", "X", "", "", "sports-yakyu")]
    assert one(spark, "z int", (1,), classify.resale_category(*a), classify.label_category(F.lit("Music_Event")), classify.signal_category(F.lit("kstyle_music"), F.lit("")), classify.signal_category(F.lit("x"), F.lit("baseball"))) == (fixed.BASEBALL, fixed.CONCERT, fixed.CONCERT, fixed.BASEBALL)


def test_prefectures_and_segments(spark):
    a = F.col("a")
    assert one(spark, "a string", ("東京",), classify.full_prefecture(a), classify.full_prefecture(F.lit("北海道")), classify.full_prefecture(F.lit("x")), classify.bracketed_prefecture(F.lit("会場［大阪府］ホール")), classify.company_segment(F.lit("海外 旅行")), classify.nights_bin(F.lit("8泊 以上")), classify.tier_rank(F.lit("B")), classify.region(F.lit("27"))) == ("東京都", "北海道", None, "大阪府", "overseas", "8泊以上", 2, "近畿（関西）")


@pytest.mark.parametrize(("raw", "keep", "squeezed"), [("【東京】 Ａ－B　c", "a-b c", "abc"), ("＆TEAM", "&team", "&team"), (None, "", ""), ("[x](y) Z", "z", "z")])
def test_normal(raw, keep, squeezed):
    assert (text.normal(raw), text.normal(raw, compact=True)) == (keep, squeezed)


def test_candidates():
    assert text.artist_candidates("EXILE（エグザイル）") == ["EXILE（エグザイル）", "EXILE"]
    assert text.venue_candidates("〇大阪・京セラドーム大阪（x）") == ["〇大阪・京セラドーム大阪（x）", "大阪・京セラドーム大阪（x）", "大阪・京セラドーム大阪", "京セラドーム大阪（x）", "京セラドーム大阪"]
    assert text.venue_candidates(" ") == []


@pytest.mark.parametrize(("value", "expected"), [("普通の文字", None), ("bad�", "forbidden_unicode_codepoint"), ("a\x00", "forbidden_unicode_codepoint"), ("東京ドーム公演".encode().decode("latin1"), "probable_utf8_mojibake"), (None, None), ("", None)])
def test_text_quality(value, expected):
    assert text.quality_issue(value) == expected


def test_broken_text_fails_the_query(spark):
    df = spark.createDataFrame([("ok",), ("bad�",)], "title string")
    with pytest.raises(Exception, match="forbidden_unicode_codepoint"):
        text.require_clean(df, ("title",), "events").collect()
    assert text.require_clean(df.limit(1), ("title",), "events").count() == 1


def test_text_columns(spark):
    assert one(spark, "a string", ("A / B、 C&A",), text.split_names(F.col("a"))) == (["A", "B", "C"],)
    assert one(spark, "a string", ("<b>x</b>  y",), text.stripped_tags(F.col("a"))) == ("x y",)
    assert one(spark, "a string", ("あ" * 200,), text.snippet(F.col("a"))) == ("あ" * 179 + "…",)


def test_labels_and_ids(spark):
    a = F.col("a")
    m = records.labels(a)
    assert one(spark, "a string", ('{"k": "", "n": 5}',), records.label(m, "k", "n"), records.label(m, "n"), records.filled(F.element_at(m, "k"), F.element_at(m, "n"))) == ("", "5", "5")
    assert one(spark, "a string", ("[1]",), records.label(m, "k")) == ("",)
    assert one(spark, "a string", (None,), records.label(m, "k")) == ("",)
    assert one(spark, "z int", (1,), records.event_uid(F.lit("v"), F.lit("k"), F.lit("t"), F.lit("d"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == ("v:k",)
    assert one(spark, "z int", (1,), records.ratio(F.lit(1), F.lit(3)), records.ratio(F.lit(1), F.lit(0))) == (0.3333, 0.0)

"""Statistical workbooks as tables of cells, and the tables that their sheets hold [S15-S29 A18 A02 F11 W12].

A workbook becomes rows (file, sheet, row, col, value), value as text. Everything after that is joins and
windows by (file, sheet), so any number of workbooks is parsed at once.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import classify
from tidemark.functions import period as P
from tidemark.operators import rows as R
from tidemark.operators import stats

KEY = ["file", "sheet"]
_CELLS = "file string, sheet string, row int, col int, value string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: Airports by the name in the list, with official name and code.
AIRPORTS = {
    "新千歳（空港）": ("新千歳空港", "CTS"), "成田（空港）": ("成田国際空港", "NRT"), "羽田（空港）": ("東京国際空港（羽田）", "HND"), "中部（空港）": ("中部国際空港", "NGO"), "関西（空港）": ("関西国際空港", "KIX"),
    "福岡（空港）": ("福岡空港", "FUK"), "那覇（空港）": ("那覇空港", "OKA"), "仙台（空港）": ("仙台空港", "SDJ"), "新潟（空港）": ("新潟空港", "KIJ"), "鹿児島（空港）": ("鹿児島空港", "KOJ"),
    "広島（空港）": ("広島空港", "HIJ"), "熊本（空港）": ("熊本空港", "KMJ"), "長崎（空港）": ("長崎空港", "NGS"),
}
STAY_SEGMENTS = {2: "domestic_total", 5: "domestic_business"}


def cells_of(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of the filled cells of an XLSX file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for cell in ElementTree.fromstring(z.read(path)).iter(f"{_MAIN}c"):
                letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                col = 0
                for x in letters:
                    col = 26 * col + ord(x) - 64
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                if text != "":
                    yield sheet.get("name"), int(digits), col, text


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all workbooks under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                found = [(name.as_py(), *c) for c in cells_of(content.as_py())]
                columns = list(zip(*found)) if found else [()] * 5
                types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "sheet", "row", "col", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _CELLS)


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def layout(cells: DataFrame) -> DataFrame:
    """(file, sheet, month_row, first_col): the first cell, row by row, that is a month, among 30 rows and 80 columns [S15]."""
    months = cells.where((F.col("row") <= 30) & (F.col("col") <= 80) & F.col("value").rlike(r"^(?U)\s*\d{1,2}月"))
    return months.groupBy(*KEY).agg(F.min(F.struct("row", "col")).alias("f")).select(*KEY, F.col("f.row").alias("month_row"), F.col("f.col").alias("first_col"))


def months(cells: DataFrame, max_cols: int = 200) -> DataFrame:
    """(file, sheet, month_row, col, ym): months of the header up to its first gap of two cells or first other text;
    the year above, written once for merged cells, holds until the next one [S16]."""
    at = layout(cells)
    head = cells.join(at, KEY).where((F.col("col") >= F.col("first_col")) & (F.col("col") < F.col("first_col") + max_cols))
    head = head.where((F.col("row") == F.col("month_row")) | (F.col("row") == F.col("month_row") - 1))
    wide = head.groupBy(*KEY, "month_row", "col").agg(F.max(F.when(F.col("row") == F.col("month_row"), F.col("value"))).alias("month"), F.max(F.when(F.col("row") < F.col("month_row"), F.col("value"))).alias("year"))
    in_order = Window.partitionBy(*KEY).orderBy("col")
    wide = wide.where(F.col("month").isNotNull()).withColumn("gap", F.col("col") - F.lag("col").over(in_order))
    ends = F.coalesce((F.col("gap") > 2) | ~F.col("month").rlike(r"^(?U)\s*\d{1,2}月"), F.lit(False)).cast("int")
    wide = wide.withColumn("ended", F.sum(ends).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("ended = 0")
    wide = R.filled_forward(wide, KEY, ["col"], "year")
    era = r"(昭和|平成|令和)(?U)\s*(元|\d+)"
    year = P.gregorian(F.regexp_extract("year", era, 1), F.regexp_extract("year", era, 2))
    return wide.select(*KEY, "month_row", "col", P.build_ym(year, F.regexp_extract("month", r"(\d{1,2})月", 1).try_cast("int")).alias("ym"))


def _prefecture(value: Column) -> Column:
    t = compact(value)
    code = F.regexp_extract(t, r"^(\d{2})(.+)$", 1)
    return F.when(t.startswith("全"), F.struct(F.lit("00").alias("pref_code"), F.lit("全国").alias("pref_name"))).when(code != "", F.struct(code.alias("pref_code"), F.regexp_extract(t, r"^(\d{2})(.+)$", 2).alias("pref_name")))


def prefecture_rows(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, pref_code, pref_name) below the month header, up to two blank rows in the first column [S17]."""
    first = cells.join(layout(cells), KEY).where((F.col("col") == 1) & (F.col("row") > F.col("month_row")) & (F.col("row") <= F.col("month_row") + 200))
    in_order = Window.partitionBy(*KEY).orderBy("row")
    gap = F.col("row") - F.coalesce(F.lag("row").over(in_order), F.col("month_row"))
    kept = first.withColumn("gap", gap).withColumn("ended", F.sum((F.col("gap") > 2).cast("int")).over(in_order)).where("ended = 0")
    return kept.withColumn("p", _prefecture(F.col("value"))).where(F.col("p").isNotNull()).select(*KEY, "row", "p.pref_code", "p.pref_name")


def long_sheet(cells: DataFrame, metric: str) -> DataFrame:
    """(file, sheet, ym, pref_code, pref_name, metric, value): the numeric cells where a prefecture and a month cross [S18]."""
    crossed = cells.join(prefecture_rows(cells), [*KEY, "row"]).join(months(cells).drop("month_row"), [*KEY, "col"])
    return crossed.select(*KEY, "ym", "pref_code", "pref_name", F.lit(metric).alias("metric"), F.col("value").try_cast("double").alias("value")).where(F.col("value").isNotNull())


def occupancy(cells: DataFrame, max_rows: int = 500) -> DataFrame:
    """(file, sheet, ym, pref_code, pref_name, facility_type, occupancy_rate): the prefecture in the first column holds
    until the next one; the table ends at six blank rows; the first row of a key counts [S19]."""
    at = layout(cells)
    side = cells.join(at, KEY).where((F.col("col") <= 2) & (F.col("row") > F.col("month_row")) & (F.col("row") <= F.col("month_row") + max_rows))
    labels = side.groupBy(*KEY, "row", "month_row").agg(F.max(F.when(F.col("col") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("col") == 2, F.col("value"))).alias("b"))
    in_order = Window.partitionBy(*KEY).orderBy("row")
    labels = labels.withColumn("gap", F.col("row") - F.lag("row").over(in_order)).withColumn("ended", F.sum(F.coalesce(F.col("gap") > 6, F.lit(False)).cast("int")).over(in_order)).where("ended = 0")
    labels = R.filled_forward(labels.withColumn("p", _prefecture(F.col("a"))), KEY, ["row"], "p")
    labels = labels.select(*KEY, "row", "p.pref_code", "p.pref_name", compact(F.col("b")).alias("facility_type")).where(F.col("pref_code").isNotNull() & (F.coalesce("facility_type", F.lit("")) != ""))
    crossed = cells.join(labels, [*KEY, "row"]).join(months(cells).drop("month_row"), [*KEY, "col"])
    rates = crossed.withColumn("occupancy_rate", P.number(F.col("value"))).where(F.col("occupancy_rate").isNotNull())
    return R.first_of(rates, [*KEY, "ym", "pref_code", "facility_type"], [F.asc("row"), F.asc("col")]).select(*KEY, "ym", "pref_code", "pref_name", "facility_type", "occupancy_rate")


def national_occupancy(cells: DataFrame) -> DataFrame:
    """[S20]"""
    return occupancy(cells).where("pref_code = '00'").select(*KEY, "ym", "facility_type", "occupancy_rate")


def monthly_sheet(names: list[str], prefix: str, legacy: bool = False) -> str | None:
    """Of the sheets named <prefix>-<n> the one with the lowest n; of those named 旧<prefix>-<n> the highest [S21]."""
    form = re.compile(rf"旧\s*{re.escape(prefix)}-(\d+)" if legacy else rf"{re.escape(prefix)}-(\d+)")
    found = sorted((int(m[1]), n) for n in names if (m := form.fullmatch(n.strip())))
    return (found[-1] if legacy else found[0])[1] if found else None


def market_stats(current: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(ym, pref_code, pref_name, total, jp, foreign) from long sheets of the three metrics; a month that the current
    sheets have is taken from them; the country is the sum of the prefectures [S22 A18 A02 U01]."""

    def wide(long: DataFrame) -> DataFrame:
        single = long.where("pref_code <> '00'")
        made = stats.pivoted(single, ["ym", "pref_code", "pref_name"], "metric", ["total", "jp", "foreign"], "value")
        whole = made.groupBy("ym").agg(*(F.sum(m).alias(m) for m in ("total", "jp", "foreign"))).withColumn("pref_code", F.lit("00")).withColumn("pref_name", F.lit("全国"))
        return made.unionByName(whole)

    if earlier is None:
        return wide(current)
    both = wide(current).withColumn("turn", F.lit(0)).unionByName(wide(earlier).withColumn("turn", F.lit(1)))
    return R.first_of(both, ["ym", "pref_code"], [F.asc("turn")]).drop("turn")


def occupancy_table(current: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Occupancy rows, current ones before earlier ones [S23]."""
    columns = ["ym", "pref_code", "pref_name", "facility_type", "occupancy_rate"]
    both = current.select(*columns).withColumn("turn", F.lit(0))
    if earlier is not None:
        both = both.unionByName(earlier.select(*columns).withColumn("turn", F.lit(1)))
    return R.first_of(both, ["ym", "pref_code", "facility_type"], [F.asc("turn")]).drop("turn")


def stay_nights(cells: DataFrame) -> DataFrame:
    """(file, sheet, section, period_type, period_key, period_label, segment, nights_bin, value) of the eight rows below
    each 宿泊数; its period stands in the nearest of the 19 rows above, leftmost first, else in the sheet's first cell [S24 J24]."""
    anchors = cells.where((F.col("col") == 1) & (compact(F.col("value")) == "宿泊数")).select(*KEY, F.col("row").alias("section"))
    named = cells.where(F.col("col") <= 6).withColumn("p", P.stay_period(F.col("value"))).where(F.col("p.period_key").isNotNull())
    above = anchors.join(named, KEY).where((F.col("row") < F.col("section")) & (F.col("row") >= F.col("section") - 19))
    near = above.groupBy(*KEY, "section").agg(F.min_by("p", F.struct(-F.col("row"), F.col("col"))).alias("near"))
    title = named.where("row = 1 AND col = 1").select(*KEY, F.col("p").alias("title"))
    dated = anchors.join(near, [*KEY, "section"], "left").join(title, KEY, "left").select(*KEY, "section", F.coalesce("near", "title").alias("p"))
    below = R.following(anchors.withColumnRenamed("section", "row"), cells, KEY, "row", 8)
    wide = below.groupBy(*KEY, F.col("anchor").alias("section"), "row").pivot("col", [1, *STAY_SEGMENTS]).agg(F.first("value"))
    wide = wide.withColumn("nights_bin", classify.nights_bin(F.col("1"))).where(F.col("nights_bin").isNotNull())
    each = wide.select(*KEY, "section", "nights_bin", F.explode(F.array(*(F.struct(F.lit(n).alias("segment"), P.number(F.col(str(c))).alias("value")) for c, n in STAY_SEGMENTS.items()))).alias("s"))
    return each.join(dated, [*KEY, "section"]).select(*KEY, "section", "p.period_type", "p.period_key", "p.period_label", "s.segment", "nights_bin", "s.value").where(F.col("value").isNotNull())


_NO_GROUP = ("", "【A1】", "（単一回答）", "（複数回答）", "費目別支出")


def _header(cells: DataFrame, marker: str = "調査項目") -> DataFrame:
    first = cells.where((F.col("row") <= 30) & (F.col("col") <= 8) & F.col("value").contains(marker))
    return first.groupBy(*KEY).agg(F.min("row").alias("header"))


def spend_items(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, nationality, item_group, item, spend_yen, share_pct): columns in pairs below each nationality;
    the group holds until the next one [S25 W12]."""
    at = cells.join(_header(cells), KEY)
    heads = at.where((F.col("row") == F.col("header")) & ~F.col("value").contains("調査項目")).select(*KEY, F.col("col"), F.trim("value").alias("nationality"))
    units = at.where(F.col("row") == F.col("header") + 1).select(*KEY, "col", F.col("value").alias("unit"))
    right = units.select(*KEY, (F.col("col") - 1).alias("col"), F.col("unit").alias("next"))
    pairs = heads.join(units, [*KEY, "col"]).join(right, [*KEY, "col"]).where(F.col("unit").contains("消費単価") & F.col("next").contains("構成比"))
    pairs = R.first_of(pairs, [*KEY, "nationality"], [F.asc("col")])
    body = at.where(F.col("row") >= F.col("header") + 2)
    labels = body.where(F.col("col").between(2, 4)).groupBy(*KEY, "row").agg(*(F.coalesce(F.trim(F.max(F.when(F.col("col") == c, F.col("value")))), F.lit("")).alias(n) for c, n in ((2, "a"), (3, "b"), (4, "c"))))
    opens = ~F.col("a").isin(*_NO_GROUP) & ~F.col("a").rlike("全体|注|調査項目")
    labels = R.filled_forward(labels.withColumn("item_group", F.when(opens, F.col("a"))), KEY, ["row"], "item_group")
    labels = labels.withColumn("item", F.when(F.col("c") != "", F.col("c")).otherwise(F.col("b"))).where(~F.col("item").isin("", "-", "－", "…") & ~F.col("item").rlike("全体|注"))
    value = lambda shift, name: body.select(*KEY, "row", (F.col("col") - shift).alias("col"), P.number(F.col("value")).alias(name))
    crossed = labels.select(*KEY, "row", F.coalesce("item_group", F.lit("その他")).alias("item_group"), "item").join(pairs.select(*KEY, "col", "nationality"), KEY)
    both = crossed.join(value(0, "spend_yen"), [*KEY, "row", "col"], "left").join(value(1, "share_pct"), [*KEY, "row", "col"], "left")
    return both.where(F.col("spend_yen").isNotNull() | F.col("share_pct").isNotNull()).select(*KEY, "row", "nationality", "item_group", "item", "spend_yen", "share_pct")


def entry_metrics(cells: DataFrame, metric: str) -> DataFrame:
    """(file, sheet, port_type, entry_port, nationality, respondents, <metric>): ports under the heading 入国 or 出国 that
    holds until the next; the row 全体 counts for both [S26 W12]."""
    at = cells.join(_header(cells), KEY)
    heads = at.where((F.col("row") == F.col("header")) & ~F.col("value").contains("調査項目")).select(*KEY, "col", F.trim("value").alias("nationality"))
    pairs = R.first_of(heads.where("col > 4"), [*KEY, "nationality"], [F.asc("col")])
    body = at.where(F.col("row") >= F.col("header") + 2)
    labels = body.where(F.col("col").between(2, 4)).groupBy(*KEY, "row").agg(*(F.coalesce(F.trim(F.max(F.when(F.col("col") == c, F.col("value")))), F.lit("")).alias(n) for c, n in ((2, "a"), (3, "b"), (4, "c"))))
    told = F.concat("a", "b")
    state = F.when(told.contains("入国"), "entry").when(told.contains("出国"), "exit")
    labels = R.filled_forward(labels.withColumn("state", state), KEY, ["row"], "state")
    port = F.when(F.col("c") != "", F.col("c")).otherwise(F.col("b"))
    both_ways = F.concat("a", "b", "c").contains("全体")
    labels = labels.select(*KEY, "row", F.when(both_ways, "全体").otherwise(port).alias("entry_port"), F.explode(F.when(both_ways, F.array(F.lit("entry"), F.lit("exit"))).otherwise(F.array("state"))).alias("port_type")).where(F.col("port_type").isNotNull() & (F.col("entry_port") != ""))
    value = lambda shift, name: body.select(*KEY, "row", (F.col("col") - shift).alias("col"), P.number(F.col("value")).alias(name))
    both = labels.join(pairs, KEY).join(value(0, "respondents"), [*KEY, "row", "col"], "left").join(value(1, metric), [*KEY, "row", "col"], "left")
    return both.where(F.col("respondents").isNotNull() | F.col(metric).isNotNull()).select(*KEY, "port_type", "entry_port", "nationality", "respondents", metric)


def company_amounts(cells: DataFrame) -> DataFrame:
    """(file, sheet, company, segment, amount): segments start where row 4 names them; the amount is in the column of
    that segment whose row 6 says 取扱額 and whose row 5 names the period of column 3, else in its first such column [S27]."""
    starts = cells.where("row = 4 AND col <= 40").withColumn("segment", classify.company_segment(F.col("value"))).where(F.col("segment").isNotNull()).groupBy(*KEY, "segment").agg(F.min("col").alias("start"))
    token = cells.where("row = 5 AND col = 3").select(*KEY, F.trim("value").alias("token"))
    units = cells.where((F.col("row") == 6) & F.col("value").contains("取扱額")).select(*KEY, "col")
    years = cells.where("row = 5").select(*KEY, "col", F.trim("value").alias("year"))
    near = starts.join(units, KEY).where((F.col("col") >= F.col("start")) & (F.col("col") < F.col("start") + 5)).join(years, [*KEY, "col"], "left").join(token, KEY, "left")
    places = near.groupBy(*KEY, "segment").agg(F.min(F.struct(F.coalesce(F.col("year") != F.col("token"), F.lit(True)).alias("other"), "col")).alias("b")).select(*KEY, "segment", F.col("b.col").alias("col"))
    name = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    companies = cells.where("row >= 7 AND col = 2").select(*KEY, "row", name.alias("company")).where((F.col("company") != "") & ~(F.col("company").contains("会社") & F.col("company").contains("名")) & ~F.col("company").rlike("合計|参考値"))
    return cells.join(companies, [*KEY, "row"]).join(places, [*KEY, "col"]).select(*KEY, "company", "segment", P.number(F.col("value")).alias("amount")).where(F.col("amount").isNotNull())


def airport_arrivals(cells: DataFrame, fallback: str) -> DataFrame:
    """(file, sheet, period_key, airport_name_raw, airport_name, airport_code, arrivals): known airports from row 4 on; no
    value counts as 0 and one that isn't a number drops the row; the period stands in F2, else it is the fallback [S28 S29]."""
    period = cells.where("row = 2 AND col = 6").select(*KEY, F.regexp_extract("value", r"(20\d{2})[^\d]?([0-9]{1,2})", 1).alias("y"), F.regexp_extract("value", r"(20\d{2})[^\d]?([0-9]{1,2})", 2).try_cast("int").alias("m")).where("y <> ''").select(*KEY, F.format_string("%s-%02d", "y", "m").alias("period_key"))
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("name"), F.lit(x[1]).alias("code")) for k, v in AIRPORTS.items() for x in (k, v)))
    names = cells.where("row >= 4 AND col = 2").select(*KEY, "row", F.trim("value").alias("airport_name_raw")).withColumn("a", F.element_at(known, F.col("airport_name_raw"))).where(F.col("a").isNotNull())
    counts = cells.where("col = 3").select(*KEY, "row", "value")
    both = names.join(counts, [*KEY, "row"], "left").join(period, KEY, "left")
    arrivals = F.when(F.col("value").isNull(), F.lit(0)).otherwise(F.col("value").try_cast("double").cast("long"))
    return both.select(*KEY, F.coalesce("period_key", F.lit(fallback)).alias("period_key"), "airport_name_raw", F.col("a.name").alias("airport_name"), F.col("a.code").alias("airport_code"), arrivals.alias("arrivals")).where(F.col("arrivals").isNotNull())

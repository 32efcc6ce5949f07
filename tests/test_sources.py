import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import feeds, occurrences, schedules, tables, workbooks


def workbook(path, sheets):
    """A small XLSX file; sheets: {name: {(row, col): value}}."""
    from xml.sax.saxutils import escape

    def ref(r, c):
        letters = ""
        while c:
            c, x = divmod(c - 1, 26)
            letters = chr(65 + x) + letters
        return f"{letters}{r}"

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {main} {rel}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        shared = []
        for i, cells in enumerate(sheets.values(), 1):
            body = ""
            for (r, c), v in sorted(cells.items()):
                if isinstance(v, str):
                    shared.append(v)
                    body += f'<c r="{ref(r, c)}" t="s"><v>{len(shared) - 1}</v></c>'
                else:
                    body += f'<c r="{ref(r, c)}"><v>{v}</v></c>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData><row>{body}</row></sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")


def read(spark, tmp_path, sheets):
    workbook(tmp_path / "a.xlsx", sheets)
    return workbooks.read_cells(spark, str(tmp_path / "a.xlsx"))


NIGHTS = {(3, 2): "平成31年", (4, 2): "4月", (3, 3): "令和元年", (4, 3): "5月", (4, 4): "6月", (5, 1): "全　国", (5, 2): 9, (6, 1): "01北海道", (6, 2): 1, (6, 3): 2.5, (6, 4): "-", (7, 1): "02 青森県", (7, 2): 4, (8, 1): "注", (8, 2): 5}


def test_market_stats(spark, tmp_path):
    cells = read(spark, tmp_path, {"1-2": NIGHTS})
    assert [(r.col, r.ym) for r in workbooks.months(cells).orderBy("col").collect()] == [(2, "2019-04"), (3, "2019-05"), (4, "2019-06")]
    assert [(r.row, r.pref_code) for r in workbooks.prefecture_rows(cells).orderBy("row").collect()] == [(5, "00"), (6, "01"), (7, "02")]
    long = workbooks.long_sheet(cells, "total")
    assert {(r.pref_code, r.ym): r.value for r in long.collect()} == {("00", "2019-04"): 9, ("01", "2019-04"): 1, ("01", "2019-05"): 2.5, ("02", "2019-04"): 4}
    every = long.unionByName(workbooks.long_sheet(cells, "jp"))
    made = {(r.ym, r.pref_code): (r.total, r.jp, r.foreign) for r in workbooks.market_stats(every, every.withColumn("value", F.lit(7.0))).collect()}
    assert made[("2019-04", "00")] == (5, 5, 0) and made[("2019-05", "01")] == (2.5, 2.5, 0)


def test_occupancy(spark, tmp_path):
    sheet = {(2, 3): "令和2年", (3, 3): "1月", (3, 4): "2月", (4, 1): "全国", (4, 2): "計", (4, 3): 50, (4, 4): "－", (5, 2): "旅 館", (5, 3): "40.5", (6, 1): "13東京都", (6, 2): "計", (6, 4): 70, (14, 1): "14神奈川県", (14, 2): "計", (14, 3): 1}
    got = {(r.pref_code, r.facility_type, r.ym): r.occupancy_rate for r in workbooks.occupancy(read(spark, tmp_path, {"4-2": sheet})).collect()}
    assert got == {("00", "計", "2020-01"): 50, ("00", "旅館", "2020-01"): 40.5, ("13", "計", "2020-02"): 70}


def test_sheet_choice():
    names = ["1-1", "旧1-1", "旧1-2", "2-2", "4-1"]
    assert workbooks.monthly_sheet(names, "1") == "1-1" and workbooks.monthly_sheet(names, "1", legacy=True) == "旧1-2" and workbooks.monthly_sheet(names, "3") is None


def test_stay_nights(spark, tmp_path):
    sheet = {(1, 1): "2024年（確報）", (3, 1): "2025年1-3月期", (5, 1): "宿泊数", (6, 1): "1泊", (6, 2): 10, (6, 5): "1,000", (7, 1): "8泊以上", (7, 2): "-", (13, 1): "7泊", (13, 2): 3, (14, 1): "2泊", (14, 2): 9, (40, 1): "宿泊数", (41, 1): "2泊", (41, 2): 5}
    got = {(r.section, r.period_key, r.segment, r.nights_bin): r.value for r in workbooks.stay_nights(read(spark, tmp_path, {"T06": sheet})).collect()}
    assert got == {(5, "2025Q1", "domestic_total", "1泊"): 10, (5, "2025Q1", "domestic_business", "1泊"): 1000, (5, "2025Q1", "domestic_total", "7泊"): 3, (40, "2024", "domestic_total", "2泊"): 5}


def test_spend_items(spark, tmp_path):
    sheet = {(2, 2): "調査項目", (2, 5): "全国籍", (3, 5): "消費単価（円）", (3, 6): "構成比（%）", (4, 2): "全体", (4, 5): 9, (5, 2): "宿泊", (5, 4): "宿泊費", (5, 5): 100, (5, 6): 50, (6, 3): "ホテル", (6, 5): "…", (6, 6): 5, (7, 2): "買物", (7, 3): "菓子", (7, 5): 7}
    got = [(r.item_group, r.item, r.spend_yen, r.share_pct) for r in workbooks.spend_items(read(spark, tmp_path, {"参考2": sheet})).orderBy("row").collect()]
    assert got == [("宿泊", "宿泊費", 100, 50), ("宿泊", "ホテル", None, 5), ("買物", "菓子", 7, None)]


def test_company_amounts(spark, tmp_path):
    sheet = {(4, 3): "海外 旅行", (5, 3): "2025年", (6, 3): "取扱額", (5, 4): "2024年", (6, 4): "取扱額", (4, 6): "国内旅行", (5, 6): "2024年", (6, 6): "取扱額", (5, 7): "2025年", (6, 7): "取扱額", (7, 2): "会社名", (8, 2): "A  社", (8, 3): 1, (8, 4): 2, (8, 6): 3, (8, 7): "4,000", (9, 2): "合計", (9, 3): 9}
    got = {(r.company, r.segment): r.amount for r in workbooks.company_amounts(read(spark, tmp_path, {"x": sheet})).collect()}
    assert got == {("A 社", "overseas"): 1, ("A 社", "domestic"): 4000}


def test_airports(spark, tmp_path):
    sheet = {(2, 6): "2025年7月", (4, 2): "成田（空港）", (4, 3): 5, (5, 2): "羽田（空港）", (6, 2): "中部（空港）", (6, 3): "x", (7, 2): "神戸", (7, 3): 1}
    got = {r.airport_code: (r.period_key, r.arrivals) for r in workbooks.airport_arrivals(read(spark, tmp_path, {"x": sheet}), "2000-01").collect()}
    assert got == {"NRT": ("2025-07", 5), "HND": ("2025-07", 0)}


def test_scans(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([("2024-01", "1", "x")], "ym string, pref_code string, total string").write.parquet(p)
    assert tuple(tables.market_stats(spark, p).first()) == ("2024-01", "01", None, None, None, None)
    assert tables.scan(spark, str(tmp_path / "none"), schemas.EVENTS).count() == 0
    (tmp_path / "a.csv").write_text('artist_id,canonical_name,aliases_json,source,updated_at,is_enabled\n1,EXILE,"[""エグザイル""]",m,2024,0\n2,B,,m,2024,\n')
    assert [(r.artist_id, r.aliases, r.is_enabled) for r in tables.artist_registry(spark, str(tmp_path / "a.csv")).orderBy("artist_id").collect()] == [("1", ["エグザイル"], False), ("2", [], True)]
    assert tables.metadata(spark, str(tmp_path / "none.json")) == {}


def test_json_ld():
    data = {"@graph": [{"@type": "MusicEvent", "name": "A &amp; B", "startDate": "2026-01-02T18:00:00+09:00", "performer": [{"name": "X"}, "Y"], "eventStatus": "https://schema.org/EventCancelled", "url": "/e"}, {"@type": "Place"}]}
    page = f'<script type="application/ld+json">{json.dumps(data)}</script><script type="application/ld+json">broken</script>'
    (e,) = feeds.jsonld_events(page, "https://x.jp/a/")
    assert (e["title"], e["start_date"], e["start_time"], e["status"], e["performers"], e["url"], e["all_day"]) == ("A & B", "2026-01-02", "18:00", "cancelled", "X, Y", "https://x.jp/e", False)


def test_calendar():
    text = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART;VALUE=DATE:20260102\r\nSUMMARY:Long\r\n  title\\, yes\r\nSTATUS:TENTATIVE\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:no date\r\nEND:VEVENT\r\n"
    (e,) = feeds.ics_events(text)
    assert (e["title"], e["start_date"], e["all_day"], e["status"], e["source_event_key"]) == ("Long title, yes", "2026-01-02", True, "unknown", "1")


def test_feeds_and_sitemaps():
    rss = "<rss><channel><title>c</title><item><title>T</title><link>https://x/1</link><pubDate>Fri, 02 Jan 2026 09:00:00 +0900</pubDate></item></channel></rss>"
    assert [(x["title"], x["url"], x["published_at_utc"]) for x in feeds.feed_items(rss)] == [("T", "https://x/1", "2026-01-02T00:00:00Z")]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="/1"/><updated>2026-01-02T00:00:00Z</updated></entry></feed>'
    assert feeds.feed_items(atom, "https://x/")[0]["url"] == "https://x/1"
    news = '<urlset xmlns="s" xmlns:n="n"><url><loc>https://x/2</loc><n:news><n:publication_date>2026-01-02T09:00:00+09:00</n:publication_date><n:title>T</n:title></n:news></url></urlset>'
    for content in (news, gzip.compress(news.encode())):
        assert [(x["url"], x["published_at_utc"], x["title"]) for x in feeds.sitemap_entries(content)] == [("https://x/2", "2026-01-02T00:00:00Z", "T")]


def test_links():
    page = '<a href="a.xlsx">一覧</a><a href="/b.xlsx">推移表</a><a href="c.pdf">推移表</a>'
    assert feeds.choose_link(page, "https://x/d/", worded=("推移表",)) == "https://x/b.xlsx"
    assert feeds.choose_link(page, "https://x/d/", named="a") == "https://x/d/a.xlsx"
    assert feeds.choose_link("", "https://x/") is None
    assert feeds.filtered_links(page, "https://x/", ".xlsx", ("推移",)) == [("https://x/b.xlsx", "推移表")]


def test_a_bad_document_doesnt_stop_the_others(spark):
    df = spark.createDataFrame([("1", "<rss><item><title>T</title></item></rss>"), ("2", "<broken"), ("3", None)], "k string, t string")
    got = {r.key: (r.title, r.error is None) for r in feeds.parsed(df, feeds.feed_items, ("title", "url"), "k", "t", "k").collect()}
    assert got == {"1": ("T", True), "2": (None, False), "3": (None, False)}


def test_confirmed_events():
    full = {"source_class": "official", "event_start_date": "2026-01-01", "venue_name": "v", "artist_name": "a", "evidence_url": "u", "confidence": "high"}
    text = json.dumps({"events": [full, full | {"source_class": "blog"}, full | {"venue_name": " "}]})
    assert [x["score"] for x in feeds.confirmed_events(text, ("official",))] == [95]


SECTION = [
    "■開催概要", "「ASC2NT SPECIAL LIVE EVENT STILL : I」", "<日時・会場>", "●東京", "2026年3月20日(祝・金)、21日(土)、22日(日)", "1部 開演15:00(開場14:30)", "2部 開演19:00(開場18:30)",
    "会場:FC LIVE TOKYO HALL(東京都新宿区大久保2-18-14 )", "●大阪", "2026年4月3日(金)", "1部 開演15:00(開場14:30)", "2026年4月4日(土)、5日(日)",
    "会場:DREAM SQUARE HALL(大阪府吹田市江坂町1-18-8 江坂パークサイドスクエア2F)", "<チケット代金>", "2026年3月2日(月)12:00~各公演4日前23:59まで",
]
LATE = [
    "■公演情報", "「Stray Kids World Tour <RUN IT JAPAN>」", "2026年8月29日（土）", "2026年8月30日（日）", "MUFG STADIUM（国立競技場）", "2026年9年5日（土）", "2026年9年6日（日）", "VANTELIN DOME NAGOYA",
    "2026年9月19日（土）", "2026年9月20日（日）", "KYOCERA DOME OSAKA", "2026年10月24日（土）", "MIZUHO PayPay Dome FUKUOKA",
]


def test_occurrences_of_prefecture_blocks():
    tokyo, osaka = "FC LIVE TOKYO HALL(東京都新宿区大久保2-18-14 )", "DREAM SQUARE HALL(大阪府吹田市江坂町1-18-8 江坂パークサイドスクエア2F)"
    found = [(d, v) for d, v, _, _ in occurrences.occurrences(SECTION, 2026)]
    assert found == [("2026-03-20", tokyo), ("2026-03-21", tokyo), ("2026-03-22", tokyo), ("2026-04-03", osaka), ("2026-04-04", osaka), ("2026-04-05", osaka)]


def test_occurrences_with_the_venue_after_the_dates():
    found = [(d, v) for d, v, _, _ in occurrences.occurrences(LATE, 2026)]
    assert found == [
        ("2026-08-29", "MUFG STADIUM(国立競技場)"), ("2026-08-30", "MUFG STADIUM(国立競技場)"), ("2026-09-05", "VANTELIN DOME NAGOYA"), ("2026-09-06", "VANTELIN DOME NAGOYA"),
        ("2026-09-19", "KYOCERA DOME OSAKA"), ("2026-09-20", "KYOCERA DOME OSAKA"), ("2026-10-24", "MIZUHO PayPay Dome FUKUOKA"),
    ]


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        (["■公演情報", "日程：2026年7月4日（土）・5日（日）", "会場：東京・TOYOTA ARENA TOKYO"], [("2026-07-04", "東京・TOYOTA ARENA TOKYO"), ("2026-07-05", "東京・TOYOTA ARENA TOKYO")]),
        (["【日程・会場】", "7月8日（水）神戸・GLION ARENA KOBE", "9月22日（火・祝）大阪・京セラドーム大阪"], [("2026-07-08", "神戸・GLION ARENA KOBE"), ("2026-09-22", "大阪・京セラドーム大阪")]),
        (["ソウル", "2026年5月1日 KSPO DOME"], []),
        (["2026年5月1日 チケット発売", "東京ドーム"], []),
        ([], []),
    ],
)
def test_occurrences(lines, expected):
    assert [(d, v) for d, v, _, _ in occurrences.occurrences(lines, 2026)] == expected


def test_occurrence_table(spark):
    df = spark.createDataFrame([("1", LATE, 2026), ("2", None, None)], "k string, l array<string>, y int")
    assert {r.key for r in occurrences.extract(df, "k", "l", "y").collect()} == {"1"}


def test_schedules():
    html = "<h2>2026年3月</h2><table><tr><th>3.14(土)</th><td>ガンバ大阪 vs 浦和レッズ</td><td>19:00 START</td></tr><tr><td>3.15(日)</td><td>休館日</td></tr></table>"
    (e,) = schedules.schedule_events(html, "2026-03-01", "stadium")
    assert (e["title"], e["start_date"], e["start_time"]) == ("ガンバ大阪 vs 浦和レッズ", "2026-03-14", "19:00")
    with pytest.raises(ValueError):
        schedules.strict_text(b"\xff\xfe")
    assert [(e["start_date"], e["title"]) for e in schedules.two_column_schedule("  3(金)  全日本大会      9 別の会場\nx", 2026, 4)] == [("2026-04-03", "全日本大会")]
    text = "3日(金) 10:00 ～ 12:00 球技場 A大会\n 13:00 競技場 B大会\n 14:00 球技場 C大会"
    assert [(e["start_time"], e["title"]) for e in schedules.timed_schedule(text, 2026, 4, "球技場")] == [("10:00", "A大会"), ("14:00", "C大会")]


def test_venue_pages(spark):
    page = "<p>2026年5月1日 Aアリーナ LIVE 18:00開演</p><p>2026年5月2日 B広場 市</p>"
    rows = [("a", page, "zepp_schedule", None), ("b", page, "saitama_arena_schedule", '{"allowed_place_keywords": ["アリーナ"]}'), ("c", page, "unknown", None), ("d", page, "zepp_schedule", "{broken"), ("e", None, "tif_calendar", None)]
    got = schedules.venue_events(spark.createDataFrame(rows, "venue_id string, html string, strategy string, config_json string"), "2026-01-01").collect()
    assert sorted((r.venue_id, r.start_date, r.start_time, r.error is None) for r in got if r.venue_id != "d") == [("a", "2026-05-01", "18:00", True), ("a", "2026-05-02", None, True), ("b", "2026-05-01", "18:00", True)]
    assert [r.error is None for r in got if r.venue_id == "d"] == [False]

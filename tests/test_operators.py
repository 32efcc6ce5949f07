import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, consolidate, lookup, matching, merge, rows, sinks, stats


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_rolling_counts_rows_and_drops_incomplete_windows(spark):
    months = [f"2024-{m:02d}" for m in range(1, 13)] + ["2025-02"]  # January is missing and isn't filled in
    df = spark.createDataFrame([("a", ym, float(i), None if ym == "2025-02" else 1.0) for i, ym in enumerate(months)], "k string, ym string, x double, y double")
    assert values(stats.rolling(df, ["k"], "ym", ["x"]), "ym") == [("a", "2024-12", 66), ("a", "2025-02", 78)]
    assert values(stats.rolling(df, ["k"], "ym", ["x", "y"]), "ym") == [("a", "2024-12", 66, 12)]


def test_rolling_equals_a_self_join(spark):
    df = spark.createDataFrame([("a", i, i * i) for i in range(30)], "k string, ym int, x long")
    naive = {i: sum(j * j for j in range(i - 11, i + 1)) for i in range(11, 30)}
    assert {r.ym: r.x for r in stats.rolling(df, ["k"], "ym", ["x"]).collect()} == naive


def test_sums_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), (None, 5)], "k string, v long")
    assert values(stats.summed(df, ["k"], ["v"]), "k") == [("a", 0), ("b", 1)]
    assert values(stats.summed(df, ["k"], ["v"], keep_null=True), "k") == [("a", None), ("b", 1)]


def test_length_of_stay(spark):
    df = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 20.0), ("s", 8, 17.0), ("t", 9, 5.0)], "segment string, bin int, value double")
    r = stats.length_of_stay(df).collect()
    assert len(r) == 1 and (r[0].total_nights, r[0].estimated_stays, r[0].one_night_stays) == (47.0, 22.0, 10.0)
    assert r[0].los == round(47 / 22, 6) and r[0].one_night_share == round(1000 / 22, 6)


def test_latest_release_prefers_final(spark):
    df = spark.createDataFrame([("2024", "確報", 1), ("2025", "1次速報", 2), ("2025", "2次速報", 3)], "p string, r string, v int")
    assert [r.v for r in stats.latest_release(df, "p", "r", ["確報", "2次速報"]).collect()] == [3]


def test_full_outer_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1, 2), ("x", 3, 0)], "k string, respondents long, nights long")
    b = spark.createDataFrame([(None, 9, 10), ("y", 4, 5)], "k string, respondents long, spend long")
    got = {r.k: (r.respondents, r.spend, r.nights, r.spend_per_night) for r in stats.merged_metrics(a, b, ["k"]).collect()}
    assert got == {None: (1, 10, 2, 5.0), "x": (3, None, 0, None), "y": (4, 5, None, None)}


def test_prunes_differ_on_an_empty_fetch(spark):
    known, empty = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([], "k int")
    assert rows.prune_missing_rows(known, empty, "k").count() == 0
    assert rows.prune_missing_unless_empty(known, empty, "k").count() == 2
    assert rows.prune_missing_unless_empty(known, known.where("k = 1"), "k").count() == 1


def test_history_window(spark):
    df = spark.createDataFrame([("2026-05-02",), ("2026-05-01",)], "end string")
    assert [r.end for r in rows.within_history(df, "end", "2026-07-31").collect()] == ["2026-05-02"]
    with pytest.raises(ValueError):
        rows.within_history(df, "end", "2026-07-31", -1)


def test_past_rows_go_unless_undated(spark):
    df = spark.createDataFrame([("2026-01-01", ""), ("2026-01-01", "2026-12-01"), ("soon", None)], "s string, e string")
    assert rows.without_past(df, "s", "e", "2026-06-01").count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", "x", "t0", "t0"), ("b", "2", "y", "t0", "t0")], "k string, data_hash string, v string, first_seen_at_utc string, updated_at_utc string")
    new = spark.createDataFrame([("a", "1", "no", 1), ("b", "3", "z", 1), ("b", "4", "w", 2), ("c", "5", "q", 1)], "k string, data_hash string, v string, n int")
    got = values(merge.upsert(old, new, "k", "t1", sequence="n"), "k")
    assert got == [("a", "1", "x", "t0", "t0", "unchanged"), ("b", "4", "w", "t0", "t1", "updated"), ("c", "5", "q", "t1", "t1", "inserted")]
    only_new = values(merge.upsert(old, new, "k", "t1", update=False, sequence="n"), "k")
    assert [r[5] for r in only_new] == ["unchanged", "unchanged", "inserted"]


def test_upsert_again_changes_nothing(spark):
    old = spark.createDataFrame([("a", "1", "x", "t0", "t0")], "k string, data_hash string, v string, first_seen_at_utc string, updated_at_utc string")
    new = spark.createDataFrame([("a", "2", "y"), ("b", "3", "z")], "k string, data_hash string, v string")
    once = merge.upsert(old, new, "k", "t1").drop("change")
    assert values(merge.upsert(once, new, "k", "t2").drop("change"), "k") == values(once, "k")


def entries(spark):
    return spark.createDataFrame(
        [("Mrs. GREEN APPLE", ["ミセス"]), ("EXILE", []), ("人生", ["Life"]), ("One", []), ("A", ["same"]), ("B", ["same"]), ("京セラドーム大阪", ["京セラドーム"])],
        "canonical_name string, aliases array<string>",
    )


def test_dictionary_keys_are_unambiguous(spark):
    keys = lookup.name_keys(entries(spark))
    assert keys.where("key = 'same'").count() == 0
    assert {r.canonical for r in keys.where("key = 'ミセス'").collect()} == {"Mrs. GREEN APPLE"}


def test_lookups(spark):
    keys = lookup.name_keys(entries(spark))
    df = spark.createDataFrame([("EXILE（エグザイル）",), ("Nobody（だれか）",), ("mrs green apple",), (None,), ("",)], "raw string")
    got = {r.raw: (r.artist, r.artist_matched) for r in lookup.resolve_artists(df, "raw", keys).collect()}
    assert got == {"EXILE（エグザイル）": ("EXILE", True), "Nobody（だれか）": ("Nobody（だれか）", False), "mrs green apple": ("Mrs. GREEN APPLE", True), None: ("", False), "": ("", False)}
    venues = spark.createDataFrame([("〇大阪・京セラドーム大阪",), ("会場：京セラドーム（大阪）",)], "raw string")
    assert {r.venue for r in lookup.resolve_venues(venues, "raw", keys).collect()} == {"京セラドーム大阪"}


def test_longest_containing(spark):
    names = spark.createDataFrame([("東京ドーム", "1"), ("東京ドームシティホール", "2"), ("abc", "3")], "k string, v string")
    df = spark.createDataFrame([("東京ドームシティ",), ("TOKYO",), ("abc",)], "t string")
    assert {r.t: r.v for r in lookup.longest_containing(df, "t", names, "k", "v").collect()} == {"東京ドームシティ": "2", "TOKYO": None, "abc": None}


def index(spark):
    return matching.AliasIndex(matching.entries_of(entries(spark)))


def test_inference(spark):
    i = index(spark)
    assert matching.infer("Mrs. GREEN APPLE ゼンジン未到とイ/ミュータブル〜間奏編〜", None, i) == ("Mrs. GREEN APPLE", "high", "Mrs. GREEN APPLE", "title")
    assert matching.infer("Mrs. GREEN APPLE スポーツフェスティバル", None, i) is None
    assert matching.infer("TRACK15 Zepp ONE MAN Tour", None, i) is None
    assert matching.infer(None, None, i) is None


def test_matches_without_the_automaton_are_the_same(spark):
    i = index(spark)
    titles = ["EXILE LIVE exile", "mrs.greenapple at 京セラドーム大阪", "life! Life", "xexile", ""]
    found = [i.matches(t) for t in titles]
    i.machines = {"keep": None, "compact": None}
    assert [i.matches(t) for t in titles] == found


def test_infer_table(spark):
    df = spark.createDataFrame([("1", "EXILE LIVE", None), ("2", None, "x")], "event_uid string, title string, description string")
    got = {r.uid: r.inferred and r.inferred.artist for r in matching.infer_artists(df, matching.entries_of(entries(spark))).collect()}
    assert got == {"1": "EXILE", "2": None}


def records(spark):
    return spark.createDataFrame(
        [
            ("r1", "ticketjam_events", "2027-01-19", "東京ドーム", "Stray Kids", "t1"),
            ("r2", "kstyle_music", "2027-01-19", "東京 ドーム", "stray kids", "t2"),
            ("r3", "venue_web_discovery", "2027-01-19", "東京ドーム", "ＳＴＲＡＹ ＫＩＤＳ", "t3"),
            ("r4", "official_events", "2027-01-20", "東京ドーム", "EXILE", "t1"),
            ("r5", "official_events", "2026-01-20", "東京ドーム", "old", "t1"),
        ],
        "record_id string, source_id string, event_date string, venue_name string, artist_name string, updated_at_utc string",
    ).withColumn("end_date", F.lit(None).cast("string"))


def test_consolidation(spark):
    df = records(spark)
    made = consolidate.build_events(df.where("source_id = 'official_events'"), df.where("source_id <> 'official_events'"), "2026-12-01").collect()
    assert [(r.display.source_id, [s.source_id for s in r.supporting_sources]) for r in made] == [("venue_web_discovery", ["venue_web_discovery", "kstyle_music", "ticketjam_events"]), ("official_events", ["official_events"])]


def test_consolidation_doesnt_depend_on_order(spark):
    df = consolidate.event_key(records(spark))
    key = lambda d: sorted((r.event_key, r.display.record_id, [s.record_id for s in r.supporting_sources]) for r in consolidate.consolidated(d, ["event_key"]).collect())
    assert key(df) == key(df.orderBy(F.desc("record_id")).repartition(3))


def test_scope(spark):
    k = "day string, venue string, artist string"
    resale = spark.createDataFrame([("d1", "v1", "a1"), ("d2", "v2", "a2"), ("d3", "v3", "a3"), ("d3", "v3", "a3")], k)
    news = spark.createDataFrame([("d1", "v1", "a1")], k)
    artists, venues = spark.createDataFrame([("a1",), ("a9",)], "artist string"), spark.createDataFrame([("v2",)], "venue string")
    r = audit.scope_summary(resale, news, ["day", "venue", "artist"], artists, venues, "artist", "venue").first()
    assert tuple(r) == (3, 2, 1, 1, 0.5, 0.3333)
    assert values(audit.scope_metrics(resale, news, ["day", "venue", "artist"], artists, "artist"), "artist") == [("a1", 1, 0, 1, 1.0), ("a9", 0, 0, 0, 0.0)]


def test_gap_labels(spark):
    df = spark.createDataFrame([("d", "v", None, True, "", "raw", False, "c"), (None, None, None, None, None, None, None, None)], "event_date string, venue_name string, raw_venue_name string, venue_matched boolean, artist_name string, raw_artist_name string, artist_matched boolean, event_category string")
    got = [r[0] for r in df.select(audit.normalisation_gaps()).collect()]
    assert got == [["unmatched_artist"], ["missing_event_date", "missing_venue", "missing_artist", "missing_category"]]


def test_sinks(spark, tmp_path):
    t = str(tmp_path / "t")
    sinks.replace_table(spark.range(5), t, ["id"])
    sinks.replace_table(spark.read.parquet(t).where("id > 2"), t)
    import os

    os.rename(t, f"{t}.old")  # broken off between the two renames, without and with a whole new table
    assert spark.read.parquet(sinks.recovered(spark, t)).count() == 2
    os.rename(t, f"{t}.old")
    spark.range(9).write.parquet(f"{t}.new")
    assert spark.read.parquet(sinks.recovered(spark, t)).count() == 9
    sinks.replace_table(spark.read.parquet(t).where("id in (3, 4)"), t)
    assert spark.read.parquet(t).count() == 2
    p = str(tmp_path / "x.json")
    assert sinks.write_json({"b": 1, "a": "あ"}, p) and not sinks.write_json({"a": "あ", "b": 1}, p)
    assert sinks.write_csv(spark.range(2), str(tmp_path / "x.csv"))
    with pytest.raises(ValueError):
        sinks.write_csv(spark.range(5), str(tmp_path / "y.csv"), limit=4)
    with pytest.raises(FileNotFoundError):
        sinks.manifest(spark, p, ("missing.txt",))
    assert sinks.file_name('a/b: "c"') == "a_b_c"


def test_streamed_merge(spark, tmp_path):
    from tidemark.streaming import incremental

    schema = "k string, data_hash string, v string"
    table, incoming = str(tmp_path / "t"), str(tmp_path / "in")
    spark.createDataFrame([("a", "1", "x", "t0", "t0")], schema + ", first_seen_at_utc string, updated_at_utc string").write.parquet(table)
    spark.createDataFrame([("a", "2", "y"), ("b", "3", "z")], schema).write.parquet(incoming)
    incremental.start(spark.readStream.schema(schema).parquet(incoming), table, str(tmp_path / "c"), "k", lambda: "t1").awaitTermination()
    assert values(spark.read.parquet(table), "k") == [("a", "2", "y", "t0", "t1"), ("b", "3", "z", "t1", "t1")]

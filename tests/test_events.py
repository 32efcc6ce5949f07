import json

from pyspark.sql import functions as F

from tidemark.operators import events, lookup


def test_resolved_artists(spark):
    entries = spark.createDataFrame([("EXILE", ["エグザイル"])], "canonical_name string, aliases array<string>")
    df = spark.createDataFrame(
        [("1", "夜会", "エグザイル", None), ("2", "夜会", "", None), ("3", "朝会", None, None), ("4", "昼会", None, None), ("5", "夜会", "EXILE", "x")],
        "event_uid string, title string, performers string, description string",
    )
    inferred = spark.createDataFrame([("4", "ABC", "medium")], "event_uid string, artist_name string, artist_confidence string")
    got = {r.event_uid: (r.artist, r.confidence) for r in events.resolved_artists(df, inferred, lookup.name_keys(entries)).collect()}
    assert got == {"1": ("EXILE", "source_normalized"), "2": ("EXILE", "cross_venue_title"), "3": ("", "low"), "4": ("ABC", "medium"), "5": ("EXILE", "source")}


def test_times(spark):
    df = spark.createDataFrame([("kstyle_music", "2026-01-01T20:00:00Z", "2026-01-02T00:00:00Z"), ("ticketjam_events", "2026-01-01T20:00:00Z", ""), ("ticketjam_events", "2026-01-01T20:00:00Z", "2026-01-03T00:00:00Z")], "s string, p string, f string")
    t = events.effective_time(F.col("s"), F.col("p"), F.col("f"))
    start, end = events.date_range(F.lit(""), F.lit("2025-01-01"), F.col("p"))
    got = df.select(t, events.is_new(t, "2026-01-03T00:00:00Z"), start, end).collect()
    assert [tuple(r) for r in got] == [("2026-01-01T20:00:00Z", False, "2026-01-02", "2026-01-02")] * 2 + [("2026-01-03T00:00:00Z", True, "2026-01-02", "2026-01-02")]


def test_shown_artists(spark):
    df = spark.createDataFrame([("A B", "a-b", "low"), ("A B", "a-b", "high"), ("X", "Y", "")], "a string, t string, c string")
    assert [r[0] for r in df.select(events.shown_artist(F.col("a"), F.col("t"), F.col("c"))).collect()] == [None, "A B", "X"]
    assert tuple(df.select(events.artist_source(F.lit(""), F.lit(""), F.lit(" P "))).first()[0]) == ("P", "source")


def test_entries_of_a_query_result(spark):
    b = [{"item": {"value": "http://x/Q1"}, "itemLabel": {"value": "A"}, "aliases": {"value": "a|A|b"}}, {"item": {"value": "http://x/Q1"}, "itemLabel": {"value": "A"}, "aliases": {"value": "b|c"}}, {"item": {"value": "http://x/Q2"}, "itemLabel": {"value": "Q2"}}]
    assert events.seed_entries(json.dumps({"results": {"bindings": b}})) == [{"artist_id": "Q1", "canonical_name": "A", "aliases": ["a", "b", "c"]}]
    df = spark.createDataFrame([("2026-01", 2), ("2026-01", 1), ("2025-12", 1)], "p string, n int")
    assert [tuple(r) for r in events.recent_periods(df, "p", [F.asc("n")], 1).collect()] == [("2026-01", 1)]

"""Derived fields of events and signals [J03 J04 P14 P24 P26-P28 X07 S31 S43]."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classify
from tidemark.functions import period as P
from tidemark.functions.text import compact_key
from tidemark.operators import lookup
from tidemark.operators.rows import first_of

#: Fixed value: the sources of which a signal's time is when it was first seen, as they don't tell when it was published.
FIRST_SEEN_SOURCES = ("starto_concert", "ticketjam_events")


def effective_time(source: Column, published: Column, first_seen: Column) -> Column:
    """First seen for sources that don't tell when they published, if it is known; else published [P24]."""
    return F.when(source.isin(*FIRST_SEEN_SOURCES), F.coalesce(F.nullif(first_seen, F.lit("")), published)).otherwise(published)


def is_new(time: Column, as_of: str, hours: int = 24) -> Column:
    """Whether UTC text is within so many hours before as_of [P26]."""
    return F.coalesce(F.try_to_timestamp(time) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))


def date_range(start: Column, end: Column, published: Column) -> tuple[Column, Column]:
    """(start, end) of a signal's event; a missing start is the Japanese date of publication."""
    from tidemark.operators.rows import repaired_range

    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return repaired_range(blank(start), blank(end), F.date_format(P.to_japan(published), "yyyy-MM-dd"))


def shown_artist(artist: Column, title: Column, confidence: Column) -> Column:
    """Null where an uncertain artist is just the title again [P27]."""
    unsure = F.coalesce(confidence, F.lit("")).isin("", "low")
    return F.when(unsure & (compact_key(artist) == compact_key(title)), F.lit(None).cast("string")).otherwise(artist)


def artist_source(resolved: Column, confidence: Column, performers: Column) -> Column:
    """(artist, confidence): the resolved artist, else the performers as their source gives them [P28]."""
    known = ~classify.blank(resolved)
    return F.struct(
        F.when(known, resolved).otherwise(F.nullif(F.trim(performers), F.lit(""))).alias("artist"),
        F.when(known, F.coalesce(F.nullif(confidence, F.lit("")), F.lit("high"))).when(~classify.blank(performers), "source").otherwise("low").alias("confidence"),
    )


def resolved_artists(events: DataFrame, inferred: DataFrame, keys: DataFrame) -> DataFrame:
    """(event_uid, artist, confidence, category) of every event [X07 A31].

    The performers' canonical name (``source_normalized`` if that changed it, else ``source``), else what was
    inferred, with its confidence, else the one artist that events of this title have elsewhere
    (``cross_venue_title``), else blank with ``low``. inferred: (event_uid, artist_name, artist_confidence).
    """
    named = lookup.resolve_artists(events, "performers", keys, "canonical")
    own = ~classify.blank(F.col("performers"))
    both = named.join(inferred.select("event_uid", F.col("artist_name").alias("__name"), F.col("artist_confidence").alias("__confidence")), "event_uid", "left")
    guessed = ~classify.blank(F.col("__name"))
    both = both.withColumn("__title", compact_key("title")).withColumn("__first", F.when(own, F.col("canonical")).when(guessed, F.col("__name")))
    elsewhere = lookup.unambiguous(both.where(F.col("__title") != "").select("__title", F.col("__first").alias("__other")), "__title", "__other")
    both = both.join(elsewhere, "__title", "left")
    artist = F.coalesce("__first", "__other", F.lit(""))
    confidence = F.when(own, F.when(F.col("canonical") != F.trim("performers"), "source_normalized").otherwise("source")).when(guessed, F.coalesce("__confidence", F.lit("high"))).when(F.col("__other").isNotNull(), "cross_venue_title").otherwise("low")
    return both.select("event_uid", artist.alias("artist"), confidence.alias("confidence"), classify.event_category(F.col("title"), artist, F.col("description")).alias("category"))


def recent_periods(entries: DataFrame, period: str, order: list[Column], periods: int = 48) -> DataFrame:
    """The first entry of each of the last so many periods [S31]."""
    return first_of(entries, [period], order).orderBy(F.desc(period)).limit(periods)


def seed_entries(document: str) -> list[dict]:
    """Dictionary entries of a query result in JSON: artist_id, canonical_name and the different aliases of each item [S43]."""
    made: dict[str, dict] = {}
    for b in json.loads(document)["results"]["bindings"]:
        value = lambda k, b=b: (b.get(k) or {}).get("value", "").strip()
        item, name = value("item").rsplit("/", 1)[-1], value("itemLabel")
        if not item or not name or name == item:
            continue
        entry = made.setdefault(item, {"artist_id": item, "canonical_name": name, "aliases": []})
        for alias in (x.strip() for x in value("aliases").split("|")):
            if alias and alias != name and alias not in entry["aliases"]:
                entry["aliases"].append(alias)
    return [made[k] for k in sorted(made)]

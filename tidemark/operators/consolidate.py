"""Consolidation of records from several sources into one event each [A22 A23 W08 F03 X08]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.classify import priority
from tidemark.functions.records import group_key
from tidemark.functions.text import key_part_udf


def event_key(df: DataFrame, date: str = "event_date", venue: str = "venue_name", artist: str = "artist_name") -> DataFrame:
    return df.withColumn("event_key", group_key(F.col(date), key_part_udf(F.col(venue)), key_part_udf(F.col(artist))))


def _place(df: DataFrame, record_id: str, updated: str, source: str, rank: str | None) -> Column:
    """What orders a key's records: the best source, then the oldest update, then the least id."""
    best = F.col(rank) if rank else priority(F.col(source))
    return F.struct(best.alias("place"), F.col(updated).alias("updated"), F.col(record_id).cast("string").alias("id"))


def displayed(df: DataFrame, keys: list[str], record_id: str = "record_id", updated: str = "updated_at_utc", source: str = "source_id", rank: str | None = None) -> DataFrame:
    """One row a key: its best record as ``display``. Combined on each task before records move, so a key may have any number [W08 A23]."""
    rows = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rows), _place(df, record_id, updated, source, rank)).alias("display"))


def consolidated(df: DataFrame, keys: list[str], record_id: str = "record_id", updated: str = "updated_at_utc", source: str = "source_id", rank: str | None = None) -> DataFrame:
    """One row a key: its best record as ``display``, and all of the key's records, best first, as ``supporting_sources``.

    The list is one row of the result, so a key must have as many records as a row holds: those of one event, not of a
    whole corpus. ``displayed`` gives the first part alone, for keys of any size."""
    rows = [c for c in df.columns if c not in keys]
    member = F.struct(_place(df, record_id, updated, source, rank).alias("place"), F.struct(*rows).alias("record"))
    both = df.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return both.select(*keys, F.col("members")[0]["record"].alias("display"), F.transform("members", lambda m: m["record"]).alias("supporting_sources"))


def build_events(official: DataFrame, signals: DataFrame, as_of: str, past_days: int = 90) -> DataFrame:
    """The publishable list: both kinds of records within the history window, checked, grouped and ordered [X08]."""
    from tidemark.functions import fixed as V
    from tidemark.functions.text import require_clean
    from tidemark.operators.rows import within_history

    every = official.unionByName(signals, allowMissingColumns=True)
    recent = within_history(every.withColumn("__end", F.coalesce("end_date", "event_date")), "__end", as_of, past_days).drop("__end")
    clean = require_clean(recent, tuple(c for c in V.TEXT_FIELDS if c in recent.columns), "events")
    made = consolidated(event_key(clean), ["event_key"])
    return made.orderBy("display.event_date", "display.venue_name", "display.artist_name", "display.source_id")

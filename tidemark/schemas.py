"""Schemas of the engine's tables. Measures are doubles; dates, times and period keys are text."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"s": StringType(), "d": DoubleType(), "l": LongType(), "i": IntegerType(), "b": BooleanType(), "a": ArrayType(StringType())}


def _schema(fields: str) -> StructType:
    """From "name:kind name:kind ..."; the kind is a string where it is left out."""
    return StructType([StructField(n, _KINDS[k or "s"]) for n, _, k in (f.partition(":") for f in fields.split())])


MARKET_STATS = _schema("ym pref_code pref_name total:d jp:d foreign:d")
OCCUPANCY = _schema("ym pref_code pref_name facility_type occupancy_rate:d")
STAY_NIGHTS = _schema("period_type period_key period_label release_type segment nights_bin value:d source_url source_title source_sha256")
SPEND_ITEMS = _schema("period_label period_key release_type purpose nationality item_group item spend_yen:d share_pct:d")
ENTRY_PORTS = _schema("period_label period_key release_type purpose port_type entry_port nationality respondents:d spend_yen:d avg_nights:d spend_per_night_yen:d")
COMPANY_AMOUNTS = _schema("fiscal_year period company segment amount:d")
AIRPORT_ARRIVALS = _schema("period_key airport_name_raw airport_name airport_code arrivals:l unit source_name source_url updated_at_utc")
VENUES = _schema("venue_id venue_name pref_code pref_name capacity:i official_url source_type source_url config_json is_enabled:b last_signature created_at_utc updated_at_utc")
EVENTS = _schema(
    "event_uid venue_id title start_date start_time end_date end_time all_day:b status url description performers capacity:i source_type source_url "
    "source_event_key artist_name_resolved artist_confidence event_category data_hash first_seen_at_utc updated_at_utc"
)
SIGNAL_SOURCES = _schema("source_id source_name source_type source_url config_json is_enabled:b last_signature created_at_utc updated_at_utc")
SIGNALS = _schema("signal_uid source_id published_at_utc title url snippet score:i labels_json content_hash first_seen_at_utc updated_at_utc")
ARTISTS = _schema("artist_id canonical_name aliases:a source updated_at is_enabled:b ticketjam_watch:b ticketjam_benchmark_tier ticketjam_watch_reason")
VENUE_ALIASES = _schema("venue_id canonical_name aliases:a source updated_at is_enabled:b")
CELLS = _schema("sheet row:i col:i value")
#: What every event parser returns.
PARSED_EVENTS = _schema("venue_id title start_date start_time end_date end_time all_day:b status url description performers source_event_key")

"""JSON labels, URLs, hashes and identifiers of records, as column expressions [F03 F20-F26 F43-F45 A32 A33]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def labels(json: Column) -> Column:
    """Text fields of a JSON object; empty for anything else."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def label(of: Column, *keys: str) -> Column:
    """The first of the keys that is there, blank or not."""
    return F.coalesce(*(F.element_at(of, k) for k in keys), F.lit(""))


def filled(*values: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def canonical_json(of: Column) -> Column:
    """A map as JSON with its keys in order; null for an empty one."""
    return F.when(F.size(of) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(of)))))


def url_host(url: Column) -> Column:
    """Host and port as written; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^https?://([^/?#]+)", 1), F.lit(""))


def bare_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def page_url(url: Column, page: Column, parameter: str = "page") -> Column:
    """With the page number as its one query parameter, if it is over 1."""
    return F.when(page > 1, F.concat(bare_url(url), F.lit(f"?{parameter}="), page.cast("string"))).otherwise(bare_url(url))


def official_url(url: Column, *of_venue: Column) -> Column:
    """url if it is on one of the venue's hosts or the venue has none, else the first of the venue's URLs."""
    hosts = F.array_compact(F.array(*(url_host(u) for u in of_venue)))
    return F.when(url_host(url).isNotNull() & ((F.size(hosts) == 0) | F.array_contains(hosts, url_host(url))), url).otherwise(filled(*of_venue))


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def event_uid(venue: Column, key: Column, title: Column, date: Column, time: Column, url: Column) -> Column:
    """The source's key if it has one, else a hash of title and date, with time and URL where either is there."""
    time, url = (F.coalesce(c, F.lit("")) for c in (time, url))
    bare = F.trim(F.regexp_replace(title, r"(?U)\s+", " "))
    raw = F.when((time != "") | (url != ""), F.concat_ws("|", venue, bare, date, time, url)).otherwise(F.concat_ws(":", venue, title, date))
    return F.when(F.coalesce(key, F.lit("")) != "", F.concat_ws(":", venue, key)).otherwise(F.concat(venue, F.lit(":h:"), F.substring(F.sha2(raw, 256), 1, 16)))


def signal_uid(source: Column, url: Column, extra: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, F.trim(url), F.nullif(F.trim(extra), F.lit(""))), 256)


def group_key(*parts: Column) -> Column:
    """The key that groups records of one event; parts are normalised before."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 20)


def set_signature(*columns: str) -> Column:
    """Aggregate: one hash of the rows, whatever their order; of rows that repeat, each counts [A32].

    Each row's SHA-256 is cut into eight numbers; their sums, which are combined on each task, and the number of rows
    are hashed again. So it takes the same small space for any number of rows.
    """
    row = F.sha2(F.concat_ws("|", *columns), 256)
    parts = [F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(28,0)")).cast("string") for k in range(8)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256)


def date_label(start: Column, end: Column) -> Column:
    return F.when(start == end, start).otherwise(F.concat(start, F.lit(" ～ "), end))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded half to even; 0 where b is 0."""
    return F.coalesce(F.bround(F.try_divide(a, b), digits), F.lit(0.0))

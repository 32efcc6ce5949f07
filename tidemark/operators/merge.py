"""Incremental merges of fetched rows into kept ones [J17 J20 K02-K05 E01-E05 E08].

A merge is a full outer join on the key, with the kept rows' first-seen time preserved, and gives the whole
new table; plain Parquet has no in-place merge, so the caller writes it beside the old one and swaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rows import first_of


def upsert(
    kept: DataFrame, fetched: DataFrame, key: str, now: str, compare: tuple[str, ...] = ("data_hash",), update: bool = True,
    first_seen: str = "first_seen_at_utc", updated: str = "updated_at_utc", sequence: str | None = None,
) -> DataFrame:
    """kept merged with fetched, and ``change``: inserted, updated or unchanged.

    A row is rewritten where any of the compared columns differs (nulls are equal to each other) and update
    is on; first_seen is only ever set on insertion. Of fetched rows with one key, the last by ``sequence``
    counts, or the first if update is off; without a sequence keys must be unique.
    """
    if sequence is not None:
        fetched = first_of(fetched, [key], [F.desc(sequence) if update else F.asc(sequence)]).drop(sequence)
    columns = [c for c in kept.columns if c not in (key, first_seen, updated)]
    old, new = kept.alias("o"), fetched.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    change = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNotNull() & differs & F.lit(update), "updated").otherwise("unchanged")
    both = both.withColumn("change", change)
    fresh = F.col("change") != "unchanged"
    made = {
        key: F.coalesce(f"o.{key}", f"n.{key}"),
        first_seen: F.coalesce(F.col(f"o.{first_seen}"), F.lit(now)),
        updated: F.when(fresh, F.lit(now)).otherwise(F.col(f"o.{updated}")),
    } | {c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in columns}
    return both.select(*(made[c].alias(c) for c in kept.columns), "change")


def upsert_sources(kept: DataFrame, defaults: DataFrame, overwrite: tuple[str, ...]) -> DataFrame:
    """Sources with default rows added; config_json of an existing one is replaced only for the sources named [K05]."""
    both = kept.alias("o").join(defaults.alias("n"), F.col("o.source_id") == F.col("n.source_id"), "full")
    config = F.when(F.coalesce("o.source_id", "n.source_id").isin(*overwrite), F.coalesce("n.config_json", "o.config_json")).otherwise(F.coalesce("o.config_json", "n.config_json"))
    return both.select(*((config if c == "config_json" else F.coalesce(f"o.{c}", f"n.{c}")).alias(c) for c in kept.columns))


def stable_updates(rows: DataFrame, before: DataFrame, key: str, payload: list[str], updated: str, now: str) -> DataFrame:
    """rows with the earlier update time where nothing in the payload differs, else now [J20]."""
    old = before.select(key, F.struct(*payload).alias("__old"), F.col(updated).alias("__when"))
    both = rows.drop(updated).join(old, key, "left")
    same = F.struct(*payload).eqNullSafe(F.col("__old"))
    return both.withColumn(updated, F.when(same, F.col("__when")).otherwise(F.lit(now))).drop("__old", "__when")


def is_unchanged(rows: DataFrame, columns: list[str], signature: str | None) -> tuple[bool, str]:
    """(whether the rows are those that the signature was taken of, their signature) [E01-E03]. One value comes to the driver."""
    from tidemark.functions.records import set_signature

    now = rows.agg(set_signature(*columns).alias("s")).first()["s"]
    return now == signature, now

"""Dictionaries of artists and venues, and lookups in them [S13 S14 A30 A31 J01 J02 J08-J12 J14 J16].

Dictionaries are maintained by hand and small, but not assumed to be: joins with them are left to the
planner, which broadcasts what it has measured to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import artist_candidates_udf, compact_key, keep_key, venue_candidates_udf
from tidemark.operators.rows import first_of


def merged_registry(files: list[DataFrame], key: str, enabled: str = "is_enabled", order: str = "canonical_name") -> DataFrame:
    """Entries of several files by key: a later file replaces an earlier one's entry whole; enabled ones stay [S13 S14]."""
    every = files[0].withColumn("__file", F.lit(0))
    for i, df in enumerate(files[1:], 1):
        every = every.unionByName(df.withColumn("__file", F.lit(i)), allowMissingColumns=True)
    return first_of(every, [key], [F.desc("__file")]).drop("__file").where(F.coalesce(F.col(enabled), F.lit(True))).orderBy(order)


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys with exactly one value [A30 A31]. Minimum and maximum tell, so nothing is collected."""
    both = df.dropna(subset=[key, value]).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__most"))
    return both.where(F.col(value) == F.col("__most")).drop("__most")


def name_keys(entries: DataFrame, name: str = "canonical_name", aliases: str = "aliases") -> DataFrame:
    """(mode, key, canonical): the keep and compact keys of all names and aliases that belong to one entry alone."""
    every = entries.select(F.col(name).alias("canonical"), F.explode(F.array_distinct(F.concat(F.array(name), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))).alias("alias"))
    keyed = every.select("canonical", F.explode(F.array(F.struct(F.lit("keep").alias("mode"), keep_key("alias").alias("key")), F.struct(F.lit("compact").alias("mode"), compact_key("alias").alias("key")))).alias("k"))
    keys = keyed.select("canonical", "k.mode", "k.key").where(F.col("key") != "")
    both = keys.groupBy("mode", "key").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("__most"))
    return both.where(F.col("canonical") == F.col("__most")).drop("__most")


def _resolved(df: DataFrame, raw: str, candidates: Column, keys: DataFrame, name: str) -> DataFrame:
    """df with name and name_matched: of the first candidate that has a key (keep before compact) its canonical
    name, else the first candidate. Distinct raw values are looked up once."""
    values = df.select(F.col(raw).alias("__raw")).distinct()
    tried = values.select("__raw", candidates.alias("__all")).select("__raw", F.get("__all", F.lit(0)).alias("__bare"), F.posexplode_outer("__all").alias("pos", "candidate"))
    asked = tried.select("*", F.explode_outer(F.array(F.struct(F.lit(0).alias("turn"), F.lit("keep").alias("mode"), keep_key("candidate").alias("key")), F.struct(F.lit(1).alias("turn"), F.lit("compact").alias("mode"), compact_key("candidate").alias("key")))).alias("k"))
    met = asked.select("__raw", "__bare", F.struct("pos", "k.turn").alias("place"), "k.mode", "k.key").join(keys, ["mode", "key"], "left")
    best = met.groupBy("__raw").agg(F.min_by("canonical", F.when(F.col("canonical").isNotNull(), F.col("place"))).alias("__found"), F.first("__bare", ignorenulls=True).alias("__bare"))
    told = best.select("__raw", F.coalesce("__found", "__bare", F.lit("")).alias(name), F.col("__found").isNotNull().alias(f"{name}_matched"))
    return df.join(told, df[raw].eqNullSafe(told["__raw"]), "left").drop("__raw")


def resolve_artists(df: DataFrame, raw: str, keys: DataFrame, name: str = "artist", base: bool = True) -> DataFrame:
    """[J10 J11]"""
    made = artist_candidates_udf(F.col("__raw"))
    return _resolved(df, raw, made if base else F.slice(made, 1, 1), keys, name)


def resolve_venues(df: DataFrame, raw: str, keys: DataFrame, name: str = "venue") -> DataFrame:
    """[J12]"""
    return _resolved(df, raw, venue_candidates_udf(F.col("__raw")), keys, name)


def enriched(df: DataFrame, dim: DataFrame, key: str, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the dimension's columns under new names; defaults where there is no entry or no value [J01-J05 J08 P14]."""
    side = dim.select(key, *(F.col(c).alias(n) for c, n in columns.items()))
    both = df.join(side, key, "left")
    for n, value in (defaults or {}).items():
        both = both.withColumn(n, F.coalesce(F.col(n), value if isinstance(value, Column) else F.lit(value)))
    return both


def two_step(df: DataFrame, by_id: DataFrame, by_name: DataFrame, id_: str, name: str, value: str, default: object) -> DataFrame:
    """df with value: of its id if that is known, else of its name, else the default [J09 X07]."""
    a = by_id.select(id_, F.col(value).alias("__by_id"))
    b = by_name.select(name, F.col(value).alias("__by_name"))
    both = df.join(a, id_, "left").join(b, name, "left")
    return both.withColumn(value, F.coalesce("__by_id", "__by_name", F.lit(default))).drop("__by_id", "__by_name")


def longest_containing(df: DataFrame, text: str, keys: DataFrame, key: str, value: str, least: int = 4) -> DataFrame:
    """df with the value of the longest key that contains the text or is contained in it; ties by key [J14].

    The distinct texts meet the keys by a key's first ``least`` characters: where one contains the other, those
    of the shorter stand somewhere in the longer. So it is an equi-join on pieces of that length, not a product.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (least - 1)), lambda i: F.substring(c, i, F.lit(least))))
    texts = df.select(F.col(text).alias("__t")).where(F.length("__t") >= least).distinct()
    names = keys.where(F.length(key) >= least).select(F.col(key).alias("__k"), F.col(value).alias(value))
    head = lambda c: F.substring(c, 1, least)
    within = texts.withColumn("__g", F.explode(grams(F.col("__t")))).join(names.withColumn("__g", head(F.col("__k"))), "__g").where(F.col("__t").contains(F.col("__k")))
    around = texts.withColumn("__g", head(F.col("__t"))).join(names.withColumn("__g", F.explode(grams(F.col("__k")))), "__g").where(F.col("__k").contains(F.col("__t")))
    met = within.unionByName(around)
    size = F.least(F.length("__k"), F.length("__t"))
    best = met.groupBy("__t").agg(F.min_by(value, F.struct((-size).alias("n"), F.col("__k"))).alias(value))
    return df.join(best, df[text] == best["__t"], "left").drop("__t")


def capacity_gate(signals: DataFrame, venues: DataFrame, least: int = 1000, known: bool = True) -> DataFrame:
    """Signals at venues of at least that capacity; unknown venues only if they needn't be known [J16]."""
    both = signals.join(venues.select("venue_name", F.col("capacity").alias("__capacity")), "venue_name", "left")
    return both.where(F.coalesce(F.col("__capacity") >= least, F.lit(not known))).drop("__capacity")


def normalisation_counts(df: DataFrame) -> DataFrame:
    """One row of counts from the columns artist_matched, venue_matched and their raw and resolved names [A37]."""
    flag = lambda c, n: F.count_if(c).alias(n)
    return df.agg(
        F.count("*").alias("rows"),
        flag(F.col("artist_matched"), "artist_matched"),
        flag(F.col("artist_matched") & (F.col("artist") != F.col("raw_artist")), "artist_changed"),
        flag(F.col("venue_matched"), "venue_matched"),
        flag(F.col("venue_matched") & (F.col("venue") != F.col("raw_venue")), "venue_changed"),
    )


def best_with_margin(df: DataFrame, by: list[str], score: str, name: str, ties: list[str], margin: int = 2) -> DataFrame:
    """The best row of each group, and whether it is ``clear``: no other name is within the margin [W13]."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    both = df.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead(F.struct(score, name)).over(w))
    close = (F.col(score) - F.col(f"__next.{score}") <= margin) & (F.col(name) != F.col(f"__next.{name}"))
    return both.where("__n = 1").withColumn("clear", ~F.coalesce(close, F.lit(False))).drop("__n", "__next")

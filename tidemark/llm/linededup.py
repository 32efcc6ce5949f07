"""Removal of boilerplate lines that are spread over many sites, in DataFrame expressions only.

A HyperLogLog sketch of the sites of each line is built before the shuffle and merged by aggregation. Lines
whose estimate is clear of the threshold are decided by it; for lines near it the distinct sites are counted
exactly. Lines on at least ``min_sites`` sites are boilerplate and are cut from every text.

A text is left whole only if just this text is on at least ``min_sites`` sites: it is a copy of a document
rather than a page with boilerplate round it, and near-duplicate detection decides. From any other text all
boilerplate goes, whatever its share, even if nothing stays.

Lines are split at \\n and compared without leading and trailing ASCII white space; blank lines are never
boilerplate and stay. A null site counts as one site of its own. Cases: a null text gives a null clean text
and no lines; an empty one stays empty; repeated rows each count, but one site counts once; an empty table
gives an empty result. A line's decision depends only on its hash, so rows that share an id or a text don't
disturb each other, and a very common line is pre-aggregated on each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import among, checkpointed, quoted, replaced, trimmed, unused

MIN_SITES = 8
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(trimmed(line))


def _site(site: Column) -> Column:
    return F.xxhash64(site.isNull(), F.coalesce(site.cast("string"), F.lit("")))


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line): the hashes of the lines that are on at least min_sites sites."""
    met = docs.select(_site(quoted(site_col)).alias("site"), F.explode(F.filter(_lines(quoted(text_col)), lambda x: trimmed(x) != "")).alias("text")).select("site", _hash(F.col("text")).alias("line"))
    spread = met.groupBy("line").agg(F.hll_sketch_agg("site", lg_k).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("about"))
    margin = max(1, round(4 * 1.04 / 2 ** (lg_k / 2) * min_sites))  # four standard errors
    spread = checkpointed(spread.where(F.col("about") >= min_sites - margin))
    clear = spread.where(F.col("about") > min_sites + margin).select("line")
    near = spread.where(F.col("about") <= min_sites + margin).select("line")
    exact = among(met.distinct(), near, "line", "site").groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return checkpointed(clear.union(exact))


def _judged(docs: DataFrame, text_col: str, site_col: str, min_sites: int, lg_k: int) -> tuple[DataFrame, str]:
    """docs and one more column, whose name comes too: a struct of text (cleaned), n_lines, n_spread and n_removed.

    The texts that have boilerplate are listed once each by their hash, so that a copied text is looked up,
    not carried, once for each copy.
    """
    common = boilerplate(docs, text_col, site_col, min_sites, lg_k)
    text = quoted(text_col)
    key, hits, out, whole = (unused(docs, x) for x in ("__key", "__hits", "__out", "__whole"))
    hashed = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    met = docs.select(hashed.alias(key), F.explode(F.array_distinct(F.transform(_lines(text), lambda x: _hash(x)))).alias("line"))
    listed = checkpointed(among(met, common, "line", key).groupBy(key).agg(F.collect_set("line").alias(hits)))
    sites = among(docs.select(hashed.alias(key), _site(quoted(site_col)).alias("site")).distinct(), listed.select(key), key, "site")
    copied = sites.groupBy(key).agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select(key, F.lit(True).alias(whole))
    both = docs.withColumn(key, hashed).join(listed.join(copied, key, "left"), key, "left")
    found = F.coalesce(F.col(hits), F.array().cast("array<bigint>"))
    lines = _lines(text)
    spread = F.filter(lines, lambda x: F.array_contains(found, _hash(x)))
    strip = (F.size(found) > 0) & ~F.coalesce(F.col(whole), F.lit(False))
    n_spread = F.when(F.size(found) > 0, F.size(spread)).otherwise(0)
    cleaned = F.when(strip, F.array_join(F.filter(lines, lambda x: ~F.array_contains(found, _hash(x))), "\n")).otherwise(text)
    told = F.struct(cleaned.alias("text"), F.size(F.filter(lines, lambda x: trimmed(x) != "")).cast("long").alias("n_lines"), n_spread.cast("long").alias("n_spread"), F.when(strip, n_spread).otherwise(0).cast("long").alias("n_removed"))
    return both.select(*(quoted(c) for c in docs.columns), told.alias(out)), out


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(id, n_lines with a word, n_spread of them boilerplate, n_removed, text cleaned) of every row."""
    judged, out = _judged(docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(site_col).alias("source")), "text", "source", min_sites, lg_k)
    return judged.select("id", *(F.col(f"{out}.{c}") for c in ("n_lines", "n_spread", "n_removed", "text")))


def clean(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """docs with text_col cleaned, every other column as it is."""
    judged, out = _judged(docs, text_col, site_col, min_sites, lg_k)
    return replaced(judged, {text_col: F.col(f"{out}.text")}).drop(out)


ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
bare AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM split),
common AS (
  SELECT body FROM bare WHERE body <> '' GROUP BY body
  HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {MIN_SITES}),
copied AS (
  SELECT coalesce(text, '') AS copy FROM documents GROUP BY 1
  HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {MIN_SITES}),
marked AS (SELECT b.*, c.body IS NOT NULL AS spread FROM bare b LEFT JOIN common c ON b.body = c.body),
whole AS (
  SELECT doc_id, any_value(text) AS text,
         count(*) FILTER (body <> '') AS n_lines, count(*) FILTER (spread) AS n_spread,
         coalesce(any_value(text), '') NOT IN (SELECT copy FROM copied) AS strip,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT spread) AS rest
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_spread,
       CASE WHEN strip THEN n_spread ELSE 0 END AS n_removed,
       CASE WHEN strip AND n_spread > 0 THEN coalesce(rest, '') ELSE text END AS text
FROM whole
"""

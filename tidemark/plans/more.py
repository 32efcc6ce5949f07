"""More of the engine's operators bound to the star-schema tables: filters, lookups, updates, choices of rows, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import classify, fixed, records
from tidemark.functions import period as P
from tidemark.operators import audit, events, lookup, merge, rows, stats
from tidemark.plans.driver import query, read
from tidemark.sources import tables

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_YM = "strftime(o_orderdate, '%Y-%m')"


def _orders(spark, d, *more):
    """(o_orderkey, day, ym, more) of all orders."""
    return read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), P.ym_of(F.col("o_orderdate")).alias("ym"), *more)


def _cents(c):
    return f"CAST(round({c} * 100) AS BIGINT)"


# Filters and scopes


@query("p02_ym_numbers", f"SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m') AS INT) AS n, {_YM} AS built FROM orders")
def p02_ym_numbers(spark, d):
    ym = F.col("ym")
    return _orders(spark, d).select("o_orderkey", P.ym_number(ym).alias("n"), P.build_ym(P.year_of(ym), P.month_of(ym)).alias("built"))


@query("p04_swapped_bounds", f"SELECT o_orderkey FROM orders WHERE {_YM} BETWEEN '1994-03' AND '1995-10'")
def p04_swapped_bounds(spark, d):
    return _orders(spark, d).where(P.between(F.col("ym"), "1995-10", "1994-03")).select("o_orderkey")


_REGION = "CASE " + " ".join(f"WHEN s_suppkey % 47 + 1 BETWEEN {a} AND {b} THEN '{name}'" for name, (a, b) in fixed.REGIONS.items()) + " END"


@query("p22_region_members", f"SELECT s_suppkey, {_REGION} AS region FROM supplier")
def p22_region_members(spark, d):
    coded = read(spark, d, "supplier").select("s_suppkey", F.lpad((F.col("s_suppkey") % 47 + 1).cast("string"), 2, "0").alias("code"))
    made = None
    for name in fixed.REGIONS:
        part = tables.region_members(coded, "code", name).select("s_suppkey", F.lit(name).alias("region"))
        made = part if made is None else made.unionByName(part)
    return made


@query("p15_around", f"SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN DATE '1995-06-15' - 30 AND DATE '1995-06-15' + 365")
def p15_around(spark, d):
    return rows.around(_orders(spark, d), "day", "1995-06-15").select("o_orderkey")


@query("p17_within_history", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-31' - 90")
def p17_within_history(spark, d):
    return rows.within_history(_orders(spark, d), "day", "1998-01-31").select("o_orderkey")


@query("p20_last_months", f"WITH m AS (SELECT DISTINCT {_YM} AS ym FROM orders ORDER BY 1 DESC LIMIT 36) SELECT o_orderkey FROM orders WHERE {_YM} IN (SELECT ym FROM m)")
def p20_last_months(spark, d):
    return tables.last_months(_orders(spark, d), "ym").select("o_orderkey")


@query("p21_last_years", "WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY 1 DESC LIMIT 4) SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (SELECT y FROM y)")
def p21_last_years(spark, d):
    return tables.last_years(_orders(spark, d), "ym").select("o_orderkey")


@query("p23_fiscal_year", "SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS fiscal_year FROM orders")
def p23_fiscal_year(spark, d):
    ym = F.col("ym")
    return _orders(spark, d).select("o_orderkey", P.fiscal_year(P.year_of(ym), P.month_of(ym)).cast("long").alias("fiscal_year"))


@query("p30_without_past", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY ELSE o_orderdate END >= DATE '1996-01-01'")
def p30_without_past(spark, d):
    end = F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")).otherwise("")
    return rows.without_past(_orders(spark, d, end.alias("end")), "day", "end", "1996-01-01").select("o_orderkey")


@query("p34_options", "SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority <> '3-MEDIUM', o_orderpriority) AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def p34_options(spark, d):
    listed = tables.option_values(read(spark, d, "orders"), "o_orderpriority", pinned="3-MEDIUM")
    return rows.ranked(listed.withColumn("all", F.lit(1)), ["all"], [F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")], "place").drop("all")


@query("p24_effective_time", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'seen' ELSE 'published' END AS t FROM events")
def p24_effective_time(spark, d):
    source = F.when(F.col("event_id") % 3 == 0, events.FIRST_SEEN_SOURCES[0]).otherwise("other")
    seen = F.when(F.col("event_id") % 2 == 0, "seen").otherwise("")
    return read(spark, d, "events").select("event_id", events.effective_time(source, F.lit("published"), seen).alias("t"))


# Sums, counts, choices


@query("a07_bin_segment_sums", f"SELECT l_returnflag, l_linestatus, sum({_cents('l_extendedprice')}) AS price, sum({_cents('l_tax')}) AS tax FROM lineitem GROUP BY ALL")
def a07_bin_segment_sums(spark, d):
    items = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", stats.cents(F.col("l_extendedprice")).alias("price"), stats.cents(F.col("l_tax")).alias("tax"))
    return stats.summed(items, ["l_returnflag", "l_linestatus"], ["price", "tax"])


@query("a11_grand_total", f"SELECT sum({_cents('o_totalprice')}) AS v FROM orders")
def a11_grand_total(spark, d):
    return stats.summed(read(spark, d, "orders").select(stats.cents(F.col("o_totalprice")).alias("v")), [], ["v"])


@query("a13_quarter_sums", f"SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_orderstatus, sum({_cents('o_totalprice')}) AS v FROM orders GROUP BY ALL")
def a13_quarter_sums(spark, d):
    orders = _orders(spark, d, "o_orderstatus", stats.cents(F.col("o_totalprice")).alias("v"))
    return stats.summed(orders.withColumn("quarter", P.quarter_key(F.col("ym"))), ["quarter", "o_orderstatus"], ["v"])


@query("a14_ranking", f"SELECT o_custkey, sum({_cents('o_totalprice')}) AS v FROM orders GROUP BY ALL ORDER BY v DESC, o_custkey LIMIT 20")
def a14_ranking(spark, d):
    sums = stats.summed(read(spark, d, "orders").select("o_custkey", stats.cents(F.col("o_totalprice")).alias("v")), ["o_custkey"], ["v"])
    return stats.top(sums, "v", 20, ["o_custkey"])


@query("a28_label_counts", "SELECT label, count(*) AS n FROM (SELECT unnest([l_linestatus, l_returnflag]) AS label FROM lineitem) GROUP BY label")
def a28_label_counts(spark, d):
    return audit.label_counts(read(spark, d, "lineitem").select(F.array("l_linestatus", "l_returnflag").alias("labels")), "labels")


@query("a35_coverage", "SELECT count(*) AS rows, min(o_totalprice) AS price_min, max(o_totalprice) AS price_max, count(DISTINCT o_totalprice) AS price_distinct, min(o_custkey) AS cust_min, max(o_custkey) AS cust_max, count(DISTINCT o_custkey) AS cust_distinct FROM orders")
def a35_coverage(spark, d):
    return audit.extent(read(spark, d, "orders"), price="o_totalprice", cust="o_custkey")


@query("w05_best_performance", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w05_best_performance(spark, d):
    orders = read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return rows.first_of(orders, ["o_custkey", "o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).drop("o_totalprice")


@query("w07_latest_by_event", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey) = 1")
def w07_latest_by_event(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return rows.first_of(items, ["l_orderkey"], [F.desc("l_shipdate"), F.desc("l_linenumber"), F.asc("l_partkey")]).drop("l_partkey")


@query("w15_least_rank", "SELECT l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_partkey")
def w15_least_rank(spark, d):
    return rows.least_of(read(spark, d, "lineitem"), ["l_partkey"], F.col("l_linenumber"), ["l_linenumber"])


@query("x09_merged_reports", "SELECT 'urgent' AS bucket, o_orderkey, o_clerk, NULL AS o_comment FROM (SELECT o_orderkey, o_orderpriority AS o_clerk FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'open', o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def x09_merged_reports(spark, d):
    orders = read(spark, d, "orders")
    urgent = orders.where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("o_clerk"))
    return audit.merged_reports(urgent=urgent, open=orders.where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_orderstatus").alias("o_comment")))


# Lookups and updates


@query("j02_source_names", "SELECT o_orderkey, o_custkey, coalesce(c_name, 'none') AS source_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j02_source_names(spark, d):
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return lookup.enriched(read(spark, d, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", {"c_name": "source_name"}, {"source_name": "none"})


@query("j18_prune_unless_empty", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j18_prune_unless_empty(spark, d):
    known, fetched = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return rows.prune_missing_unless_empty(known, fetched, "c_custkey")


@query("j20_stable_updates", "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN 'then' ELSE 'now' END AS updated FROM customer")
def j20_stable_updates(spark, d):
    now = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    before = now.select("c_custkey", F.greatest("c_acctbal", F.lit(0)).alias("c_acctbal"), F.lit("then").alias("updated")).where("c_acctbal > 0")
    return merge.stable_updates(now.withColumn("updated", F.lit("")), before, "c_custkey", ["c_acctbal"], "updated", "now")


@query("j21_reused_rows", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE (o_custkey, 'F') IN (SELECT o_custkey, o_orderstatus FROM orders) AND o_orderstatus = 'F'")
def j21_reused_rows(spark, d):
    pairs = read(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()
    return rows.also_in(pairs, pairs.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderstatus"])


@query("k04_insert_only", "SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 THEN 'old' ELSE 'new' END AS data_hash, CASE WHEN c_nationkey < 12 THEN 'a' ELSE 'now' END AS first_seen_at_utc, CASE WHEN c_nationkey < 12 THEN 'b' ELSE 'now' END AS updated_at_utc, CASE WHEN c_nationkey < 12 THEN 'unchanged' ELSE 'inserted' END AS change FROM customer")
def k04_insert_only(spark, d):
    every = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    kept = every.where("c_nationkey < 12").select("id", F.lit("old").alias("data_hash"), F.lit("a").alias("first_seen_at_utc"), F.lit("b").alias("updated_at_utc"))
    return merge.upsert(kept, every.select("id", F.lit("new").alias("data_hash")), "id", "now", update=False)


@query("k05_default_sources", "SELECT s_suppkey AS source_id, CASE WHEN s_nationkey < 12 AND s_suppkey NOT IN (1, 2, 3) THEN 'kept' ELSE 'default' END AS config_json FROM supplier")
def k05_default_sources(spark, d):
    every = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_nationkey")
    kept = every.where("s_nationkey < 12").select("source_id", F.lit("kept").alias("config_json"))
    return merge.upsert_sources(kept, every.select("source_id", F.lit("default").alias("config_json")), (1, 2, 3))


@query("s45_target_sources", "SELECT s_suppkey AS source_id FROM supplier WHERE s_acctbal > 0")
def s45_target_sources(spark, d):
    return tables.target_sources(read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("is_enabled"))).select("source_id")


# Scalar functions


@query("o03_period_order", f"""WITH k AS (SELECT DISTINCT unnest([{_YM}, CAST(year(o_orderdate) AS VARCHAR), year(o_orderdate) || 'Q' || quarter(o_orderdate), 'total']) AS key FROM orders)
  SELECT key, CASE WHEN key = 'total' THEN 9999 ELSE CAST(substr(key, 1, 4) AS INT) END AS year, CASE WHEN key = 'total' THEN 3 WHEN length(key) = 4 THEN 0 WHEN contains(key, 'Q') THEN 1 ELSE 2 END AS kind,
         CASE WHEN key = 'total' OR length(key) = 4 THEN 0 WHEN contains(key, 'Q') THEN CAST(substr(key, 6, 1) AS INT) ELSE CAST(substr(key, 6, 2) AS INT) END AS part FROM k""")  # fmt: skip
def o03_period_order(spark, d):
    ym = F.col("ym")
    keys = _orders(spark, d).select(F.explode(F.array(ym, F.substring(ym, 1, 4), P.quarter_key(ym), F.lit("total"))).alias("key")).distinct()
    return keys.select("key", P.period_order(F.col("key")).alias("o")).select("key", "o.*")


@query("o04_company_period_order", f"SELECT DISTINCT key, CASE WHEN key = 'total' THEN 0 WHEN contains(key, '-') THEN 1 ELSE 2 END AS kind FROM (SELECT unnest([{_YM}, 'total', o_orderstatus]) AS key FROM orders)")
def o04_company_period_order(spark, d):
    keys = _orders(spark, d, "o_orderstatus").select(F.explode(F.array("ym", F.lit("total"), "o_orderstatus")).alias("key")).distinct()
    return keys.select("key", P.company_period_order(F.col("key"))["kind"].alias("kind"))


@query("f10_numbers", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS DOUBLE) * 1000 + 5 WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS v FROM orders")
def f10_numbers(spark, d):
    key = F.col("o_orderkey").cast("string")
    written = F.when(F.col("o_orderstatus") == "F", F.concat(key, F.lit(",005"))).when(F.col("o_orderstatus") == "O", F.lit("…")).otherwise(F.concat(F.lit(" "), key))
    return read(spark, d, "orders").select("o_orderkey", P.number(written).alias("v"))


@query("f16_japan_to_utc", "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM orders")
def f16_japan_to_utc(spark, d):
    return _orders(spark, d).select("o_orderkey", P.to_utc(F.col("day")).alias("utc"))


@query("f18_start_time", "SELECT event_id, CASE WHEN event_id % 30 <= 23 THEN lpad(CAST(event_id % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') END AS t FROM events")
def f18_start_time(spark, d):
    i = F.col("event_id")
    return read(spark, d, "events").select("event_id", P.start_time(F.format_string("開場 12:15 / %d:%02d 開演", i % 30, i % 60)).alias("t"))


@query("f23_row_hash", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS h FROM nation")
def f23_row_hash(spark, d):
    return read(spark, d, "nation").select("n_nationkey", records.row_hash("n_regionkey", "n_name").alias("h"))


@query("f24_uids", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'v:' || o_custkey ELSE 'v:h:' || substr(sha256(CASE WHEN o_orderstatus = 'O' THEN 'v|title ' || o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|18:00|'
  ELSE 'v:title ' || o_custkey || ':' || strftime(o_orderdate, '%Y-%m-%d') END), 1, 16) END AS event_uid, sha256('s|http://x/' || o_custkey || CASE WHEN o_orderstatus = 'F' THEN '|F' ELSE '' END) AS signal_uid FROM orders""")  # fmt: skip
def f24_uids(spark, d):
    cust, status = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    key, time = F.when(status == "F", cust).otherwise(""), F.when(status == "O", "18:00").otherwise("")
    event = records.event_uid(F.lit("v"), key, F.concat(F.lit("title "), cust), F.date_format("o_orderdate", "yyyy-MM-dd"), time, F.lit(None).cast("string"))
    signal = records.signal_uid(F.lit("s"), F.concat(F.lit(" http://x/"), cust), F.when(status == "F", "F").otherwise(" "))
    return read(spark, d, "orders").select("o_orderkey", event.alias("event_uid"), signal.alias("signal_uid"))


@query("f26_urls", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 4 > 1 THEN '?page=' || page_id % 4 ELSE '' END AS paged FROM pages")
def f26_urls(spark, d):
    return read(spark, d, "pages").select("page_id", records.bare_url(F.col("url")).alias("bare"), records.page_url(F.col("url"), F.col("page_id") % 4).alias("paged"))


@query("f41_booleans", "SELECT o_orderkey, o_orderstatus <> 'F' AS b FROM orders")
def f41_booleans(spark, d):
    written = F.when(F.col("o_orderstatus") == "F", " No ").when(F.col("o_orderstatus") == "O", "TRUE").otherwise("odd")
    return read(spark, d, "orders").select("o_orderkey", classify.tolerant_bool(written, True).alias("b"))


_TIERS = tuple(fixed.TIERS)


@query("f42_tier_rank", "SELECT c_custkey, CASE " + " ".join(f"WHEN c_custkey % {len(_TIERS) + 1} = {i} THEN {fixed.TIERS[t]}" for i, t in enumerate(_TIERS)) + f" ELSE {fixed.LAST_TIER} END AS rank FROM customer")
def f42_tier_rank(spark, d):
    tier = F.get(F.array(*map(F.lit, (*_TIERS, "none"))), (F.col("c_custkey") % (len(_TIERS) + 1)).cast("int"))
    return read(spark, d, "customer").select("c_custkey", classify.tier_rank(tier).alias("rank"))


@query("f44_ratios", f"SELECT o_orderstatus, round_even(CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) / count(*), 4) AS share FROM orders GROUP BY ALL")
def f44_ratios(spark, d):
    counts = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.count("*").alias("b"))
    return counts.select("o_orderstatus", records.ratio(F.col("a"), F.col("b")).alias("share"))


@query("f19_prefectures", "SELECT s_suppkey, CASE " + " ".join(f"WHEN s_suppkey % 47 = {i} THEN '{p}'" for i, p in enumerate(fixed.PREFECTURES)) + " END AS prefecture FROM supplier")
def f19_prefectures(spark, d):
    short = [p if p == "北海道" else p[:-1] for p in fixed.PREFECTURES]
    given = F.get(F.array(*map(F.lit, short)), (F.col("s_suppkey") % 47).cast("int"))
    return read(spark, d, "supplier").select("s_suppkey", classify.full_prefecture(given).alias("prefecture"))


_TERM = fixed.NEWS_INCLUDE[0]
_HITS = [sum(w in _TERM for w in words) for words in (fixed.NEWS_INCLUDE, fixed.NEWS_LOCATIONS)]


@query("f35_news_score", f"SELECT item_id, CASE WHEN item_id % 2 = 1 THEN least(100, 70 + 8 * {_HITS[0]} + 6 * {_HITS[1]}) ELSE 70 END AS score, item_id % 2 = 1 AS candidate FROM benchmark")
def f35_news_score(spark, d):
    told = F.when(F.col("item_id") % 2 == 1, F.lit(_TERM)).otherwise("")
    return read(spark, d, "benchmark").select("item_id", classify.news_score(told, F.lit("")).alias("score"), classify.event_candidate(told, F.lit("")).alias("candidate"))

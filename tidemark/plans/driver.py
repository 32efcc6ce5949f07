"""The engine's operators bound to the driver's star-schema tables, each with SQL that gives the same rows.

Amounts are in cents, as whole numbers, so that sums don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import classify, fixed, records
from tidemark.functions import period as P
from tidemark.functions import text as T
from tidemark.operators import audit, consolidate, lookup, matching, merge, rows, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def regional(spark: SparkSession, d: str) -> DataFrame:
    """(r_name, n_name, ym, status, v): orders by region, in cents."""
    orders = read(spark, d, "orders").select("o_custkey", "o_orderstatus", P.ym_of(F.col("o_orderdate")).alias("ym"), stats.cents(F.col("o_totalprice")).alias("v"))
    customer = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("r_name", "n_name", "ym", F.col("o_orderstatus").alias("status"), "v")


OCN = """ocn AS (
  SELECT r_name, n_name, strftime(o_orderdate, '%Y-%m') AS ym, o_orderstatus AS status,
         CAST(round(o_totalprice * 100) AS BIGINT) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""


@query("w01_rolling12", f"""WITH {OCN}, m AS (SELECT r_name, ym, CAST(sum(v) AS BIGINT) AS v FROM ocn GROUP BY ALL),
  w AS (SELECT r_name, ym, CAST(sum(v) OVER x AS BIGINT) AS v, count(*) OVER x AS n FROM m
        WINDOW x AS (PARTITION BY r_name ORDER BY ym ROWS 11 PRECEDING))
  SELECT r_name, ym, v FROM w WHERE n = 12""")  # fmt: skip
def w01_rolling12(spark, d):
    return stats.rolling(stats.summed(regional(spark, d), ["r_name", "ym"], ["v"]), ["r_name"], "ym", ["v"])


@query("a01_region_rollup", f"WITH {OCN} SELECT r_name, ym, CAST(sum(v) AS BIGINT) AS v FROM ocn GROUP BY ALL")
def a01_region_rollup(spark, d):
    return stats.summed(regional(spark, d), ["r_name", "ym"], ["v"])


@query("a02_national_union", f"""WITH {OCN}, s AS (SELECT n_name AS area, ym, CAST(sum(v) AS BIGINT) AS v FROM ocn GROUP BY ALL)
  SELECT * FROM s UNION ALL SELECT '00', ym, CAST(sum(v) AS BIGINT) FROM s GROUP BY ym""")  # fmt: skip
def a02_national_union(spark, d):
    single = stats.summed(regional(spark, d).withColumnRenamed("n_name", "area"), ["area", "ym"], ["v"])
    return stats.with_national(single, "area", ["ym"], ["v"])


@query("a03_fiscal_mean", f"""WITH {OCN}, x AS (SELECT *, CAST(substr(ym, 1, 4) AS INT) AS y, CAST(substr(ym, 6, 2) AS INT) AS month FROM ocn)
  SELECT CASE WHEN month >= 4 THEN y ELSE y - 1 END AS fiscal_year, month, round(sum(v) / count(v) / 100, 4) AS mean FROM x GROUP BY ALL""")  # fmt: skip
def a03_fiscal_mean(spark, d):
    return stats.fiscal_mean(regional(spark, d), "ym", "v")


@query("a04_fiscal_type_mean", f"""WITH {OCN}, x AS (SELECT *, CAST(substr(ym, 1, 4) AS INT) AS y, CAST(substr(ym, 6, 2) AS INT) AS month FROM ocn)
  SELECT status, CASE WHEN month >= 4 THEN y ELSE y - 1 END AS fiscal_year, month, round(sum(v) / count(v) / 100, 8) AS mean
  FROM x GROUP BY ALL""")  # fmt: skip
def a04_fiscal_type_mean(spark, d):
    return stats.fiscal_mean(regional(spark, d), "ym", "v", by=["status"], digits=8)


@query("a05_latest_mean", f"WITH {OCN}, l AS (SELECT max(ym) AS ym FROM ocn) SELECT ym, round(sum(v) / count(v), 4) AS mean FROM ocn JOIN l USING (ym) GROUP BY ym")
def a05_latest_mean(spark, d):
    return stats.latest_mean(regional(spark, d), "ym", "v").withColumn("mean", F.round("mean", 4))


@query("a06_los_by_segment", """WITH b AS (SELECT l_returnflag AS segment, CAST(least(l_quantity, 8) AS INT) AS bin, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
  s AS (SELECT *, value / CASE WHEN bin = 8 THEN 8.5 ELSE bin END AS stays FROM b),
  g AS (SELECT segment, sum(value) AS total_nights, round(sum(stays), 6) AS estimated_stays, coalesce(sum(CASE WHEN bin = 1 THEN stays END), 0) AS one_night_stays FROM s GROUP BY segment)
  SELECT segment, total_nights, estimated_stays, one_night_stays, round(total_nights / estimated_stays, 6) AS los,
         round(one_night_stays / estimated_stays * 100, 6) AS one_night_share, round(greatest(estimated_stays - one_night_stays, 0) / estimated_stays * 100, 6) AS two_plus_share
  FROM g WHERE estimated_stays > 0""")  # fmt: skip
def a06_los_by_segment(spark, d):
    items = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("segment"), F.least("l_quantity", F.lit(8)).cast("int").alias("bin"), F.col("l_quantity").alias("value"))
    return stats.length_of_stay(items)


@query("a08_bucket_min_count", """WITH x AS (SELECT CASE WHEN contains(p_type, 'BRASS') THEN 'brass' WHEN contains(p_type, 'STEEL') THEN 'steel' WHEN contains(p_type, 'TIN') THEN 'tin' ELSE 'other' END AS bucket,
         CASE WHEN p_size > 25 THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS v, p_brand FROM part)
  SELECT p_brand, bucket, CAST(sum(v) AS BIGINT) AS v FROM x GROUP BY ALL HAVING sum(v) IS NOT NULL""")  # fmt: skip
def a08_bucket_min_count(spark, d):
    t = F.col("p_type")
    part = read(spark, d, "part").select("p_brand", F.when(t.contains("BRASS"), "brass").when(t.contains("STEEL"), "steel").when(t.contains("TIN"), "tin").otherwise("other").alias("bucket"), F.when(F.col("p_size") > 25, stats.cents(F.col("p_retailprice"))).alias("v"))
    return stats.summed(part, ["p_brand", "bucket"], ["v"], keep_null=True).dropna(subset=["v"])


@query("a15_monthly_average", f"""WITH {OCN}, m AS (SELECT CAST(count(DISTINCT ym) AS BIGINT) AS months FROM ocn)
  SELECT n_name, CAST(sum(v) AS BIGINT) AS total, any_value(months) AS months, round(sum(v) / any_value(months), 4) AS average FROM ocn, m GROUP BY n_name""")  # fmt: skip
def a15_monthly_average(spark, d):
    return stats.monthly_average(regional(spark, d), ["n_name"], "ym", "v")


@query("a16_daily_intensity", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(event_id) AS n, CAST(sum(CAST(round(coalesce(value, 0) * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY ALL""")
def a16_daily_intensity(spark, d):
    day = read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", stats.cents(F.coalesce("value", F.lit(0.0))).alias("v"))
    return day.groupBy("day").agg(F.count("event_id").alias("n"), F.sum("v").alias("v"))


@query("a18_metric_pivot", f"""WITH {OCN} SELECT r_name, ym, CAST(coalesce(sum(v) FILTER (status = 'F'), 0) AS BIGINT) AS "F",
         CAST(coalesce(sum(v) FILTER (status = 'O'), 0) AS BIGINT) AS "O", CAST(coalesce(sum(v) FILTER (status = 'P'), 0) AS BIGINT) AS "P" FROM ocn GROUP BY ALL""")  # fmt: skip
def a18_metric_pivot(spark, d):
    return stats.pivoted(regional(spark, d), ["r_name", "ym"], "status", ["F", "O", "P"], "v")


@query("a19_year_month_pivot", f"""WITH {OCN}, m AS (SELECT CAST(unnest(range(1, 13)) AS INT) AS month)
  SELECT m.month, {', '.join(f"CAST(coalesce(sum(v) FILTER (substr(ym, 1, 4) = '{y}'), 0) AS BIGINT) AS y{y}" for y in (1996, 1997, 2005))}
  FROM m LEFT JOIN ocn ON CAST(substr(ym, 6, 2) AS INT) = m.month GROUP BY m.month""")  # fmt: skip
def a19_year_month_pivot(spark, d):
    return stats.year_by_month(regional(spark, d), [1996, 1997, 2005], "ym", "v")


@query("a21_period_releases", f"WITH {OCN} SELECT ym, string_agg(DISTINCT status, ',' ORDER BY status) AS releases FROM ocn GROUP BY ym")
def a21_period_releases(spark, d):
    return stats.releases(regional(spark, d), "ym", "status")


_PARTIES = """parties AS (
  SELECT 'customer' AS source, c_custkey AS id, c_nationkey AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, 20 AS place FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT), 10 FROM supplier)"""


def parties(spark, d):
    """Suppliers and customers as records of two sources."""
    c = read(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), stats.cents(F.col("c_acctbal")).alias("balance"), F.lit(20).alias("place"))
    s = read(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), stats.cents(F.col("s_acctbal")).alias("balance"), F.lit(10).alias("place"))
    return c.unionByName(s)


@query("a22_consolidate", f"""WITH {_PARTIES}, r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY place, balance, CAST(id AS VARCHAR)) AS n FROM parties)
  SELECT nation, max(CASE WHEN n = 1 THEN source END) AS display_source, max(CASE WHEN n = 1 THEN id END) AS display_id, count(*) AS members,
         string_agg(source || ':' || id, ',' ORDER BY n) AS supporting FROM r GROUP BY nation""")  # fmt: skip
def a22_consolidate(spark, d):
    made = consolidate.consolidated(parties(spark, d), ["nation"], "id", "balance", "source", rank="place")
    named = F.transform("supporting_sources", lambda m: F.concat_ws(":", m["source"], m["id"].cast("string")))
    return made.select("nation", F.col("display.source").alias("display_source"), F.col("display.id").alias("display_id"), F.size("supporting_sources").cast("long").alias("members"), F.array_join(named, ",").alias("supporting"))


@query("a23_display_counts", f"""WITH {_PARTIES}, r AS (SELECT source, row_number() OVER (PARTITION BY nation ORDER BY place, balance, CAST(id AS VARCHAR)) AS n FROM parties)
  SELECT source AS display_source, count(*) AS n FROM r WHERE n = 1 GROUP BY source""")  # fmt: skip
def a23_display_counts(spark, d):
    made = consolidate.displayed(parties(spark, d), ["nation"], "id", "balance", "source", rank="place")
    return made.groupBy(F.col("display.source").alias("display_source")).agg(F.count("*").alias("n"))


@query("a24_scope_metrics", """WITH r AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'O'),
  b AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'F'),
  h AS (SELECT r.*, b.name IS NOT NULL AS known FROM r LEFT JOIN b USING (day, name)),
  w AS (SELECT DISTINCT o_orderpriority AS name FROM orders UNION SELECT 'none')
  SELECT w.name, count(h.name) AS hits, count(h.name) FILTER (NOT known) AS additional, count(h.name) FILTER (known) AS overlap,
         CASE WHEN count(h.name) = 0 THEN 0.0 ELSE round_even(count(h.name) FILTER (known) / count(h.name), 4) END AS noise_rate
  FROM w LEFT JOIN h ON w.name = h.name GROUP BY w.name""")  # fmt: skip
def a24_scope_metrics(spark, d):
    orders = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("name"), "o_orderstatus")
    watched = orders.select("name").union(spark.createDataFrame([("none",)], "name string"))
    return audit.scope_metrics(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'F'"), ["day", "name"], watched, "name")


@query("a26_same_event", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS name, count(DISTINCT o_orderstatus) AS sources, count(*) AS records,
         string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS source_list FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) >= 2""")  # fmt: skip
def a26_same_event(spark, d):
    orders = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("source_id"))
    return audit.same_event(orders, ["day", "name"])


@query("a27_gap_counts", """WITH g AS (SELECT l_linestatus, unnest(list_filter([CASE WHEN l_discount = 0 THEN 'no_discount' END, CASE WHEN l_tax = 0 THEN 'no_tax' END, CASE WHEN l_quantity < 5 THEN 'few' END], lambda x: x IS NOT NULL)) AS label FROM lineitem)
  SELECT l_linestatus, label, count(*) AS n FROM g GROUP BY ALL""")  # fmt: skip
def a27_gap_counts(spark, d):
    items = read(spark, d, "lineitem").select("l_linestatus", audit.gaps(no_discount=F.col("l_discount") == 0, no_tax=F.col("l_tax") == 0, few=F.col("l_quantity") < 5).alias("labels"))
    return audit.label_counts(items, "labels", ["l_linestatus"])


@query("a30_unique_keys", "SELECT p_name, min(p_brand) AS p_brand FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) = 1")
def a30_unique_keys(spark, d):
    return lookup.unambiguous(read(spark, d, "part"), "p_name", "p_brand")


@query("a32_signature", """WITH h AS (SELECT l_returnflag, sha256(l_orderkey || '|' || l_linenumber) AS x FROM lineitem)
  SELECT l_returnflag, sha256(concat_ws(':', count(*), """ + ", ".join(f"sum(CAST('0x' || substr(x, {8 * k + 1}, 8) AS BIGINT))" for k in range(8)) + """)) AS signature FROM h GROUP BY l_returnflag""")
def a32_signature(spark, d):
    items = read(spark, d, "lineitem").select("l_returnflag", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("x"))
    return items.groupBy("l_returnflag").agg(records.set_signature("x").alias("signature"))


@query("a34_top_unknown", "SELECT p_type, count(*) AS n FROM part WHERE NOT contains(p_type, 'TIN') GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def a34_top_unknown(spark, d):
    return stats.top(read(spark, d, "part").where(~F.col("p_type").contains("TIN")).groupBy("p_type").agg(F.count("*").alias("n")), "n", 10, ["p_type"])


@query("a36_extent", """SELECT count(*) AS "rows", min(strftime(o_orderdate, '%Y-%m')) AS ym_min, max(strftime(o_orderdate, '%Y-%m')) AS ym_max, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS ym_distinct,
  min(o_orderstatus) AS status_min, max(o_orderstatus) AS status_max, count(DISTINCT o_orderstatus) AS status_distinct FROM orders""")  # fmt: skip
def a36_extent(spark, d):
    orders = read(spark, d, "orders").select(P.ym_of(F.col("o_orderdate")).alias("ym"), F.col("o_orderstatus").alias("status"))
    return audit.extent(orders, ym="ym", status="status")


@query("a38_grouped_schedules", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 10 AS place, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS info FROM events GROUP BY ALL")
def a38_grouped_schedules(spark, d):
    events = read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 10).alias("place"), F.col("event_type").alias("info"))
    return audit.grouped_schedules(events, ["day", "place"], "info")


@query("w02_keep_first", "SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def w02_keep_first(spark, d):
    return rows.first_of(read(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", stats.cents(F.col("o_totalprice")).alias("v"))


@query("w03_keep_last", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w03_keep_last(spark, d):
    return rows.first_of(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w04_best_by_key", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w04_best_by_key(spark, d):
    return rows.first_of(read(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("w06_least_row", "SELECT l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_suppkey")
def w06_least_row(spark, d):
    return rows.least_of(read(spark, d, "lineitem"), ["l_suppkey"], F.col("l_partkey"), ["l_partkey"])


@query("w08_priority_rank", f"WITH {_PARTIES} SELECT nation, source, id, row_number() OVER (PARTITION BY nation ORDER BY place, balance, source, id) AS rank FROM parties")
def w08_priority_rank(spark, d):
    return rows.ranked(parties(spark, d), ["nation"], [F.asc("place"), F.asc("balance"), F.asc("source"), F.asc("id")]).select("nation", "source", "id", "rank")


@query("w09_latest_release", """WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, o_orderstatus FROM orders), l AS (SELECT * FROM x WHERE ym = (SELECT max(ym) FROM x)),
  r AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS p FROM l) SELECT o_orderkey, ym, o_orderstatus FROM r WHERE p = (SELECT min(p) FROM r)""")  # fmt: skip
def w09_latest_release(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", P.ym_of(F.col("o_orderdate")).alias("ym"), "o_orderstatus")
    return stats.latest_release(orders, "ym", "o_orderstatus", ["F", "O", "P"]).select("o_orderkey", "ym", "o_orderstatus")


@query("w12_forward_fill", """SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_linenumber % 3 = 1 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS label FROM lineitem""")
def w12_forward_fill(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_partkey")).alias("label"))
    return rows.filled_forward(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "label").select("l_orderkey", "l_linenumber", "label")


@query("w13_score_margin", """WITH x AS (SELECT p_brand, p_name, p_partkey, p_size AS score, lead(p_size) OVER w AS s2, lead(p_name) OVER w AS n2, row_number() OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC, p_name, p_partkey))
  SELECT p_brand, p_name, p_partkey, score, NOT coalesce(score - s2 <= 2 AND p_name <> n2, false) AS clear FROM x WHERE n = 1""")  # fmt: skip
def w13_score_margin(spark, d):
    part = read(spark, d, "part").select("p_brand", "p_name", "p_partkey", F.col("p_size").alias("score"))
    return lookup.best_with_margin(part, ["p_brand"], "score", "p_name", ["p_name", "p_partkey"])


@query("w14_share", f"""WITH {OCN}, p AS (SELECT ym, coalesce(sum(v) FILTER (status = 'F'), 0) AS f, coalesce(sum(v) FILTER (status = 'O'), 0) AS o, coalesce(sum(v) FILTER (status = 'P'), 0) AS p FROM ocn GROUP BY ym),
  l AS (SELECT ym, 'F' AS part, f AS value, f + o + p AS t FROM p UNION ALL SELECT ym, 'O', o, f + o + p FROM p UNION ALL SELECT ym, 'P', p, f + o + p FROM p)
  SELECT ym, part, CAST(value AS BIGINT) AS value, coalesce(round_even(value * 100 / nullif(t, 0), 4), 0) AS share_pct FROM l""")  # fmt: skip
def w14_share(spark, d):
    return stats.shares(stats.pivoted(regional(spark, d), ["ym"], "status", ["F", "O", "P"], "v"), ["ym"], ["F", "O", "P"])


@query("j01_left_enrich", """SELECT o_orderkey, coalesce(c_name, 'unknown') AS name, coalesce(c_mktsegment, 'unknown') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey""")
def j01_left_enrich(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return lookup.enriched(orders, read(spark, d, "customer").where("c_custkey % 3 > 0"), "c_custkey", {"c_name": "name", "c_mktsegment": "segment"}, {"name": "unknown", "segment": "unknown"}).drop("c_custkey")


@query("j06_full_outer", """WITH a AS (SELECT l_returnflag AS flag, CASE WHEN l_linenumber > 4 THEN NULL ELSE l_linenumber END AS line, count(*) AS respondents, CAST(sum(l_quantity) AS BIGINT) AS nights FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL),
  b AS (SELECT l_returnflag AS flag, CASE WHEN l_linenumber > 4 THEN NULL ELSE l_linenumber END AS line, count(*) AS respondents, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS spend FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL)
  SELECT coalesce(a.flag, b.flag) AS flag, coalesce(a.line, b.line) AS line, coalesce(a.respondents, b.respondents) AS respondents, spend, nights, CASE WHEN nights > 0 THEN round(spend / nights, 4) END AS spend_per_night
  FROM a FULL JOIN b ON a.flag IS NOT DISTINCT FROM b.flag AND a.line IS NOT DISTINCT FROM b.line""")  # fmt: skip
def j06_full_outer(spark, d):
    items = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_linenumber", F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber")).alias("line"), "l_quantity", stats.cents(F.col("l_extendedprice")).alias("price"))
    nights = items.where("l_linenumber <> 2").groupBy("flag", "line").agg(F.count("*").alias("respondents"), F.sum("l_quantity").cast("long").alias("nights"))
    spend = items.where("l_linenumber <> 3").groupBy("flag", "line").agg(F.count("*").alias("respondents"), F.sum("price").alias("spend"))
    return stats.merged_metrics(nights, spend, ["flag", "line"])


@query("j09_two_step_lookup", """WITH i AS (SELECT p_partkey, p_brand AS value FROM part WHERE p_partkey % 4 = 0), n AS (SELECT p_name, min(p_type) AS value FROM part WHERE p_size < 20 GROUP BY p_name)
  SELECT p.p_partkey, p.p_name, coalesce(i.value, n.value, 'none') AS value FROM part p LEFT JOIN i ON p.p_partkey = i.p_partkey LEFT JOIN n ON p.p_name = n.p_name""")  # fmt: skip
def j09_two_step_lookup(spark, d):
    part = read(spark, d, "part")
    by_id = part.where("p_partkey % 4 = 0").select("p_partkey", F.col("p_brand").alias("value"))
    by_name = part.where("p_size < 20").groupBy("p_name").agg(F.min("p_type").alias("value"))
    return lookup.two_step(part.select("p_partkey", "p_name"), by_id, by_name, "p_partkey", "p_name", "value", "none").select("p_partkey", "p_name", "value")


@query("j13_alias_in_text", """WITH t AS (SELECT item_id, lower(text) AS t FROM benchmark), a AS (SELECT unnest(['thing', 'tion the', 'ening', 'erand']) AS alias)
  SELECT item_id, alias, count(*) AS n FROM t, a, generate_series(1, length(t)) s(i) WHERE substr(t, CAST(i AS BIGINT), length(alias)) = alias GROUP BY ALL""")  # fmt: skip
def j13_alias_in_text(spark, d):
    names = ["thing", "tion the", "ening", "erand"]
    found = read(spark, d, "benchmark").select("item_id", F.lower("text").alias("t"), F.explode(F.array(*map(F.lit, names))).alias("alias"))
    # Overlapping places: a look-ahead matches at each of them.
    return found.select("item_id", "alias", F.regexp_count("t", F.concat(F.lit("(?="), F.col("alias"), F.lit(")"))).cast("long").alias("n")).where("n > 0")


@query("j14_longest_contains", """WITH t AS (SELECT DISTINCT p_type FROM part), k AS (SELECT DISTINCT n_name AS key FROM nation UNION SELECT DISTINCT substr(p_type, 1, 7) FROM part),
  m AS (SELECT p_type, key, row_number() OVER (PARTITION BY p_type ORDER BY least(length(key), length(p_type)) DESC, key) AS n FROM t JOIN k ON contains(p_type, key) OR contains(key, p_type) WHERE length(key) >= 4 AND length(p_type) >= 4)
  SELECT p_partkey, p.p_type, key AS found FROM part p LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON p.p_type = m.p_type""")  # fmt: skip
def j14_longest_contains(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_type")
    names = read(spark, d, "nation").select(F.col("n_name").alias("key")).union(part.select(F.substring("p_type", 1, 7))).distinct().withColumn("found", F.col("key"))
    return lookup.longest_containing(part, "p_type", names, "key", "found")


@query("j15_prune_anti", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def j15_prune_anti(spark, d):
    back = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return rows.not_in(read(spark, d, "orders").select("o_orderkey", "o_custkey"), back, ["o_orderkey"])


@query("j16_capacity_gate", "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 1000")
def j16_capacity_gate(spark, d):
    venues = read(spark, d, "customer").select(F.col("c_custkey").alias("venue_name"), F.col("c_acctbal").alias("capacity"))
    return lookup.capacity_gate(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("venue_name")), venues).withColumnRenamed("venue_name", "o_custkey")


_HALVES = """old AS (SELECT o_orderkey AS k, o_orderstatus AS data_hash, CAST(round(o_totalprice * 100) AS BIGINT) AS v, '2024-01-01' AS seen FROM orders WHERE o_orderkey % 3 > 0),
  new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS data_hash, CAST(round(o_totalprice * 100) AS BIGINT) + 1 AS v FROM orders WHERE o_orderkey % 3 < 2)"""


@query("j17_upsert", f"""WITH {_HALVES}, x AS (SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NOT NULL AND o.data_hash IS DISTINCT FROM n.data_hash THEN 'updated' ELSE 'unchanged' END AS change,
         o.data_hash AS oh, n.data_hash AS nh, o.v AS ov, n.v AS nv, o.seen FROM old o FULL JOIN new n ON o.k = n.k)
  SELECT k, CASE WHEN change = 'unchanged' THEN oh ELSE nh END AS data_hash, CASE WHEN change = 'unchanged' THEN ov ELSE nv END AS v, coalesce(seen, '2024-02-01') AS first_seen_at_utc,
         CASE WHEN change = 'unchanged' THEN seen ELSE '2024-02-01' END AS updated_at_utc, change FROM x""")  # fmt: skip
def j17_upsert(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("data_hash"), stats.cents(F.col("o_totalprice")).alias("v"))
    kept = orders.where("k % 3 > 0").withColumn("first_seen_at_utc", F.lit("2024-01-01")).withColumn("updated_at_utc", F.lit("2024-01-01"))
    fetched = orders.where("k % 3 < 2").withColumn("data_hash", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("data_hash"))).withColumn("v", F.col("v") + 1)
    return merge.upsert(kept, fetched, "k", "2024-02-01")


@query("j19_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def j19_semi(spark, d):
    urgent = read(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return rows.also_in(read(spark, d, "customer").select("c_custkey", "c_name"), urgent, ["c_custkey"])


@query("j22_fill_blanks", """SELECT l_orderkey, arg_min(CASE WHEN l_linenumber > 1 THEN l_returnflag END, CASE WHEN l_linenumber > 1 THEN place END) AS flag, arg_min(l_linestatus, place) AS status
  FROM (SELECT *, (l_linenumber * 10000000 + l_partkey) * 10000000 + l_suppkey AS place FROM lineitem) GROUP BY l_orderkey""")
def j22_fill_blanks(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", ((F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 10_000_000 + F.col("l_suppkey")).alias("place"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).otherwise("").alias("flag"), F.col("l_linestatus").alias("status"))
    return rows.filled_blanks(items, ["l_orderkey"], F.col("place"), ["flag", "status"])


@query("j24_range_join", """SELECT a.l_orderkey, a.l_linenumber AS anchor, b.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber BETWEEN a.l_linenumber + 1 AND a.l_linenumber + 8 WHERE a.l_linestatus = 'O'""")
def j24_range_join(spark, d):
    items = read(spark, d, "lineitem")
    return rows.following(items.where("l_linestatus = 'O'"), items.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], "l_linenumber", 8)


@query("o01_sorted", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name")
def o01_sorted(spark, d):
    both = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_name")


@query("o02_custom_order", """SELECT c_mktsegment AS segment, count(*) AS n, any_value(coalesce(nullif(list_position(['MACHINERY', 'BUILDING', 'FURNITURE'], c_mktsegment), 0), 999)) AS place FROM customer GROUP BY ALL""")
def o02_custom_order(spark, d):
    return read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")).withColumn("place", stats.in_order(F.col("segment"), ("MACHINERY", "BUILDING", "FURNITURE")).cast("int"))


@query("o05_topn", "SELECT l_partkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY l_partkey ORDER BY v DESC, l_partkey LIMIT 15")
def o05_topn(spark, d):
    return stats.top(stats.summed(read(spark, d, "lineitem").select("l_partkey", stats.cents(F.col("l_extendedprice")).alias("v")), ["l_partkey"], ["v"]), "v", 15, ["l_partkey"])


@query("o06_topn_restrict", f"WITH {OCN}, t AS (SELECT n_name FROM ocn GROUP BY n_name ORDER BY sum(v) DESC, n_name LIMIT 5) SELECT n_name, ym, CAST(sum(v) AS BIGINT) AS v FROM ocn WHERE n_name IN (SELECT n_name FROM t) GROUP BY ALL")
def o06_topn_restrict(spark, d):
    return stats.of_top(stats.summed(regional(spark, d), ["n_name", "ym"], ["v"]), "n_name", "v", 5)


@query("u01_union_all", "SELECT c_nationkey AS nation, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier")
def u01_union_all(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")).unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")))


@query("u02_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u02_union_distinct(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u03_except", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def u03_except(spark, d):
    return read(spark, d, "part").select("p_partkey").subtract(read(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("u04_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u04_intersect(spark, d):
    orders = read(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("u05_changes", "(SELECT 'removed' AS side, s_nationkey AS nation FROM supplier WHERE s_suppkey < 40 EXCEPT SELECT 'removed', s_nationkey FROM supplier WHERE s_suppkey >= 40) UNION ALL (SELECT 'added', s_nationkey FROM supplier WHERE s_suppkey >= 40 EXCEPT SELECT 'added', s_nationkey FROM supplier WHERE s_suppkey < 40)")
def u05_changes(spark, d):
    nation = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return rows.changed(nation.where("s_suppkey < 40").select("nation"), nation.where("s_suppkey >= 40").select("nation")).select("side", "nation")


@query("u06_unpivot", "SELECT * FROM (SELECT l_orderkey, l_linenumber, 'discount' AS metric, CAST(round(l_discount * 100) AS BIGINT) AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', CAST(round(l_tax * 100) AS BIGINT) FROM lineitem)")
def u06_unpivot(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stats.cents(F.col("l_discount")).alias("discount"), stats.cents(F.col("l_tax")).alias("tax"))
    return items.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "metric", "value")


@query("p01_year_month", f"WITH {OCN} SELECT DISTINCT ym, CAST(substr(ym, 1, 4) AS INT) AS year, CAST(substr(ym, 6, 2) AS INT) AS month, substr(ym, 6, 2) AS month_label, CAST(replace(ym, '-', '') AS INT) AS number FROM ocn")
def p01_year_month(spark, d):
    ym = F.col("ym")
    return regional(spark, d).select("ym").distinct().select("ym", P.year_of(ym).alias("year"), P.month_of(ym).alias("month"), P.month_label(ym).alias("month_label"), P.ym_number(ym).alias("number"))


@query("p03_clamped", f"WITH {OCN} SELECT DISTINCT ym, greatest('1996-02', least('1997-03', ym)) AS inside, ym NOT BETWEEN '1996-02' AND '1997-03' AS moved FROM ocn")
def p03_clamped(spark, d):
    return regional(spark, d).select("ym").distinct().select("ym", P.clamped(F.col("ym"), "1996-02", "1997-03").alias("c")).select("ym", F.col("c.ym").alias("inside"), "c.moved")


@query("p05_range", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1996-03' AND '1996-09'")
def p05_range(spark, d):
    return read(spark, d, "orders").where(P.between(P.ym_of(F.col("o_orderdate")), "1996-09", "1996-03")).select("o_orderkey")


@query("p09_overlap", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE strftime(l_shipdate + INTERVAL 20 DAY, '%Y-%m-%d') >= '1996-05-01' AND strftime(l_shipdate, '%Y-%m-%d') <= '1996-05-31'")
def p09_overlap(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("a"), F.date_format(F.date_add("l_shipdate", 20), "yyyy-MM-dd").alias("b"))
    return rows.overlapping(items, "a", "b", "1996-05-01", "1996-05-31").drop("a", "b")


@query("p10_keyword", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ening') OR contains(lower(source), 'src1')")
def p10_keyword(spark, d):
    docs = read(spark, d, "documents")
    return docs.where(F.lower("text").contains("ening") | F.lower("source").contains("src1")).select("doc_id")


@query("p25_range_repair", """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS s, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate - INTERVAL 5 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') END AS e FROM orders)
  SELECT o_orderkey, coalesce(s, '1996-01-01') AS start, greatest(coalesce(s, '1996-01-01'), e) AS "end" FROM x""")  # fmt: skip
def p25_range_repair(spark, d):
    day = F.col("o_orderdate")
    start, end = rows.repaired_range(F.when(F.col("o_orderkey") % 7 > 0, F.date_format(day, "yyyy-MM-dd")), F.date_format(F.when(F.col("o_orderkey") % 3 > 0, F.date_sub(day, 5)).otherwise(F.date_add(day, 5)), "yyyy-MM-dd"), F.lit("1996-01-01"))
    return read(spark, d, "orders").select("o_orderkey", start.alias("start"), end.alias("end"))


@query("p26_new_24h", "SELECT event_id, ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR AS is_new FROM events")
def p26_new_24h(spark, d):
    return read(spark, d, "events").select("event_id", (F.col("ts") >= F.expr("TIMESTAMP'2024-01-20 12:00:00' - INTERVAL 24 HOURS")).alias("is_new"))


@query("p29_complete", "SELECT p_partkey FROM part WHERE trim(CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END) <> ''")
def p29_complete(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_name")).alias("p_name"))
    return rows.complete(part, ["p_name"])[0].select("p_partkey")


@query("f12_quarter", "SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter FROM orders")
def f12_quarter(spark, d):
    return read(spark, d, "orders").select("o_orderkey", P.quarter_key(P.ym_of(F.col("o_orderdate"))).alias("quarter"))


@query("f13_period_sort", """WITH k AS (SELECT DISTINCT unnest([CAST(year(o_orderdate) AS VARCHAR), year(o_orderdate) || 'Q' || quarter(o_orderdate), strftime(o_orderdate, '%Y-%m'), 'total']) AS key FROM orders),
  s AS (SELECT key, CASE WHEN key = 'total' THEN 9999 ELSE CAST(substr(key, 1, 4) AS INT) END AS y, CASE WHEN key = 'total' THEN 3 WHEN length(key) = 4 THEN 0 WHEN contains(key, 'Q') THEN 1 ELSE 2 END AS kind FROM k)
  SELECT key, row_number() OVER (ORDER BY y, kind, key) AS place FROM s""")  # fmt: skip
def f13_period_sort(spark, d):
    ym = P.ym_of(F.col("o_orderdate"))
    keys = read(spark, d, "orders").select(F.explode(F.array(F.substring(ym, 1, 4), P.quarter_key(ym), ym, F.lit("total"))).alias("key")).distinct()
    # A place among all keys needs all keys in one order; there is one row a period, so one task holds them.
    return rows.ranked(keys, [], [P.period_order(F.col("key"))], "place")


@query("f20_labels_json", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def f20_labels_json(spark, d):
    return read(spark, d, "events").select("event_id", records.label(records.labels(F.col("props")), "k", "kk").alias("k"))


@query("f25_url_host", "SELECT page_id, nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host, regexp_replace(url, '[?#].*$', '') AS bare FROM pages")
def f25_url_host(spark, d):
    return read(spark, d, "pages").select("page_id", records.url_host(F.col("url")).alias("host"), records.bare_url(F.col("url")).alias("bare"))


_LIKE = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query("f28_classify", f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END || ' ') AS t, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS a FROM documents)
  SELECT doc_id, CASE WHEN {_LIKE(fixed.NON_MUSIC_WORDS)} AND {_LIKE(fixed.VERSUS_WORDS)} THEN '{fixed.OTHER}' WHEN {_LIKE(fixed.BASEBALL_WORDS)} THEN '{fixed.BASEBALL}'
    WHEN {_LIKE(fixed.TEAM_WORDS)} AND {_LIKE(fixed.VERSUS_WORDS)} THEN '{fixed.BASEBALL}' WHEN {_LIKE(fixed.NON_MUSIC_WORDS)} AND (a = '' OR NOT {_LIKE(fixed.CONCERT_WORDS)}) THEN '{fixed.OTHER}'
    WHEN a <> '' OR {_LIKE(fixed.CONCERT_WORDS)} THEN '{fixed.CONCERT}' ELSE '{fixed.OTHER}' END AS category FROM x""")  # fmt: skip
def f28_classify(spark, d):
    artist = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("")
    return read(spark, d, "documents").select("doc_id", classify.event_category(F.col("text"), artist, F.lit("")).alias("category"))


@query("f31_spend_bucket", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '宿泊' WHEN p_partkey % 6 = 1 THEN '飲食' WHEN p_partkey % 6 = 2 THEN '交通' WHEN p_partkey % 6 = 3 THEN '買物' WHEN p_partkey % 6 = 4 THEN '娯楽' ELSE 'その他' END AS bucket FROM part""")
def f31_spend_bucket(spark, d):
    items = F.array(*map(F.lit, ("宿泊費", "飲食費", "タクシー", "化粧品・菓子", "美術館", "通信費")))
    return read(spark, d, "part").select("p_partkey", classify.spend_bucket(F.get(items, (F.col("p_partkey") % 6).cast("int"))).alias("bucket"))


@query("f33_text_quality", "SELECT doc_id, contains(text, chr(65533)) AS broken FROM documents")
def f33_text_quality(spark, d):
    return read(spark, d, "documents").select("doc_id", T.forbidden(F.col("text")).alias("broken"))


@query("f34_snippet", "SELECT doc_id, CASE WHEN length(text) > 180 THEN rtrim(substr(text, 1, 179)) || '…' ELSE text END AS snippet FROM documents")
def f34_snippet(spark, d):
    return read(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("f43_date_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%Y-%m-%d') || ' ～ ' || strftime(l_shipdate + INTERVAL 2 DAY, '%Y-%m-%d') END AS label FROM lineitem")
def f43_date_label(spark, d):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    later = F.when(F.col("l_linenumber") == 1, day).otherwise(F.date_format(F.date_add("l_shipdate", 2), "yyyy-MM-dd"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", records.date_label(day, later).alias("label"))


def _names(spark, d) -> list[tuple[str, list[str]]]:
    return [(w, []) for w in ("thing", "tion the", "ening", "erand")]


@query("x06_inference")
def x06_inference(spark, d):
    found = matching.infer_artists(read(spark, d, "benchmark"), _names(spark, d), "item_id", "text", "text")
    return found.select(F.col("uid").alias("item_id"), F.col("inferred.artist").alias("artist"), F.col("inferred.confidence").alias("confidence"))


@query("j11_lookup")
def j11_lookup(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.concat(F.lit("【new】"), F.initcap("p_name"), F.lit("（"), F.col("p_brand"), F.lit("）")).alias("raw"))
    entries = read(spark, d, "part").select(F.col("p_name").alias("canonical_name"), F.array("p_brand").alias("aliases"))
    return lookup.resolve_artists(part, "raw", lookup.name_keys(entries)).select("p_partkey", "artist", "artist_matched")


@query("s44_page_text")
def s44_page_text(spark, d):
    from tidemark.sources import feeds

    return feeds.page_text(read(spark, d, "pages")).select(F.col("key").cast("long").alias("page_id"), "title", F.length("text").cast("long").alias("n_chars"), "short", "error")

"""Resolution of not-modified revisits in web archives: an as-of join by canonical URL.

A revisit record stands for the body that the server did not send again. It is resolved to the latest full
response (status 200) of the same canonical URL that is strictly earlier; of responses at one time the one
with the greatest record id counts. The revisit's validators must agree with that response: its ETag (weak
comparison) if it has one, else its Last-Modified date. The resolved headers are the response's, updated by
those of the revisit's headers that a 304 may change.

The as-of join runs on distinct (URL, time) pairs in two levels: within a period of PERIOD seconds by a
window over (URL, period), and across periods by a window over one row for each (URL, period). So what one
task holds for a popular URL is bounded by the seconds in a period and by the number of periods, however
many records the URL has.

Result, one row for each revisit: ``outcome`` is resolved, validator_mismatch, no_validator (the revisit has
none) or no_response (no earlier full response, or a null URL or time); response columns are null for
no_response, merged headers are null unless resolved. Repeated rows are resolved each. Header names are
compared in lower case. An empty table gives an empty result. Columns beyond those named aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 86_400
#: The response headers that a 304 may update, and query parameters that name a campaign rather than a page.
MAY_CHANGE = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"


def canonical(url: Column) -> Column:
    """The URL without fragment, tracking parameters, default port, trailing slash and scheme, host in lower case."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), ":(80|443)$", ""))
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, f"([?&])(({TRACKING})(=[^&]*)?(&|$))+", "$1")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/$", ""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(F.element_at(headers, "etag")), "^W/", "")


def _entries(headers: Column) -> Column:
    return F.array_sort(F.map_entries(headers))


def resolve(records: DataFrame, period: int = PERIOD) -> DataFrame:
    """records: (record_id long, url string, ts long seconds, kind 'response' or 'revisit', status int,
    headers map with lower-case names, digest string, size long). Gives the columns named above:
    (record_id, canonical_url, ts, outcome, response_id, response_ts, digest, size, headers), headers as sorted
    "name: value" lines.
    """
    known = records.select("record_id", canonical(F.col("url")).alias("url"), "ts", "kind", "status", "headers", "digest", "size")
    full = known.where((F.col("kind") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("ts").isNotNull())
    body = F.struct("record_id", "ts", F.coalesce(_tag(F.col("headers")), F.lit("")).alias("tag"), F.coalesce(F.element_at("headers", "last-modified"), F.lit("")).alias("modified"), "digest", "size", _entries(F.col("headers")).alias("headers"))
    responses = full.groupBy("url", "ts").agg(F.max(body).alias("found"))
    revisits = known.where(F.col("kind") == "revisit")
    asked = revisits.where(F.col("url").isNotNull() & F.col("ts").isNotNull()).select("url", "ts").distinct()
    shape = responses.schema["found"].dataType
    events = responses.select("url", "ts", F.lit(1).alias("turn"), "found").union(asked.select("url", "ts", F.lit(0).alias("turn"), F.lit(None).cast(shape).alias("found")))
    events = events.withColumn("period", F.floor(F.col("ts") / period).cast("long"))
    latest = F.last("found", ignorenulls=True)
    within = Window.partitionBy("url", "period").orderBy("ts", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("url").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    ends = events.groupBy("url", "period").agg(F.max("found.ts").alias("last_ts"), F.max_by("found", F.coalesce(F.col("found.ts"), F.lit(-(1 << 62)))).alias("found"))
    carried = ends.select("url", "period", latest.over(before).alias("carried"))
    here = events.withColumn("here", latest.over(within)).where(F.col("turn") == 0).select("url", "ts", "period", "here")
    answers = here.join(carried, ["url", "period"], "left").select("url", "ts", F.coalesce("here", "carried").alias("found"))
    both = revisits.join(answers, ["url", "ts"], "left")
    tag, modified = _tag(F.col("headers")), F.element_at("headers", "last-modified")
    agrees = F.when(tag.isNotNull(), tag == F.col("found.tag")).otherwise(modified == F.col("found.modified"))
    outcome = F.when(F.col("found").isNull(), "no_response").when(tag.isNull() & modified.isNull(), "no_validator").when(agrees, "resolved").otherwise("validator_mismatch")
    news = F.filter(_entries(F.col("headers")), lambda e: e["key"].isin(*MAY_CHANGE))
    kept = F.filter(F.col("found.headers"), lambda e: ~F.array_contains(F.transform(news, lambda n: n["key"]), e["key"]))
    merged = F.array_join(F.transform(F.array_sort(F.concat(kept, news)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return both.select("record_id", F.col("url").alias("canonical_url"), "ts", outcome.alias("outcome"), F.col("found.record_id").alias("response_id"), F.col("found.ts").alias("response_ts"), F.col("found.digest").alias("digest"), F.col("found.size").alias("size"), F.when(outcome == "resolved", merged).alias("headers"))


#: Of the capture log below: first capture, seconds over which captures are spread, and how much later the revisit comes.
START, SPREAD, LATER = 1_704_067_200, 2_419_200, 1_209_600


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of pages(page_id, url, html): each page's full response, and a later revisit of it.

    The crawler sends the ETag of the body it has; every fifth revisit sends Last-Modified alone, every
    seventh an ETag that is out of date, and every eleventh response is an error, not a full response.
    """
    n = F.col("page_id")
    ts = F.lit(START) + F.pmod(n * 7919, F.lit(SPREAD))
    html = F.coalesce("html", F.lit(""))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    tag, modified = F.concat(F.lit('"'), F.md5(html), F.lit('"')), F.pmod(n, F.lit(97))
    first = F.map_from_entries(F.array(entry("cache-control", F.lit("max-age=60")), entry("content-type", F.lit("text/html; charset=utf-8")), entry("date", ts), entry("etag", tag), entry("last-modified", modified)))
    sent = F.when(n % 7 == 0, F.lit('"0"')).otherwise(F.concat(F.lit("W/"), tag))
    again = [entry("cache-control", F.lit("max-age=3600")), entry("content-length", F.lit("0")), entry("date", ts + LATER)]
    later = F.when(n % 5 == 0, F.map_from_entries(F.array(*again, entry("last-modified", modified)))).otherwise(F.map_from_entries(F.array(*again, entry("etag", sent))))
    one = F.struct(ts.alias("ts"), F.lit("response").alias("kind"), F.when(n % 11 == 0, 503).otherwise(200).alias("status"), first.alias("headers"), F.sha2(html, 256).alias("digest"), F.length(html).cast("long").alias("size"))
    two = F.struct((ts + LATER).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), later.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("size"))
    return pages.select(n.alias("record_id"), "url", F.explode(F.array(one, two)).alias("r")).select("record_id", "url", "r.*")


ORACLE_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(html, '') AS html,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare,
         {START} + (page_id * 7919) % {SPREAD} AS ts
  FROM pages),
canon AS (
  SELECT page_id, html, ts, md5(html) AS tag, (page_id % 97)::VARCHAR AS modified,
         lower(regexp_replace(regexp_extract(bare, '^[^/?]*'), ':(80|443)$', '')) ||
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''),
           '([?&])(({TRACKING})(=[^&]*)?(&|$))+', '\\1', 'g'), '[?&]+$', ''), '/$', '') AS url
  FROM parts),
full_ AS (
  SELECT url, ts, max(page_id) AS page_id FROM canon WHERE page_id % 11 <> 0 GROUP BY url, ts),
resp AS (SELECT c.* FROM canon c JOIN full_ f ON c.url = f.url AND c.ts = f.ts AND c.page_id = f.page_id),
rev AS (SELECT page_id, url, ts + {LATER} AS ts, tag, modified FROM canon),
near AS (
  SELECT v.page_id, v.url, v.ts, r.page_id AS response_id, r.ts AS response_ts, r.html, r.tag AS rtag,
         CASE WHEN r.page_id IS NULL THEN 'no_response'
              WHEN v.page_id % 5 = 0 THEN CASE WHEN v.modified = r.modified THEN 'resolved' ELSE 'validator_mismatch' END
              WHEN v.page_id % 7 = 0 THEN 'validator_mismatch'
              WHEN v.tag = r.tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
         r.modified AS rmodified
  FROM rev v ASOF LEFT JOIN resp r ON v.url = r.url AND v.ts > r.ts)
SELECT page_id, url AS canonical_url, ts, outcome, response_id, response_ts,
       CASE WHEN response_id IS NOT NULL THEN sha256(html) END AS payload_sha256,
       CASE WHEN response_id IS NOT NULL THEN length(html) END AS n_chars,
       CASE WHEN outcome = 'resolved' THEN
         'cache-control: max-age=3600' || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) ||
         'date: ' || ts || chr(10) ||
         'etag: ' || CASE WHEN page_id % 5 = 0 THEN '' ELSE 'W/' END || '"' || rtag || '"' || chr(10) ||
         'last-modified: ' || rmodified END AS headers
FROM near
"""

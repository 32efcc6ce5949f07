"""Events and articles in web formats: JSON-LD, calendars, feeds, sitemaps, links and page text [S30 S31 S33-S35 S39-S41 S44 X01 E06].

A parser is a plain function from (text, where it comes from) to rows. ``parsed`` runs one over a column of
documents in Arrow batches; a document that can't be parsed gives an error row instead of failing the others.
"""

from __future__ import annotations

import gzip
import html
import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_FIELDS = ("title", "start_date", "start_time", "end_date", "end_time", "all_day", "status", "url", "description", "performers", "source_event_key")
STATUSES = {"eventscheduled": "scheduled", "eventcancelled": "cancelled", "eventpostponed": "postponed", "eventrescheduled": "scheduled", "confirmed": "scheduled", "tentative": "unknown", "cancelled": "cancelled"}
MIN_TEXT = 500


def _event(**fields) -> dict:
    return {k: fields.get(k) for k in EVENT_FIELDS}


def split_stamp(value: str | None) -> tuple[str | None, str | None]:
    """(YYYY-MM-DD, HH:MM) of an ISO date or time as written; nulls for what isn't there."""
    m = re.match(r"(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2}))?", value or "")
    return (f"{m[1]}-{m[2]}-{m[3]}", f"{m[4]}:{m[5]}" if m[4] else None) if m else (None, None)


class _Scripts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.inside, self.found = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "script" and (dict(attrs).get("type") or "").lower() == "application/ld+json":
            self.inside = True
            self.found.append("")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "script"

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


def _walk(x) -> Iterator[dict]:
    stack = [x]
    while stack:
        at = stack.pop()
        if isinstance(at, list):
            stack += reversed(at)
        elif isinstance(at, dict):
            kinds = at.get("@type")
            if any(str(k).endswith("Event") or k == "Festival" for k in (kinds if isinstance(kinds, list) else [kinds])):
                yield at
            if "@graph" in at:
                stack.append(at["@graph"])


def jsonld_events(text: str, base: str = "") -> list[dict]:
    """Events in the JSON-LD scripts of a page, also in lists and graphs; broken scripts are passed over."""
    page, made = _Scripts(), []
    page.feed(text or "")
    for script in page.found:
        try:
            data = json.loads(script)
        except ValueError:
            continue
        for e in _walk(data):
            (start, at), (end, until) = split_stamp(e.get("startDate")), split_stamp(e.get("endDate"))
            if not e.get("name") or not start:
                continue
            people = e.get("performer") or []
            names = [p.get("name") if isinstance(p, dict) else str(p) for p in (people if isinstance(people, list) else [people])]
            url = e.get("url")
            made.append(_event(title=html.unescape(str(e["name"])).strip(), start_date=start, start_time=at, end_date=end or start, end_time=until, all_day=at is None, status=STATUSES.get(str(e.get("eventStatus") or "").rsplit("/", 1)[-1].lower(), "scheduled"), url=urljoin(base, url) if url else None, description=e.get("description"), performers=", ".join(n for n in names if n) or None, source_event_key=e.get("@id") or url))
    return made


def ics_events(text: str, base: str = "") -> list[dict]:
    """VEVENT blocks of a calendar; folded lines are joined, escapes undone."""
    lines = re.sub(r"\r?\n[ \t]", "", text or "").splitlines()
    made, fields = [], None
    plain = lambda v: re.sub(r"\\([,;\\nN])", lambda m: "\n" if m[1] in "nN" else m[1], v)
    for line in lines:
        if line.strip() == "BEGIN:VEVENT":
            fields = {}
        elif line.strip() == "END:VEVENT" and fields is not None:
            (start, at), (end, until) = split_stamp(fields.get("DTSTART")), split_stamp(fields.get("DTEND"))
            if start and fields.get("SUMMARY"):
                made.append(_event(title=plain(fields["SUMMARY"]).strip(), start_date=start, start_time=at, end_date=end or start, end_time=until, all_day=at is None, status=STATUSES.get(fields.get("STATUS", "").lower(), "scheduled"), url=fields.get("URL"), description=plain(fields["DESCRIPTION"]) if "DESCRIPTION" in fields else None, source_event_key=fields.get("UID")))
            fields = None
        elif fields is not None and ":" in line:
            name, value = line.split(":", 1)
            fields.setdefault(name.split(";")[0].upper(), value.strip())
    return made


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _child(node, *names: str) -> str | None:
    for c in node:
        if _local(c.tag) in names:
            return (c.get("href") if _local(c.tag) == "link" and c.get("href") else c.text or "").strip() or None
    return None


def utc_text(value: str | None) -> str | None:
    """UTC text of an RFC 822 or ISO time; null if it is neither."""
    from email.utils import parsedate_to_datetime

    for parse in (lambda v: datetime.fromisoformat(v.replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            t = parse(value)
        except (ValueError, TypeError, AttributeError):
            continue
        return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return None


def feed_items(text: str, base: str = "") -> list[dict]:
    """Items of RSS and entries of Atom: title, url, published_at_utc, summary, key."""
    made = []
    for node in ElementTree.fromstring(text).iter():
        if _local(node.tag) in ("item", "entry"):
            url = _child(node, "link")
            made.append({"title": html.unescape(_child(node, "title") or ""), "url": urljoin(base, url) if url else None, "published_at_utc": utc_text(_child(node, "pubdate", "published", "updated", "date")), "summary": _child(node, "description", "summary", "content"), "key": _child(node, "guid", "id") or url})
    return [x for x in made if x["title"]]


def sitemap_entries(content: bytes | str) -> list[dict]:
    """Entries of a sitemap or of an index of sitemaps, plain or gzip: kind, url, lastmod, and of news published_at_utc and title."""
    raw = content.encode() if isinstance(content, str) else content
    root = ElementTree.fromstring(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
    made = []
    for node in root:
        kind = _local(node.tag)
        if kind not in ("url", "sitemap"):
            continue
        inner = {_local(x.tag): (x.text or "").strip() for x in node.iter()}
        if inner.get("loc"):
            made.append({"kind": kind, "url": inner["loc"], "lastmod": inner.get("lastmod"), "published_at_utc": utc_text(inner.get("publication_date")), "title": inner.get("title")})
    return made


class _Page(HTMLParser):
    """Text, title and links of a page, without scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts, self.links, self.title, self.in_title = 0, [], [], "", False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")
        self.in_title = self.in_title or tag == "title"
        if tag == "a" and dict(attrs).get("href"):
            self.links.append([dict(attrs)["href"], ""])
        if tag in ("p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "section", "article", "td", "th"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0
        self.in_title = self.in_title and tag != "title"
        if tag == "a" and self.links:
            self.links.append(["", ""])

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts.append(data)
            if self.links and self.links[-1][0]:
                self.links[-1][1] += data


def page(text: str, base: str = "") -> dict:
    """title, text (a line a block) and links [(url, text)] of a page; ``short`` if there is too little text to rely on."""
    p = _Page()
    p.feed(text or "")
    lines = [" ".join(x.split()) for x in "".join(p.parts).split("\n")]
    body = "\n".join(x for x in lines if x)
    return {"title": " ".join(p.title.split()), "text": body, "links": [(urljoin(base, u), " ".join(t.split())) for u, t in p.links if u], "short": len(body) < MIN_TEXT}


def choose_link(text: str, base: str, extension: str = ".xlsx", named: str | None = None, worded: tuple[str, ...] = ()) -> str | None:
    """The first link to such a file whose name has ``named``, else whose text has one of the words, else the first."""
    links = [(u, t) for u, t in page(text, base)["links"] if re.sub(r"[?#].*$", "", u).lower().endswith(extension)]
    by_name = [u for u, _ in links if named and named in u.rsplit("/", 1)[-1]]
    by_word = [u for u, t in links if any(w in t for w in worded)]
    return next(iter([*by_name, *by_word, *(u for u, _ in links)]), None)


def filtered_links(text: str, base: str, extension: str = "", words: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Links with the extension whose text has all of the words, without repetition."""
    found = [(u, t) for u, t in page(text, base)["links"] if u.lower().endswith(extension) and all(w in t for w in words)]
    return list(dict.fromkeys(found))


def confirmed_events(text: str, accepted: tuple[str, ...]) -> list[dict]:
    """Events of a configuration of confirmed ones, of the accepted source classes, with all they need, scored by confidence."""
    from tidemark.functions.fixed import CONFIDENCE_SCORES

    made = []
    for e in (json.loads(text) or {}).get("events", []):
        if e.get("source_class") in accepted and all(str(e.get(k) or "").strip() for k in ("event_start_date", "venue_name", "artist_name", "evidence_url")):
            made.append({"event_start_date": e["event_start_date"], "event_end_date": e.get("event_end_date") or e["event_start_date"], "venue_name": e["venue_name"], "artist_name": e["artist_name"], "source_class": e["source_class"], "evidence_url": e["evidence_url"], "score": CONFIDENCE_SCORES.get(e.get("confidence"), CONFIDENCE_SCORES["low"])})
    return made


_TYPES = {"all_day": pa.bool_(), "score": pa.int32(), "short": pa.bool_()}


def parsed(documents: DataFrame, parser: Callable, fields: tuple[str, ...], key: str, text: str, base: str | None = None) -> DataFrame:
    """(key, *fields, error) of the rows that parser(text, base) gives for each document; an error row where it fails."""
    kinds = [_TYPES.get(f, pa.string()) for f in fields]
    spark_names = {pa.bool_(): "boolean", pa.int32(): "int", pa.string(): "string"}
    schema = ", ".join(["key string", *(f"`{f}` {spark_names[k]}" for f, k in zip(fields, kinds)), "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, b in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    made = parser(t, b) if base is not None else parser(t)
                    rows += [(k, *(r.get(f) for f in fields), None) for r in (made if isinstance(made, list) else [made])]
                except Exception as x:  # one bad document mustn't take the others with it
                    rows.append((k, *(None for _ in fields), f"{type(x).__name__}: {x}"[:500]))
            columns = list(zip(*rows)) if rows else [()] * (len(fields) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *kinds, pa.string()])], names=["key", *fields, "error"])

    slim = documents.select(F.col(key).cast("string"), F.col(text), (F.col(base) if base is not None else F.lit(None)).cast("string").alias("__base"))
    return slim.mapInArrow(run, schema)


def page_text(spark_pages: DataFrame, key: str = "page_id", text: str = "html", base: str = "url") -> DataFrame:
    """(key, title, text, short, error) of a table of pages [S44]."""
    return parsed(spark_pages, page, ("title", "text", "short"), key, text, base)

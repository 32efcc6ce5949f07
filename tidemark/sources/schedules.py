"""Schedules of venues in pages and in the text of printed calendars, by declared rules [S32 S42 X03].

A schedule page is read as blocks of text; a rule set says what opens an event, how its date, time and title
are found, and what is left out. Rule sets are data, so a venue's is a few lines, registered by name.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.feeds import EVENT_FIELDS, _event, page

_TIME = re.compile(r"(?<!\d)([01]?\d|2[0-3])\s*[:：時]\s*([0-5]\d)?(?!\d)")
_FULL = re.compile(r"(20\d{2})\s*[./年-]\s*(\d{1,2})\s*[./月-]\s*(\d{1,2})")
_SHORT = re.compile(r"(?<!\d)(\d{1,2})\s*[./月]\s*(\d{1,2})(?!\d)\s*日?")
_MONTH = re.compile(r"(20\d{2})\s*[年./-]\s*(\d{1,2})\s*月?\s*$")


@dataclass(frozen=True)
class Rules:
    """carry: a date holds for the lines after it. start: a time after this word is preferred. skip: titles left out.
    only: words of which a line must have one. ahead: a month this much before the reference month means next year."""

    carry: bool = True
    start: str = r"開演|START"
    skip: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    ahead: int = 6
    first_day_only: bool = False


SCHEDULES: dict[str, Rules] = {
    "generic": Rules(),
    "first_day": Rules(first_day_only=True),
    "stadium": Rules(skip=("休館日", "予約不可", "貸切", "未定")),
    "private_hidden": Rules(skip=("PRIVATE", "関係者のみ")),
}
#: The strategies that venues name in their configuration, by the rule set that reads their pages.
STRATEGIES: dict[str, str] = {
    name: rules
    for rules, names in {
        "generic": (
            "tif_calendar", "zepp_schedule", "saitama_arena_schedule", "tokyo_dome_calendar", "vantelin_dome_schedule", "belluna_dome_schedule", "makuhari_messe_schedule", "k_arena_yokohama_schedule",
            "sapporo_dome_schedule", "fukuoka_paypay_dome_schedule", "zozo_marine_stadium_schedule", "portmesse_nagoya_events", "asue_arena_osaka_events", "nissan_stadium_calendar", "mufg_stadium_schedule",
            "marine_messe_fukuoka_event", "osaka_jo_hall_schedule", "festival_hall_schedule", "ariake_arena_schedule", "yoyogi_gymnasium_schedule", "garden_theater_schedule", "tdc_hall_schedule",
            "kyocera_dome_schedule", "toyosu_pit_schedule",
        ),
        "stadium": ("panasonic_stadium_suita_schedule",),
        "private_hidden": ("pia_arena_mm_schedule",),
    }.items()
    for name in names
}


def strict_text(raw: bytes) -> str:
    """UTF-8 text, or ValueError: a wrongly decoded page must not get any further."""
    try:
        return raw.decode("utf-8", errors="strict")
    except UnicodeDecodeError as x:
        raise ValueError(f"not UTF-8: {x}") from x


def time_in(text: str, rules: Rules) -> str | None:
    after = re.search(rf"(?:{rules.start})[^0-9]{{0,6}}(.*)", text, re.I)
    m = (after and _TIME.search(after[1])) or _TIME.search(text)
    return f"{int(m[1]):02d}:{int(m[2] or 0):02d}" if m else None


def _day(y: int, m: str, d: str) -> str | None:
    try:
        return date(y, int(m), int(d)).isoformat()
    except ValueError:
        return None


def dates_in(text: str, month: tuple[int, int] | None, as_of: str, rules: Rules) -> list[str]:
    """Dates of a line: full ones, else short ones in the year of the month heading or the one nearest ahead of as_of."""
    full = [x for m in _FULL.finditer(text) if (x := _day(int(m[1]), m[2], m[3]))]
    if full:
        return full
    found, today = [], date.fromisoformat(as_of)
    for m in _SHORT.finditer(text):
        year = month[0] if month else today.year + (int(m[1]) < today.month - rules.ahead)
        if x := _day(year, m[1], m[2]):
            found.append(x)
    return found


def schedule_events(text: str, as_of: str, rules: str | Rules = "generic") -> list[dict]:
    """Events of a schedule page in the order of the page, each date and title once."""
    r, month, days, made = SCHEDULES[rules] if isinstance(rules, str) else rules, None, [], {}
    for line in page(text)["text"].split("\n"):
        line = unicodedata.normalize("NFKC", line).strip()
        if heading := _MONTH.fullmatch(line):
            month = (int(heading[1]), int(heading[2]))
            continue
        found = dates_in(line, month, as_of, r)
        rest = line
        if found:
            days = found[:1] if r.first_day_only else found
            rest = re.sub(r"[（(][月火水木金土日祝・]+[）)]", "", _SHORT.sub("", _FULL.sub("", line))).strip(" -~〜～・、/")
        elif not r.carry:
            days = []
        title = re.sub(r"(?:開場|開演|OPEN|START)?\s*[:：]?\s*" + _TIME.pattern + r"\s*[~〜～]?\s*(?:開場|開演|OPEN|START)?", "", rest, flags=re.I).strip(" -~〜～・、/|")
        at = time_in(rest, r)
        if not title:
            if at and made and days:
                last = made[list(made)[-1]]
                last["start_time"] = last["start_time"] or at
            continue
        if not days or any(w in title for w in r.skip) or r.only and not any(w in line for w in r.only):
            continue
        made.setdefault((days[0], title), _event(title=title, start_date=days[0], end_date=days[-1], start_time=at, all_day=at is None, status="scheduled"))
    return list(made.values())


def two_column_schedule(text: str, year: int, month: int, width: int = 100) -> list[dict]:
    """Events of the left column of a printed calendar: a day, maybe a weekday, then the title."""
    made = []
    for line in text.splitlines():
        left = line[:width].split("   ")[0] if line[:1].strip() else line[:width].strip().split("   ")[0]
        m = re.match(r"\s*(\d{1,2})\s*(?:日)?\s*(?:[（(][月火水木金土日祝・]+[）)])?\s+(\S.*)$", left)
        if m and (day := _day(year, str(month), m[1])):
            made.append(_event(title=" ".join(m[2].split()), start_date=day, end_date=day, start_time=None, all_day=True, status="scheduled"))
    return made


def timed_schedule(text: str, year: int, month: int, venue: str) -> list[dict]:
    """Events at one venue in a printed calendar of several: rows that a time opens, below the day they belong to."""
    made, day = [], None
    for line in text.splitlines():
        if m := re.match(r"\s*(\d{1,2})\s*日?\s*[（(][月火水木金土日祝・]+[）)]", line):
            day = _day(year, str(month), m[1])
            line = line[m.end() :]
        m = re.match(rf"\s*([0-2]?\d[:：][0-5]\d)\s*[~〜～-]?\s*(?:[0-2]?\d[:：][0-5]\d)?\s+{re.escape(venue)}\s+(\S.*)$", line)
        if m and day:
            h, _, n = unicodedata.normalize("NFKC", m[1]).partition(":")
            made.append(_event(title=" ".join(m[2].split()), start_date=day, end_date=day, start_time=f"{int(h):02d}:{n}", all_day=False, status="scheduled"))
    return made


def month_range(as_of: str, months: int = 3) -> list[tuple[int, int]]:
    """The month of a date and those after it."""
    first, made = date.fromisoformat(as_of).replace(day=1), []
    for _ in range(months + 1):
        made.append((first.year, first.month))
        first = (first + timedelta(days=32)).replace(day=1)
    return made


def strategy_events(text: str, strategy: str | None, as_of: str, config: str | None = None) -> list[dict]:
    """Events of a venue's page by the strategy that its configuration names; none for a strategy that isn't known.
    A configuration may list words of which a line must have one, under allowed_place_keywords or allowed_categories."""
    if strategy not in STRATEGIES:
        return []
    told = json.loads(config) if config else {}
    only = tuple(told.get("allowed_place_keywords") or told.get("allowed_categories") or ())
    return schedule_events(text, as_of, replace(SCHEDULES[STRATEGIES[strategy]], only=only))


def venue_events(pages: DataFrame, as_of: str, venue: str = "venue_id", html: str = "html", strategy: str = "strategy", config: str = "config_json") -> DataFrame:
    """(venue_id, the fields of an event, error) of a table of venues' pages; a page that fails gives an error row [S32 E06]."""
    kinds = [pa.bool_() if f == "all_day" else pa.string() for f in EVENT_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, text, s, c in zip(*(x.to_pylist() for x in batch.columns)):
                try:
                    rows += [(v, *(e[f] for f in EVENT_FIELDS), None) for e in strategy_events(text, s, as_of, c)]
                except Exception as x:  # one venue's page mustn't take the others with it
                    rows.append((v, *(None for _ in EVENT_FIELDS), f"{type(x).__name__}: {x}"[:500]))
            columns = list(zip(*rows)) if rows else [()] * (len(EVENT_FIELDS) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *kinds, pa.string()])], names=["venue_id", *EVENT_FIELDS, "error"])

    schema = ", ".join(["venue_id string", *(f"{f} {'boolean' if f == 'all_day' else 'string'}" for f in EVENT_FIELDS), "error string"])
    return pages.select(F.col(venue).cast("string"), F.col(html), F.col(strategy), F.col(config)).mapInArrow(run, schema)

"""Artist names in titles, and the inference of an event's artist [J13 W13 X06 X07].

All aliases are sought at once by an Aho-Corasick automaton, built once for each worker from the dictionary,
which is small; titles stream through in Arrow batches. Without that library a regular scan gives the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed as V
from tidemark.functions.text import normal

_PLAIN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Match:
    artist: str
    alias: str
    mode: str
    position: int
    length: int
    canonical: bool

    @property
    def score(self) -> int:
        """Long and early matches win; the whole name, the plain form and (always true of a match) word ends add."""
        return self.length - self.position + 4 * (self.position == 0) + 12 * self.canonical + 8 * (self.mode == "keep") + 5


class AliasIndex:
    """Names and aliases in both key forms. Short plain keys aren't kept; entries are (artist, aliases)."""

    def __init__(self, entries: list[tuple[str, list[str]]]) -> None:
        self.keys: dict[str, dict[str, list[tuple[str, str, bool]]]] = {"keep": {}, "compact": {}}
        for artist, aliases in entries:
            for alias in dict.fromkeys([artist, *aliases]):
                for mode, kept in self.keys.items():
                    key = normal(alias, compact=mode == "compact")
                    if key and not (_PLAIN.fullmatch(key) and len(key) <= 2):
                        kept.setdefault(key, []).append((artist, alias, alias == artist))
        self.machines = {mode: self._machine(keys) for mode, keys in self.keys.items()}

    @staticmethod
    def _machine(keys):
        try:
            import ahocorasick
        except ImportError:
            return None
        made = ahocorasick.Automaton()
        for k in keys:
            made.add_word(k, k)
        if keys:
            made.make_automaton()
        return made

    def _places(self, mode: str, text: str) -> Iterator[tuple[str, int]]:
        keys, machine = self.keys[mode], self.machines[mode]
        if not keys:
            return
        if machine is not None:
            yield from ((k, end - len(k) + 1) for end, k in machine.iter(text))
            return
        for k in keys:
            at = text.find(k)
            while at >= 0:
                yield k, at
                at = text.find(k, at + 1)

    def matches(self, title: str | None) -> list[Match]:
        """All matches, keep before compact; keys that end words must, and don't overlap themselves."""
        found = []
        for mode in ("keep", "compact"):
            text = normal(title, compact=mode == "compact")
            last: dict[str, int] = {}
            places = sorted(self._places(mode, text), key=lambda p: (-len(p[0]), p[0], p[1]))
            for key, at in places:
                if _PLAIN.fullmatch(key) and (mode == "keep" or len(key) <= 4):
                    inside = (at and _PLAIN.fullmatch(text[at - 1])) or (text[at + len(key) : at + len(key) + 1] and _PLAIN.fullmatch(text[at + len(key)]))
                    if inside or at < last.get(key, 0):
                        continue
                    last[key] = at + len(key)
                found += [Match(artist, alias, mode, at, len(key), canonical) for artist, alias, canonical in self.keys[mode][key]]
        return found


def chosen(matches: list[Match]) -> tuple[Match | None, str]:
    """(best match, confidence): medium for a compact match, or if another artist is within two points; low for none."""
    if not matches:
        return None, "low"
    order = sorted(matches, key=lambda m: -m.score)
    close = len(order) > 1 and order[0].score - order[1].score <= 2 and order[0].artist != order[1].artist
    return order[0], "high" if order[0].mode == "keep" and not close else "medium"


_WEAK = frozenset(normal(x, compact=True) for x in (*V.AMBIGUOUS_ALIASES, *V.GENERIC_ALIASES))


def _valid(m: Match) -> bool:
    alias, artist = normal(m.alias, compact=True), normal(m.artist, compact=True)
    if len(alias) <= 1 or alias in V.AMBIGUOUS_SIGNS or alias in _WEAK or _PLAIN.fullmatch(alias) and len(alias) <= 2:
        return False
    return not (len(artist) == 1 and len(alias) <= 2)


def _best(text: str, index: AliasIndex) -> tuple[Match, str] | None:
    valid = [m for m in index.matches(text) if _valid(m)]
    best, confidence = chosen(valid)
    if best is None or confidence == "low":
        return None
    if confidence == "medium" and not any(m.artist == best.artist and m.position == 0 and m.length >= 4 for m in valid):
        return None
    return best, confidence


def _musical(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in V.MUSIC_HINTS) and not any(w in low for w in V.NON_MUSIC_EXCLUDES)


def infer(title: str | None, description: str | None, index: AliasIndex) -> tuple[str, str, str, str] | None:
    """(artist, confidence, alias, field) of an event, or None."""
    title, description = title or "", description or ""
    found = _best(title, index)
    if found:
        m, confidence = found
        key, name = normal(title, compact=True), normal(m.artist, compact=True)
        excluded = any(w in title.lower() for w in V.NON_MUSIC_EXCLUDES)
        if _musical(title) or key in (name, normal(m.alias, compact=True)) or confidence == "high" and not excluded and len(name) >= 4 and key.startswith(name):
            return m.artist, confidence, m.alias, "title"
    if _musical(title) or _musical(description):
        for field, text in (("description", description), ("title+description", f"{title} {description}".strip())):
            found = _best(text, index) if text else None
            if found:
                return found[0].artist, found[1], found[0].alias, field
    return None


_MATCH = pa.list_(pa.struct([("artist", pa.string()), ("alias", pa.string()), ("mode", pa.string()), ("position", pa.int32()), ("length", pa.int32()), ("score", pa.int32())]))
_INFERRED = pa.struct([("artist", pa.string()), ("confidence", pa.string()), ("alias", pa.string()), ("field", pa.string())])


def entries_of(dictionary: DataFrame, limit: int = 1_000_000) -> list[tuple[str, list[str]]]:
    """The dictionary's entries for an index; fails beyond the limit rather than flood the driver."""
    rows = dictionary.select("canonical_name", "aliases").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a dictionary of more than {limit} entries can't be sent to every worker")
    return sorted((r["canonical_name"], list(r["aliases"] or [])) for r in rows)


def match_titles(df: DataFrame, title: str, entries: list[tuple[str, list[str]]]) -> DataFrame:
    """(title, matches) of the distinct titles [J13]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = AliasIndex(entries)
        for batch in batches:
            found = [[{"artist": m.artist, "alias": m.alias, "mode": m.mode, "position": m.position, "length": m.length, "score": m.score} for m in index.matches(t.as_py())] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _MATCH)], names=["title", "matches"])

    return df.select(F.col(title).cast("string").alias("title")).distinct().mapInArrow(run, "title string, matches array<struct<artist:string,alias:string,mode:string,position:int,length:int,score:int>>")


def infer_artists(df: DataFrame, entries: list[tuple[str, list[str]]], uid: str = "event_uid", title: str = "title", description: str = "description") -> DataFrame:
    """(uid, title, inferred) of every row; inferred is null where no artist is found [X06]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = AliasIndex(entries)
        for batch in batches:
            made = [infer(t.as_py(), d.as_py(), index) for t, d in zip(batch.column(1), batch.column(2))]
            rows = [m and dict(zip(("artist", "confidence", "alias", "field"), m)) for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, _INFERRED)], names=["uid", "title", "inferred"])

    slim = df.select(F.col(uid).cast("string").alias("uid"), F.col(title).cast("string").alias("title"), F.col(description).cast("string").alias("description"))
    return slim.mapInArrow(run, "uid string, title string, inferred struct<artist:string,confidence:string,alias:string,field:string>")

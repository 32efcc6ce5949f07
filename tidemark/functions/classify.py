"""Classifiers as column expressions [F19 F27-F32 F35 F36 F41 F42 P18 P32]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed as V


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text holds one of the words as it is; null text holds none."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return F.coalesce(found, F.lit(False))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words text holds."""
    return sum((F.coalesce(text.contains(w), F.lit(False)).cast("int") for w in words), F.lit(0))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def event_category(title: Column, artist: Column, description: Column, variant: str = "etl") -> Column:
    """Concert, baseball or other. Variant "app" lacks the first rule and the newer non-music words."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(artist, F.lit("")), F.coalesce(description, F.lit(""))))
    newer = variant == "etl"
    other_words = V.NON_MUSIC_WORDS if newer else tuple(w for w in V.NON_MUSIC_WORDS if w not in V.NON_MUSIC_NEWER)
    elsewhere, versus, concert = any_of(text, other_words), any_of(text, V.VERSUS_WORDS), any_of(text, V.CONCERT_WORDS)
    rules = [(elsewhere & versus, V.OTHER)] if newer else []
    rules += [
        (any_of(text, V.BASEBALL_WORDS) | any_of(text, V.TEAM_WORDS) & versus, V.BASEBALL),
        (elsewhere & (blank(artist) | ~concert), V.OTHER),
        (~blank(artist) | concert, V.CONCERT),
    ]
    made = F
    for condition, label in rules:
        made = made.when(condition, label)
    return made.otherwise(V.OTHER)


def resale_category(title: Column, artist: Column, info: Column, group: Column, slug: Column, explicit: Column | None = None) -> Column:
    """A given category, else by the site's group and slug, else by the title, with the artist only where the site says music."""
    group, slug = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (group, slug))
    music = group.isin(*V.RESALE_CONCERT_GROUPS) | any_of(slug, V.RESALE_CONCERT_SLUGS)
    by_site = F.when(any_of(group, V.RESALE_BASEBALL) | any_of(slug, V.RESALE_BASEBALL), V.BASEBALL).when(music, V.CONCERT)
    given = F.lit(None).cast("string") if explicit is None else label_category(explicit)
    return F.coalesce(given, by_site, event_category(title, F.when(music, artist).otherwise(""), info))


def label_category(value: Column) -> Column:
    """The category that a label names, in either language; null if it names none."""
    key = F.lower(F.trim(value))
    made = F.when(F.trim(value).isin(V.CONCERT, V.BASEBALL, V.OTHER), F.trim(value))
    for k, v in V.LABEL_CATEGORIES.items():
        made = made.when(key == k, v)
    return made


def signal_category(source: Column, *labels: Column) -> Column:
    """The first label that names a category, else the source's default, else other."""
    default = F.lit(None).cast("string")
    for k, v in V.SOURCE_CATEGORIES.items():
        default = F.when(source == k, v).otherwise(default)
    return F.coalesce(*(label_category(x) for x in labels), default, F.lit(V.OTHER))


def spend_bucket(item: Column) -> Column:
    made = F
    for bucket, words in V.SPEND_BUCKETS:
        made = made.when(any_of(item, words), bucket)
    return made.otherwise(V.OTHER_BUCKET)


def company_segment(header: Column) -> Column:
    """Segment of a travel-agency table's header."""
    t = F.regexp_replace(header, r"(?U)\s+", "")
    return F.when(t.contains("外国人旅行"), "foreign").when(t.contains("海外旅行"), "overseas").when(t.contains("国内旅行"), "domestic").when(t.contains("合計"), "total")


def nights_bin(value: Column) -> Column:
    t = F.regexp_replace(value, r"(?U)\s+", "")
    return F.when(t.contains("8泊") & t.contains("以上"), "8泊以上").when(t.rlike("^[1-7]泊"), F.substring(t, 1, 2))


def excludes(text: Column) -> Column:
    """How many exclude terms text holds, in any case of letters."""
    return hits(F.lower(text), tuple(w.lower() for w in V.NEWS_EXCLUDE))


def news_score(title: Column, snippet: Column) -> Column:
    """Relevance of a news article, 0 to 100."""
    text = F.concat_ws(" ", title, snippet)
    return F.greatest(F.lit(0), F.least(F.lit(100), 70 + 8 * hits(text, V.NEWS_INCLUDE) + 6 * hits(text, V.NEWS_LOCATIONS) - 10 * excludes(text)))


def event_candidate(title: Column, context: Column) -> Column:
    """Whether more include terms than exclude terms are there, and one at least."""
    text = F.concat_ws(" ", title, context)
    include = hits(text, V.NEWS_INCLUDE)
    return (include >= 1) & (include > excludes(text))


def tier_rank(tier: Column) -> Column:
    made = F
    for k, v in V.TIERS.items():
        made = made.when(F.coalesce(F.trim(tier), F.lit("")) == k, v)
    return made.otherwise(V.LAST_TIER)


def priority(source: Column) -> Column:
    made = F
    for k, v in V.SOURCE_PRIORITY.items():
        made = made.when(source == k, v)
    return made.otherwise(V.LAST_PRIORITY)


def tolerant_bool(value: Column, default: bool) -> Column:
    t = F.lower(F.trim(value.cast("string")))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False).otherwise(default)


def full_prefecture(value: Column) -> Column:
    """The full name of a prefecture given in full or without its suffix; null for others."""
    t = F.trim(value)
    made = F
    for name in V.PREFECTURES:
        short = name if name == "北海道" else name[:-1]
        made = made.when(t.isin(name, short), name)
    return made.otherwise(F.lit(None).cast("string"))


def bracketed_prefecture(text: Column) -> Column:
    """The first prefecture that stands in brackets."""
    return full_prefecture(F.nullif(F.regexp_extract(text, r"[［\[（(【]\s*([^\]］）)】]{2,4}?)\s*[\]］）)】]", 1), F.lit("")))


def is_japan(venue: Column, prefecture: Column) -> Column:
    """Whether an occurrence has a Japanese prefecture, or a place in its venue's name."""
    return full_prefecture(prefecture).isNotNull() | any_of(venue, V.NEWS_LOCATIONS) | any_of(venue, V.PREFECTURES)


def region(pref_code: Column) -> Column:
    code = pref_code.try_cast("int")
    made = F
    for name, (a, b) in V.REGIONS.items():
        made = made.when(code.between(a, b), name)
    return made.otherwise(F.lit(None).cast("string"))


def title_excluded(title: Column, words: tuple[str, ...]) -> Column:
    return any_of(F.lower(title), tuple(w.lower() for w in words))

"""Text normalisation and checks [F01 F02 F04-F09 F33 F34].

Spark has no Unicode normalisation, so what needs NFKC or case folding runs in Arrow UDFs, a batch at a time.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DataType, StringType

from tidemark.functions import fixed as V

# The forms that names are normalised by.
_DASHES = re.compile("[‐–—―ー−]")
_LEADING = re.compile(r"\s*(?:【[^】]*】|\[[^\]]*\]|［[^］]*］|＜[^＞]*＞|<[^>]*>|\([^)]*\))\s*")
_PUNCTUATION = re.compile(r"[\s\-_/.,()\[\]{}<>【】［］＜＞'\"`]+")
_SPACES = re.compile(r"\s+")
_MARKERS = re.compile(r"^[\s　○〇●•・◆■□▲△▽▼▶▷►→※＊*]+")
_LABEL = re.compile(r"^(?:会場名?|場所|venue)\s*[:：_\-]\s*", re.I)
_SEPARATOR = re.compile(r"\s*[・/／|｜]\s*")
_TAIL = re.compile(r"(?:\s*[（(][^()（）]{1,20}[）)]\s*)+$")
_TAGS = re.compile(r"<[^>]+>")


def normal(text: str | None, compact: bool = False) -> str:
    """The key form of a name: NFKC, lower case, one kind of dash, up to eight leading bracket groups gone, single spaces;
    compact: no punctuation or spaces either."""
    t = unicodedata.normalize("NFKC", text or "").lower().replace("＆", "&")
    t = _DASHES.sub("-", t).strip()
    for _ in range(8):
        m = _LEADING.match(t)
        if not m or not m.end():
            break
        t = t[m.end() :]
    t = _SPACES.sub(" ", t).strip()
    return _PUNCTUATION.sub("", t) if compact else t


def key_part(text: str | None) -> str:
    return _SPACES.sub("", unicodedata.normalize("NFKC", text or "").casefold())


def comparable(text: str | None) -> str:
    return _SPACES.sub(" ", unicodedata.normalize("NFKC", text or "").lower()).strip()


def without_tail(text: str) -> str:
    """Without trailing parentheticals of up to 20 characters."""
    return _TAIL.sub("", " ".join(text.split())).strip()


def artist_candidates(text: str | None, base: bool = True) -> list[str]:
    """What to look an artist up by, in order."""
    t = " ".join(_TAGS.sub(" ", text or "").split())
    made = [t, without_tail(t)] if base else [t]
    return [x for x in dict.fromkeys(made) if x]


def venue_candidates(text: str | None) -> list[str]:
    """What to look a venue up by: breadth first from the whole text, taking off markers and labels, tails, and what stands before the first separator."""
    queue, seen = [" ".join(_TAGS.sub(" ", text or "").split())], []
    for t in queue:  # grows as it is read
        t = t.strip()
        if not t or t in seen:
            continue
        seen.append(t)
        bare = _LABEL.sub("", _MARKERS.sub("", t).strip()).strip()
        parts = _SEPARATOR.split(" ".join((bare or t).split()), maxsplit=1)
        after = parts[1].strip() if len(parts) == 2 else ""
        queue += [x for x in (bare, without_tail(bare or t), after, without_tail(after)) if x and x != t]
    return seen


#: What no text may hold. Control signs but tab and line ends, the replacement sign, lone surrogates, non-characters.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffd\ud800-\udfff\ufffe\uffff]")
#: Kana and Han signs.
_JAPANESE = re.compile("[\u3040-\u30ff\u3400-\u9fff]")


def japanese(text: str) -> int:
    return len(_JAPANESE.findall(text))


def reread(text: str, codec: str) -> str:
    """The text that was meant if UTF-8 was read in another encoding; nothing if that can't be."""
    return text.encode(codec, "replace").decode("utf-8", "replace") if _whole(text, codec) else ""


def _whole(text: str, codec: str) -> bool:
    try:
        text.encode(codec).decode("utf-8")
    except UnicodeError:
        return False
    return True


def quality_issue(text: str | None) -> str | None:
    """Why a text can't be right: forbidden code points, or UTF-8 that was read in another encoding, which shows in
    at least four Japanese signs more when it is read again; null if nothing is wrong."""
    if not text or _FORBIDDEN.search(text):
        return "forbidden_unicode_codepoint" if text else None
    gained = max((japanese(reread(text, codec)) for codec in V.MOJIBAKE_CODECS), default=0) - japanese(text)
    return "probable_utf8_mojibake" if gained >= 4 else None


def _strings(name: str, f, kind: DataType = StringType()):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action=None)

    run.__name__ = name
    return pandas_udf(run, kind)


keep_key = _strings("keep_key", lambda x: normal(x))
compact_key = _strings("compact_key", lambda x: normal(x, compact=True))
key_part_udf = _strings("key_part", key_part)
comparable_udf = _strings("comparable", comparable)
artist_candidates_udf = _strings("artist_candidates", artist_candidates, ArrayType(StringType()))
venue_candidates_udf = _strings("venue_candidates", venue_candidates, ArrayType(StringType()))
quality_issue_udf = _strings("quality_issue", quality_issue)


def stripped_tags(c: Column) -> Column:
    """Without markup, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "))


def without_white(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def without_tail_column(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"(\s*[（(][^()（）]{1,20}[）)]\s*)+$", ""))


def split_names(c: Column) -> Column:
    """Distinct names of a list written with slashes, commas, ampersands or line breaks, in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[/／、,\n&]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def snippet(c: Column, length: int = 180) -> Column:
    """At most length characters, ended by an ellipsis if cut."""
    return F.when(F.length(c) > length, F.concat(F.rtrim(F.substring(c, 1, length - 1)), F.lit("…"))).otherwise(c)


def forbidden(c: Column) -> Column:
    """The part of the text check that needs no decoding: replacement, non-characters and controls."""
    return F.coalesce(c.rlike("[�￾￿\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"), F.lit(False))


def require_clean(df, columns: tuple[str, ...], context: str):
    """df, failing the query on the first row with a broken text in one of columns, before anything is written."""
    issues = [F.concat(F.lit(c + "="), quality_issue_udf(F.col(c))) for c in columns]
    found = F.concat_ws(", ", *issues)
    checked = df.withColumn("__issues", found)
    fails = F.when(F.col("__issues") != "", F.raise_error(F.concat(F.lit(context + ": "), F.col("__issues")))).otherwise(F.lit(None))
    return checked.where(F.coalesce(fails.cast("string"), F.lit("")) == "").drop("__issues")

"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier learns from their votes.

Four base kinds are found by pattern and validity check (see ``base_spans``); they are always reported. For
what patterns alone can't settle (telephone numbers without a country code, national identity numbers, bank
account numbers, spelled-out e-mail addresses, personal names, keys and tokens) broad patterns propose candidates.
Regular-expression, gazetteer and context labelers vote for or against each candidate, base ones included, or abstain.
Expectation-maximisation over the votes of the whole corpus estimates, for each kind, how often each labeler votes either
way on true and on false candidates, and how many are true; nothing but PRIOR_VOTES pseudo-candidates holds the
estimates. Its posteriors train a logistic classifier on the votes, the kind and what the span and its edges look like
(FEATURES, which no labeler reads), and the classifier decides the candidates.

A candidate enters the estimation only through its kind, votes and features, each of a few values, so what is gathered
is one count for each pattern, whose number has a bound whatever the size of the corpus. A text is read whole, in time
in proportion to its length.

Cases: null text counts as empty; repeated rows are handled each; an empty corpus keeps the starting
reliabilities; spans are code points, end exclusive; added spans never overlap a base span or each other
(the earlier, then the longer one stays). Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "identity", "local_phone", "name", "secret", "spelled_email")
KINDS = BASE_KINDS + ADDED_KINDS
LABELERS = ("shape", "check", "gazetteer", "context_for", "context_against", "boundary")
#: How often a labeler is first taken to vote for, and against, a true candidate and a false one.
START = {"shape": (0.1, 0.1, 0.1, 0.5), "check": (0.8, 0.05, 0.2, 0.6), "gazetteer": (0.5, 0.02, 0.1, 0.1), "context_for": (0.5, 0.02, 0.1, 0.1), "context_against": (0.02, 0.05, 0.02, 0.3), "boundary": (0.02, 0.05, 0.02, 0.3)}
#: Length of the span, share of its digits, what stands before it, what stands after it.
FEATURES = 4
ITERATIONS, PRIOR_VOTES = 30, 10.0
SHARES = {k: 0.6 if k in BASE_KINDS else 0.5 for k in KINDS}
THRESHOLD = 0.6
AROUND = 48

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match always starts and ends with whole runs of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = {
    "identity": re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "local_phone": re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}
_AT = re.compile(r"\s?[\[(]at[\])]", re.I)
_REST = re.compile(r"\s?[A-Za-z0-9-]++(?:\s?(?:[\[(]dot[\])]|\.)\s?[A-Za-z0-9-]++)++", re.I)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
_TOLD_KEY = re.compile(r"(?<![A-Za-z])(?:api[ _-]?key|token|secret|password|passwd|pwd)\x20{0,3}[:=]\x20{0,3}[\"']?([!-&(-~]{8,200})", re.I)
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Señora")
_TITLED = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.?\x20([A-ZÀ-Ý][\w'-]+(?:\x20[A-ZÀ-Ý][\w'-]+){0,2})")
_TOLD = re.compile(r"(?<!\w)(?:my name is|mein Name ist|je m'appelle|me llamo|Name:|Nom:|Nombre:)\x20?([A-ZÀ-Ý][\w'-]+(?:\x20[A-ZÀ-Ý][\w'-]+){0,2})")
_TELLS = ("my name is", "mein Name ist", "je m'appelle", "me llamo", "Name:", "Nom:", "Nombre:")
#: Gazetteers: common first names of the four languages, top-level domains, and how known services' keys begin.
_FIRST_NAMES = frozenset(
    """Aaron Adam Adrian Agnès Alain Alan Albert Alejandro Alex Alexander Alfonso Alfred Alice Alicia Álvaro Amanda Amélie Amy Ana André Andrea
    Andreas Andrew Ángel Anna Anne Anthony Antoine Antonio Arthur Ashley Barbara Beatriz Ben Bernard Bernd Birgit Brian Brigitte Camille Carla
    Carlos Carmen Carol Caroline Catherine Cécile Charles Charlotte Christian Christine Christoph Claire Clara Claude Claudia Cristina Daniel
    David Deborah Dennis Diana Diego Dieter Dominique Donald Dorothy Edward Elena Elizabeth Emily Emma Enrique Eric Erik Ernst Esther Eva
    Fernando François Frank Franz Friedrich Gabriel Gabriele George Gérard Gerhard Gloria Greta Guillaume Günter Hannah Hans Heinz Helen Helga
    Henri Henry Hugo Ingrid Irene Isabel Isabelle Jack Jacob Jacques James Jan Jane Javier Jean Jennifer Jessica Joan Johann Johannes John Jorge
    José Joseph Juan Julia Julie Julien Jürgen Karen Karin Karl Katharina Kevin Klaus Laura Léa Linda Lisa Louis Louise Lucas Lucía Luis Lukas
    Manuel Marc Marcel Margaret María Maria Marie Mario Mark Marta Martin Mary Mathieu Matthew Max Michael Michel Miguel Monika Nancy Nathalie
    Nicolas Olivier Oscar Pablo Patricia Patrick Paul Pedro Peter Philippe Pierre Rachel Ralf Raúl Rebecca Richard Robert Rosa Sandra Sara Sarah
    Sergio Sofía Sophie Stefan Susan Sylvie Teresa Thomas Ursula Valérie Werner William Wolfgang Yves""".split()
)
_DOMAINS = frozenset(
    """ac app ar at au be biz br ca cat cc ch cl cloud cn co com cz de dev dk edu es eu example fi fr gov gr hk hu id ie il in info int invalid io
    is it jp kr lt lu lv me mil mobi mx museum name net nl no nz org pe ph pl pro pt ro ru se sg shop si site sk store test th tr tv tw ua uk
    us uy ve vn xyz za""".split()
)
_KEY_STARTS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "SG.", "npm_", "hf_", "ya29.")
_CUES = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "anruf", "appel"),
    "local_phone": ("tel", "phone", "call", "fax", "mobile"),
    "identity": ("ssn", "social security", "identity", "id no"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "name": ("name", "dear", "signed", "sincerely", "contact"),
    "spelled_email": ("mail", "contact", "write"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"),
}
_AGAINST = ("isbn", "issn", "version", "page ", "figure", "chapter", "section", "invoice", "order no", "serial", "price", "license", "licence", "commit", "checksum", "sha1", "sha256", "md5", "digest", "uuid")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _iban(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Just the matches of _EMAIL, found from their @ signs: a run of local characters is never scanned twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Spelled-out addresses, found from their at signs as _emails finds its own."""
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        rest = _REST.match(text, m.end()) if start < m.start() else None
        if rest:
            yield start, rest.end()
            done = rest.end()


def _keys(text: str) -> Iterator[tuple[int, int, bool]]:
    """Long words of keys' signs with a digit among letters, and what is told as a key; whether each looks random."""
    seen = set()
    for m in _TOLD_KEY.finditer(text):
        end = m.start(1) + len(m[1].rstrip("\"';,.!?)"))
        if end - m.start(1) >= 8:
            seen.add((m.start(1), end))
    for m in _KEY.finditer(text):
        if _DIGIT.search(m[0]) and not m[0].isdigit() and m[0].count("-") + m[0].count("/") <= len(m[0]) // 6:
            seen.add(m.span())
    for a, b in sorted(seen):
        signs = text[a:b]
        yield a, b, len(set(signs)) >= min(10, len(signs) // 2) and any(c in "0123456789" for c in signs)


def proposals(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether the kind's validity check holds) of all matches, failing ones included.

    Candidates of the added kinds that overlap a base span are left out: they are decided."""
    found = [("email", a, b, True) for a, b in _emails(text)]
    added = []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            found.append(("ip", *m.span(), all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split(".")))))
        for m in _CARD.finditer(text):
            if m.end() - m.start() > 7:  # shorter ones can't be cards and tell nothing
                digits = _digits(m[0])
                found.append(("card", *m.span(), 13 <= len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            found += [("phone", *m.span(), 9 <= len(_digits(m[0])) <= 15) for m in _PHONE.finditer(text)]
        for kind, pattern in _NUMBERS.items():
            for m in pattern.finditer(text):
                added.append((kind, *m.span(), _iban(m[0]) if kind == "iban" else m[0][:3] not in ("000", "666") if kind == "identity" else True))
        added += [("secret", *k) for k in _keys(text)]
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        added += [("spelled_email", *s, True) for s in _spelled(text)]
    if any(x in text for x in _TITLES):
        added += [("name", *m.span(1), True) for m in _TITLED.finditer(text)]
    if any(x in text for x in _TELLS):
        added += [("name", *m.span(1), True) for m in _TOLD.finditer(text)]
    if added:
        taken = _merged((a, b) for _, a, b, ok in found if ok)
        found += [c for c in added if _free(taken, c[1], c[2])]
    return found


def _merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends, ascending, of the union of spans."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _free(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether no span of a union overlaps [a, b)."""
    k = bisect_right(taken[1], a)
    return k == len(taken[0]) or taken[0][k] >= b


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    return _base(proposals(text or ""))


def _base(found: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int]]:
    return sorted(((k, a, b) for k, a, b, ok in found if ok and k in BASE_KINDS), key=lambda s: (KINDS.index(s[0]), s[1]))


def labels(text: str, kind: str, start: int, end: int, ok: bool) -> str:
    """The labelers' votes on a candidate, in the order of LABELERS: + for, - against, 0 abstains."""
    body, before = text[start:end], text[max(0, start - AROUND) : start].lower()
    near = before + " " + text[end : end + AROUND // 2].lower()
    digits = sum(c in "0123456789" for c in body)
    known = "0"
    if kind in ("email", "spelled_email"):
        shape = "0" if len(body) <= 254 and ".." not in body else "-"
        known = "+" if re.split(r"[^A-Za-z]+", body[-40:])[-1].lower() in _DOMAINS else "0"
    elif kind == "name":
        shape = "+" if " " in body else "0"
        known = "+" if body.split(" ")[0] in _FIRST_NAMES else "0"
    elif kind == "secret":
        mixed = any(c.isupper() for c in body) and any(c.islower() for c in body)
        shape = "+" if len(body) in (32, 40, 64) or mixed else "0" if len(body) <= 128 else "-"
        known = "+" if body.startswith(_KEY_STARTS) else "0"
    else:
        shape = "0" if {"ip": 7 <= len(body) <= 15, "card": digits in (15, 16), "phone": digits >= 10}.get(kind, True) else "-"
    check = ("+" if kind not in ("name", "local_phone") else "0") if ok else "-"
    cue = "+" if any(c in near for c in _CUES[kind]) else "0"
    against = "-" if any(c in before for c in _AGAINST) else "0"
    inside = (start and (text[start - 1].isalnum() or text[start - 1] in "._")) or (end < len(text) and text[end].isalnum())
    return shape + check + known + cue + against + ("-" if inside else "0")


def _edge(c: str) -> str:
    return "w" if not c or c.isspace() else "q" if c in "\"'`<>=:" else "a" if c.isalnum() else "p"


def features(text: str, start: int, end: int) -> str:
    """FEATURES signs of what a candidate and its edges look like."""
    n = end - start
    digits = sum(c in "0123456789" for c in text[start:end])
    size = "01234"[sum(n > most for most in (8, 16, 24, 48))]
    return size + ("0" if not digits else "3" if digits == n else "1" if 2 * digits < n else "2") + _edge(text[start - 1 : start] if start else "") + _edge(text[end : end + 1])


def candidates(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """The base spans, and (kind, start, end, votes and features) of every candidate."""
    text = text or ""
    found = proposals(text)
    return _base(found), [(k, a, b, labels(text, k, a, b, ok) + features(text, a, b)) for k, a, b, ok in found]


def posteriors(counts: dict[tuple[str, str], int]) -> tuple[dict[tuple[str, str], float], dict[str, np.ndarray], dict[str, float]]:
    """From how often each (kind, votes and features) occurs: the probability that such a candidate is true; for each kind
    how often each labeler votes for, against (last axis) a false and a true one (first axis); and the share that is true.

    Kinds are estimated each by itself: what a labeler is worth differs between them."""
    start = np.array([[START[x][2:] for x in LABELERS], [START[x][:2] for x in LABELERS]])
    made, every, shares = {}, {}, {}
    for kind in sorted({k for k, _ in counts}):
        keys = sorted(k for k in counts if k[0] == kind)
        n = np.array([counts[k] for k in keys], dtype=float)
        cast = np.array([[{"+": 0, "-": 1, "0": 2}[c] for c in v[: len(LABELERS)]] for _, v in keys])
        hit = np.stack([cast == 0, cast == 1], axis=-1).astype(float)
        rates, share = start, SHARES[kind]
        for _ in range(ITERATIONS):
            full = np.concatenate([rates, 1 - rates.sum(axis=2, keepdims=True)], axis=2).clip(1e-9)
            logs = np.log(full)[:, np.arange(len(LABELERS)), cast].sum(axis=2)  # (class, pattern)
            posterior = 1 / (1 + np.exp(np.clip(np.log(1 - share) - np.log(share) + logs[0] - logs[1], -700, 700)))
            weigh = np.stack([n * (1 - posterior), n * posterior])
            rates = (np.einsum("ck,klv->clv", weigh, hit) + PRIOR_VOTES * start) / (weigh.sum(axis=1) + PRIOR_VOTES)[:, None, None]
            share = float((weigh[1].sum() + PRIOR_VOTES * SHARES[kind]) / (n.sum() + PRIOR_VOTES))
        made |= zip(keys, posterior.tolist())
        every[kind], shares[kind] = rates, share
    return made, every, shares


def fit(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """The classifier's probability for each (kind, votes and features), from how often each occurs."""
    keys = sorted(counts)
    if not keys:
        return {}
    given = posteriors(counts)[0]
    n, told = np.array([counts[k] for k in keys], dtype=float), np.array([given[k] for k in keys])
    signs = [{(i, c): None for _, v in keys for i, c in enumerate(v)}, {k: None for k, _ in keys}]
    place = {x: i for i, x in enumerate([*signs[0], *signs[1]])}
    x = np.zeros((len(keys), len(place)))
    for r, (k, v) in enumerate(keys):
        x[r, [place[k], *(place[i, c] for i, c in enumerate(v))]] = 1
    weights, rate = np.zeros(x.shape[1]), np.sqrt(n) / np.sqrt(n).sum()  # a rare pattern is heard beside a common one
    for _ in range(500):
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= 2.0 * (x.T @ (rate * (p - told)) + 1e-4 * weights)
    return dict(zip(keys, (1 / (1 + np.exp(-x @ weights))).tolist()))


def chosen(base: list[tuple[str, int, int]], found: list[tuple[str, int, int, str]], accepted: frozenset[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """Base spans and the accepted ones of the added kinds that overlap neither them nor each other, in reporting order."""
    taken, last, added = _merged((a, b) for _, a, b in base), 0, []
    for k, a, b, v in sorted((c for c in found if c[0] in ADDED_KINDS and (c[0], c[3]) in accepted), key=lambda c: (c[1], -c[2])):
        if a >= last and _free(taken, a, b):
            last = b
            added.append((k, a, b))
    return base + sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string())])
_FOUND = "id long, base array<struct<kind:string,start:int,end:int,votes:string>>, found array<struct<kind:string,start:int,end:int,votes:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, found) of every row: its base spans, and all candidates with their votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for t in batch.column(1):
                b, f = candidates(t.as_py())
                base.append([{"kind": k, "start": x, "end": y, "votes": ""} for k, x, y in b])
                found.append([{"kind": k, "start": x, "end": y, "votes": v} for k, x, y, v in f])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_SPAN))], names=["id", "base", "found"])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).mapInArrow(run, _FOUND)


def train(scanned: DataFrame) -> frozenset[tuple[str, str]]:
    """The patterns that the classifier accepts. Gathers one count for each pattern."""
    seen = scanned.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    return frozenset(k for k, p in fit({(r["kind"], r["votes"]): r["count"] for r in seen}).items() if p >= THRESHOLD)


def report(scanned: DataFrame, accepted: frozenset[tuple[str, str]]) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                kinds = [s[0] for s in spans]
                every = chosen(spans, [(s["kind"], s["start"], s["end"], s["votes"]) for s in found], accepted)
                rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(_joined(spans).encode()).hexdigest(), _joined(every)))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return scanned.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the earlier is replaced and the rest of the later one too."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced, other columns as they are; the classifier is trained on all of docs first."""
    accepted = train(scan(docs.select(F.lit(0).alias("doc_id"), quoted(text_col).alias("text"))))
    schema, place = docs.schema, docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold dots, or clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else masked(t, chosen(*candidates(t), accepted)) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return plain.mapInArrow(run, plain.schema).toDF(*schema.names)

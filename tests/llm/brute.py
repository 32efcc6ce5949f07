"""Plain versions of the operators, written from their contracts, to hold the engine's results against."""

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(i, i + 5))
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": again, "n_repeat_words": len(inside), "base_failed": failed}


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def components(prints, bits=2):
    """{id: least id reachable}; prints: [(id, fingerprint)]."""
    parent = {f: f for _, f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    flips = [1 << i for i in range(64)]
    reach = flips + [a | b for i, a in enumerate(flips) for b in flips[:i]]
    for f in distinct:
        for m in reach:
            if f ^ m in parent:
                a, b = root(f), root(f ^ m)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, f in prints:
        least[root(f)] = min(i, least.get(root(f), i))
    return {i: least[root(f)] for i, f in prints}


def base_pii(text):
    text, found = text or "", []
    luhn = lambda s: sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(s[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    for kind, pattern, ok in rules:
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if ok(m)]
    return found


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licenses(text, templates, phrases, threshold):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words, places = LICENSE_WORD.findall(low), []
    for phrase, label in phrases.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    base, labels, score = {x for _, x in places}, set(), 1.0 if places else 0.0
    for label, t in templates:
        each = LICENSE_WORD.findall(t.lower())
        want, n = set(each), len(each)
        for start in range(0, len(words), max(1, n // 2)):
            share = len(want & set(words[start : start + 2 * n])) / len(want)
            if share >= threshold - 1e-9:
                labels.add(label)
                score = max(score, share)
    starts = [a for a, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 6)

"""Weak supervision for document quality, in DataFrame expressions only.

Rules on counts of a text vote that it has a fault (-1), that it is sound (1), or abstain (0). A document is sound or
has one of the faults in CLASSES; a rule may be made for one of them (its own) or be a weak hint that is right no more
often than the corpus says. Expectation-maximisation over the votes of all documents estimates, without labels, the
share of each class and how often each rule votes in it, and from these each rule's accuracy: how often what it votes
is so. Nothing holds the estimates but PRIOR_VOTES pseudo-documents at the start values, whose weight fades as the
corpus grows. The posterior probability of being sound replaces the demand that all rules pass: a text
with a repeated line or without a final stop is kept if such texts mostly are sound.

The votes of all documents are first counted by pattern: at most 2 ** len(RULES) rows whatever the input.
The estimation runs in one expression over those rows and gives a number for each class and rule.

Cases: null and empty text have no words and fail the base rule; repeated rows and copies count each time;
texts of any length are handled in one row's arrays; an empty table gives the starting parameters. Columns
of the input other than those asked for play no part, and names of its own that clash are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, checkpointed, let, quoted, trimmed, unused, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
ITERATIONS = 30
PRIOR_VOTES = 20.0
#: Sound first, then the faults. Shares to start from.
CLASSES = ("sound", "noise", "shouting", "repetition")
SHARES = (0.8, 0.2 / 3, 0.2 / 3, 0.2 / 3)


def _without(c: Column, characters: str) -> Column:
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def _ratio(a: str, b: str = "n_words") -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _bad(bad: Column) -> Column:
    return F.when(bad, -1).otherwise(0)


def _good(good: Column) -> Column:
    return F.when(good, 1).otherwise(0)


#: name: (the class that it is made for, or None for a weak hint at any fault; vote on the counts)
RULES = {
    "symbols": ("noise", lambda: _bad(_ratio("n_symbols") > 0.1)),
    "exclamations": ("shouting", lambda: _bad(_ratio("n_exclamations") > 0.1)),
    "capitals": ("shouting", lambda: _bad(_ratio("n_capital_runs") > 0.1)),
    "repeated_words": ("repetition", lambda: _bad(_ratio("n_repeat_words") > 0.2)),
    "repeated_lines": ("repetition", lambda: _bad(_ratio("n_dup_lines", "n_lines") > 0.3)),
    "some_repeats": (None, lambda: _bad(_ratio("n_repeat_words") > 0.02)),
    "few_words": (None, lambda: _bad(F.col("n_words") < 30)),
    "one_line": (None, lambda: _bad(F.col("n_lines") < 2)),
    "open_end": (None, lambda: _bad(F.col("n_open_ends") > 0)),
    "word_length": (None, lambda: _bad(~_ratio("word_chars").between(3, 12))),
    "tidy": ("sound", lambda: _good((_ratio("n_symbols") <= 0.02) & (_ratio("n_exclamations") <= 0.02))),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_capital_runs", "n_open_ends")


def _start(own: str | None, kind: str) -> float:
    """How often a rule is first taken to vote in documents of a class."""
    if own == kind:
        return 0.9
    if own is None:
        return 0.1 if kind == "sound" else 0.15
    return 0.05 if kind == "sound" else 0.1


START = tuple((share, *(_start(own, kind) for own, _ in RULES.values())) for kind, share in zip(CLASSES, SHARES))


def _repeat_words(words: Column) -> Column:
    """How many positions lie in a window of WINDOW words that occurs twice or more; 0 if no window does."""

    def covered(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spread(s: Column) -> Column:
            same = lambda x, k: F.get(s, k)["h"] == x["h"]
            twice = F.filter(s, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            at = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(starts, at, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ranked, spread))

    def grams(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(grams(w), covered)))


def counted(text: Column) -> Column:
    """An array of one struct of COUNTS, all long. Its parts are lambda variables and it is to be exploded, so that
    the optimizer, which would inline a plain column wherever a rule reads it, has them computed once."""

    def told(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
        per_line = let(lines, lambda a: F.struct(F.size(a).alias("n"), F.size(F.array_distinct(a)).alias("kinds")))
        per_word = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again")))

        def named(x: Column) -> Column:
            found = {
                "n_words": x["w"]["n"],
                "word_chars": F.length(_without(t, WHITE)),
                "n_symbols": F.length(t) - F.length(_without(t, SYMBOLS)),
                "n_dup_lines": x["l"]["n"] - x["l"]["kinds"],
                "n_repeat_words": x["w"]["again"],
                "n_lines": x["l"]["n"],
                "n_exclamations": F.length(t) - F.length(_without(t, "!")),
                "n_capital_runs": F.size(F.split(t, r"\p{Lu}{4,}")) - 1,
                "n_open_ends": (x["end"] != F.translate(x["end"], ".!?", "")).cast("int") * -1 + 1,
            }
            return F.struct(*(found[c].cast("long").alias(c) for c in COUNTS))

        return let(F.struct(per_line.alias("l"), per_word.alias("w"), F.right(trimmed(t), F.lit(1)).alias("end")), named)

    return F.transform(F.array(F.coalesce(text.cast("string"), F.lit(""))), told)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *COUNTS): what the rules read of each text."""
    return docs.select(quoted(id_col).alias("id"), F.explode(counted(quoted(text_col))).alias("c")).select("id", "c.*")


@dataclass(frozen=True)
class Model:
    """For each of CLASSES its share, then how often each of RULES votes in it."""

    state: tuple[tuple[float, ...], ...]

    def posterior(self) -> Column:
        """The probability of being sound."""
        weights = []
        for share, *rates in self.state:
            w = F.lit(share)
            for (_, rule), r in zip(RULES.values(), rates):
                w = w * F.when(rule() != 0, r).otherwise(1 - r)
            weights.append(w)
        return weights[0] / sum(weights[1:], weights[0])

    def accuracies(self) -> dict[str, float]:
        """How often each rule is right where it votes: that there is a fault, or that there is none."""
        made = {}
        for j, (name, (own, _)) in enumerate(RULES.items()):
            each = [row[0] * row[j + 1] for row in self.state]
            sound = each[0] / sum(each)
            made[name] = sound if own == "sound" else 1 - sound
        return made


def votes() -> Column:
    return F.array(*(rule().cast("int") for _, rule in RULES.values()))


def _shares(v: Column, state: Column) -> Column:
    """The posterior probability of each class, given votes and the model's state."""

    def weight(row: Column) -> Column:
        each = F.zip_with(v, F.slice(row, 2, len(RULES)), lambda x, r: F.when(x != 0, r).otherwise(1 - r))
        return F.aggregate(each, row[0], lambda a, x: a * x)

    return let(F.transform(state, weight), lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda all_: F.transform(w, lambda x: x / all_)))


def fit(counts: DataFrame) -> Model:
    """Estimates the model on counts of all documents."""
    return _fit(counts.groupBy(votes().alias("v")).agg(F.count("*").cast("double").alias("n")))


def _fit(patterns: DataFrame) -> Model:
    """patterns: (v, n), each pattern of votes and how many documents have it; at most 2 ** len(RULES) rows."""
    seen = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("seen"))

    def again(state: Column, seen: Column) -> Column:
        weighed = F.transform(seen, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), _shares(x["v"], state).alias("g")))

        def told(w: Column) -> Column:
            total = lambda f: F.aggregate(w, F.lit(0.0), lambda a, x: a + f(x))
            number = total(lambda x: x["n"])
            rows = []
            for k, (share, *rates) in enumerate(START):
                size = total(lambda x, k=k: x["n"] * x["g"][k])
                cast = [(total(lambda x, j=j, k=k: x["n"] * x["g"][k] * F.abs(x["v"][j])) + PRIOR_VOTES * r) / (size + PRIOR_VOTES) for j, r in enumerate(rates)]
                rows.append(F.array((size + PRIOR_VOTES * share) / (number + PRIOR_VOTES), *cast))
            return F.array(*rows)

        return let(weighed, told)

    start = F.array(*(F.array(*map(F.lit, row)) for row in START))
    state = seen.select(F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, lambda a, _: again(a, F.col("seen"))).alias("state")).first()["state"]
    return Model(tuple(map(tuple, state)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judged(counts: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """counts with base_failed, posterior and kept."""
    return counts.withColumn("base_failed", base_failed()).withColumn("posterior", F.round(model.posterior(), 6)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, that the model fitted on all of docs keeps. Texts are counted once and written with their counts."""
    name = unused(docs, "__counts")
    rows = checkpointed(docs.select("*", F.explode(counted(quoted(text_col))).alias(name)))
    model = fit(rows.select(f"{name}.*"))
    held = rows.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), f"{name}.*")
    return judged(held, model, threshold).where("kept").select("row.*")

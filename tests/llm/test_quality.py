import re

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import ODD
from tidemark.llm import quality

D = "/root/testdata/sf0.01"


def brute_votes(text):
    """Whether each rule votes, from a text, in plain Python."""
    text, c = text or "", brute.base_counts(text)
    n, lines = max(c["n_words"], 1), sum(1 for x in text.split("\n") if brute.WORD.search(x))
    shouts, runs, end = text.count("!"), len(re.findall(r"[A-ZÀ-ÖØ-Þ]{4,}", text)), text.strip(" \t\n\x0b\x0c\r")[-1:]
    return (
        c["n_symbols"] / n > 0.1, shouts / n > 0.1, runs / n > 0.1, c["n_repeat_words"] / n > 0.2, c["n_dup_lines"] / max(lines, 1) > 0.3,
        c["n_repeat_words"] / n > 0.02, c["n_words"] < 30, lines < 2, end not in tuple(".!?"), not 3 <= c["word_chars"] / n <= 12,
        c["n_symbols"] / n <= 0.02 and shouts / n <= 0.02,
    )


def brute_shares(votes, state):
    weights = []
    for share, *rates in state:
        for v, r in zip(votes, rates):
            share *= r if v else 1 - r
        weights.append(share)
    return [w / sum(weights) for w in weights]


def brute_model(rows, rounds=quality.ITERATIONS):
    """Expectation-maximisation over each document's votes."""
    state = [list(row) for row in quality.START]
    for _ in range(rounds):
        given = [brute_shares(v, state) for v in rows]
        for k, (share, *rates) in enumerate(quality.START):
            size = sum(g[k] for g in given)
            cast = [sum(g[k] for g, v in zip(given, rows) if v[j]) for j in range(len(rates))]
            state[k] = [(size + 20 * share) / (len(rows) + 20), *((x + 20 * r) / (size + 20) for x, r in zip(cast, rates))]
    return state


@pytest.fixture(scope="module")
def judged(spark):
    """Of sf0.01: the engine's rows, and {id: (posterior, unfitted posterior, base failed, votes)} in plain Python."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    counted = quality.counts(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    votes = {i: brute_votes(t) for i, t in texts.items()}
    state = brute_model(list(votes.values()))
    plain = {i: (brute_shares(v, state)[0], brute_shares(v, quality.START)[0], brute.base_counts(texts[i])["base_failed"], v) for i, v in votes.items()}
    return {r.id: r for r in quality.judged(counted, quality.fit(counted)).collect()}, plain


def test_kept_by_brute_force(judged):
    got, plain = judged
    assert {i: r.posterior for i, r in got.items()} == pytest.approx({i: p for i, (p, *_) in plain.items()}, abs=2e-6)
    assert {i: r.kept for i, r in got.items()} == {i: p >= 0.5 and not failed for i, (p, _, failed, _) in plain.items()}


def test_the_estimate_decides(judged):
    """Neither all rules passing nor the start values alone give the same documents."""
    got, plain = judged
    every = {i for i, (_, _, failed, v) in plain.items() if not failed and not any(v[:-1])}
    kept = {i for i, r in got.items() if r.kept}
    assert len(kept - every) > 0.03 * len(plain)
    assert max(abs(p - q) for p, q, _, _ in plain.values()) > 0.3


def test_agreement_with_labels(spark, judged):
    got, _ = judged
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    asked = [i for i in labels if i in got and not got[i].base_failed]
    assert sum(got[i].kept != (labels[i] == 1) for i in asked) <= 0.02 * len(asked)


def test_accuracies(spark):
    """A rule that meets a real fault is trusted; one that meets as many sound texts isn't, without bounds on either."""
    model = quality.fit(quality.counts(spark.read.parquet(f"{D}/documents.parquet")))
    accuracies = model.accuracies()
    assert accuracies["symbols"] > 0.95 and accuracies["few_words"] < 0.5
    assert set(accuracies) == set(quality.RULES)


def test_quality_of_odd_tables(odd, empty):
    assert quality.keep_good(empty).columns == empty.columns and quality.keep_good(empty).count() == 0
    assert [list(r) for r in quality.fit(quality.counts(empty)).state] == [pytest.approx(list(r)) for r in quality.START]
    kept = quality.keep_good(odd.withColumn("__counts", F.lit(1)))
    assert kept.columns == [*odd.columns, "__counts"]
    assert {hash(r.text) for r in kept.select("text").collect()} <= {hash(t) for t in ODD}

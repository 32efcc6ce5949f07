import random
import time

import pytest

from tests.llm import brute
from tidemark.llm import pii


@pytest.mark.parametrize(
    "text",
    [
        "1.1.1." + "0" * 5000, "9" * 70_000, "1." * 40_000, "w" * 100_000 + " at)", "w" * 100_000 + "[at]", "a(at)" * 20_000, "+1" + "(" * 70_000, "4 " * 40_000,
        "x" * 70_000 + "1", "token=" * 15_000, "key: " + "k9" * 50_000, "Mr " * 30_000, "1.2.3.4 a@b.co token = 'deadbeef12' " * 4_000,
    ],
    ids=lambda t: t[:8],
)
def test_long_odd_texts_take_little_time(text):
    began = time.perf_counter()
    base, found = pii.candidates(text)
    spans = pii.chosen(base, found, frozenset((k, v) for k, _, _, v in found))
    assert time.perf_counter() - began < 5
    assert base == brute.base_pii(text) if len(text) < 10_000 else spans is not None


def test_chosen_by_brute_force():
    r = random.Random(4)
    for _ in range(300):
        base = sorted(("card", a, a + r.randint(1, 6)) for a in r.sample(range(80), r.randint(0, 6)))
        found = [(r.choice(pii.ADDED_KINDS), a, a + r.randint(1, 9), "v") for a in r.sample(range(80), r.randint(0, 20))]
        taken, want = [(a, b) for _, a, b in base], []
        for k, a, b, _ in sorted(found, key=lambda c: (c[1], -c[2])):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                want.append((k, a, b))
        got = pii.chosen(base, found, frozenset((k, "v") for k in pii.ADDED_KINDS))
        assert got[: len(base)] == base and sorted(got[len(base) :]) == sorted(want)


def test_secrets_and_what_only_looks_like_one(spark):
    """Labelers disagree; what is told as a digest is left out although its shape is that of a token."""
    r = random.Random(1)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f'then token = "{h}" ends') for i, h in enumerate(hexes[:30])] + [(100 + i, f"see commit {h} of the tree") for i, h in enumerate(hexes[30:])]
    rows += [(200 + i, "a plain sentence about keys and tokens, without any") for i in range(30)]
    scanned = pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.id: x.spans for x in pii.report(scanned, pii.train(scanned)).collect()}
    assert all(got[i] == "secret:14:54" for i in range(30))
    assert not any("secret" in got[100 + i] or got[200 + i] for i in range(30))


def brute_posteriors(kind, counts):
    """Expectation-maximisation over the single candidates of a kind, in plain Python."""
    rows = [v[: len(pii.LABELERS)] for (k, v), n in counts.items() if k == kind for _ in range(n)]
    rates, share, made, prior = dict(pii.START), pii.SHARES[kind], {}, pii.PRIOR_VOTES

    def likely(vote, both, true):
        yes, no = both[:2] if true else both[2:]
        return {"+": yes, "-": no, "0": 1 - yes - no}[vote]

    for _ in range(pii.ITERATIONS):
        given = []
        for v in rows:
            t, f = share, 1 - share
            for x, vote in zip(pii.LABELERS, v):
                t, f = t * likely(vote, rates[x], True), f * likely(vote, rates[x], False)
            given.append(t / (t + f))
            made[v] = given[-1]
        true, false = sum(given) + prior, len(given) - sum(given) + prior
        for i, x in enumerate(pii.LABELERS):
            old = pii.START[x]
            cast = [sum(g for g, v in zip(given, rows) if v[i] == c) for c in "+-"] + [sum(1 - g for g, v in zip(given, rows) if v[i] == c) for c in "+-"]
            rates[x] = tuple((c + prior * o) / (true if j < 2 else false) for j, (c, o) in enumerate(zip(cast, old)))
        share = (sum(given) + prior * pii.SHARES[kind]) / (len(given) + prior)
    return made


COUNTS = {("name", "+0++00" + "1000"): 50, ("name", "000000" + "1000"): 30, ("card", "0-00--" + "1300"): 40, ("card", "0+0+00" + "1300"): 40, ("secret", "++0+00" + "32qq"): 25, ("secret", "++00-0" + "32ww"): 25}


def test_reliabilities_by_brute_force():
    got, rates, share = pii.posteriors(COUNTS)
    for (k, v), p in got.items():
        assert p == pytest.approx(brute_posteriors(k, COUNTS)[v[: len(pii.LABELERS)]], abs=1e-6)
    assert got["card", "0+0+001300"] > 0.9 > 0.1 > got["card", "0-00--1300"]
    assert got["secret", "++0+0032qq"] > 0.9 > 0.1 > got["secret", "++00-032ww"]
    check = pii.LABELERS.index("check")
    assert rates["card"][1, check, 0] > rates["card"][0, check, 0] and share["card"] < 0.65


def test_classifier_reads_more_than_votes():
    made = pii.fit(COUNTS)
    assert made["secret", "++0+0032qq"] > pii.THRESHOLD > made["secret", "++00-032ww"]
    two = pii.fit(COUNTS | {("secret", "+0000032qq"): 20, ("secret", "+0000032ww"): 20})
    assert two["secret", "+0000032qq"] > two["secret", "+0000032ww"]
    assert pii.fit({}) == {}

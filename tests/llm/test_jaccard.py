import random

import pytest

from tests.llm import brute
from tidemark.llm import common, jaccard


def shingles(text):
    w = brute.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def groups(found):
    """Sets of ids by the label that found gives."""
    made = {}
    for r in found.collect():
        made.setdefault(r.label, set()).add(r.id)
    return sorted(map(sorted, made.values()))


def brute_groups(rows):
    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 10 * len(a & b) >= 8 * len(a | b):
                parent[root(i)] = root(j)
    made = {}
    for i, _ in rows:
        made.setdefault(root(i), set()).add(i)
    return sorted(map(sorted, made.values()))


def corpus():
    """Texts edited at several places in groups of different size, one passage in all of them, exact copies, and short texts."""
    r, rows = random.Random(8), [None, "", " ", "a b", "A  b", "a c"]
    passage = [f"p{i}" for i in range(20)]
    for size in (1, 2, 3, 30, 50):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(90, 130))]
        for _ in range(size):
            edited = list(base)
            for _ in range(r.randint(0, 4)):
                edited[r.randrange(len(edited))] = f"w{r.randrange(10**6)}"
            rows.append(" ".join(edited[: r.choice([70, 85, 130])] + passage))
    return list(enumerate(rows + rows[-60:-40]))


@pytest.mark.parametrize("limit", [1, 8, jaccard.BUCKET_LIMIT])
def test_groups_are_those_of_all_pairs(spark, limit):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups(jaccard.near_duplicates(docs, bucket_limit=limit)) == brute_groups(rows)


def test_stage_links_what_fingerprints_miss(spark):
    """Edits that move more than two of 64 bits but leave four fifths of the five-word shingles."""
    import corpus_pipeline
    from tidemark.llm import simhash

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {g[0] for g in brute_groups(rows)}
    assert simhash.keep_one(docs).count() > len(kept)


@pytest.mark.parametrize("room", [0, common.BROADCAST_BYTES])
def test_listed_keys_whatever_their_size(spark, monkeypatch, room):
    """One key has a third of all rows, and the list is broadcast or not."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", room)
    keys = [0] * 400 + [k // 2 for k in range(800)]
    rows = spark.createDataFrame(list(enumerate(keys)), "at long, key long")
    counted = rows.groupBy("key").count().where("key % 3 = 0").select("key", "count").toDF("key", "n")
    known = counted.selectExpr("key", "n as label")
    asked = sorted(i for i, k in enumerate(keys) if k % 3 == 0)
    for found in (common.among_counted(rows, counted, "key", "at"), common.among(rows, counted.select("key"), "key", "at")):
        assert sorted(found.columns) == sorted(rows.columns)
        assert sorted(r.at for r in found.collect()) == asked
    told = {r.at: r.label for r in common.told(rows, known, "key", "at").collect()}
    assert told == {i: keys.count(k) if k % 3 == 0 else None for i, k in enumerate(keys)}
    assert common.among_counted(rows, counted.limit(0), "key", "at").count() == 0


def test_what_goes_is_left_out_whatever_its_size(spark, monkeypatch):
    from tidemark.llm import simhash

    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    rows = [(None, "a b"), (None, "a b"), (2, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __gone_id string")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [2, 3, 5]

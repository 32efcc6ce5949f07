import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import ODD
from tidemark.llm import audio, htmltree, licenses, linededup, packing, pii, quality, simhash, treebpe, warc

WORD_BPE = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1. quality rules


@pytest.mark.parametrize("name", ["odd", "sample"])
def test_counts(request, name):
    df = request.getfixturevalue(name)
    got = sorted(tuple(r)[1:6] + (r.base_failed,) for r in quality.counts(df).withColumn("base_failed", quality.base_failed()).collect())
    want = [brute.base_counts(t) for _, t in texts(df)]
    assert got == sorted(tuple(w[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for w in want)


# 2. pages


def test_simple_tree_matching_is_the_largest():
    def plain(a, b):
        if a.tag != b.tag or a.names != b.names:
            return 0
        m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain(x, y))
        return m[-1][-1] + 1

    r, matcher = random.Random(3), htmltree.Matcher()

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in r.choices(["div", "span", "b", "ul"], k=r.randint(0, 4))) if depth else ""

    for _ in range(60):
        a, b = (htmltree.parse(f"<div>{tree(3)}</div>") for _ in range(2))
        htmltree.numbered(a), htmltree.numbered(b)
        assert matcher.weight(a, b) == plain(a, b) == len(matcher.align(a, b))


# 3. telephony


def scalar_adpcm(block):
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = audio.STEPS[index]
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + audio.MOVES[code & 7]))
            out.append(value)
    return out


def test_adpcm():
    blocks = np.random.default_rng(0).integers(0, 256, (40, 192), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [scalar_adpcm(bytes(b)) for b in blocks]
    wave = (8000 * np.sin(np.arange(5000) / 9)).astype("<i2")
    back, rate = audio.samples_of(audio.wav(audio.encode_adpcm(wave), audio.ADPCM, 8000, 192, 4, 5000, 377))
    assert rate == 8000 and np.abs(back[:5000].astype(int) - wave).mean() < 400


def test_companding_tables():
    assert audio.MULAW_TABLE[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert all((np.diff(np.sort(t.astype(int))) >= 0).all() and len(set(t.tolist())) >= 255 for t in (audio.MULAW_TABLE, audio.ALAW_TABLE))


def test_formats():
    assert audio.to_pcm(None) is None and audio.to_pcm(b"RIFFxxxxWAVE") is None and audio.to_pcm(b"") is None
    pcm = audio.parse(audio.to_pcm(audio.wav(bytes(range(256)))))
    assert (pcm["kind"], pcm["rate"], len(pcm["data"])) == (audio.PCM, 16000, 1024)
    assert audio.samples_of(audio.wav(b"\x01\x02\x03\x04", audio.PCM, 8000, 2, 16))[0].tolist() == [513, 1027]


def test_resampling_keeps_tones_and_takes_off_what_folds():
    t = np.arange(16000) / 16000
    low, high = (10_000 * np.sin(2 * np.pi * f * t) for f in (500, 6500))
    made = audio.resample(np.rint(low + high).astype("<i2"), 16000, 8000)
    want = 10_000 * np.sin(2 * np.pi * 500 * np.arange(8000) / 8000)
    assert len(made) == 8000 and np.abs(made[100:-100] - want[100:-100]).max() < 300
    up = audio.resample(np.rint(low).astype("<i2"), 16000, 22050)
    assert len(up) == 22050 and np.abs(up[100:-100] - 10_000 * np.sin(2 * np.pi * 500 * np.arange(22050) / 22050)[100:-100]).max() < 100


def test_stored_pcm_and_odd_media(spark):
    tone = (8000 * np.sin(np.arange(2000) / 9)).astype("<i2")
    files = [None, b"", b"RIFF", b"no wav", audio.wav(bytes(range(192))), audio.wav(bytes(range(192)), audio.ALAW), audio.wav(audio.encode_adpcm(tone), audio.ADPCM, 8000, 192, 4, 2000, 377), audio.wav(tone.tobytes(), audio.PCM, 44100, 2, 16), audio.wav(b"\0" * 192, 99)]
    df = spark.createDataFrame([(i, 1, f, None if f is None else "x") for i, f in enumerate(files)], "id long, n_bytes long, media binary, pcm string")
    made = audio.converted(df)
    assert made.columns == ["id", "n_bytes", "media", "pcm", "pcm_"]
    got = {r.id: r.pcm_ for r in made.collect()}
    assert all((got[i] and bytes(got[i])) == audio.to_pcm(f) for i, f in enumerate(files)) and all(got[i] is None for i in (0, 1, 2, 3, 8))
    assert all(audio.parse(bytes(got[i]))["rate"] == 16000 for i in (4, 5, 6, 7))
    read = {r.id: r for r in audio.read(df).collect()}
    assert all(read[i].payload_sha256 is None and read[i].feature is None for i in range(4))
    assert read[8].payload_bytes == 192 and read[8].feature is None and read[4].feature


def test_stored_payloads(odd, empty):
    got = sorted(((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in audio.read(audio.store(odd)).collect()))
    want = []
    for _, t in texts(odd):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert got == sorted(want)
    assert audio.read(audio.store(empty)).count() == 0
    one = {r.feature for r in audio.read(audio.store(odd.where("text like 'the quick%dawn'"))).collect()}
    assert len(one) == 1


# 4. revisits


def naive_resolve(records):
    out = []
    for r in records:
        if r["kind"] != "revisit":
            continue
        earlier = [x for x in records if x["kind"] == "response" and x["status"] == 200 and x["u"] is not None and x["u"] == r["u"] and x["ts"] is not None and r["ts"] is not None and x["ts"] < r["ts"]]
        best = max(earlier, key=lambda x: (x["ts"], x["record_id"]), default=None)
        tag, mod = r["headers"].get("etag"), r["headers"].get("last-modified")
        if best is None:
            out.append((r["record_id"], "no_response", None))
        elif tag is None and mod is None:
            out.append((r["record_id"], "no_validator", best["record_id"]))
        else:
            same = tag.removeprefix("W/") == best["headers"].get("etag", "").removeprefix("W/") if tag is not None else mod == best["headers"].get("last-modified")
            out.append((r["record_id"], "resolved" if same else "validator_mismatch", best["record_id"]))
    return sorted(out)


def test_revisits(spark):
    r = random.Random(5)
    records = []
    for i in range(400):
        kind = r.choice(["response", "revisit"])
        headers = {k: v for k, v in (("etag", r.choice(['"a"', 'W/"a"', '"b"'])), ("last-modified", r.choice("xy")), ("server", "s")) if r.random() < 0.7}
        u = r.choice(["h/a", "h/b", None])
        records.append({"record_id": i, "url": u and f"HTTP://{u.replace('h', 'H')}{r.choice(['', '#f', '?utm_source=x', '/'])}", "u": u, "ts": r.choice([None, *range(0, 400_000, 7919)]), "kind": kind, "status": r.choice([200, 200, 503]) if kind == "response" else 304, "headers": headers, "digest": str(i), "size": i})
    columns = ("record_id", "url", "ts", "kind", "status", "headers", "digest", "size")
    df = spark.createDataFrame([tuple(x[c] for c in columns) for x in records], "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, size long")
    found = warc.resolve(df)
    assert sorted((x.record_id, x.outcome, x.response_id) for x in found.collect()) == naive_resolve(records)
    assert all((x.headers is not None) == (x.outcome == "resolved") for x in found.collect())
    assert warc.resolve(df.limit(0)).count() == 0


def test_only_permitted_headers_change(spark):
    rows = [(1, "http://h/", 1, "response", 200, {"etag": '"a"', "server": "old", "expires": "1"}, "d", 3), (2, "http://h", 2, "revisit", 304, {"etag": '"a"', "server": "new", "expires": "2", "vary": "x"}, None, None)]
    (x,) = warc.resolve(spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, size long")).collect()
    assert x.headers.split("\n") == ['etag: "a"', "expires: 2", "server: old", "vary: x"] and (x.digest, x.size) == ("d", 3)


# 5. packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_place_every_piece_once(counts):
    made = packing.plan(counts, 64)
    assert all(sum(n * k for n, k in parts) <= 64 for parts, _ in made)
    used = {}
    for parts, times in made:
        for n, k in parts:
            used[n] = used.get(n, 0) + k * times
    assert used == counts
    room = []  # plain best fit, longest first, one piece at a time
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(64 - n)
    assert sum(t for _, t in made) <= 1.1 * len(room) + 1


def test_complements_against_all_combinations():
    from itertools import combinations_with_replacement

    r = random.Random(2)
    for _ in range(300):
        have = np.zeros(33, dtype=np.int64)
        for _ in range(r.randint(0, 6)):
            have[r.randint(1, 32)] += r.randint(1, 2)
        gap = r.randint(1, 32)
        there = [n for n in range(1, 33) for _ in range(have[n])]
        possible = any(sum(c) == gap and all(c.count(x) <= have[x] for x in c) for k in (1, 2, 3) for c in combinations_with_replacement(sorted(set(there)), k))
        found = packing.complements(have, gap)
        assert bool(found) == possible and (not found or sum(found) == gap and all(found.count(x) <= have[x] for x in found))


@pytest.mark.parametrize("name", ["odd", "sample", "empty"])
def test_packed_tables(request, name):
    from tokenizers import Tokenizer

    df, t = request.getfixturevalue(name), Tokenizer.from_file(WORD_BPE)
    rows = packing.pack(packing.pieces(df, WORD_BPE)).collect()
    want = []
    for doc, text in texts(df):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.append((str(doc), k, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 for n in filled.values())


# 6. lines


def test_lines(spark, odd, empty):
    rows = [(i, f"Common line\n body {i} of its own\n  Common line ", f"s{i % 9}") for i in range(30)] + [(99, None, None), (98, "", "s1"), (97, "copied whole", "s0")]
    rows += [(200 + i, "copied whole", f"s{i}") for i in range(12)]
    got = {r.id: r for r in linededup.removed(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=8).collect()}
    assert all(got[i].text == f" body {i} of its own" and (got[i].n_lines, got[i].n_spread, got[i].n_removed) == (3, 2, 2) for i in range(30))
    assert got[99].text is None and got[98].text == "" and got[97].text == "copied whole" and (got[97].n_spread, got[97].n_removed) == (1, 0)
    assert linededup.clean(odd).schema == odd.schema and linededup.clean(odd).count() == odd.count()
    assert linededup.clean(empty).count() == 0


@pytest.mark.parametrize("size", [0, 8 << 20])
def test_sites_near_the_threshold_are_counted_exactly(spark, size, monkeypatch):
    """With what is listed broadcast, and dealt out by salted keys."""
    from tidemark.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", size)
    rows = [(i, f"line {n}\nbody {i} {'x' * 50}", f"s{k}") for i, (n, k) in enumerate((n, k) for n in range(1, 14) for k in range(n))]
    found = linededup.boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=8)
    want = spark.createDataFrame([(f"line {n}",) for n in range(8, 14)], "t string").select(F.xxhash64("t"))
    assert {r[0] for r in found.collect()} == {r[0] for r in want.collect()}


# 7. personal data


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@.+-_ 0()9%\nZ4", max_size=80))
def test_base_spans(text):
    assert pii.base_spans(text) == [s for k in pii.BASE_KINDS for s in brute.base_pii(text) if s[0] == k]


def test_base_spans_of_documents(sample):
    for _, t in texts(sample):
        assert pii.base_spans(t) == brute.base_pii(t)


def test_added_spans(spark, odd, empty):
    good = "Please contact Dr. Maria Lopez, tel (212) 555-0188 or write to maria [at] example [dot] org; account DE89 3704 0044 0532 0130 00."
    rows = [(i, good) for i in range(20)] + [(50, "version 123-45-6789-0 page 999.999.999.999 and 4111 1111 1111 1112")] + [(60 + i, f"mail a{i}@x.com card 4111111111111111 ip 10.0.0.{i} call +1 212 555 0100") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = pii.scan(df)
    got = {r.id: r for r in pii.report(scanned, pii.train(scanned)).collect()}
    kinds = {s.split(":")[0] for s in got[0].spans.split(",")}
    assert {"local_phone", "name", "iban", "spelled_email"} <= kinds
    assert got[50].spans == "" and (got[60].n_email, got[60].n_ip, got[60].n_card, got[60].n_phone) == (1, 1, 1, 1)
    assert pii.mask(odd).schema == odd.schema and pii.mask(odd).count() == odd.count() and pii.mask(empty).count() == 0
    text = pii.mask(df.where("doc_id = 60")).first().text
    assert text == "mail <EMAIL> card <CARD> ip <IP> call <PHONE>"


# 8. tokens


@pytest.fixture
def small_leaves(monkeypatch):
    for k, v in {"LEAF_CHARS": 64, "LEAF_BYTES": 48, "WINDOW": 4, "CACHE": 500}.items():
        monkeypatch.setattr(treebpe, k, v)
    treebpe.forms.cache_clear()


def test_tree_encoding_is_exact(small_leaves):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(WORD_BPE), random.Random(1)
    signs = ["a", "th", "in", "'", "'s", " ", "\n", "é", "É", "ß", "1", "!", "%%%", "’", "Σ", "İ", "漢字", "́", "<|endoftext|>", "½", "\x85", "\xa0", "\x1c", "ﬁ", "😀", "\t"]
    cases = ["".join(r.choices(signs, k=r.randint(0, 250))) for _ in range(800)]
    cases += ["".join(r.choices(kind, k=r.randint(50, 800))) for kind in ("漢字語文", "абвгде", "ab漢é😀", "abcdefghij", ["the", "and", "ing", "er"], "ab", "éèa", "!?", "a") for _ in range(40)]
    for c in cases:
        want = t.encode(c, add_special_tokens=False).ids
        assert treebpe.encode(WORD_BPE, c) == want
        assert treebpe.decode(WORD_BPE, want) == t.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["odd", "sample", "empty"])
def test_encoded_tables(request, name):
    from tokenizers import Tokenizer

    treebpe.forms.cache_clear()
    df, t = request.getfixturevalue(name), Tokenizer.from_file(WORD_BPE)
    want = []
    for doc, text in texts(df):
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((str(doc), len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in treebpe.encode_and_decode(df, WORD_BPE).collect()) == sorted(want)


# 9. licenses


@pytest.mark.parametrize("name", ["odd", "sample", "empty"])
def test_licenses(request, name):
    df = request.getfixturevalue(name)
    got = sorted(map(str, ((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(df).collect())))
    assert got == sorted(str(brute.licenses(t, licenses.TEMPLATES, licenses.PHRASES, licenses.THRESHOLD)) for _, t in texts(df))


def test_license_join_against_brute_force():
    r = random.Random(4)
    vocabulary = sorted(licenses.template_words()) + [b"other", b"words"]
    index = licenses.Index({w: r.randint(0, 50) for w in vocabulary})
    for _ in range(250):
        label, template = r.choice(licenses.TEMPLATES)
        held = [w.decode() for w in licenses.words(template)]
        cut = [w for w in held if r.random() < r.choice([0.8, 0.9, 1.0])] + [w.decode() for w in r.choices(vocabulary, k=r.randint(0, 12))]
        r.shuffle(cut)
        text = "\n".join(" ".join(cut) for _ in range(r.randint(1, 2))) + r.choice(["", "\nunder The MIT license: apache-license VERSION 2 cc by nc by nc"])
        assert licenses.scan_text(text, index) == brute.licenses(text, licenses.TEMPLATES, licenses.PHRASES, licenses.THRESHOLD)


def test_wrapped_notices_and_scattered_words():
    """A notice broken into short lines has its label; a sentence that happens to have a short notice's words hasn't."""
    index = licenses.Index({})
    for label, template in licenses.TEMPLATES:
        held = template.split()
        wrapped = "\n * ".join(" ".join(held[i : i + 5]) for i in range(0, len(held), 5))
        assert label in licenses.scan_text("Some words before.\n" + wrapped + "\nand after", index)[5].split(",")
    assert licenses.scan_text("The film was released in May; under new rules MIT students need a license", index)[5] == ""


# 10. near duplicates


def groups(df, **more):
    return [(r.id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, **more).collect()]


@pytest.mark.parametrize("limit", [1, simhash.BUCKET_LIMIT])
def test_near_duplicates(sample, limit):
    got = groups(sample, bucket_limit=limit)
    prints = [(i, brute.fingerprint(t)) for i, t in texts(sample)]
    assert sorted((i, f) for i, f, _ in got) == sorted(prints)
    assert {i: c for i, _, c in got} == brute.components(prints)


@pytest.mark.parametrize("limit", [1, 3, simhash.BUCKET_LIMIT])
def test_links_of_close_fingerprints(spark, limit):
    """Crowded fingerprints: chains and balls of ones that differ in a few bits, with a shared half."""
    r, prints = random.Random(6), set()
    for _ in range(12):
        at = r.getrandbits(64)
        for _ in range(25):
            prints.add(at)
            for _ in range(r.randint(1, 3)):
                at ^= 1 << r.randrange(r.choice([8, 32, 64]))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    made = {row.node % (1 << 64): row.label % (1 << 64) for row in simhash.components(simhash.links(nodes, limit)).collect()}
    want = brute.components([(f, f) for f in prints])
    assert all(signed(made[f]) <= signed(f) for f in made)
    classes = {}
    for f in prints:
        classes.setdefault(made.get(f, f), set()).add(f)
    truth = {}
    for f in prints:
        truth.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, truth.values()))


def test_near_duplicates_of_odd_tables(odd, empty):
    got = sorted(map(str, groups(odd)))
    prints = [(i, brute.fingerprint(t)) for i, t in texts(odd)]
    assert len(got) == len(prints)
    assert groups(empty) == []
    kept = simhash.keep_one(odd)
    assert kept.schema == odd.schema and kept.count() == len(set(brute.components([(f, f) for _, f in prints]).values()))
    assert simhash.keep_one(empty).count() == 0

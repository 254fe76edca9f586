"""Parts without Spark: round trips, damage, hashes, windows, ordinal fit, language net."""

import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import decontaminate, language, licenses, media, neardup, storage, toxicity, warc


@given(st.binary(max_size=500))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(data):
    length, samples = media.decode_png(media.encode_png(data))
    assert length == len(data) and samples[:length] == data and len(samples) % 64 == 0 and len(samples) >= 64 and not any(samples[length:])


def test_png_damage_is_told():
    png = bytearray(media.encode_png(b"x" * 100))
    png[40] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(png))


def scan(data, compressed, start=0, end=None):
    return list(warc.scan(storage.Window(lambda: io.BytesIO(data), len(data), step=4096), "f", start, len(data) if end is None else end, compressed))


def ids(rows):
    return [int(r[8][12:-1]) for r in rows if r[0] == "record"]


def records(n):
    out = []
    for i in range(n):
        payload = f"<p>page {i} ".encode() + random.Random(i).randbytes(200)
        block = warc.HTTP_HEAD % len(payload) + payload
        out.append(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x-page:{i}>"), ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + warc.base32_sha1(block))], block))
    return out


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_salvage(compressed, ranges):
    parts = [warc.member(r) if compressed else r for r in records(20)]
    starts = np.cumsum([0, *map(len, parts)])
    data = bytearray(b"".join(parts))
    for k in (3, 4, 11):  # damage in the middle, and a lost start
        data[starts[k] + len(parts[k]) * 3 // 4] ^= 0x55
    data[starts[15]] = 0
    data = bytes(data) + b"trailing junk"
    known = storage.known_ranges([{"path": "f", "size": len(data), "starts": starts[1:-1].tolist()}], len(data) // ranges)
    assert len(known) >= min(2, ranges)
    rows = [r for _, a, b in known for r in scan(data, compressed, a, b)]
    got = sorted(int(r[8][12:-1]) for r in rows if r[0] == "record")
    assert got == [i for i in range(20) if i not in (3, 4, 11, 15)]
    covered = sorted((r[2], r[2] + r[3]) for r in rows)
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_member_with_several_records(monkeypatch):
    parts = records(9)
    for whole in (warc.WHOLE, 500):  # the second way reads a long member twice
        monkeypatch.setattr(warc, "WHOLE", whole)
        data = warc.member(b"".join(parts[:3])) + warc.member(parts[3]) + warc.member(b"".join(parts[4:]))
        rows = scan(data, True)
        assert ids(rows) == list(range(9)) and all(r[0] == "record" for r in rows)
        assert [r[4] for r in rows[:3]] == [0, len(parts[0]), len(parts[0]) + len(parts[1])] and rows[2][3] == len(warc.member(b"".join(parts[:3])))
        # a bad record in the middle of a whole file's one member costs itself only
        bad = bytearray(parts[1])
        bad[-40] ^= 1
        rows = scan(warc.member(b"".join([parts[0], bytes(bad), parts[2], b"rest"])), True)
        assert ids(rows) == [0, 2] and [(r[4], r[5]) for r in rows if r[0] == "gap"] == [(len(parts[0]), len(bad)), (sum(map(len, parts[:3])), 4)]
        # of a member that fails its own check, records with digests that agree are taken
        broken = bytearray(data)
        broken[len(warc.member(b"".join(parts[:3]))) - 8] ^= 1
        rows = scan(bytes(broken), True)
        assert sorted(ids(rows)) == list(range(9)) and sum(r[0] == "gap" for r in rows) == 1


@pytest.mark.parametrize("compressed", [True, False])
def test_records_inside_payloads_are_no_records(compressed):
    inner = records(3)
    pack = (lambda b: warc.member(b, 0)) if compressed else bytes

    def outer(i, damage=False):
        block = b"".join(map(pack, inner))
        out = bytearray(warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:x-page:{100 + i}>"), ("WARC-Block-Digest", "sha1:" + warc.base32_sha1(block))], block))
        if damage:
            out[-len(block) // 2 - 40] ^= 1
        return bytes(out)

    parts = [pack(x) for x in (outer(0), records(1)[0], outer(1), outer(2))]
    data = b"".join(parts)
    starts = np.cumsum([0, *map(len, parts)])[1:-1].tolist()
    for target in (1, len(parts[0]), 1 << 30):
        rows = [r for _, a, b in storage.known_ranges([{"path": "f", "size": len(data), "starts": starts}], target) for r in scan(data, compressed, a, b)]
        assert ids(rows) == [100, 0, 101, 102] and all(r[0] == "record" for r in rows)
    if not compressed:
        rows = scan(outer(0) + outer(1, True) + records(1)[0], False)
        assert ids(rows) == [100, 0] and [(r[2], r[3]) for r in rows if r[0] == "gap"] == [(len(outer(0)), len(outer(1)))]


def test_long_headers_and_false_lengths():
    block = b"x" * 10
    long = warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x-page:7>"), ("X-Note", "n" * 200_000)], block)
    liar = records(1)[0].replace(b"Content-Length: ", b"Content-Length: 99999999999")
    for compressed in (True, False):
        pack = warc.member if compressed else bytes
        rows = scan(pack(long) + pack(liar) + pack(long), compressed)
        assert ids(rows) == [7, 7] and sum(r[0] == "gap" for r in rows) == 1


@given(st.lists(st.sampled_from("a b c d e".split()), max_size=40), st.lists(st.lists(st.sampled_from("a b c d e".split()), max_size=8), max_size=5))
@settings(max_examples=80, deadline=None)
def test_window_hits_against_brute_force(words, items):
    index = decontaminate.WindowIndex([(i, " ".join(w)) for i, w in enumerate(items)], 4)
    hit, found = index.hits([w.encode() for w in words])
    want, ids = [False] * len(words), set()
    for i, item in enumerate(items):
        n = min(4, len(item))
        for s in range(len(item) - n + 1) if item else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == item[s : s + n]:
                    ids.add(i)
                    want[at : at + n] = [True] * n
    assert hit.tolist() == want and found == ids


def test_cut_spans():
    assert decontaminate.cut_spans("One, two; THREE four. Five", [[1, 3]]) == "One, four. Five"
    assert decontaminate.cut_spans("one", [[0, 1]]) == ""


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for similarity in (0.75, 0.9):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            n = int(600 * (1 - similarity) / 2)
            a, b = both[: 600 - n], both[n:]
            xor = np.bitwise_count(neardup.odd_sketch(neardup.samples_of(a)).view(np.uint64) ^ neardup.odd_sketch(neardup.samples_of(b)).view(np.uint64)).sum()
            assert xor <= neardup.MOST_XOR
            errors.append(float(neardup.similarity_by_sketch(xor)) - (600 - 2 * n) / 600)
        assert abs(np.mean(errors)) < 0.05


def test_shingles():
    assert len(neardup.shingles("A b c d e f")) == 2 and len(neardup.shingles("a b")) == 1 and len(neardup.shingles(" \n")) == len(neardup.shingles(None)) == 0
    assert neardup.set_key(neardup.shingles("a  B\tc")) == neardup.set_key(neardup.shingles("A b C"))
    assert neardup.set_key(neardup.shingles("a b")) != neardup.set_key(neardup.shingles("b a"))


def test_ordinal_fit():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    grades = (x @ [3, 0, 0] > 1).astype(int) + (x @ [3, 0, 0] > 2)
    w, t = toxicity.fit_ordinal(x, grades, np.ones(400), steps=800)
    z = x @ w
    assert t[1] > t[0] and ((z > t[0]).astype(int) + (z > t[1]) == grades).mean() > 0.9


def test_ordinal_fit_is_cumulative():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 1))
    latent = 2 * x[:, 0] + rng.logistic(size=6000)
    grades = (latent > 1).astype(int) + (latent > 3)
    w, t = toxicity.fit_ordinal(x, grades, np.ones(6000))
    assert w == pytest.approx([2], abs=0.15) and t == pytest.approx([1, 3], abs=0.2)


def test_ordinal_fit_against_brute_force_likelihood():
    """At the fit no small step of any parameter makes the likelihood, written down plainly, better."""
    rng = np.random.default_rng(5)
    x, weight = rng.random((300, 2)), rng.random(300) + 0.5
    grades = np.digitize(3 * x[:, 0] - 2 * x[:, 1] + rng.logistic(size=300), [0.5, 2.0])
    w, t = toxicity.fit_ordinal(x, grades, weight, steps=4000, rate=0.03)

    def loss(w, t):
        total = 0.0
        for row, g, k in zip(x, grades, weight):
            above = [1.0] + [1 / (1 + np.exp(-(row @ w - c))) for c in t] + [0.0]
            total -= k * np.log(above[g] - above[g + 1])
        return total / weight.sum() + 1e-5 / 2 * (w @ w)

    best, params = loss(w, t), np.concatenate((w, t))
    for i in range(4):
        for step in (-0.02, 0.02):
            moved = params.copy()
            moved[i] += step
            assert loss(moved[:2], moved[2:]) > best - 1e-7


def test_only_real_copies_collapse():
    shared = [b"w%d" % i for i in range(50)]
    rows = [(1, [*shared, b"one"]), (1, [*shared, b"two"]), (1, [b"one", *shared, b"w3"]), (0, [*shared, b"one"])]
    assert [(label, list(counts.elements())) for label, counts in ((x, Counter(c)) for x, c in toxicity.one_of_copies(rows))] == [rows[0], rows[1], rows[3]]


def test_language_net():
    rng = random.Random(3)
    vocab = {"xx": "alpha beta gamma delta", "yy": "zorro kilo wiki junky", "zz": "éta ößu ñan çid"}
    rows = [(k, " ".join(rng.choices(v.split(), k=30))) for k, v in vocab.items() for _ in range(80)]
    net = language.ByteCnn(sorted(vocab))
    net.fit(np.concatenate([language.windows_of(language.letters_of(t))[:1] for _, t in rows]), np.array([sorted(vocab).index(k) for k, _ in rows]), epochs=5)
    assert net.predict("alpha gamma alpha beta")[0] == "xx" and net.predict("ÑAN ÇID")[0] == "zz"
    assert net.predict(None) == net.predict("12 !!") == ("und", 0.0)
    assert len(language.windows_of(b"x" * 1000)) == 4 and language.windows_of(b"ab").shape == (1, 256)


@given(st.lists(st.sampled_from("cc by nc mit license under the".split()), max_size=30))
@settings(max_examples=60, deadline=None)
def test_places(words):
    for phrase, _ in licenses.BASE:
        p = phrase.split()
        assert licenses.places([w.encode() for w in words], phrase) == [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def test_license_templates_find_themselves():
    index = licenses.RareTokenIndex({})
    for label, passage, _ in licenses.TEMPLATES:
        assert label in {m[0] for m in index.matches([b"x", b"y", *passage.encode().split(), b"z"])}
    assert index.matches(b"the license of this software is free".split()) == []


@pytest.mark.parametrize("before", ["", "under ", "distributed under the ", "under the terms of the ", "this work is licensed under the "])
@pytest.mark.parametrize("version", [2, 3])
def test_license_key_phrase_is_enough(before, version):
    words = f"x y {before}gnu general public license version {version} z".encode().split()
    assert {m[0] for m in licenses.RareTokenIndex({}).matches(words)} == {f"gpl-{version}"}


def test_crc_of_tail():
    assert zlib.crc32(media.padded(b"")[-64:]) == zlib.crc32(bytes(64))

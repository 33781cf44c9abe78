"""Digests of repetitive texts around the size of a chunk."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import fingerprints
from foliant.llm.common import mix64


def test_repeated_features_count_once_at_every_size():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), int(rng.integers(2, 12)))) for _ in range(600)]
    passage = " ".join(words) + " "
    many = passage * (fingerprints.CHUNK // len(passage) + 2)
    below, above = many[: fingerprints.CHUNK - 100], many[: fingerprints.CHUNK + 3000]
    for text in (passage * 3, below, above):
        found = fingerprints.features(np.frombuffer(text.encode(), dtype=np.uint8))
        assert len(found) == len(set(found.tolist())) > 0
    prints = [fingerprints.fingerprint(t) for t in (passage * 3, below, above)]
    assert all(fingerprints.likeness(a, b) > 0.9 for a in prints for b in prints)


def plain_places(raw):
    """Window by window: the rarest of each run of consecutive windows, kept if it is that often enough."""
    rare = fingerprints.rarity(raw)
    span, need = fingerprints.rules(len(rare))
    wins = {}
    for i in range(len(rare) - span + 1):
        best = max(range(i, i + span), key=lambda k: (rare[k], -k))
        wins[best] = wins.get(best, 0) + 1
    return [j for j in sorted(wins) if wins[j] >= need]


def test_places_do_not_depend_on_chunks():
    rng = np.random.default_rng(1)
    for n in (16, 17, 40, 255, 271, 272, 1000, 3000):
        for kinds in (1, 3, 26):
            raw = rng.integers(97, 97 + kinds, n).astype(np.uint8)
            want = plain_places(raw)
            for chunk in (1, 3, 64, 1000, 1 << 40):
                assert fingerprints.places(raw, chunk).tolist() == want


def test_chunked_equals_whole_around_a_chunk():
    rng = np.random.default_rng(3)
    noise = rng.integers(32, 127, fingerprints.CHUNK + 300).astype(np.uint8)
    again = np.resize(noise[:700], fingerprints.CHUNK + 300)
    for raw in (noise, again):
        for n in (-40, -1, 0, 1, 17, 47, 300):
            text = raw[: fingerprints.CHUNK + n]
            assert np.array_equal(fingerprints.features(text), fingerprints.features(text, 1 << 40))


def plain_digest(text):
    """Features, filters and their counts, bit by bit, in whole numbers."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return [0], [set()]
    if len(raw) < fingerprints.WINDOW:
        hashes = [int.from_bytes(hashlib.sha256(raw.tobytes()).digest()[:8], "little")]
    else:
        hashes = []
        for at in plain_places(raw):
            h = 0
            for b in raw[at : at + fingerprints.WINDOW].tolist():
                h = (h * 0x100000001B3 + b) % (1 << 64)
            h = int(mix64(np.array([h], dtype=np.uint64))[0])
            if h not in hashes:
                hashes.append(h)
    chain = [hashes[i : i + fingerprints.PER_FILTER] for i in range(0, len(hashes), fingerprints.PER_FILTER)] or [[]]
    return [len(c) for c in chain], [{(h >> (11 * k)) % fingerprints.FILTER_BITS for h in c for k in range(fingerprints.PROBES)} for c in chain]


def plain_likeness(a, b):
    (ca, fa), (cb, fb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not sum(ca) or not sum(cb):
        return float(sum(ca) == sum(cb))
    if fa == fb:
        return 1.0
    total = 0.0
    for n, own in zip(ca, fa):
        scores = []
        for other in fb:
            most, chance = min(len(own), len(other)), len(own) * len(other) / fingerprints.FILTER_BITS
            floor = chance + fingerprints.CUTOFF * (most - chance)
            scores.append(min(1.0, max(0.0, (len(own & other) - floor) / (most - floor))) if most > floor else 0.0)
        total += n * max(scores)
    return min(1.0, total / sum(ca))


def test_whole_query_against_plain_python(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghiäß 1"), int(rng.integers(1, 9)))) for _ in range(90)]
    texts = [" ".join(rng.choice(words, int(n))) for n in (0, 1, 3, 9, 30, 90, 400, 90, 30)] + ["", None, "x" * 500]
    texts += [texts[6], texts[6] + " and more"]
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(40, "another text of id 40"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_bucket", F.lit(7)).withColumn("fingerprint", F.lit("x"))
    tie = {r.t: r.h for r in df.select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]], r[1] or ""))
    got = {(r.doc_id, r.n_chars): r for buckets in (1, 4) for r in fingerprints.compare_neighbours(df, buckets).collect()}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        new = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, other, following = map(plain_digest, (t, new, after))
        r = got[i, len(t)]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        for text, said in ((own, r.fingerprint), (other, r.edited_fingerprint)):
            packed, counts = fingerprints.from_string(said)
            assert counts.tolist() == text[0] and [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in packed] == text[1]
        assert abs(r.near_edited - plain_likeness(own, other)) < 1e-9 and abs(r.near_next - plain_likeness(own, following)) < 1e-9

"""Repeated passages against a plain scan of all windows, and odd rows."""

import hashlib
import random

import numpy as np
import pytest

from foliant.llm import queries, substrings

SF = "/root/testdata/sf0.01"


def brute(docs):
    """The contract for distinct ids: a dictionary of the first start of every window."""
    first, out = {}, {}
    split = sorted((d, (t or "").encode().split()) for d, t in docs if d is not None)
    for d, words in split:
        keep = [True] * len(words)
        for i in range(len(words) - 19):
            if first.setdefault(tuple(words[i : i + 20]), (d, i)) < (d, i):
                keep[i : i + 20] = [False] * 20
        out[d] = (len(words), keep.count(False), hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest())
    return out


def results(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_whole_table_equals_a_scan(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = results(queries.op11_substrings(spark, SF))
    assert got == brute(docs) and sum(r[1] for r in got.values()) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_few_words_many_repeats(spark, seed):
    """Small vocabularies: periods, overlaps, passages that begin and end anywhere, copies with one word changed."""
    rng = random.Random(seed)
    docs, base = [], [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(300)]
    for i in range(60):
        a = rng.randrange(250)
        words = base[a : a + rng.randrange(10, 120)] + [str(rng.random())] * rng.randrange(3) + ["x", "y"] * rng.randrange(30)
        if words and rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(100, "z " * 500), (101, "z " * 19), (102, "z " * 20), (103, docs[5][1]), (-4, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert results(substrings.kept_words(df)) == brute(docs)


def test_odd_rows(spark):
    long = "word wörd x\x1cy " * 20_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (None, long), (6, "a"), (7, "one two three " * 10), (7, "one two three " * 10)]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "doc_id long, text string, n int, start int, gone string")
    got = substrings.kept_words(df).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] != 7])
    for r in got:
        if r.doc_id in want:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    lone = next(r for r in got if r.doc_id is None)
    assert (lone.n_words, lone.n_removed) == (40_000, 0)
    # equal rows of one id fare alike: only what repeats inside goes
    assert [(r.n_words, r.n_removed) for r in got if r.doc_id == 7] == [(30, 27)] * 2
    assert substrings.kept_words(df.limit(0)).count() == 0


def test_pieces_of_a_long_text_are_its_words(monkeypatch):
    text = " ".join(str(i) * (i % 7 + 1) for i in range(2000)) + "  end\t"
    whole = text.encode().split()
    monkeypatch.setattr(substrings, "PIECE", 97)
    assert [w for p in substrings.pieces(text) for w in p] == whole
    assert np.diff(substrings.hashed([text, "", "a b"])[2]).tolist() == [len(whole), 0, 2]


def test_a_false_source_removes_nothing():
    """The second hash decides: a span that only the first hash calls equal stays."""
    start, n, check = np.array([0]), np.array([1]), np.array([12345])
    assert substrings.covered("w " * 25, start, n, check).all()

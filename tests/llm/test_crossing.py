"""Aligned tokens against whole texts encoded by both libraries, and odd rows."""

import hashlib
from collections import Counter, defaultdict

import pytest

from foliant.llm import crossing, queries
from foliant.llm.bpe import byte_chars

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return [public_tokenizers.path(name) for name in queries.PAIR]


def brute(docs, paths):
    """Whole texts, all pairs by their offsets, counted in one dictionary."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_model.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_chars())}
    holders, rows = Counter(), []
    for d, text in docs:
        row = None
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_raw = [bytes(byte_of[c] for c in a_model.id_to_token(i)) for i in a]
            b_raw = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_raw) == b"".join(b_raw) == f" {text}".encode():
                a_at, b_at = [0], [0]
                for raw, at in ((a_raw, a_at), (b_raw, b_at)):
                    for token in raw:
                        at.append(at[-1] + len(token))
                owner = [j for j, token in enumerate(b_raw) for _ in token]
                links = [(x, b[j]) for i, x in enumerate(a) for j in sorted(set(owner[a_at[i] : a_at[i + 1]]))]
                both, groups = sorted({*a_at} & {*b_at}), []
                for lo, hi in zip(both, both[1:]):
                    groups.append("|".join(",".join(str(x) for x, s in zip(ids, at) if lo <= s < hi) for ids, at in ((a, a_at), (b, b_at))))
                holders.update(set(links))
                row = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        rows.append((d, row))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    return Counter(
        (d, 0, 0, 0, 0, 0, 0, "") if r is None else (d, *r[:3], len(r[3]), sum(holders[p] == most[p[0]] for p in r[3]), sum(holders[p] for p in r[3]), r[4]) for d, r in rows
    )


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def results(df):
    return Counter(tuple(r) for r in df.select(*NAMES).collect())


def short(docs):
    return [(d, t) for d, t in docs if len(t or "") < 20_000]  # the plain version takes long over long texts


def test_whole_table_equals_plain_alignment(spark, paths):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    if len(short(docs)) == len(docs):
        assert results(queries.op12_alignment(spark, SF)) == brute(docs, paths)
    else:
        df = spark.createDataFrame(short(docs), "doc_id long, text string")
        assert results(crossing.alignments(df, *paths)) == brute(short(docs), paths)


ODD = [(1, None), (2, ""), (3, " "), (4, "a  b\t\tc\n\n d\r\n;\r x"), (5, "<|endoftext|> <s> </s><unk>"), (6, "日本語 テスト　全角 ▁▁ x"), (7, "▁a"), (8, "é́ \x1c x\x85y​ z    q"), (None, "no id here"), (9, "same text"), (9, "same text"), (10, "word " * 3000), (11, "x" * 5000), (12, " lead and trail  "), (13, "don't it's 12 345 !!! ...\n"), (14, "\x00 nul"), (15, "🎉🎉 emoji  🎉 ﻿bom")]


def test_odd_rows(spark, paths):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in ODD], "doc_id long, text string, segment string, block int, count int")
    assert results(crossing.alignments(df, *paths)) == brute(ODD, paths)
    assert crossing.alignments(df.limit(0), *paths).count() == 0


def test_small_blocks_and_pieces_change_nothing(spark, paths, monkeypatch):
    """Blocks of a few characters, cut in this process: the same codes spell the same texts."""
    both = crossing.codec(*paths)
    monkeypatch.setattr(crossing, "PIECE_CHARS", 50)
    for _, text in ODD:
        parts = [s for p in both.segments(text or "") for s in p]
        assert "".join(parts) == (" " + text if text else "")
        assert parts == (both.find(" " + text) if text else [])


def test_cuts_are_verified_on_the_vocabularies(paths):
    both = crossing.codec(*paths)
    assert " " in both.cuts and "\r" not in both.cuts  # ";\r" is a piece of B


def test_packed_numbers_come_back():
    import numpy as np

    for values in ([], [0], [1, 2**31, 255, 256]):
        assert crossing.unpack(crossing.pack(np.array(values, np.uint32))).tolist() == values

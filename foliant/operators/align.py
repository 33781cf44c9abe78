"""Sequence alignment and joins of text parts that SQL cannot express; Arrow-batched."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over the shorter text."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


# What an exact comparison may take, in bytes and in pairs of equal characters.
MASK_BYTES, PAIRS, PAIR_BYTES = 64 << 20, 10_000_000, 16 << 20


def sparse_lcs_length(a: str, b: str) -> int:
    """The same by places: for each character of the longer text its places in the shorter one, from the last, extend the
    tails of increasing runs.  Its time goes with the pairs of equal characters."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, list[int]] = {}
    for i in reversed(range(len(b))):
        where.setdefault(b[i], []).append(i)
    tails: list[int] = []
    for c in a:
        for i in where.get(c, ()):
            at = bisect_left(tails, i)
            tails[at : at + 1] = [i]
    return len(tails)


def comparison(baseline: str, tagged: str, mask_bytes: int = MASK_BYTES, pairs: int = PAIRS, pair_bytes: int = PAIR_BYTES) -> tuple[float | None, str]:
    """(share of the baseline that a longest common subsequence covers, how it was found): by masks if they fit, else by
    places if there are few enough pairs; a comparison that neither can do exactly is told as beyond_limits, with no share.

    An empty baseline is covered by an empty text and by no other."""
    short, long = sorted((baseline, tagged), key=len)
    counts = Counter(short)
    if len(counts) * (len(short) // 8 + 64) <= mask_bytes:
        n, how = lcs_length(long, short), "masks"
    elif sum(counts[c] for c in long) <= pairs and 48 * len(short) <= pair_bytes:
        n, how = sparse_lcs_length(long, short), "places"
    else:
        return None, "beyond_limits"
    return (n / len(baseline) if baseline else float(not tagged)), how


@pandas_udf(StructType([StructField("ratio", DoubleType()), StructField("mode", StringType())]))
def match_ratios(baseline: pd.Series, tagged: pd.Series) -> pd.DataFrame:
    """(ratio, mode) of two texts as measured; a null text is empty."""
    return pd.DataFrame([comparison(x or "", y or "") for x, y in zip(baseline, tagged)], columns=["ratio", "mode"])


@pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / total length; two empty texts are equal (1)."""

    def one(x: str | None, y: str | None) -> float:
        x, y = x or "", y or ""
        return 2 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


# What a text may end or begin with for a space to be put between two of them.
CLOSES = re.compile(r"[\w)\]}]")
OPENS = re.compile(r"[\w(\[{]")


def is_wide_letter(c: str) -> bool:
    return c.isalnum() and unicodedata.east_asian_width(c) in ("W", "F")


def seam(last: str, first: str) -> str:
    """What is done where a text that ends in `last` meets one that begins with `first` (either may be empty).

    White space there becomes one space; a space is put between a word or closing bracket and a word or opening bracket,
    unless both are wide letters, which stay adjacent, as does all else."""
    if last.isspace():
        return "normalize_existing_space"
    if first.isspace():
        return "trim_left"
    wordlike = CLOSES.match(last) and OPENS.match(first) and not (is_wide_letter(last) and is_wide_letter(first))
    return "insert_space" if wordlike else "keep_adjacent"


def joined(parts: list[str]) -> tuple[str, list[str]]:
    """Text parts as one string, and what was done at each seam.  Linear in the text: parts are put together once."""
    out, done = parts[:1], []
    for part in parts[1:]:
        while out and not out[-1]:
            out.pop()
        what = seam(out[-1][-1] if out else "", part[:1])
        done.append(what)
        if what == "normalize_existing_space":
            while out and not (bare := out[-1].rstrip()):
                out.pop()
            out[-1:] = [bare] if out else []
        out += [part] if what == "keep_adjacent" else [" ", part if what == "insert_space" else part.lstrip()]
    return "".join(out), done


SEAMS = ArrayType(StructType([StructField("boundary", IntegerType()), StructField("action", StringType())]))


@pandas_udf(StructType([StructField("joined", StringType()), StructField("actions", SEAMS)]))
def join_parts(parts: pd.Series) -> pd.DataFrame:
    """(joined, actions): the joined text, and each seam (boundary from 0) with what was done there.  A null part is empty."""
    rows = [joined(["" if x is None else str(x) for x in p] if p is not None else []) for p in parts]
    return pd.DataFrame({"joined": [r[0] for r in rows], "actions": [[{"boundary": i, "action": a} for i, a in enumerate(r[1])] for r in rows]})

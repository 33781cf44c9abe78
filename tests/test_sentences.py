"""Sentence offsets against a version that looks at one terminator at a time, on all documents and on odd mixtures."""

import random
import unicodedata

import pytest

from foliant.operators import sentences

SF = "/root/testdata/sf0.01"


def joined(c):
    return c.isalnum() or c == "_"


def closes(c):
    return c in sentences.CLOSING or unicodedata.category(c) in ("Pe", "Pf")


def opens(c):
    return c in sentences.OPENING or unicodedata.category(c) in ("Ps", "Pi")


def skip(text, i, step, when):
    while 0 <= i < len(text) and when(text[i]):
        i += step
    return i


def letter_stop(text, i):
    """Where a single letter with marks and a full stop ends, if one begins at i."""
    if not (0 <= i < len(text) and text[i].isalpha()):
        return None
    j = skip(text, i + 1, 1, lambda c: unicodedata.category(c)[0] == "M")
    return j + 1 if j < len(text) and text[j] == "." else None


def initial_stop(text, i):
    return 0 < i < len(text) and text[i] == "." and text[i - 1].isalpha() and text[i - 1].isupper() and not (i > 1 and joined(text[i - 2]))


def address_end(text, start, end):
    while end > start and closes(text[end - 1]) and (text[end - 1] != ")" or text.count(")", start, end) > text.count("(", start, end)):
        end -= 1
    return end - len(text[start:end]) + len(text[start:end].rstrip(".,!?;:"))


def plain_starts(text):
    held = set()
    for m in sentences.URL.finditer(text):
        held.update(range(m.start(), address_end(text, *m.span())))
    for pattern in (sentences.EMAIL, sentences.DOTTED_LETTERS):
        for m in pattern.finditer(text):
            held.update(range(*m.span()))
    for m in sentences.DOTTED_WORD.finditer(text):
        a, *rest = m[0].split(".")
        if len(rest) > 1 or any(c.isdigit() for c in m[0]) or (a.isalpha() and rest[0].isalpha() and len(rest[0]) >= 2 and rest[0] == rest[0].upper() and rest[0].isupper()):
            held.update(range(*m.span()))
    for i, c in enumerate(text):
        if letter_stop(text, i) and not (i and joined(text[i - 1])):
            ends = [letter_stop(text, i)]
            while (j := skip(text, ends[-1], 1, str.isspace)) > ends[-1] and letter_stop(text, j):
                ends.append(letter_stop(text, j))
            if len(ends) > 1:
                held.update(range(i, ends[-1]))
        if c != ".":
            continue
        if 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit():
            held.add(i)
        a = skip(text, i - 1, -1, str.isalpha) + 1
        word, after = text[a:i], skip(text, i + 1, 1, str.isspace)
        if 1 <= len(word) <= 3 and not (a and joined(text[a - 1])):
            if len(word) > 1 and word[0].isupper() and all(x.islower() for x in word[1:]):
                held.add(i)
            if len(word) == 1 and unicodedata.category(word) == "Lo" and text[after : after + 1].isdigit():
                held.add(i)
        if initial_stop(text, i):
            if initial_stop(text, after + 1):
                held |= {i, after + 1}
            elif text[after : after + 1].isupper():
                b = skip(text, i - 2, -1, str.isspace)
                if b < 0 or not text[b].isdigit():
                    held.add(i)
    out = []
    for i, c in enumerate(text):
        if c in ".!?" and i not in held:
            s = skip(text, skip(text, i + 1, 1, closes), 1, str.isspace)
            first = text[skip(text, s, 1, opens) :][:1]
            if first and (first.isupper() or first.isdigit() or unicodedata.category(first) == "Lo"):
                out.append(s)
    return out


@pytest.mark.parametrize("text, starts", [
    ("Press it. Then wait! Ok? 3 times.", ["Then", "Ok? ", "3 ti"]), ("See www.a.org/x(1). Now mail a.b@c.de. Done", ["Now ", "Done"]), ("z. B. heute. Morgen", ["Morg"]), ("Dr. Who met J. R. Smith. He left.", ["He l"]),
    ("Use 5 V. Then 3.5 m. Stop", ["Then", "Stop"]), ('He said "no." “Yes.” (Maybe.) End', ["“Yes", "End"]), ("これ. それ. 終", ["それ. ", "終"]), ("file.TXT is v1.2.3. Good", ["Good"]), ("", []), ("...", []),
])
def test_known_starts(text, starts):
    got = [text[i : i + 4] for i in sentences.sentence_starts(text)]
    assert got == plain_text(text) and got == [s[:4] for s in starts]


def plain_text(text):
    return [text[i : i + 4] for i in plain_starts(text)]


def test_every_document(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert len({t[:1] for t in texts}) > 5
    for t in texts[:400]:
        assert sentences.sentence_starts(t) == plain_starts(t)


def test_odd_mixtures():
    rng = random.Random(11)
    parts = [*". . . ! ? ABab12_-(\"'”»«“’) \t\n日ªǅⅧⒶ²́ é@:/", "www.", "http://", "a.b", "Dr", "x@y.z", "e.g.", "TXT", " "]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert sentences.sentence_starts(text) == plain_starts(text), text


def test_nulls_and_long_texts(spark):
    long = "Sentence number one ends here. " * 20_000
    rows = spark.createDataFrame([(1, None), (2, ""), (3, long)], "i int, text string").select("i", sentences.sentence_offsets("text").alias("s")).collect()
    assert [len(r.s) for r in sorted(rows)] == [0, 0, 19_999]

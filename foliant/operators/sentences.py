"""Where sentences start in a text of any script, as offsets.

A text is first written as its shape, one letter for the class of each character; what shields a terminator is then a few
patterns over the shape, or over the text where the very characters matter.  Python runs in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

# Terminators, characters that open or close whatever their category, and patterns of addresses and dotted words.
TERMINATORS = ".!?"
OPENING, CLOSING = "\"'“‘«‹([{", "\"'”’»›)]}"
URL = re.compile(r"\b(?:https?://|www\.)[^\s<>{}\[\]]+", re.IGNORECASE)
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
DOTTED_WORD = re.compile(r"(?<![\w-])[\w-]+(?:\.[\w-]+)+")
DOTTED_LETTERS = re.compile(r"(?<!\w)(?:[^\W\d_]\.){2,}")
URL_TAIL = ".,!?;:"


class Shapes(dict):
    """The class of a character, by its number.

    . a full stop, ! another terminator, space, Q quote that opens and closes, P other opening, C other closing, M mark,
    U upper-case letter, L lower-case letter, B one without case that counts as lower-case, O other letter without case,
    A other letter, V numeral that is upper-case, Y symbol that is upper-case, D digit, N other numeral, _, and x for the rest."""

    def __missing__(self, number: int) -> str:
        self[number] = shape = self._of(chr(number))
        return shape

    @staticmethod
    def _of(c: str) -> str:
        kind = unicodedata.category(c)
        opens, closes = c in OPENING or kind in ("Ps", "Pi"), c in CLOSING or kind in ("Pe", "Pf")
        if c in TERMINATORS:
            return "." if c == "." else "!"
        if opens or closes:
            return "Q" if opens and closes else "P" if opens else "C"
        if c.isspace() or c == "_":
            return " " if c != "_" else "_"
        if c.isalpha():
            if kind == "Lo":
                return "B" if c.islower() else "O"
            return "U" if c.isupper() else "L" if c.islower() else "A"
        if c.isdigit():
            return "D"
        if c.isupper():
            return "V" if c.isalnum() else "Y"
        return "N" if c.isalnum() else "M" if kind[0] == "M" else "x"


SHAPES = Shapes()
_alone = r"(?<![ULBOAVDN_])"  # no letter, numeral or underscore stands before
#: Stretches of the shape in which full stops end no sentence.
SHIELDS = [
    regex.compile(pattern)
    for pattern in (
        rf"{_alone}[ULBOA]M*\.(?: +[ULBOA]M*\.)+",  # single letters with stops, spaced
        r"(?<=D)\.(?=D)",  # a decimal
        rf"{_alone}U[LB]{{1,2}}\.",  # a short word set like a title
        rf"{_alone}[OB]\.(?= *D)",  # a letter without case before a digit
        rf"{_alone}U\.(?: *U\.)+",  # initials
        rf"{_alone}(?<!D *)U\.(?= *[UVY])",  # an initial before a name, but not a unit behind a digit
    )
]
START = regex.compile(r"[CQ]*+ *+(?=[PQ]*+[UVYDOB])")


def url_length(url: str) -> int:
    """How much of a match is the address: not the brackets and quotes that close something outside it, nor marks behind."""
    n, surplus = len(url), url.count(")") - url.count("(")
    while n and SHAPES[ord(url[n - 1])] in "CQ":
        if url[n - 1] == ")":
            if surplus <= 0:
                break
            surplus -= 1
        n -= 1
    return len(url[:n].rstrip(URL_TAIL))


def is_code(word: str) -> bool:
    """Whether the stops in a dotted word belong to it: several of them, a digit in it, or an ending in capitals."""
    parts = word.split(".")
    capital_ending = len(parts) == 2 and parts[0].isalpha() and parts[1].isalpha() and len(parts[1]) > 1 and parts[1].isupper()
    return len(parts) > 2 or capital_ending or any(c.isdigit() for c in word)


def shielded(text: str, shape: str) -> np.ndarray:
    """For each character whether it stands where terminators end no sentence."""
    spans = [(m.start(), m.start() + url_length(m[0])) for m in URL.finditer(text)]
    spans += [m.span() for pattern in (EMAIL, DOTTED_LETTERS) for m in pattern.finditer(text)]
    spans += [m.span() for m in DOTTED_WORD.finditer(text) if is_code(m[0])]
    spans += [m.span() for pattern in SHIELDS for m in pattern.finditer(shape)]
    depth = np.zeros(len(text) + 1, np.int32)
    for start, end in spans:
        depth[start] += 1
        depth[end] -= 1
    return depth.cumsum()[:-1] > 0


def sentence_starts(text: str) -> list[int]:
    """Offsets at which a sentence starts behind the end of another one.

    Behind a terminator that nothing shields, closing marks and white space are passed over; there a sentence starts, if an
    upper-case letter, a digit or a letter of a script without case comes next, behind opening marks or not."""
    if not text:
        return []
    shape = text.translate(SHAPES)
    hidden = shielded(text, shape)
    ends = (m.start() + 1 for m in re.finditer(r"[.!]", shape))
    return [m.end() for m in (START.match(shape, e) for e in ends if not hidden[e - 1]) if m]


@pandas_udf(ArrayType(IntegerType()))
def sentence_offsets(texts: pd.Series) -> pd.Series:
    """The starts of each text; a null text has none."""
    return pd.Series([sentence_starts(t or "") for t in texts])

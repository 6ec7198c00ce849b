"""Text functions as column expressions; only Unicode normalisation and segmentation need Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

BLANKS = r"\p{IsWhite_Space}+"
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: str | Column) -> Column:
    """The pieces between blanks (of any Unicode kind)."""
    return F.filter(F.split(col(c), BLANKS), lambda w: w != "")


def tokens_cased(c: str | Column) -> Column:
    return F.filter(F.split(col(c), NOT_WORD), lambda w: w != "")


def tokens(c: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.transform(tokens_cased(c), F.lower)


def index_tokens(c: str | Column) -> Column:
    """What the lexical index holds: lower-case runs of letters and digits of more than one byte."""
    return F.filter(F.split(F.lower(col(c)), NOT_WORD), lambda w: F.octet_length(w) > 1)


def word_count(c: str | Column) -> Column:
    return F.size(words(c))


def estimated(n: Column) -> Column:
    """Model tokens of so many words: 1.3 each in single precision, rounded down."""
    return F.floor(n.cast("float") * F.lit(1.3).cast("float")).cast("int")


def estimate_tokens(c: str | Column) -> Column:
    return estimated(word_count(c))


def words_for(tokens_: int) -> int:
    """Words that so many model tokens have room for."""
    import numpy as np

    return int(np.float32(tokens_) / np.float32(1.3))


def truncate_to_tokens(c: str | Column, most: int) -> Column:
    """The first words if there are more than the tokens have room for, with an ellipsis; else the text as it is."""
    w, m = words(c), words_for(most)
    return F.when(F.size(w) > m, F.concat(F.array_join(F.slice(w, 1, m), " "), F.lit("..."))).otherwise(col(c))


def collapse(c: str | Column) -> Column:
    return F.array_join(words(c), " ")


def collapse_ends(c: str | Column) -> Column:
    """Without blanks (spaces, tabs and line ends) at either end."""
    return F.rtrim(F.ltrim(col(c), F.lit(" \t\r\n")), F.lit(" \t\r\n"))


def drop_control(c: str | Column) -> Column:
    """Without control characters, but for blanks."""
    return F.regexp_replace(col(c), r"[\p{Cc}&&[^\p{IsWhite_Space}]]", "")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


def normalize(c: str | Column) -> Column:
    """Composed, without zero-width characters, blanks collapsed and trimmed."""
    return collapse(F.regexp_replace(nfc(col(c)), "[\\u200B\\u200C\\u200D\\uFEFF]", ""))


_X = r"[\p{SB=Extend}\p{SB=Format}]*"
#: An end mark with what belongs to it, up to where a sentence may end; or the end of a paragraph.
_END = regex.compile(rf"(?P<before>[\p{{SB=Upper}}\p{{SB=Lower}}]{_X})?(?P<mark>[\p{{SB=STerm}}\p{{SB=ATerm}}]){_X}(?P<close>(?:\p{{SB=Close}}{_X})*)(?P<blank>(?:\p{{SB=Sp}}{_X})*)(?P<par>\r\n|\p{{SB=Sep}}|\p{{SB=CR}}|\p{{SB=LF}})?|(?P<only>\r\n|\p{{SB=Sep}}|\p{{SB=CR}}|\p{{SB=LF}})")
_ATERM = regex.compile(r"\p{SB=ATerm}")
_NUMERIC, _UPPER = regex.compile(r"\p{SB=Numeric}"), regex.compile(r"\p{SB=Upper}")
_GOES_ON = regex.compile(r"[\p{SB=SContinue}\p{SB=STerm}\p{SB=ATerm}]")
_LOWER_AHEAD = regex.compile(r"[^\p{SB=OLetter}\p{SB=Upper}\p{SB=Lower}\p{SB=Sep}\p{SB=CR}\p{SB=LF}\p{SB=STerm}\p{SB=ATerm}]*\p{SB=Lower}")


def split_sentences(text: str) -> list[str]:
    """The sentences of a text by the default rules of Unicode's annex 29; joined they give the text again."""
    out, begin, at = [], 0, 0
    while m := _END.search(text, at):
        at = end = m.end()
        if m.group("only") is None and m.group("par") is None:
            full, here = _ATERM.match(m.group("mark")), end < len(text)
            bare = not m.group("close") and not m.group("blank")
            if here and full and bare and (_NUMERIC.match(text, end) or (m.group("before") and _UPPER.match(text, end))):
                continue
            if here and full and _LOWER_AHEAD.match(text, end):
                continue
            if here and _GOES_ON.match(text, end):
                continue
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]] if begin < len(text) else out


@F.pandas_udf(ArrayType(StringType()))
def sentences(s: pd.Series) -> pd.Series:
    """Sentences with the blanks that follow them; joined they give the text again."""
    return s.map(lambda x: split_sentences(x) if x else [], na_action="ignore")


def sentences_filtered(c: str | Column) -> Column:
    """The trimmed sentences that aren't blank."""
    return F.filter(F.transform(sentences(col(c)), collapse_ends), lambda x: x != "")


def sentence_pieces(c: str | Column) -> Column:
    """The plain form: pieces after an end mark and blanks, without empty ones."""
    return F.filter(F.split(col(c), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def wrap(c: str | Column, width: int) -> Column:
    """Greedy lines of at most so many bytes; longer words stand alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        fits = F.octet_length(acc["line"]) + F.octet_length(w) + 1 <= width
        empty = acc["line"] == ""
        return F.struct(
            F.when(empty | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"),
            F.when(empty, w).when(fits, F.concat(acc["line"], F.lit(" "), w)).otherwise(w).alias("line"),
        )

    return F.aggregate(words(c), start, step, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["line"]))))

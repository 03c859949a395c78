"""Text analysis as Column expressions: fields to text, text to terms, term keys.

Everything here but json_field_text is built-in functions, so it stays in the
JVM and inside the plans that Catalyst sees.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of scripts that the Unicode rules part one by one, each with its marks; names of scripts differ by engine.
_ALONE = ("Han", "Hiragana", "Thai", "Lao", "Khmer", "Myanmar")
_ONE = "[" + "".join(rf"\p{{{x}}}" for x in _ALONE) + "]"
_JOIN = r"[\p{M}\p{Cf}]"
LETTERS = rf"(?:[^\P{{L}}{_ONE[1:-1]}]|{_JOIN})"
#: Word segments by the Unicode text segmentation rules for letters, digits and what may join them.
WORD = (
    rf"_*(?:{LETTERS}+(?:[.'’:·]{LETTERS}+)*|\p{{N}}[\p{{N}}\p{{M}}\p{{Cf}}]*(?:[.,;'’]\p{{N}}[\p{{N}}\p{{M}}\p{{Cf}}]*)*)"
    rf"(?:(?:{LETTERS}+(?:[.'’:·]{LETTERS}+)*|\p{{N}}[\p{{N}}\p{{M}}\p{{Cf}}]*(?:[.,;'’]\p{{N}}[\p{{N}}\p{{M}}\p{{Cf}}]*)*)|_+)*"
    rf"|{_ONE}{_JOIN}*"
)
#: The same language for the JVM: no part of a segment can be given back, so nothing is tried twice.
_J_ONE = "[" + "".join(rf"\p{{Is{x}}}" for x in _ALONE) + "]"
_J_LETTER = rf"[[\p{{L}}&&[^{_J_ONE[1:-1]}]]\p{{M}}\p{{Cf}}]"
_J_DIGITS = r"\p{N}[\p{N}\p{M}\p{Cf}]*+(?:[.,;'’]\p{N}[\p{N}\p{M}\p{Cf}]*+)*+"


def _j_word(letter: str) -> str:
    letters = rf"{letter}++(?:[.'’:·]{letter}++)*+"
    return rf"_*+(?:{letters}|{_J_DIGITS})(?:{letters}|{_J_DIGITS}|_++)*+"


JVM_WORD = rf"{_j_word(_J_LETTER)}|{_J_ONE}{_JOIN}*+"
#: The same for a text without letters of those scripts, three times as fast: the scripts needn't be looked up.
PLAIN_WORD = _j_word(r"[\p{L}\p{M}\p{Cf}]")
#: Where those scripts may be: beyond other alphabets, but not among punctuation, symbols, private letters, forms and emoji.
_J_BLOCKS = r"[\x{E00}-\x{1FFF}\x{2C00}-\x{D7FF}\x{F900}-\x{FAFF}\x{10000}-\x{1F2FF}\x{20000}-\x{10FFFF}]"


#: A text of Latin-1 and common marks alone, and the same words of it: single letters are looked up as bits, and no part needs a category.
_J_LATIN = r"\A[\x00-\xFF\x{2010}-\x{2027}\x{20AC}]*\z"
_L_LETTER = "[" + "".join(chr(c) for c in range(256) if c == 0xAD or chr(c).isalpha()) + "]"
_L_DIGITS = "[0123456789²³¹¼½¾][0123456789²³¹¼½¾\xad]*"
_L_DIGITS = rf"{_L_DIGITS}(?:[.,;'’]{_L_DIGITS})*+"
_L_LETTERS = rf"{_L_LETTER}+(?:[.'’:·]{_L_LETTER}+)*+"
LATIN_WORD = rf"_*+(?:{_L_LETTERS}|{_L_DIGITS})(?:{_L_LETTERS}|{_L_DIGITS}|_++)*+"


def _by_script(text: Column, cut: Callable[[str], Column], latin: Callable[[str], Column] | None = None) -> Column:
    return F.when(text.rlike(_J_LATIN), (latin or cut)(LATIN_WORD)).when(text.rlike(_J_BLOCKS), cut(JVM_WORD)).otherwise(cut(PLAIN_WORD))


def words(text: Column) -> Column:
    """The words of a text in order, as they are written."""
    return _by_script(text, lambda word: F.regexp_extract_all(text, F.lit(word), F.lit(0)))


def gaps(text: Column) -> Column:
    """What stands before each word, and after the last: one more than words."""
    return _by_script(text, lambda word: F.split(text, word, -1))


def terms(text: Column) -> Column:
    """The words of a text in order, in lower case.  No stemming, stop words or accent folding.

    Latin letters have small ones of their own, whatever stands beside them, so such a text is put in lower case at once.
    """
    found = lambda rows, word: F.regexp_extract_all(rows, F.lit(word), F.lit(0))
    return _by_script(text, lambda word: F.transform(found(text, word), F.lower), lambda word: found(F.lower(text), word))


def trigrams(term: Column) -> Column:
    """Character trigrams of a term between $ marks, in order, repeats kept; none for an empty term."""
    marked = F.concat(F.lit("$"), term, F.lit("$"))
    each = F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substring(marked, i, 3))
    return F.when(F.length(term) > 0, each).otherwise(F.array().cast("array<string>"))


def soundex(term: Column) -> Column:
    """A phonetic code: the first letter, and up to three digits for the sounds that follow.

    Unlike the built-in soundex, the first letter stays in its case and takes no
    part in collapsing, vowels and h, w and y part repeats, and a single
    character stands for itself.
    """
    rest = F.regexp_replace(F.substring(term, 2, 2**31 - 1), "[^a-z]", "0")
    codes = F.translate(rest, "aeiouhwybfpvcgjkqsxzdtlmnr", "00000000111122222222334556")
    codes = F.replace(F.regexp_replace(codes, r"(.)\1+", "$1"), F.lit("0"), F.lit(""))
    return F.when(F.length(term) <= 1, term).otherwise(F.concat(F.substring(term, 1, 1), F.rpad(codes, 3, "0")))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance in characters; with most, -1 where it is greater."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def _strings(value: Column, kind: T.DataType) -> Column:
    """All strings within a value in order, fields of a structure or map by name."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        found = F.array(value)
    elif isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(value, lambda x: _strings(x, kind.elementType)))
    elif isinstance(kind, T.StructType):
        inner = [_strings(value[f.name], f.dataType) for f in sorted(kind.fields, key=lambda f: f.name)]
        found = F.concat(*inner) if inner else none
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        found = F.flatten(F.transform(entries, lambda e: _strings(e["value"], kind.valueType)))
    else:
        return none
    return F.coalesce(F.when(value.isNotNull(), found), none)


def field_text(docs: DataFrame, field: str) -> Column:
    """The text of a top-level field: its strings, however deep, joined by blanks.

    A null or missing field has empty text.  Numbers, booleans and nulls give
    nothing.  Strings aren't trimmed.
    """
    kind = {f.name: f.dataType for f in docs.schema.fields}.get(field)
    return F.lit("") if kind is None else F.array_join(_strings(docs[field], kind), " ")


def _walk(value: Any) -> list[str]:
    out, rest = [], [value]
    while rest:
        x = rest.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            rest.extend(reversed(x))
        elif isinstance(x, dict):
            rest.extend(x[k] for k in sorted(x, reverse=True))
    return out


def json_field_text(document: Column, field: str) -> Column:
    """field_text for a column of JSON strings of any depth, for which no schema is known.

    What isn't a JSON object has empty text.
    """

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        def one(raw: str | None) -> str:
            try:
                found = json.loads(raw) if raw else None
            except (ValueError, RecursionError):
                return ""
            return " ".join(_walk(found.get(field))) if isinstance(found, dict) else ""

        return column.map(one, na_action=None)

    return run(document)

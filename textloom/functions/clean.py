"""Cleaning of OCR text, as expressions; only the rejoining of split words needs Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that are never a fragment, and prefixes that get stuck to the next word, in the order of their tests.
WHOLE_WORDS = "the and that with from this they have been are was were will clean clear can for not but all has".split()
PREFIXES = "between within without through around before after under over about above below inside outside into onto upon towards toward".split()

_CONSONANTS, _VOWELS = "bcdfghjklmnpqrstvwxyz", "aeiouy"
_SPLITS = [
    re.compile(rf"\b([a-z]+[{_CONSONANTS}])\s+([aeiouy][a-z]{{2,}})\b", re.I),
    re.compile(rf"\b([a-z]+[{_VOWELS}])\s+([{_CONSONANTS}][a-z]{{2,}})\b", re.I),
]


def without_page_numbers(text: Column) -> Column:
    def stays(line: Column) -> Column:
        s = F.regexp_replace(line, r"^\s+|\s+$", "")
        return (s == "") | ~(s.rlike(r"^\d{1,5}$") | s.rlike(r"(?i)^(?:page\s+)?\d+\s*[|\-]?$") | s.rlike(r"^\d+(\s+\d+){3,}$"))

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def fixed_spacing(text: Column) -> Column:
    for _ in range(3):
        text = F.regexp_replace(text, r"(\d+)\s+\.\s+(\d+)", "$1.$2")
    for _ in range(3):
        text = F.regexp_replace(text, r"(\d+)\s+\.\s+([A-Z])", "$1. $2")
    return F.regexp_replace(F.regexp_replace(text, r"([^\n]) {2,}", "$1 "), r"([^\n])\s+([.,;:!?])", "$1$2")


def fixed_characters(text: Column) -> Column:
    for digit, letter in (("1", "l"), ("0", "o")):
        # a run of any length: its last digit marks the word, then each digit before a letter so made follows
        text = F.regexp_replace(text, rf"(?<=[a-z]{{3}}){digit}(?={digit}*\b)", "\u0002")
        text = F.regexp_replace(text, rf"\G(?!^){digit}|\u0002", letter)
    return F.regexp_replace(F.regexp_replace(text, r"(?U)(\w)[!/\\|](\w)", "$1$2"), r"(?U)(\w)!([A-Z])", "$1$2")


def _joined(m: re.Match) -> str:
    a, b = m.groups()
    apart = len(a) < 2 or len(b) < 3 or len(a) > 6 or a.lower() in WHOLE_WORDS or b.lower() in WHOLE_WORDS or (len(a) > 4 and a.lower().endswith(("ly", "ed", "ing", "er")))
    return m.group(0) if apart else a + b


@F.pandas_udf(StringType())
def fixed_split_words(text: pd.Series) -> pd.Series:
    """Fragments rejoined; a pair that is left alone still uses up its second word, which no single pattern can say."""
    for rx in _SPLITS:
        text = text.map(lambda t, rx=rx: None if t is None else rx.sub(_joined, t))
    return text


def fixed_joined_words(text: Column) -> Column:
    for p in PREFIXES:
        text = F.regexp_replace(text, rf"(?i)\b({p})([a-z]{{5,}})\b", "$1 $2")
    return F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")


def final_cleanup(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?m)[ \t\r\f\x0B]+$", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_text(text: Column, fix_spacing: bool = True, fix_ocr_chars: bool = True, fix_split_words: bool = True, fix_joined_words: bool = True, remove_page_numbers: bool = True) -> Column:
    steps = ((remove_page_numbers, without_page_numbers), (fix_spacing, fixed_spacing), (fix_ocr_chars, fixed_characters), (fix_split_words, fixed_split_words), (fix_joined_words, fixed_joined_words), (True, final_cleanup))
    for wanted, step in steps:
        text = step(text) if wanted else text
    return text


def ocr_issues(text: Column) -> Column:
    """A struct of five counts."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    words = sum(F.regexp_count(text, F.lit(p)) for p in (rf"(?i)\b[a-z]{{3,}}[{_CONSONANTS}]\s+[aeiouy][a-z]{{2,}}\b", rf"(?i)\b[a-z]{{3,}}[{_VOWELS}]\s+[{_CONSONANTS}][a-z]{{2,}}\b"))
    number = lambda x: x.rlike(r"^\d{1,5}$")
    return F.struct(
        F.regexp_count(text, F.lit(r"\d+\s+\.\s+\d+")).cast("long").alias("spacing_in_numbers"),
        F.regexp_count(text, F.lit(r"(?U)\w[!/\\|]\w")).cast("long").alias("special_chars_in_words"),
        words.cast("long").alias("possible_split_words"),
        F.size(F.filter(lines, number)).cast("long").alias("page_numbers"),
        F.size(F.filter(lines, lambda x: ~number(x) & x.rlike(r"^\d+(\s+\d+){3,}$"))).cast("long").alias("number_clusters"),
    )

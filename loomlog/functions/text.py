"""Text columns: stripping, levels, search predicates, display."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.schema import DEFAULT_LEVEL, LEVEL_ALIASES, LEVELS

# Unicode whitespace; SQL trim() alone removes spaces only.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# Whole-word keywords. The boundary is spelled out because \b changed meaning between JDKs.
_KEYWORD = (
    r"(?i)(?=[DIWECF])(?<![\p{L}\p{N}_])"  # the first letter is the cheapest test
    r"(DEBUG|INFO|WARNING|WARN|ERROR|ERR|CRITICAL|FATAL)"
    r"(?![\p{L}\p{N}_])"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_level(c: Column) -> Column:
    known = {**{level: level for level in LEVELS}, **LEVEL_ALIASES}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(strip(c))), F.lit(DEFAULT_LEVEL))


def level_word(c: Column) -> Column:
    """The first level keyword of the text, empty if there is none."""
    return F.regexp_extract(c, _KEYWORD, 1)


def detect_level(c: Column) -> Column:
    """Level of the first keyword in the text, INFO if there is none."""
    return normalize_level(level_word(c))


def lines(c: Column) -> Column:
    """The lines of a text, whatever ends them; texts with plain newlines skip the regex."""
    unusual = [F.contains(c, F.lit(mark)) for mark in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"]
    return F.when(reduce(Column.__or__, unusual), F.split(c, LINE_BREAK)).otherwise(F.split(c, "\n"))


def blank(c: Column) -> Column:
    return strip(c) == ""


def contains_text(c: Column, q: str) -> Column:
    """Case-insensitive substring; % and _ in the query are plain characters."""
    return F.contains(F.lower(c), F.lower(F.lit(q)))


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def phrase_prefix(c: Column, q: str) -> Column:
    """Query words in a row, the last one possibly cut short. No words: no match."""
    phrase = _words(F.lit(q))
    hit = (phrase != "") & F.contains(F.concat(F.lit(" "), _words(c)), F.concat(F.lit(" "), phrase))
    # Every query word must occur in the text, so one cheap contains() on the longest word
    # spares most rows the regular expression. Only for ASCII, where both sides split alike.
    plain = re.findall(r"[a-z0-9]+", q.lower()) if q.isascii() else []
    if plain:
        hit = F.contains(F.lower(c), F.lit(max(plain, key=len))) & hit
    return hit


def general_number(c: Column) -> Column:
    """A positive double in the shortest form with at most six significant digits."""
    power = F.floor(F.log10(c))
    scale = F.pow(F.lit(10.0), 5 - power)
    short = F.rint(c * scale) / scale
    plain = F.when(short == F.rint(short), short.cast("long").cast("string")).otherwise(
        F.regexp_replace(F.regexp_replace(F.format_number(short, 10), ",", ""), r"\.?0+$", "")
    )
    mantissa = (F.rint(c / F.pow(F.lit(10.0), power - 5)) / 100000).cast("string")
    science = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    return F.when(c == 0, F.lit("0")).when((power >= 6) | (power < -4), science).otherwise(plain)
